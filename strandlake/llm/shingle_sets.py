"""Groups of documents whose word shingles are similar, by ball hashing of SimHashes (SimHash stage of the pipeline).

A single 64-bit SimHash within 4 bits finds nearly identical texts only: at a
Jaccard similarity of 0.8 some 15 % of the bits differ.  So each distinct set
of shingles gets several independently seeded SimHashes, cut into 16 pieces of
24 bits, and sets meet if a piece of theirs differs in at most two bits.  These
are found as in operator 7, by meeting in the middle: a piece emits all words
within one bit of it (its variants), sent by their leading bits; the receiver
writes out the trailing ones.  128 further bits tell which of the sets that
meet are worth a look.  What is linked is verified by the exact similarity
of the shingle sets.  Sets of up to eight shingles differ in too many bits for
that; they are found by name among the small sets that others hold.

The first round looks at each set's nearest other by every piece, so its
rows do not grow with the square of a group.  The second looks at all pairs
that the first has not connected yet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import map_pandas, written
from strandlake.llm.simhash import LOWER, components, flips

#: 64-bit SimHashes for comparing, and those that are cut into pieces.
NEAR, CUT = 2, 6
WORDS = NEAR + CUT
#: Bits of a piece: the leading ones, by which a variant is sent, and the trailing ones.
LEAD, TAIL = 12, 12
PIECE = LEAD + TAIL
PIECES = CUT * 64 // PIECE
#: Two pieces meet if they differ in at most this many bits.
RADIUS = 2
#: Bits that may differ of the NEAR words, and of all: four deviations over the mean of the least similar short texts.
NEAR_BITS, ALL_BITS = 40, 133
#: Groups up to this size are compared by shifting, and rows that are held before they are compared.
SMALL, AT_ONCE = 256, 200_000
SEEDS = np.random.default_rng(42).integers(0, 1 << 64, WORDS, np.uint64)


def shingles(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct XXH64 of the word shingles, in order; a shorter text is one shingle, a blank one none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(len(words) - shingle + 1, 1)
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    ends = starts[np.minimum(np.arange(n) + shingle, len(words))] - 1
    return np.unique(np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)], np.uint64))


def name_of(hashes: np.ndarray) -> int:
    """A set's name, as a signed long."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(hashes.tobytes())).view(np.int64))


def fewer(hashes: np.ndarray) -> list[int]:
    """Names of all sets of up to eight shingles that are held by this one and similar to it (0.8).

    Two such sets differ by one shingle, or by two if they have eight and ten.
    """
    n = len(hashes)
    if 5 <= n <= 9:
        return [name_of(np.delete(hashes, i)) for i in range(n)]
    return [name_of(np.delete(hashes, (i, j))) for i in range(n) for j in range(i)] if n == 10 else []


def sketch(hashes: np.ndarray) -> bytes:
    """The set's SimHashes: a bit is set if it is set in over half of the shingles' hashes of its seed."""
    ones = np.zeros(WORDS * 64, np.int64)
    for at in range(0, len(hashes), 255):  # 255 still fit into a byte
        x = hashes[at : at + 255, None] ^ SEEDS[None, :]
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def sketches(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(id, node, sketch, fewer): equal sets of shingles are one node; ``fewer`` names the small sets that it holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(t, shingle, seed) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "node": np.array([name_of(s) for s in sets], np.int64), "sketch": [sketch(s) for s in sets], "fewer": [fewer(s) for s in sets]})

    return map_pandas(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, node long, sketch binary, fewer array<long>")


def _words(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u8").reshape(len(column), WORDS)


def _pieces(words: np.ndarray) -> np.ndarray:
    cut = np.ascontiguousarray(words[:, NEAR:]).view(np.uint8).reshape(len(words), PIECES, PIECE // 8).astype(np.int64)
    return cut[:, :, 0] | cut[:, :, 1] << 8 | cut[:, :, 2] << 16


def _dealt(nodes: DataFrame, whole: bool) -> DataFrame:
    """The variants of each piece of each node, a row for each way to flip leading bits; ``whole``: with root and sketch.

    ``sent`` holds the number of the piece, the leading bits of the variant and the piece; rows are ordered by it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks = np.array(flips(LEAD, RADIUS // 2), np.int64)
        each = PIECES * len(masks)
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                words = _words(part["sketch"])
                piece = _pieces(words)[:, :, None]
                lead = (np.arange(PIECES) << LEAD)[None, :, None] | piece >> TAIL ^ masks
                out = {"sent": (lead << PIECE | piece).ravel(), "node": np.repeat(part["node"].to_numpy(), each)}
                if whole:
                    out |= {"root": np.repeat(part["root"].to_numpy(), each), "sketch": np.repeat(part["sketch"].to_numpy(), each)}
                else:
                    out |= {f"near{k}": np.repeat(words[:, k].view(np.int64), each) for k in range(NEAR)}
                yield pd.DataFrame(out)

    more = "root long, sketch binary" if whole else ", ".join(f"near{k} long" for k in range(NEAR))
    return map_pandas(nodes, run, f"sent long, node long, {more}").repartition(F.shiftright("sent", PIECE)).sortWithinPartitions("sent")


def _met(rows: DataFrame, find: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What ``find`` names in whole leads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        held, bound = 0, AT_ONCE
        for pdf in batches:
            rest.append(pdf)
            held += len(pdf)
            if held < bound:
                continue
            rows = pd.concat(rest, ignore_index=True)
            lead = rows["sent"].to_numpy() >> PIECE
            done = int(np.searchsorted(lead, lead[-1]))  # all but the last lead are complete
            if done:
                yield find(rows[:done])
            rest, held = [rows[done:]], len(rows) - done
            bound = max(AT_ONCE, 2 * held)
        if rest:
            yield find(pd.concat(rest, ignore_index=True))

    return map_pandas(rows, run, schema)


def _runs(leads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], leads[1:] != leads[:-1]])) if len(leads) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(leads)))


def _own(met: np.ndarray) -> np.ndarray:
    """Whether the variant is the piece itself."""
    return (met >> PIECE ^ met) & ((1 << PIECE) - 1) == 0


def _variants(sent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The variants that rows meet in: number of the row and (variant, piece), ordered by it; start and size of each variant's group.

    Equal pieces share all their variants; they are compared at the piece itself only, so groups without other pairs are left out.
    """
    lead, piece = sent >> PIECE, sent & ((1 << PIECE) - 1)
    calm = (lead & ((1 << LEAD) - 1)) == piece >> TAIL  # no leading bit is flipped: a trailing one may be
    head = lead << TAIL | piece & ((1 << TAIL) - 1)
    masks = np.array(flips(TAIL, RADIUS // 2), np.int64)
    row = np.concatenate([np.repeat(np.flatnonzero(calm), len(masks)), np.flatnonzero(~calm)])
    met = np.concatenate([(head[calm][:, None] ^ masks).ravel(), head[~calm]]) << PIECE | piece[row]
    order = np.argsort(met)
    row, met = row[order], met[order]
    first, size = _runs(met >> PIECE)
    some = np.repeat((size > 1) & ((met[first] != met[first + size - 1]) | _own(met[first])), size)
    row, met = row[some], met[some]
    return row, met, *_runs(met >> PIECE)


def _shifted(met: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the small groups, by distance: none has a place twice on one side."""
    after = np.repeat(first + size, size) - np.arange(len(met)) - 1
    small = np.flatnonzero(np.repeat(size <= SMALL, size))
    own = _own(met)
    for d in range(1, SMALL):
        small = small[after[small] >= d]
        if not len(small):
            break
        i = small[own[small] | (met[small] != met[small + d])]
        yield i, i + d


def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Every node with the nearest other under each variant, if that is near, the bits that differ, and the number of the piece."""
    row, met, first, size = _variants(pdf["sent"].to_numpy())
    node = pdf["node"].to_numpy()[row]
    near = [pdf[f"near{k}"].to_numpy().view(np.uint64)[row] for k in range(NEAR)]
    best, other = np.full(len(node), 255, np.uint8), np.zeros(len(node), np.int64)
    for a, b in _shifted(met, first, size):
        far = sum(np.bitwise_count(x[a] ^ x[b]) for x in near)
        for i, j in ((a, b), (b, a)):
            less = far < best[i]
            best[i[less]], other[i[less]] = far[less], j[less]
    for s, z in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        start, count = _runs(met[s : s + z])
        for at, to in zip((s + start).tolist(), (s + start + count).tolist(), strict=True):  # a piece against those after it, and itself
            own = bool(_own(met[at]))
            left = at if own else to
            if left == s + z:
                continue
            step = max(1, 4_000_000 // (s + z - left))
            for i in range(at, to, step):
                mine = np.arange(i, min(i + step, to))
                far = sum(np.bitwise_count(x[mine, None] ^ x[None, left : s + z]) for x in near)
                if own:
                    far[np.arange(len(mine)), mine - left] = 255
                k = far.argmin(axis=1)
                least = far[np.arange(len(mine)), k]
                less = least < best[mine]
                best[mine[less]], other[mine[less]] = least[less], left + k[less]
                k = far.argmin(axis=0)
                least = far[k, np.arange(s + z - left)]
                less = np.flatnonzero(least < best[left : s + z])
                best[left + less], other[left + less] = least[less], i + k[less]
    close = best <= NEAR_BITS
    return pd.DataFrame({"node": node[close], "piece": (met[close] >> 2 * PIECE).astype(np.int32), "far": best[close].astype(np.int32), "other": node[other[close]]})


def nearest_pairs(nodes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b): every node with the nearest of those it meets by each of its pieces."""
    met = _met(_dealt(nodes, False), nearest, "node long, piece int, far int, other long")
    best = met.groupBy("node", "piece").agg(F.min(F.struct("far", "other")).alias("best"))
    return best.select(F.least("node", "best.other").alias("a"), F.greatest("node", "best.other").alias("b")).distinct()


def apart(pdf: pd.DataFrame) -> pd.DataFrame:
    """All pairs (a, b) of near nodes with different roots, each at the first piece by which the two meet."""
    row, met, first, size = _variants(pdf["sent"].to_numpy())
    node, root = pdf["node"].to_numpy()[row], pdf["root"].to_numpy()[row]
    words = _words(pdf["sketch"])
    pieces, near = _pieces(words), [words[row, k] for k in range(NEAR)]
    a, b = [node[:0]], [node[:0]]

    def add(i: np.ndarray, j: np.ndarray) -> None:
        for c in range(0, len(i), 100_000):
            m, n = i[c : c + 100_000], j[c : c + 100_000]
            x, y = row[m], row[n]
            close = np.bitwise_count(words[x] ^ words[y]).sum(axis=1) <= ALL_BITS
            close &= (np.bitwise_count(pieces[x] ^ pieces[y]) <= RADIUS).argmax(axis=1) == met[m] >> 2 * PIECE
            a.append(node[m[close]])
            b.append(node[n[close]])

    for i, j in _shifted(met, first, size):
        differ = root[i] != root[j]
        i, j = i[differ], j[differ]
        close = sum(np.bitwise_count(x[i] ^ x[j]) for x in near) <= NEAR_BITS
        add(i[close], j[close])
    for s, z in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        roots, of, count = np.unique(root[s : s + z], return_inverse=True, return_counts=True)
        rest = s + np.flatnonzero(of != count.argmax())  # pairs of different roots have one that is not the most frequent
        step = max(1, 4_000_000 // z)
        for at in range(0, len(rest), step):
            mine = rest[at : at + step]
            far = sum(np.bitwise_count(x[mine, None] ^ x[None, s : s + z]) for x in near)
            i, j = np.nonzero((far <= NEAR_BITS) & (root[mine, None] != root[None, s : s + z]))
            i, j = mine[i], s + j
            once = (met[i] != met[j]) | _own(met[i])
            add(i[once], j[once])
    x, y = np.concatenate(a), np.concatenate(b)
    return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, seed: int, least: float) -> DataFrame:
    """The pairs whose sets of shingles are similar.

    A node's text is that of its smallest id; where an id is repeated with
    other texts, those have other names and are passed over.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, np.ndarray]] = {}

        def of(text: str | None) -> tuple[int, np.ndarray]:
            if (found := known.get(text or "")) is None:
                if len(known) >= 2000:
                    known.clear()
                found = shingles(text, shingle, seed)
                found = known[text or ""] = (name_of(found), found)
            return found

        for pdf in batches:
            good = []
            for a, b, s, t in zip(pdf["a"], pdf["b"], pdf["text_a"], pdf["text_b"], strict=True):
                (m, x), (n, y) = of(s), of(t)
                both = len(np.intersect1d(x, y, assume_unique=True)) if m == a and n == b else -1
                good.append(both >= 0 and both >= least * (len(x) + len(y) - both))
            yield pdf.loc[good, ["a", "b"]]

    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = docs.join(nodes.join(wanted, "node").select(F.col("least").alias("id"), "node"), "id").select("node", "text")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return map_pandas(both.select("a", "b", "text_a", "text_b"), run, "a long, b long").distinct()


def similar_groups(docs: DataFrame, shingle: int = 5, seed: int = 42, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id`` and ``component_id``: the smallest id connected with it by pairs of similar sets of shingles."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = written(sketches(docs, shingle, seed), "sketches")
    nodes = written(rows.groupBy("node").agg(F.min("id").alias("least"), F.first("sketch").alias("sketch"), F.first("fewer").alias("fewer")), "sketch-nodes")
    held = nodes.select(F.col("node").alias("other"), F.explode("fewer").alias("node")).join(nodes.select("node"), "node")
    held = held.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    nodes = nodes.drop("fewer")
    pairs = written(nearest_pairs(nodes).unionByName(held).distinct(), "near-pairs")
    links = written(verified(pairs, nodes, docs, shingle, seed, least), "near-links")
    roots = written(components(links), "near-roots")
    seen = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    named = nodes.join(seen, "node").join(roots, "node", "left").select("node", "sketch", F.coalesce("root", "node").alias("root"))
    further = written(_met(_dealt(named, True), apart, "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti"), "further-pairs")
    more = written(verified(further, nodes, docs, shingle, seed, least), "further-links")
    if not more.isEmpty():
        roots = written(components(links.unionByName(more)), "near-roots")
    placed = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("id", "node").join(placed.select("node", "root").join(lowest, "root"), "node").select("id", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, seed: int = 42, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with all its columns: the one with the smallest id.

    Of rows that repeat an id one stays.  Rows without an id cannot be told
    apart and all stay.  Null texts, and texts without a word, have the same
    (empty) set of shingles: they are one group, of which one row stays.  An
    empty table stays empty; other columns may have any names.
    """
    named = docs.where(F.col(id_col).isNotNull())
    kept = similar_groups(named, shingle, seed, least, id_col, text_col).where("id = component_id").select("id").distinct()
    rows = named.select(F.col(id_col).alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.join(kept, "id", "left_semi").dropDuplicates(["id"]).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
    return rows.unionByName(docs.where(F.col(id_col).isNull()))
