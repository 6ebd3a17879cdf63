"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 7).

Two 64-bit fingerprints differ in at most r bits exactly if some 64-bit word
lies within r/2 bits of both.  So every distinct fingerprint emits all words
within r/2 bits (its variants), and fingerprints that meet in a variant are
linked.  A variant is sent as its leading bits, the fingerprint and the number
of flips that are left; the receiver writes out the trailing bits.  That is
the same set of variants with a fifteenth of the shuffled rows.

All members of a variant's group are within r of each other, so a star to the
smallest member keeps every connection without writing all pairs; each link is
verified once more.  Components come from alternating large and small stars.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import map_pandas, written

BITS = 64
#: Leading bits of a variant by which it is sent, and further ones for crowded leads (together they come to all bits).
LEAD, MORE = 16, 12
#: A lead with more messages than this is dealt out by further bits.
CROWD = 20_000
#: Variants that a task writes out and sorts at once, if no single group is larger.
AT_ONCE = 4_000_000
UPPER = bytes(range(65, 91))
LOWER = bytes.maketrans(UPPER, UPPER.lower())


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Bit b is set if it is set in over half of the XXH64 of the text's word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(LOWER).split()  # bytes.split: space and 9-13
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), (starts[shingle : shingle + n] - 1).tolist(), strict=True)]
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(n, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 4096):
        ones += np.unpackbits(raw[at : at + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed long; null and blank texts have 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in pdf["text"]], np.uint64)
            yield pd.DataFrame({"id": pdf["id"], "fp": fps.view(np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    return map_pandas(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, fp long")


def flips(width: int, at_most: int) -> list[int]:
    """All masks of ``width`` bits with up to ``at_most`` ones."""
    return [sum(1 << b for b in c) for k in range(at_most + 1) for c in combinations(range(width), k)]


def _sent(fps: DataFrame, half: int, shift: int, width: int, lead: Column, left: Column) -> DataFrame:
    """One row for each way to flip bits [shift, shift + width) with the flips that are left."""
    masks = F.array(*(F.lit(m) for m in flips(width, half)))
    rows = fps.select("fp", lead.alias("lead"), left.alias("left"), F.explode(masks).alias("mask"))
    rows = rows.where(F.bit_count("mask") <= F.col("left"))
    here = F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1).bitwiseXOR(F.col("mask"))
    key = F.shiftleft("lead", width).bitwiseOR(here)
    return rows.select("fp", key.cast("long").alias("lead"), (F.col("left") - F.bit_count("mask")).cast("int").alias("left"))


def _tails(width: int, half: int) -> list[np.ndarray]:
    """By flips left: the masks of the trailing bits."""
    return [np.array(flips(width, k), np.uint64) for k in range(half + 1)]


def _stars(fps: np.ndarray, left: np.ndarray, leads: np.ndarray, width: int, half: int, tails: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest member) of the groups that meet in a variant, distinct."""
    low = np.uint64((1 << width) - 1)
    variants, owners = [], []
    for k in range(half + 1):
        mine = np.flatnonzero(left == k)
        if len(mine):
            head = leads[mine].astype(np.uint64) << np.uint64(width)
            variants.append(((head | (fps[mine] & low))[:, None] ^ tails[k][None, :]).ravel())
            owners.append(np.repeat(mine.astype(np.int32), len(tails[k])))
    if not variants:
        return fps[:0], fps[:0]
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variant)
    variant, owner = variant[order], fps[owner[order]]
    first = np.flatnonzero(np.concatenate([[True], variant[1:] != variant[:-1]]))
    size = np.diff(np.append(first, len(variant)))
    met = size > 1
    first, size = first[met], size[met]
    if not len(first):
        return fps[:0], fps[:0]
    at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    hub = np.repeat(np.minimum.reduceat(owner[at], np.concatenate([[0], np.cumsum(size)[:-1]])), size)
    pairs = np.stack([owner[at], hub], axis=1)
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    return pairs[:, 0], pairs[:, 1]


def _meet(messages: DataFrame, width: int, half: int, radius: int) -> DataFrame:
    """Links (a, b) of the fingerprints that share a lead, from their written-out variants."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tails = _tails(width, half)
        weight = np.array([len(t) for t in tails])

        def links(pdf: pd.DataFrame) -> pd.DataFrame:
            fps = pdf["fp"].to_numpy().view(np.uint64)
            left, leads = pdf["left"].to_numpy(), pdf["lead"].to_numpy()
            a, b = _stars(fps, left, leads, width, half, tails)
            near = np.bitwise_count(a ^ b) <= radius  # verified; always so
            return pd.DataFrame({"a": a[near].view(np.int64), "b": b[near].view(np.int64)})

        rest: list[pd.DataFrame] = []
        held = 0
        for pdf in batches:
            rest.append(pdf)
            held += int(weight[pdf["left"].to_numpy()].sum())
            if held < AT_ONCE:
                continue
            all_rows = pd.concat(rest)  # rows come ordered by lead: all but the last lead are complete
            done = (all_rows["lead"] != all_rows["lead"].iloc[-1]).to_numpy()
            if done.any():
                yield links(all_rows[done])
            rest = [all_rows[~done]]
            held = int(weight[rest[0]["left"].to_numpy()].sum())
        if rest:
            yield links(pd.concat(rest))

    return map_pandas(messages.repartition("lead").sortWithinPartitions("lead"), run, "a long, b long")


def ball_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints at most ``radius`` bits apart; they connect all that are.

    Crowded leads (many fingerprints alike in their leading bits) are found by
    counting and dealt out by 12 further bits, again and again until a lead is
    calm or all bits are used; then its group is one variant, with no more
    fingerprints than lie within half the radius of it.
    """
    half = radius // 2
    if radius % 2:
        raise ValueError("the radius must be even")
    rest = BITS - LEAD
    sent = _sent(fps, half, rest, LEAD, F.lit(0).cast("long"), F.lit(half))
    found = []
    while True:
        crowded = written(sent.groupBy("lead").count().where(F.col("count") > CROWD).select("lead"), "crowded-leads") if rest else None
        if crowded is None or crowded.isEmpty():
            found.append(_meet(sent, rest, half, radius))
            break
        found.append(_meet(sent.join(crowded, "lead", "left_anti"), rest, half, radius))
        rest -= MORE
        sent = _sent(sent.join(crowded, "lead", "left_semi"), half, rest, MORE, F.col("lead"), F.col("left"))
    return reduce(DataFrame.unionByName, found).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches.

    Alternating stars: every node's larger neighbours, then its smaller ones,
    are linked to its smallest neighbour, until nothing changes.  Each round is
    two shuffles and is written to the shared folder.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small_star = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small_star.where("u <> v").distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
        before = state


def near_duplicates(docs: DataFrame, shingle: int = 4, seed: int = 42, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``fingerprint`` (hex) and ``component_id``, the smallest id it is linked with.

    Links hold between rows whose fingerprints differ in at most ``radius``
    bits; blank and null texts have fingerprint zero and are linked like any
    other.  Rows with equal fingerprints are one node, so a group of copies of
    any size is one row until the end.  Null ids are never the smallest (a
    component of null ids only has a null id); repeated rows give a row each;
    other columns are not looked at.
    """
    rows = written(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-nodes")
    roots = written(components(ball_links(nodes.select("fp"), radius)), "roots")
    # fp -> root -> smallest id under the root
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    place = placed.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    out = rows.join(place, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, seed: int = 42, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with all its columns: the one with the smallest id.

    The kept ids are joined with the rows; of rows that repeat an
    id one stays.  Rows without an id cannot be told apart and all stay.
    """
    named = docs.where(F.col(id_col).isNotNull())
    found = near_duplicates(named, shingle, seed, radius, id_col, text_col)
    kept = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__kept")).distinct()
    rows = named.join(kept, F.col(id_col) == F.col("__kept"), "left_semi").dropDuplicates([id_col])
    return rows.unionByName(docs.where(F.col(id_col).isNull()))
