"""Prefix trie of conversations with composable fingerprints (operator 11).

Every conversation is rebuilt from the head of its base conversation and its
own turns after that head.  The rebuilt texts are never put together: a
sequence of turns is an element (length, fingerprint) of the monoid

    (n, f) * (m, g) = (n + m, f + B^n g)    modulo four primes,

a turn t alone being (1, t B).  Running products of all stored conversations
give, by one subtraction, the product of any part of one, and a rebuilt prefix
is the product of a stored head and a stored part.  A row of a rebuilt
conversation holds its depth, that product and a reference to a stored turn.

Rows of equal (depth, fingerprint) are a node of the trie.  That they really
are equal is verified: all rows of a node must have the same parent node and
refer to turns of the same key, and turns of the same key are read again and
compared whole.  If anything differs, all is done again with another base.

Sums over subtrees need no walk over levels: a node is represented by its
smallest member, so what stands below a node is what its members represent at
its depth or deeper, a running sum along each conversation.
"""

from __future__ import annotations

import hashlib
import itertools
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import ship, written
from strandlake.operators.scans import scanned, total

#: The four largest primes under 2^31.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
#: Moduli and seed of each attempt.
ATTEMPTS = tuple((PRIMES, seed) for seed in range(1, 6))
#: A head has fewer turns than this.
HEADS = 6
#: Turns of a conversation in one cell of a running sum, and ids in a piece of a list.
CELL, PIECE = 4096, 4096
LANES = range(len(PRIMES))


class Monoid:
    """Fingerprints of turn sequences as expressions over four columns."""

    def __init__(self, primes: tuple[int, ...], seed: int):
        rng = random.Random(seed)
        self.primes, self.seed = primes, seed
        self.bases = [1 if p < 4 else rng.randrange(p // 3, p - 1) for p in primes]

    def key(self) -> tuple[Column, Column]:
        """128 bits of a turn's role and text."""
        return F.xxhash64("role", "text", F.lit(self.seed)), F.xxhash64(F.lit(self.seed), "role", "text")

    def turn(self, k: int) -> Column:
        """A turn's number in lane k, from columns key_a and key_b."""
        c = F.col("key_a" if k < 2 else "key_b")
        return F.pmod(F.shiftrightunsigned(c, 33) if k % 2 else c.bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(self.primes[k]))

    def power(self, k: int, exponent: Column) -> Column:
        """Base to the exponent, by its binary digits."""
        p, squares = self.primes[k], [self.bases[k] % self.primes[k]]
        for _ in range(62):
            squares.append(squares[-1] ** 2 % p)
        table, digits = F.array(*map(F.lit, map(int, squares))).cast("array<bigint>"), F.split(F.reverse(F.bin(exponent)), "")
        return F.aggregate(F.zip_with(F.filter(digits, lambda x: x != ""), F.slice(table, 1, F.greatest(F.length(F.bin(exponent)), F.lit(1))), lambda x, y: F.when(x == "1", y).otherwise(F.lit(1).cast("long"))), F.lit(1).cast("long"), lambda a, y: a * y % p)

    def compose(self, k: int, head: Column, upto: Column, start: Column, back: Column) -> Column:
        """Product of a head and a part of stored turns that moves ``back`` places towards the front (under HEADS)."""
        p = self.primes[k]
        inverse = pow(self.bases[k], -1, p) if p > 1 else 0
        table = F.array(*(F.lit(inverse**i % p).cast("long") for i in range(HEADS)))
        return F.pmod(head + F.pmod(upto - start, F.lit(p)) * F.get(table, back), F.lit(p))


def _pack(lane: list[Column]) -> tuple[Column, Column]:
    return F.shiftleft(lane[0], 31).bitwiseOR(lane[1]), F.shiftleft(lane[2], 31).bitwiseOR(lane[3])


def _stored(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of turns that belong to a conversation; null roles and texts are empty."""
    rows = conversations.where(F.col("conv_id").isNotNull())
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _products(conversations: DataFrame, m: Monoid) -> DataFrame:
    """Stored turns without their texts: place (from 1), running product with (p) and without (q) the turn, key, length.

    Turns are put in order by range, so that one long conversation is dealt
    over many tasks; the scan then works by conversation and range.
    """
    a, b = m.key()
    rows = _stored(conversations).select("conv_id", "turn", "role", F.xxhash64("text").alias("tie"), a.alias("key_a"), b.alias("key_b"), F.length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))
    order = ["turn", "role", "tie", "row"]
    rows = written(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "trie-turns")
    rows = scanned(rows, ["conv_id"], order, F.col("part"), stored=True, place=total()).drop("role", "tie")
    rows = rows.withColumns({f"t{k}": m.turn(k) * m.power(k, F.col("place")) % m.primes[k] for k in LANES})
    rows = scanned(rows, ["conv_id"], ["place"], F.floor(F.col("place") / CELL), **{f"p{k}": total(F.col(f"t{k}")) for k in LANES})
    p = {f"p{k}": F.col(f"p{k}") % m.primes[k] for k in LANES}
    return written(rows.withColumns(p | {f"q{k}": F.pmod(p[f"p{k}"] - F.col(f"t{k}"), F.lit(m.primes[k])) for k in LANES}).drop("part", "turn", "row", *(f"t{k}" for k in LANES)), "trie-products")


def rebuilt(products: DataFrame, m: Monoid) -> DataFrame:
    """Rows (conv_id, depth, length, node f/g, parent f/g, key, chars, reference) of all rebuilt conversations, depth 0 included."""
    head_turns = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEADS)).cast("int")
    lanes = lambda x: F.array(*(F.col(f"{x}{k}") for k in LANES))
    at_head = F.max(F.when(F.col("place") == head_turns, lanes("p"))).alias("start")
    convs = products.groupBy("conv_id").agg(F.count("*").alias("n"), at_head).withColumn("h", head_turns)
    entry = F.struct("place", lanes("p").alias("p"), lanes("q").alias("q"), "key_a", "key_b", "chars", F.col("conv_id").alias("ref"))
    heads = products.where((F.col("conv_id") % 100 == 0) & (F.col("place") < HEADS)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(entry)).alias("head"))
    zero = F.array(*[F.lit(0).cast("long") for _ in LANES])
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(heads, "base", "left")
    convs = convs.withColumn("head", F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.array()), 1, F.greatest("h", F.lit(1)))).otherwise(F.array())).withColumn("k", F.size("head"))
    top = F.when(F.col("k") > 0, F.element_at("head", F.greatest("k", F.lit(1)))["p"]).otherwise(zero)
    convs = written(convs.select("conv_id", "h", "k", "head", top.alias("top"), F.coalesce("start", zero).alias("start"), (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-conversations")

    def row(depth: Column, own: list[Column] | None, parent: list[Column] | None, key, chars: Column, ref: Column, place: Column) -> list[Column]:
        f, g = _pack(own) if own else (F.lit(0).cast("long"),) * 2
        pf, pg = _pack(parent) if parent else (F.lit(None).cast("long"),) * 2
        return [F.col("conv_id"), depth.cast("long").alias("depth"), F.col("length").cast("long").alias("length"), f.alias("f"), g.alias("g"), pf.alias("pf"), pg.alias("pg"), key("key_a"), key("key_b"), chars.alias("chars"), ref.alias("ref_conv_id"), place.cast("long").alias("ref_place")]

    none = F.lit(None).cast("long")
    roots = convs.select(*row(F.lit(0), None, None, none.alias, F.lit(0).cast("long"), none, none))
    first = convs.select("conv_id", "length", F.explode("head").alias("e"))
    of = lambda x: [F.get(F.col(f"e.{x}"), F.lit(k)) for k in LANES]
    first = first.select(*row(F.col("e.place"), of("p"), of("q"), lambda c: F.col(f"e.{c}").alias(c), F.col("e.chars"), F.col("e.ref"), F.col("e.place")))
    own = products.join(convs.drop("head"), "conv_id").where(F.col("place") > F.col("h"))
    back = F.col("h") - F.col("k")
    made = lambda x: [m.compose(k, F.get("top", F.lit(k)), F.col(f"{x}{k}"), F.get("start", F.lit(k)), back) for k in LANES]
    own = own.select(*row(F.col("place") - back, made("p"), made("q"), F.col, F.col("chars"), F.col("conv_id"), F.col("place")))
    return roots.unionByName(first).unionByName(own)


NODE = ["depth", "f", "g"]


def _grouped(rows: DataFrame) -> DataFrame:
    """Nodes with their smallest member, and ``mixed``: rows that can't be the same sequence."""
    sign = F.struct("pf", "pg", "key_a", "key_b", "chars")
    found = rows.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min(F.struct("conv_id", "ref_conv_id", "ref_place")).alias("first"), F.min(sign).alias("sign"), F.max(sign).alias("other"))
    return found.select(*NODE, "n_convs", "first.*", F.col("sign.pf").alias("pf"), F.col("sign.pg").alias("pg"), F.col("sign.chars").alias("chars"), (~F.col("sign").eqNullSafe(F.col("other"))).alias("mixed"))


def _different_texts(conversations: DataFrame, products: DataFrame, m: Monoid) -> DataFrame:
    """Keys of several stored turns whose roles and texts, read again, are not all the same."""
    several = products.groupBy("key_a", "key_b").agg(F.count("*").alias("turns")).where("turns > 1").select("key_a", "key_b")
    a, b = m.key()
    said = F.struct("role", "text")
    again = _stored(conversations).select(a.alias("key_a"), b.alias("key_b"), said.alias("said")).join(several, ["key_a", "key_b"], "left_semi")
    return again.groupBy("key_a", "key_b").agg(F.min("said").alias("lo"), F.max("said").alias("hi")).where("lo <> hi")


def _ends(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256): digest of the ids of conversations that end at a node, in order, joined by commas.

    Ids are ordered by range and joined to pieces there; the pieces of a node,
    some ten thousand times fewer than its ids, then run through one digest,
    which cannot be split, as a stream.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, f, g, c = (batch[x].to_pylist() for x in (*NODE, "conv_id"))
            out: dict[str, list] = {x: [] for x in (*NODE, "least", "ids")}
            for node, run in itertools.groupby(range(len(c)), lambda i: (d[i], f[i], g[i])):  # noqa: B023
                run = list(run)
                for i in range(0, len(run), PIECE):
                    part = run[i : i + PIECE]
                    for x, v in zip(out, (*node, c[part[0]], ",".join(str(c[j]) for j in part)), strict=True):
                        out[x].append(v)
            yield pa.RecordBatch.from_pydict({x: pa.array(v, pa.string() if x == "ids" else pa.int64()) for x, v in out.items()})

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        done = lambda pairs: pa.RecordBatch.from_pydict({x: pa.array([n[i] for n, _ in pairs], pa.int64()) for i, x in enumerate(NODE)} | {"ends_sha256": pa.array([s for _, s in pairs], pa.string())})
        for batch in batches:
            out = []
            for d, f, g, ids in zip(*(batch[x].to_pylist() for x in (*NODE, "ids")), strict=True):
                if (d, f, g) != now:
                    if now:
                        out.append((now, state.hexdigest()))
                    now, state = (d, f, g), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield done(out)
        if now:
            yield done([(now, state.hexdigest())])

    ends = rows.where("depth = length").select(*NODE, "conv_id")
    ends = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    joined = ends.mapInArrow(pieces, "depth long, f long, g long, least long, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "least").mapInArrow(digests, "depth long, f long, g long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, attempts=ATTEMPTS) -> DataFrame:
    """The nodes of the trie of rebuilt conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, and the stored turn that
    the node's last turn is a reference to (ref_conv_id, ref_place; null for
    the root).

    Turns of a conversation are in the order of ``turn`` (null first), then
    role, then a hash of the text, so repeated rows are turns one after
    another.  Rows without a conversation take no part; null roles and texts
    are empty.  A base without turns gives an empty head.  An empty table gives
    no rows, not even a root.  Other columns are not looked at.
    """
    ship(conversations.sparkSession)
    for primes, seed in attempts:
        m = Monoid(primes, seed)
        products = _products(conversations, m)
        rows = written(rebuilt(products, m), "trie-rows")
        nodes = written(_grouped(rows), "trie-nodes")
        if nodes.where("mixed").isEmpty() and _different_texts(conversations, products, m).isEmpty():
            return _measured(rows, nodes)
    raise RuntimeError("fingerprints of different prefixes were the same in every attempt")


def _measured(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pf").alias("f"), F.col("pg").alias("g")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-children")
    # What a node adds to all nodes above it, at its smallest member.
    own = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("w"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    paths = rows.select("conv_id", *NODE).join(own, ["conv_id", "depth"], "left").withColumn("up", -F.col("depth"))
    paths = scanned(paths, ["conv_id"], ["up"], F.floor(F.col("up") / CELL), below=total(F.col("w")), leaves=total(F.col("leaf")))
    sums = paths.groupBy(*NODE).agg(F.sum("below").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f").alias("pf"), F.col("g").alias("pg"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, NODE).join(_ends(rows), NODE, "left").join(parents, ["depth", "pf", "pg"], "left")
    none = hashlib.sha256().hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), "ref_conv_id", "ref_place")
