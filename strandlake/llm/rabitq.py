"""Nearest neighbours by randomly rotated one-bit codes (operator 3).

A vector is centred, rotated at random and kept as the signs of its components,
with two correction scalars: its length and the inner product f of the unit
vector with its code.  The bits then estimate any inner product, with an error
of at most length * |q| * sqrt((1 - f^2) / f^2) * eps / sqrt(D - 1) with high
probability.  Vectors whose upper bound reaches the k-th best exact product
seen are reranked with their original components; the others are passed over.

All rows are indexed and every query meets every row, block by block: the
work is one pair of blocks a task, whatever the sizes.  Equal vectors are one
entry with their smallest ids, so a vector that a third of the rows hold costs
no more than another.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.llm.common import ship, written

#: Rows of a block at most, and bytes of a block's vectors (so long vectors make smaller blocks): one of rows is copied for each of queries.
ROW_BLOCK, ROW_BYTES, QUERY_BYTES = 16_384, 1 << 27, 1 << 25
#: Rows (chosen by hash) on which the centre is fitted.
CENTRE_ROWS = 100_000
#: Candidates that are always scored first, and queries that are estimated at once.
FIRST, AT_ONCE = 64, 128


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, length of the centred vector, and f."""
    rest = vectors - centre
    length = np.linalg.norm(rest, axis=1)
    unit = rest / np.where(length, length, 1)[:, None] @ turn.T
    return np.packbits(unit > 0, axis=1), length, np.abs(unit).sum(axis=1) / math.sqrt(vectors.shape[1])


def estimate(queries: np.ndarray, bits: np.ndarray, length: np.ndarray, f: np.ndarray, centre: np.ndarray, turn: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (query by row) and the error bound of each row for a query of length 1."""
    dim = len(centre)
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    scale = np.where(length > 0, length / np.where(f > 0, f, 1), 0)
    products = (queries @ turn.T).astype(np.float32) @ signs.T / math.sqrt(dim)
    bound = scale * np.sqrt(np.clip(1 - f * f, 0, None)) * eps / math.sqrt(max(dim - 1, 1))
    return products * scale + (queries @ centre)[:, None], bound


def search_block(queries: np.ndarray, rows: np.ndarray, bits: np.ndarray, length: np.ndarray, f: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int, centre: np.ndarray, turn: np.ndarray, eps: float) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each query its k best rows of the block, ties to the one with the least id: (query number, ids, least ids, exact products)."""
    out = []
    exact = lambda q, at: (rows[at] * q).sum(axis=1)
    for start in range(0, len(queries), AT_ONCE):
        some = queries[start : start + AT_ONCE]
        about, bound = estimate(some, bits, length, f, centre, turn, eps)
        for i, q in enumerate(some):
            at = np.arange(len(rows))
            if len(rows) > max(FIRST, k):
                first = np.argpartition(-about[i], FIRST)[: max(FIRST, k)]
                reach = np.partition(exact(q, first), -k)[-k]
                at = np.flatnonzero(about[i] + bound * np.linalg.norm(q) + 1e-5 >= reach)
                at = np.union1d(at, first)
            scores = exact(q, at)
            best = np.lexsort((ids[at], least[at], -scores))[:k]
            out.append((start + i, ids[at[best]], least[at[best]], scores[best]))
    return out


def blocks(n_rows: int, n_queries: int, dim: int) -> tuple[int, int]:
    """The numbers of row and query blocks."""
    held = lambda size: max(1, size // (8 * dim))
    return max(1, math.ceil(n_rows / min(ROW_BLOCK, held(ROW_BYTES)))), max(1, math.ceil(n_queries / held(QUERY_BYTES)))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(row, id, vector) of the rows that take part, written; ``row`` tells rows apart that repeat an id.

    Rows without an id, and vectors that are null, zero, or hold a null or a
    non-finite component, do not.
    """
    e = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & e.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(e, lambda x: x != 0))
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "id", "vector"), "vectors")


def build_index(rows: DataFrame, k: int, seed: int = 5) -> tuple[DataFrame, dict]:
    """Every distinct vector: smallest row ``vid``, its ``ids`` (the k smallest, with their rows), code and scalars; and the model."""
    place = F.row_number().over(W.partitionBy("vector").orderBy("id", "row"))
    few = rows.withColumn("place", place).where(F.col("place") <= k).groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("id", "row"))).alias("ids"))
    few = written(few.withColumn("vid", F.array_min(F.transform("ids", lambda x: x["row"]))), "distinct-vectors")
    share = F.pmod(F.xxhash64("vid"), F.lit(1_000_000)) < math.ceil(1e6 * CENTRE_ROWS / max(few.count(), 1))
    dim = few.select(F.size("vector")).first()[0]
    means = few.where(share).select(F.posexplode("vector").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m")).orderBy("at").collect()
    model = {"centre": np.array([r["m"] for r in means]) if means else np.zeros(dim), "turn": rotation(dim, seed)}

    def coded(batches):
        for pdf in batches:
            bits, length, f = encode(np.stack(pdf["vector"]), model["centre"], model["turn"])
            yield pdf.assign(code=[b.tobytes() for b in bits], length=length, f=f)

    ship(rows.sparkSession)
    index = few.mapInPandas(coded, "vector array<double>, ids array<struct<id:long,row:long>>, vid long, code binary, length double, f double")
    return written(index, "rabitq-index"), model


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, eps: float = 3.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of largest inner product for each row whose id is divisible by ``every``, that row itself left out.

    Columns query_id, rank, vec_id, score.  Fewer than k candidates give all of
    them; ties go to the smaller id.  Rows that repeat an id are queries and
    candidates each.  A query meets the vectors of its own length; every length
    is an index of its own.  An empty table gives an empty result.
    """
    rows = usable(vectors, id_col, vector_col)
    lengths = [r[0] for r in rows.groupBy(F.size("vector")).count().orderBy(F.size("vector")).collect()]
    parts = [_nearest(rows.where(F.size("vector") == n), every, k, eps) for n in lengths]
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, parts) if parts else empty


def _nearest(found: DataFrame, every: int, k: int, eps: float) -> DataFrame:
    """The same over vectors (row, id, vector) of one length."""
    index, model = build_index(found, k + 1)
    asked = found.where(F.col("id") % every == 0).select(F.col("row").alias("query_row"), F.col("id").alias("query_id"), "vector")
    asked = written(asked.join(index.select("vector", "vid"), "vector").select("query_row", "query_id", "vid"), "queries")
    n_rows, n_queries = index.count(), asked.select("vid").distinct().count()
    row_blocks, query_blocks = blocks(n_rows, n_queries, len(model["centre"]))
    block = lambda c, n, salt: F.pmod(F.xxhash64(F.lit(salt), c), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = index.select("vid", F.col("ids")[0]["id"].alias("least"), "vector", "code", "length", "f", block(F.col("vid"), row_blocks, 1).alias("rb"), copies(query_blocks).alias("qb"))
    queries = index.join(asked.select("vid").distinct(), "vid", "left_semi").select(F.col("vid").alias("asked"), F.col("vector").alias("query"), block(F.col("vid"), query_blocks, 2).alias("qblock"), copies(row_blocks).alias("rblock"))

    def meet(qs: pd.DataFrame, rs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(rs):
            return pd.DataFrame({"vid": [], "other": [], "least": [], "score": []}).astype({"vid": "int64", "other": "int64", "least": "int64"})
        dim = len(model["centre"])
        bits = np.frombuffer(b"".join(rs["code"]), np.uint8).reshape(len(rs), (dim + 7) // 8)
        found = search_block(np.stack(qs["query"]), np.stack(rs["vector"]), bits, rs["length"].to_numpy(), rs["f"].to_numpy(), rs["vid"].to_numpy(), rs["least"].to_numpy(), k + 1, model["centre"], model["turn"], eps)
        vids = qs["asked"].to_numpy()
        return pd.DataFrame({
            "vid": np.concatenate([np.repeat(vids[i], len(ids)) for i, ids, _, _ in found]),
            "other": np.concatenate([ids for _, ids, _, _ in found]),
            "least": np.concatenate([x for _, _, x, _ in found]),
            "score": np.concatenate([s for _, _, _, s in found]),
        })

    parts = queries.groupBy("qblock", "rblock").cogroup(rows.groupBy("qb", "rb")).applyInPandas(meet, "vid long, other long, least long, score double")
    best = F.row_number().over(W.partitionBy("vid").orderBy(F.desc("score"), "least", "other"))
    top = parts.withColumn("n", best).where(F.col("n") <= k + 1).drop("n")
    # Rows of equal vectors, at most (k + 1)^2 for a query vector; then the k + 1 best rows.
    held = top.join(index.select(F.col("vid").alias("other"), "ids"), "other").select("vid", "score", F.inline("ids"))
    lists = held.groupBy("vid").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "id", "row"))), 1, k + 1).alias("near"))
    out = asked.join(lists, "vid").select("query_id", F.slice(F.filter("near", lambda x: x["row"] != F.col("query_row")), 1, k).alias("near"))
    out = out.select("query_id", F.posexplode("near").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.less")).alias("score"))
