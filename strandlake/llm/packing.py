"""Optimal length buckets and token-budget batches (operator 1).

Dynamic programming over the global length histogram chooses the bucket ends
that need the least padding; documents of a bucket are then dealt into batches
whose padded size stays within a token budget.  The histogram has every length
there is, so the ends are the best at any size; as the best start of a bucket
never moves back when its end moves on, each step of the programme is
O(m log m) in the m different lengths.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.llm.common import words_of, written


def best_starts(before: np.ndarray, ends: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """For every end j > 0 the first i < j with the least before[i] + ends[j] * (documents of bins i + 1 to j).

    Best starts grow with j: the middle end of a range of ends is settled
    first, by which the starts of both halves are narrowed; all ranges of a
    level are settled together.
    """
    best = np.zeros(len(ends), np.int64)
    first, last, low, high = np.array([1]), np.array([len(ends) - 1]), np.array([0]), np.array([len(ends) - 1])
    while len(first):
        middle = (first + last) // 2
        size = np.minimum(high, middle - 1) - low + 1
        starts = np.cumsum(size) - size
        i = np.arange(size.sum()) + np.repeat(low - starts, size)
        j = np.repeat(middle, size)
        cost = before[i] + ends[j] * (upto[j + 1] - upto[i + 1])
        least = np.repeat(np.minimum.reduceat(cost, starts), size)
        best[middle] = np.minimum.reduceat(np.where(cost == least, i, len(ends)), starts)
        halves = [(first, middle - 1, low, best[middle]), (middle + 1, last, best[middle], high)]
        first, last, low, high = (np.concatenate(x) for x in zip(*halves, strict=True))
        left = first <= last
        first, last, low, high = first[left], last[left], low[left], high[left]
    return best


def optimal_ends(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Bucket ends with the least total padding: cost[j] after k buckets, over the last bin j."""
    ends = np.array(lengths, dtype=np.int64)
    upto = np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64))])
    m = len(ends)
    cost = ends * upto[1:]
    came = []
    for _ in range(1, min(buckets, m)):
        start = best_starts(cost, ends, upto)
        new = cost[start] + ends * (upto[1:] - upto[start + 1])
        better = (new < cost) & (np.arange(m) > 0)
        came.append(np.where(better, start, -1))
        cost = np.where(better, new, cost)
    out, j = [], m - 1
    for back in reversed(came):
        if back[j] >= 0:
            out.append(j)
            j = int(back[j])
    out.append(j)
    return [int(lengths[k]) for k in sorted(out)]


def pack(docs: DataFrame, length: Column, buckets: int = 16, budget: int = 65_536, rows_a_part: int = 100_000, id_col: str = "doc_id") -> DataFrame:
    """Per document: length, ``bucket``, ``padded_length``, ``batch_id`` and its ``slot`` in the batch.

    A bucket may hold most rows, so ranks are counted in parts of some
    ``rows_a_part`` rows and shifted by the sizes of the parts before; all
    batches but the last of a bucket are full.  A batch holds budget //
    padded_length documents, at least one.  Lengths that are null or below 1
    count as 1; ids may be null or repeated (a slot for each row); an empty
    table gives an empty result.  The driver gets one row for each different
    length.
    """
    size = F.greatest(F.coalesce(length.cast("long"), F.lit(1)), F.lit(1))
    # Rows without an id are told apart by their place in the written table.
    tell = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    rows = written(docs.select(F.col(id_col).alias("id"), size.alias("length"), tell.alias("tell")), "lengths")
    hist = rows.groupBy("length").count().orderBy("length").collect()
    ends = optimal_ends([r["length"] for r in hist], [r["count"] for r in hist], buckets) if hist else [1]
    parts = max(16, sum(r["count"] for r in hist) // rows_a_part)
    bucket = F.lit(len(ends) - 1)
    for k in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("length") <= ends[k], k).otherwise(bucket)
    rows = rows.withColumn("bucket", bucket).withColumn("part", F.pmod(F.xxhash64(F.lit(3), "id", "length", "tell"), F.lit(parts)).cast("int"))
    before = W.partitionBy("bucket").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("bucket", "part").count().select("bucket", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    at = F.col("start") + F.row_number().over(W.partitionBy("bucket", "part").orderBy("id", "length", "tell")) - 1
    end = F.get(F.array(*map(F.lit, ends)), F.col("bucket")).cast("long")
    room = F.greatest(F.floor(F.lit(budget) / end), F.lit(1)).cast("long")
    rows = rows.join(starts, ["bucket", "part"]).withColumn("at", at)
    return rows.select(
        F.col("id").alias(id_col), "length", "bucket", end.alias("padded_length"),
        (F.col("bucket").cast("long") * F.lit(1 << 40) + F.floor(F.col("at") / room)).alias("batch_id"),
        (F.col("at") % room).cast("int").alias("slot"),
    )


def word_length(text: Column) -> Column:
    """Words of a text and one end mark."""
    return F.size(words_of(text)) + 1
