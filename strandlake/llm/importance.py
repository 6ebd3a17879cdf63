"""Quality classifier by importance resampling (operator 5).

Two generative models over hashed word n-grams (one of target text, one of all
raw text) give every document the weight log p_target - log p_raw; Gumbel
noise is added and the k largest keys are kept, which is sampling without
replacement in proportion to the weights.  The models are two count vectors
of 2**bits buckets, so what the driver and the executors hold does not grow.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import map_pandas, ship, written

#: Words, and runs of marks; bytes over 127 belong to words.
TOKEN = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^\sA-Za-z0-9_\x80-\xff]+")
BITS = 16
#: Texts that are hashed at once.
CHUNK = 512


def ngrams(text: str, bits: int = BITS) -> np.ndarray:
    """Buckets of the words and word pairs of a whole text."""
    h = np.fromiter(map(crc32, TOKEN.findall(text.encode())), np.uint32)
    pairs = h[:-1] * np.uint32(0x9E3779B1) ^ h[1:]
    return (np.concatenate([h, pairs]) * np.uint32(2654435769) >> np.uint32(32 - bits)).astype(np.int64)


def count_ngrams(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(bucket, raw, target): n-gram counts of all rows, and of those with ``target``; one row a bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 << bits), np.int64)
        for pdf in batches:
            for text, target in zip(pdf["text"], pdf["target"], strict=True):
                if text:
                    seen = ngrams(text, bits)
                    np.add.at(total[0], seen, 1)
                    if target:
                        np.add.at(total[1], seen, 1)
        found = np.flatnonzero(total[0])
        yield pd.DataFrame({"bucket": found, "raw": total[0][found], "target": total[1][found]})

    parts = map_pandas(docs.select("text", "target"), run, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def labelled(docs: DataFrame, labels: DataFrame, max_labels: int, seed: int = 29, id_col: str = "doc_id") -> DataFrame:
    """Ids of good documents (quality 1, not toxic): at most about ``max_labels``, chosen by hash, so the broadcast is bounded."""
    good = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(((F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).alias("target")).where("target")
    total = good.count()
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1_000_000))
    return good.where(bucket < math.ceil(1_000_000 * max_labels / max(total, 1))).limit(max_labels + max_labels // 10)


class Model:
    """Log ratio of the target and the raw model, by bucket."""

    def __init__(self, counts: pd.DataFrame, bits: int = BITS, smoothing: float = 1.0):
        size = 1 << bits
        both = np.zeros((2, size))
        both[:, counts["bucket"].to_numpy(dtype=np.int64)] = counts[["target", "raw"]].to_numpy(dtype=float).T
        share = (both + smoothing) / (both.sum(axis=1, keepdims=True) + smoothing * size)
        self.ratio = np.log(share[0]) - np.log(share[1]) if both[0].sum() else np.zeros(size)
        self.bits = bits

    def weight(self, text: str | None) -> float:
        return float(self.ratio[ngrams(text, self.bits)].sum()) if text else 0.0


def fit(docs: DataFrame, good: DataFrame, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Counts over all documents in one pass; ``good`` (bounded) marks the target ones."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(good.select(F.col(id_col).alias("id"), "target")), "id", "left")
    return Model(count_ngrams(rows.select("text", F.coalesce("target", F.lit(False)).alias("target")), bits).toPandas(), bits)


def weigher(docs: DataFrame, model: Model):
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def log_weight(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            yield pd.Series([m.weight(t) for t in texts], dtype="float64")

    return log_weight


def gumbel_key(weight: Column, doc_id: Column, seed: int) -> Column:
    uniform = (F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 53)) + F.lit(0.5)) / F.lit(float(1 << 53))
    return weight - F.ln(-F.ln(uniform))


def kth_largest(rows: DataFrame, value: str, k: int, bins: int = 2048, last: int = 4096) -> float | None:
    """Exact k-th largest value: bounded histograms narrow the range, then at most ``last`` rows are ordered."""
    lo, hi = rows.agg(F.min(value), F.max(value)).first()
    v = F.col(value)
    while lo is not None and lo < hi:
        width = (hi - lo) / bins
        place = F.least(F.floor((v - lo) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
        inside = rows.where(v.between(lo, hi))
        found = {r["at"]: r for r in inside.groupBy(place.alias("at")).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).collect()}
        for at in sorted(found, reverse=True):
            if found[at]["n"] >= k:
                break
            k -= found[at]["n"]
        if found[at]["n"] <= last:
            top = rows.where(v.between(found[at]["lo"], found[at]["hi"])).orderBy(v.desc()).limit(k).agg(F.min(v)).first()
            return top[0]
        lo, hi = found[at]["lo"], found[at]["hi"]
    return lo


def threshold(docs: DataFrame, labels: DataFrame, max_labels: int, lose: float, seed: int, id_col: str, text_col: str):
    """The weighing UDF, and the key of the last document that the top k keep.

    k is the number of documents whose weight reaches the ``lose`` quantile of
    the good labelled ones that were held back, a third (no cap: it grows with
    the input).
    """
    good = written(labelled(docs, labels, max_labels, id_col=id_col), "good-labels")
    held = F.pmod(F.xxhash64(F.lit(31), F.col(id_col)), F.lit(3)) == 0
    model = fit(docs, good.where(~held), id_col=id_col, text_col=text_col)
    weigh = weigher(docs, model)
    scored = docs.select(F.col(id_col).alias("id"), weigh(F.col(text_col)).alias("weight"))
    scored = written(scored.withColumn("key", gumbel_key(F.col("weight"), F.col("id"), seed)), "weights")
    least = scored.join(F.broadcast(good.where(held).select(F.col(id_col).alias("id"))), "id", "left_semi").agg(F.percentile_approx("weight", lose, 100_000)).first()[0]
    k = scored.where(F.col("weight") >= least).count() if least is not None else scored.count()
    return weigh, scored, kth_largest(scored, "key", k) if k else None


def resample(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, lose: float = 0.002, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``log_weight``, ``gumbel_key`` and ``kept``.

    Null and empty texts weigh 0.  Rows with equal keys (repeated rows) are
    kept or rejected together.  Without good labels all weights are 0 and all
    rows are kept.  Other columns are not looked at.
    """
    _, scored, least = threshold(docs, labels, max_labels, lose, seed, id_col, text_col)
    kept = F.col("key") >= least if least is not None else F.lit(True)
    return scored.select(F.col("id").alias(id_col), F.col("weight").alias("log_weight"), F.col("key").alias("gumbel_key"), kept.alias("kept"))


def keep_sampled(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, lose: float = 0.002, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows with all their columns; texts are weighed again rather than moved."""
    weigh, _, least = threshold(docs, labels, max_labels, lose, seed, id_col, text_col)
    if least is None:
        return docs
    return docs.where(gumbel_key(weigh(F.col(text_col)), F.col(id_col), seed) >= least)
