"""Training examples: site filters, sampling, splits, batches and label statistics.

A row is a (site, allele) with a label (1: true allele) and its supporting reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.operators.scans import numbered
from strandlake.shared import written
def unit_hash(seed: int, *columns: str) -> Column:
    """A number in [0, 1) told by the columns: the same on every run and for any partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1_000_000)) / F.lit(1_000_000.0)


def trainable_sites(rows: DataFrame, least_alleles: int = 2) -> DataFrame:
    """Sites with a true allele and at least two alleles."""
    good = rows.groupBy("site").agg(F.count("*").alias("n"), F.max("label").alias("top")).where((F.col("n") >= least_alleles) & (F.col("top") > 0))
    return rows.join(good.select("site"), "site", "left_semi")


def prune_homozygous(rows: DataFrame, keep: float, seed: int = 13, snv_only: bool = False) -> DataFrame:
    """Sites with one allele stay with probability ``keep``; in SNV-only mode indel sites all stay."""
    per = rows.groupBy("site").agg(F.count("*").alias("n"), F.max((F.length("allele") != 1).cast("int")).alias("indel"))
    stays = (F.col("n") > 1) | (unit_hash(seed, "site") <= keep)
    return rows.join(per.where(stays | (F.lit(snv_only) & (F.col("indel") == 1))).select("site"), "site", "left_semi")


def fraction_qc(rows: DataFrame, cutoff: float) -> DataFrame:
    """Drops sites where a true allele (label over 0.4) has less than ``cutoff`` of the support; 0 turns it off."""
    if cutoff == 0:
        return rows
    w = W.partitionBy("site")
    low = F.max(((F.col("label") > 0.4) & (F.col("support") < F.col("__all") * cutoff)).cast("int")).over(w)
    return rows.withColumn("__all", F.sum("support").over(w)).withColumn("__low", low).where("__low = 0").drop("__all", "__low")


def covered_truth(rows: DataFrame) -> DataFrame:
    """After sampling: every true allele still has support, unsupported alleles go, two or more are left."""
    w = W.partitionBy("site")
    bare = F.max(((F.col("label") > 0) & (F.col("support") <= 0)).cast("int")).over(w)
    left = F.sum((F.col("support") > 0).cast("int")).over(w)
    return rows.withColumn("__bare", bare).withColumn("__left", left).where("__bare = 0 AND __left >= 2 AND support > 0").drop("__bare", "__left")


def subsample(reads: DataFrame, rates: list[tuple[float, float]], seed: int = 13) -> DataFrame:
    """Each site draws a rate from (rate, probability); each of its reads stays with that probability."""
    u, rate, upto = unit_hash(seed, "site"), None, 0.0
    for r, p in rates:
        upto += p
        rate = F.when(u < upto, r) if rate is None else rate.when(u < upto, r)
    rows = reads.withColumn("rate", rate.otherwise(rates[-1][0]))
    return rows.where(unit_hash(seed + 1, "site", "allele", "read") < F.col("rate"))


def cap_site_reads(reads: DataFrame, most: int, seed: int = 13) -> DataFrame:
    w = W.partitionBy("site").orderBy(F.xxhash64(F.lit(seed), "allele", "read"), "allele", "read")
    return reads.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def site_depth(rows: DataFrame) -> DataFrame:
    return rows.groupBy("site", "tech").agg(F.sum("support").alias("depth"))


def label_frequency(rows: DataFrame) -> DataFrame:
    """By kind of site: positives (one or two per site), negatives, and their share."""
    per = rows.groupBy("site").agg(F.max((F.length("allele") != 1).cast("int")).alias("indel"), F.sum((F.col("label") > 0).cast("int")).alias("t"), F.count("*").alias("n"))
    pos = F.when(F.col("t") <= 1, 1).otherwise(2)
    out = per.groupBy("indel").agg(F.sum(pos).alias("positive"), F.sum(F.col("n") - pos).alias("negative"))
    return out.withColumn("share", F.col("positive") / (F.col("positive") + F.col("negative") + F.lit(1e-15)))


def dataset_length(rows: DataFrame, batch: int, workers: int) -> DataFrame:
    """Whole batches of each worker's sites, and the least over workers."""
    per = rows.select("site").distinct().withColumn("worker", F.pmod(F.xxhash64("site"), F.lit(workers))).groupBy("worker").agg(F.floor(F.count("*") / batch).alias("batches"))
    return per.agg(F.min("batches").alias("batches"), F.count("*").alias("workers"))


def max_q(rows: DataFrame) -> DataFrame:
    """Mean of -ln 0.5 over heterozygous sites; labels other than 0 and 1 are an error."""
    loss = F.when(F.col("site_label") == 1, F.lit(0.6931471805599453)).when(F.col("site_label") == 0, F.lit(0.0)).otherwise(F.raise_error(F.lit("unknown site label")).cast("double"))
    return rows.agg(F.avg(loss).alias("max_q"), F.count("*").alias("sites"))


def split(rows: DataFrame, share: float = 0.9, seed: int = 13) -> DataFrame:
    """Adds ``part`` (train or validation) by the hash of the site: no global sort, the same for any partitioning."""
    return rows.withColumn("part", F.when(unit_hash(seed, "site") < share, "train").otherwise("validation"))


def worker_shards(rows: DataFrame, workers: int, seed: int = 13) -> DataFrame:
    """Equal shards of sites: in the order of a hash, ceil(n / workers) to a worker, cut to the shortest."""
    at = written(numbered(rows.select("site").distinct().withColumn("u", unit_hash(seed, "site")), "u", "site", out="at"), "ranked-sites")
    total = at.count()
    size = max(1, -(-total // workers))
    shortest = total - size * max(0, -(-total // size) - 1)
    at = at.withColumn("worker", F.floor(F.col("at") / size)).withColumn("place", F.col("at") % size)
    return at.where(F.col("place") < shortest).select("site", "worker", "place")


def block_shuffle(rows: DataFrame, epoch: int, blocks: int = 64, seed: int = 13) -> DataFrame:
    """Order of an epoch: blocks by hash, then rows inside a block by hash."""
    block = F.pmod(F.xxhash64("site"), F.lit(blocks))
    rows = rows.withColumn("block", block)
    return rows.withColumn("block_order", F.xxhash64(F.lit(seed + epoch), "block")).withColumn("row_order", F.xxhash64(F.lit(seed + epoch), "site", "allele"))


def collate(rows: DataFrame, batch: int, workers: int = 8) -> DataFrame:
    """Batches of whole sites: alleles per site, reads per allele and per site, labels, in site order."""
    per = rows.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("allele", "support", "label"))).alias("a"))
    per = per.withColumn("worker", F.pmod(F.xxhash64("site"), F.lit(workers)))
    per = numbered(per, "site", by=("worker",), out="at")
    per = per.withColumn("batch", F.floor(F.col("at") / batch))
    lists = per.groupBy("worker", "batch").agg(F.sort_array(F.collect_list(F.struct("site", "a"))).alias("s"))
    return lists.select(
        "worker", "batch", F.transform("s", lambda x: F.size(x["a"])).alias("alleles_per_site"),
        F.flatten(F.transform("s", lambda x: F.transform(x["a"], lambda y: y["support"]))).alias("reads_per_allele"),
        F.transform("s", lambda x: F.aggregate(x["a"], F.lit(0).cast("long"), lambda t, y: t + y["support"])).alias("reads_per_site"),
        F.flatten(F.transform("s", lambda x: F.transform(x["a"], lambda y: y["label"]))).alias("labels"),
    )


def ranked_features(rows: DataFrame) -> DataFrame:
    """Alleles of a site from best to worst as parallel arrays; a site with one allele is an error."""
    lists = rows.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("score", "support", "allele")), False).alias("a"))
    lists = lists.withColumn("a", F.when(F.size("a") > 1, F.col("a")).otherwise(F.raise_error(F.lit("a site has one allele"))))
    return lists.select("site", F.transform("a", lambda x: x["allele"]).alias("alleles"), F.transform("a", lambda x: x["score"]).alias("scores"), F.transform("a", lambda x: x["support"]).alias("supports"))


def pad_or_chop(values: Column, length: int, fill: int = 0) -> Column:
    """Centred to ``length``: the odd extra goes to the left."""
    n = F.size(values)
    more, less = F.greatest(F.lit(length) - n, F.lit(0)), F.greatest(n - length, F.lit(0))
    cut = F.slice(values, F.ceil(less / 2).cast("int") + 1, F.least(n, F.lit(length)))
    left = F.ceil(more / 2).cast("int")
    return F.concat(F.array_repeat(F.lit(fill), left), cut, F.array_repeat(F.lit(fill), (more - left).cast("int")))


def random_partner(rows: DataFrame, others: DataFrame, seed: int = 13) -> DataFrame:
    """Each (dataset, chrom) with one of the partners, told by hash: the partner list is numbered, so no cross join."""
    numbered = others.select("partner").distinct().withColumn("k", F.row_number().over(W.orderBy("partner")) - 1)
    n = numbered.count()
    return rows.withColumn("k", F.pmod(F.xxhash64(F.lit(seed), "dataset", "chrom"), F.lit(max(n, 1)))).join(F.broadcast(numbered), "k").drop("k")


def depth_normalise(values: Column, coverage: Column, mean: Column) -> Column:
    return F.transform(values, lambda x: (x - coverage) / mean)


def supported(rows: DataFrame, longest: int = 80) -> DataFrame:
    """Alleles with support that are not too long."""
    return rows.where((F.col("support") > 0) & (F.length("allele") <= longest))


def callable_sites(rows: DataFrame, ref: Column) -> DataFrame:
    """Sites with an allele other than the reference: (site, n)."""
    per = rows.groupBy("site").agg(F.count("*").alias("n"), F.bool_or(F.col("allele") != ref).alias("__alt"))
    return per.where("__alt").drop("__alt")


def with_status(rows: DataFrame, longest: int = 80) -> DataFrame:
    """Adds ``status``: TOO_LONG, MISSED (neither true nor supported) or DATA; writers split by it."""
    return rows.withColumn("status", F.when(F.length("allele") > longest, "TOO_LONG").when((F.col("label") == 0) & (F.col("support") == 0), "MISSED").otherwise("DATA"))


def truth_support_gate(rows: DataFrame, support: DataFrame) -> DataFrame:
    """Labels only of alleles that the first technology supports (site, allele, support)."""
    return rows.join(support.where("support > 0").select("site", "allele"), ["site", "allele"], "left_semi")


def missing_alleles(rows: DataFrame) -> DataFrame:
    """(site, missing): true alleles of a site that nothing supports; sites without any are left out."""
    pick = lambda test, name: F.collect_set(F.when(test, F.col("allele"))).alias(name)
    lists = rows.groupBy("site").agg(pick(F.col("label") > 0, "truth"), pick(F.col("support") > 0, "found"))
    return lists.select("site", F.array_sort(F.array_except("truth", "found")).alias("missing")).where("size(missing) > 0")


def added_field(rows: DataFrame, values: DataFrame) -> DataFrame:
    """Stored alleles with a further column from ``values`` (site, allele, ...); null where there is none."""
    return rows.join(values, ["site", "allele"], "left")


def differences(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("site", "allele"), tolerance: float = 1e-8) -> DataFrame:
    """Rows in which two stores differ: (keys, kind), with kind ``missing`` (only in a), ``extra`` (only in b) or the column that differs."""
    rest = [c for c in a.columns if c not in keys]
    left = a.select(*keys, F.struct(*rest).alias("__a"))
    both = left.join(b.select(*keys, F.struct(*rest).alias("__b")), list(keys), "full")
    number = {c for c, t in a.dtypes if t in ("float", "double")}
    apart = lambda c: F.abs(F.col(f"__a.{c}") - F.col(f"__b.{c}")) > tolerance if c in number else ~F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}"))
    kinds = F.when(F.col("__b").isNull(), F.array(F.lit("missing"))).when(F.col("__a").isNull(), F.array(F.lit("extra")))
    return both.select(*keys, F.explode(kinds.otherwise(F.array_compact(F.array(*(F.when(F.coalesce(apart(c), F.lit(True)), c) for c in rest))))).alias("kind"))


def contig_features(contigs: DataFrame, coverage: DataFrame, top: int = 4) -> DataFrame:
    """Per site: (score, support, length) of the best contigs, padded with (-100, -1, -1), then mean and deviation of the coverage."""
    lists = contigs.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("score", "support", F.length("allele").alias("length"), "allele")), False).alias("c"))
    best = F.flatten(F.transform(F.slice("c", 1, top), lambda x: F.array(x["score"].cast("double"), x["support"].cast("double"), x["length"].cast("double"))))
    pad = F.flatten(F.array_repeat(F.array(F.lit(-100.0), F.lit(-1.0), F.lit(-1.0)), F.greatest(top - F.size("c"), F.lit(0)).cast("int")))
    cov = coverage.groupBy("site").agg(F.avg("depth").alias("mean"), F.coalesce(F.stddev_pop("depth"), F.lit(0.0)).alias("deviation"))
    return lists.join(cov, "site", "left").select("site", F.concat(best, pad, F.array(F.coalesce("mean", F.lit(0.0)), F.coalesce("deviation", F.lit(0.0)))).alias("features"))


def examples_as_records(examples: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of labelled examples (site_key, chrom, start, stop, allele, label), and the sites without a true allele.

    ``refs`` has the reference text of each site (site_key, ref).  Alleles are
    numbered in order, the reference first; a single true allele is doubled.
    """
    lists = examples.groupBy("site_key", "chrom", "start", "stop").agg(F.array_sort(F.collect_set("allele")).alias("__all"), F.collect_set(F.when(F.col("label") > 0, F.col("allele"))).alias("__true"))
    rows = lists.join(refs, "site_key").withColumn("alts", F.array_remove("__all", F.col("ref")))
    every = F.concat(F.array("ref"), "alts")
    gt = F.filter(F.transform(every, lambda x, i: F.when(F.array_contains("__true", x), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("gt", gt)
    rows = rows.withColumn("gt", F.when(F.size("gt") == 1, F.concat("gt", "gt")).otherwise(F.col("gt")))
    none = rows.where("size(gt) = 0").select("chrom", "start", "stop")
    return rows.where("size(gt) > 0").select("chrom", F.col("start").alias("pos"), "ref", "alts", "gt"), none
