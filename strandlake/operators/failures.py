"""Explaining failed calls: three-way sweep of regions, candidates and truth, and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.operators.intervals import chained, merge_overlaps, overlap_join
from strandlake.operators.variants import reference_slice


def overlap_class(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """One of seven ways in which [a0, a1) and [b0, b1) lie to each other."""
    return (
        F.when((a0 == b0) & (a1 == b1), "EQUAL").when((a0 <= b0) & (b1 <= a1), "CONTAINS").when((b0 <= a0) & (a1 <= b1), "INSIDE")
        .when((a0 < b0) & (b0 < a1), "LEFT").when((b0 < a0) & (a0 < b1), "RIGHT").when(a1 <= b0, "BEFORE").otherwise("AFTER")
    )


def three_way_sweep(large: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Inside the large intervals: overlapping (first, chained second) pairs, and what has no partner.

    Overlapping items of the second stream are one chain.
    """
    a = overlap_join(first, large, how="left_semi", inside=True).select("chrom", "start", "stop")
    b = merge_overlaps(overlap_join(second, large, how="left_semi", inside=True)).select("chrom", "start", "stop")
    both = overlap_join(a, b).select("chrom", "start", "stop", "b_start", "b_stop")
    alone_a = a.join(both, ["chrom", "start", "stop"], "left_anti").select("*", F.lit(None).cast("long").alias("b_start"), F.lit(None).cast("long").alias("b_stop"))
    mine = both.select("chrom", "b_start", "b_stop")
    alone_b = b.select("chrom", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("stop"), F.col("start").alias("b_start"), F.col("stop").alias("b_stop")).join(mine, ["chrom", "b_start", "b_stop"], "left_anti")
    rows = both.unionByName(alone_a).unionByName(alone_b)
    kind = F.when(F.col("b_start").isNull(), "FIRST_ONLY").when(F.col("start").isNull(), "SECOND_ONLY").otherwise(overlap_class(*map(F.col, ("start", "stop", "b_start", "b_stop"))))
    return rows.withColumn("kind", kind)


def failure_reason(rows: DataFrame) -> DataFrame:
    """Why a call failed: from the truth alleles, the assembled ones, the ranked top two, and whether the site ran.

    Columns: ran, analysable (booleans), truth, found, top (arrays of alleles).
    """
    missing = F.size(F.array_except("truth", "found"))
    wrong = F.size(F.array_except("truth", "top"))
    reason = (
        F.when(~F.col("ran"), "DID_NOT_RUN").when(~F.col("analysable"), "CANNOT_ANALYSE").when(missing > 0, "ASSEMBLY")
        .when(wrong > 0, "MODELING").otherwise("CLASSIFICATION")
    )
    kind = F.when(F.size(F.array_distinct("truth")) > 1, "HETEROZYGOUS").otherwise("HOMOZYGOUS")
    return rows.withColumn("reason", F.when(reason.isin("DID_NOT_RUN", "CANNOT_ANALYSE"), reason).otherwise(F.concat_ws("_", reason, kind)))


def explained(failures: DataFrame, features: DataFrame, confident: DataFrame, reference: DataFrame) -> DataFrame:
    """Failed calls inside confident regions with the reason of each: (chrom, start, stop, reason).

    ``failures`` (chrom, start, stop, ref, alts, gt0 of the truth, gt1 of the
    call) that overlap each other are one chain; ``features`` (chrom, start,
    stop, allele, p) are the scored alleles of the sites that ran.  A chain
    without a site did not run; one with several failures can be analysed only
    if exactly one of them has true alleles.  Alleles of both are grown to the
    same span and then compared.
    """
    inside = overlap_join(failures, confident, how="left_semi", inside=True)
    rows = chained(inside, out="chain")
    known = F.when(F.col("gt0").isNotNull(), F.struct("start", "ref", "alts", "gt0"))
    chains = rows.groupBy("chrom", "chain").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n"), F.count(known).alias("n_true"), F.min(known).alias("true"), F.min(F.struct("start", "ref", "alts", "gt0")).alias("any"))
    sites = features.groupBy("chrom", "start", "stop").agg(F.sort_array(F.collect_list(F.struct("p", "allele")), False).alias("ranked"))
    sites = overlap_join(sites, confident, how="left_semi", inside=True)
    met = overlap_join(chains, sites).select("chrom", "chain", F.struct(F.col("b_start").alias("start"), F.col("b_stop").alias("stop"), F.col("b_ranked").alias("ranked")).alias("site"))
    met = met.groupBy("chrom", "chain").agg(F.min_by("site", "site.start").alias("site"))
    rows = chains.join(met, ["chrom", "chain"], "left").withColumn("pick", F.when(F.col("n") > 1, F.col("true")).otherwise(F.col("any")))
    analysable = (F.col("n") == 1) | (F.col("n_true") == 1)
    rows = rows.withColumn("pos", F.coalesce("pick.start", "start")).withColumn("ref", F.coalesce("pick.ref", F.lit("")))
    rows = rows.withColumn("lo", F.least("start", "site.start")).withColumn("hi", F.greatest("stop", "site.stop"))
    rows = reference_slice(rows, reference, "lo", "hi", "text", any_length=True)
    between = lambda a, b: F.expr(f"substring(text, cast({a} - lo AS int) + 1, cast({b} - ({a}) AS int))")
    grown = lambda x, a, b: F.concat(between("lo", a), x, between(b, "hi"))
    true = F.transform(F.coalesce(F.col("pick.gt0"), F.array(F.lit(0))), lambda i: F.when(i == 0, F.col("pick.ref")).otherwise(F.get("pick.alts", i - 1)))
    rows = rows.withColumn("truth", F.array_distinct(F.transform(true, lambda x: grown(x, "pos", "pos + length(ref)"))))
    rows = rows.withColumn("found", F.transform("site.ranked", lambda x: grown(x["allele"], "site.start", "site.stop")))
    # A single true allele has to be the best one, two have to be the best two.
    rows = rows.withColumn("top", F.slice("found", 1, F.size("truth"))).withColumn("ran", F.col("site").isNotNull()).withColumn("analysable", analysable)
    return failure_reason(rows).select("chrom", "start", "stop", "reason")


def fraction_pass(rows: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Top two alleles by support; PASS if the best reaches the share, heterozygous if both do."""
    lists = rows.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("support", "allele")), False).alias("a"), F.sum("support").alias("t"))
    share = lambda k: F.coalesce(F.get("a", F.lit(k))["support"], F.lit(0)) / F.greatest("t", F.lit(1))
    name = lambda k: F.get("a", F.lit(k))["allele"]
    return lists.select("site", name(0).alias("a1"), F.when(share(1) >= threshold, name(1)).otherwise(name(0)).alias("a2"), F.when(share(0) >= threshold, "PASS").otherwise("FAIL").alias("filter"))


def variant_groups(pairs: DataFrame) -> DataFrame:
    """Runs of difference of two aligned haplotypes (site, at, ref, h0, h1; '-' is a gap): alleles and genotype."""
    w = W.partitionBy("site").orderBy("at")
    differ = (F.col("ref") != F.col("h0")) | (F.col("ref") != F.col("h1"))
    rows = pairs.withColumn("d", differ.cast("int")).withColumn("new", F.coalesce((F.col("d") != F.lag("d").over(w)).cast("int"), F.lit(0)))
    rows = rows.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))).where("d = 1")
    text = lambda c: F.regexp_replace(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.col(c).alias("x")))), lambda y: y["x"]), ""), "-", "").alias(c)
    out = rows.groupBy("site", "run").agg(F.min("at").alias("at"), text("ref"), text("h0"), text("h1"))
    gt = F.when(F.col("h0") == F.col("h1"), "1/1").when(F.col("h0") == F.col("ref"), "0/1").when(F.col("h1") == F.col("ref"), "1/0").otherwise("1/2")
    return out.withColumn("gt", gt)
