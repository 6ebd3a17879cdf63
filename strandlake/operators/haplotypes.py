"""Haplotype labelling: match truth and candidate haplotypes of a region and label alleles.

A region row has ``region``, ``seg_start``, ``segment`` and an array ``sites``
of (pos, ref, alts, gt) in order.  Regions with more than ten sites are told
apart before anything else.  Labelling walks through the trie of candidate
alleles (``trie``); ``truth_haplotypes`` and ``candidate_haplotypes`` list
haplotypes where a list is asked for, as rows, so that no row holds them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.operators import trie

MAX_SITES = 10

_GAP = "substring(segment, cast(a.at - seg_start AS int) + 1, cast(x.pos - a.at AS int))"
_TAIL = "substring(segment, cast(a.at - seg_start AS int) + 1)"


def feasible(regions: DataFrame) -> DataFrame:
    """Adds ``reject``: too many sites, or a site outside of the segment."""
    over = F.expr("exists(sites, x -> x.pos < seg_start OR x.pos + length(x.ref) > seg_start + length(segment))")
    return regions.withColumn("reject", (F.size("sites") > MAX_SITES) | over)


def _walked(regions: DataFrame, start: str, choices: str, step: str) -> DataFrame:
    """(region, segment, seg_start, a): ``a`` after all sites, a row for each way to choose ``g`` at every site ``x``."""
    rows = feasible(regions).where("NOT reject").select("region", "seg_start", "segment", "sites", F.expr(start).alias("a"))
    for k in range(MAX_SITES):
        rows = rows.withColumn("x", F.get("sites", F.lit(k)))
        rows = rows.select("*", F.posexplode_outer(F.expr(f"if(x IS NULL, NULL, {choices})")).alias("o", "g"))
        rows = rows.withColumn("a", F.expr(f"if(x IS NULL, a, {step})")).drop("x", "o", "g")
    return rows


def truth_haplotypes(regions: DataFrame) -> DataFrame:
    """(region, ordinal, h0, h1, missed, extra), swapped and repeated pairs left out (the first stays)."""
    every = "concat(array(x.ref), x.alts)"
    gts = "array_distinct(array(named_struct('u', 0, 'v', 0), named_struct('u', x.gt[0], 'v', 0), named_struct('u', 0, 'v', x.gt[0]), named_struct('u', x.gt[1], 'v', 0), named_struct('u', 0, 'v', x.gt[1]), named_struct('u', x.gt[0], 'v', x.gt[1])))"
    true = f"array_distinct(transform(x.gt, t -> {every}[t]))"
    step = f"""named_struct('at', cast(x.pos + length(x.ref) AS bigint), 'ordinal', a.ordinal * 6 + o,
        'h0', concat(a.h0, {_GAP}, {every}[g.u]), 'h1', concat(a.h1, {_GAP}, {every}[g.v]),
        'missed', a.missed + size(array_except({true}, array({every}[g.u], {every}[g.v]))),
        'extra', a.extra + size(array_except(array({every}[g.u], {every}[g.v]), {true})))"""
    rows = _walked(regions, "named_struct('at', cast(seg_start AS bigint), 'ordinal', 0L, 'h0', '', 'h1', '', 'missed', 0, 'extra', 0)", gts, step)
    out = rows.select("region", "a.ordinal", F.expr(f"concat(a.h0, {_TAIL})").alias("h0"), F.expr(f"concat(a.h1, {_TAIL})").alias("h1"), "a.missed", "a.extra")
    return dedupe_haplotypes(out)


def dedupe_haplotypes(pairs: DataFrame) -> DataFrame:
    """Pairs (region, ordinal, h0, h1, missed, extra) without those that repeat or swap an earlier one."""
    return pairs.groupBy("region", F.least("h0", "h1").alias("lo"), F.greatest("h0", "h1").alias("hi")).agg(F.min(F.struct("ordinal", "h0", "h1", "missed", "extra")).alias("h")).select("region", "h.*")


def candidate_haplotypes(regions: DataFrame) -> DataFrame:
    """(region, haplotype, picks): every choice of one allele at each site; equal texts keep the first choice."""
    step = f"named_struct('at', cast(x.pos + length(x.ref) AS bigint), 'ordinal', concat(a.ordinal, array(o)), 'h', concat(a.h, {_GAP}, g), 'picks', concat(a.picks, array(g)))"
    rows = _walked(regions, "named_struct('at', cast(seg_start AS bigint), 'ordinal', cast(array() AS array<int>), 'h', '', 'picks', cast(array() AS array<string>))", "concat(array(x.ref), x.alts)", step)
    out = rows.select("region", "a.ordinal", F.expr(f"concat(a.h, {_TAIL})").alias("haplotype"), "a.picks")
    return out.groupBy("region", "haplotype").agg(F.min_by("picks", "ordinal").alias("picks"))


def matched(truths: DataFrame, candidates: DataFrame) -> DataFrame:
    """Truth pairs of which both haplotypes are among the candidates."""
    a = candidates.select("region", F.col("haplotype").alias("h0"), F.col("picks").alias("picks0"))
    b = candidates.select("region", F.col("haplotype").alias("h1"), F.col("picks").alias("picks1"))
    return truths.join(a, ["region", "h0"]).join(b, ["region", "h1"])


def best_labelling(pairs: DataFrame) -> DataFrame:
    """The pair with the fewest (missed, extra); of equal ones the last."""
    best = F.min(F.struct("missed", "extra", (-F.col("ordinal")).alias("late"), "picks0", "picks1")).alias("b")
    return pairs.groupBy("region").agg(best).select("region", "b.missed", "b.extra", "b.picks0", "b.picks1")


def label_sites(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate sites with the two picked alleles, or status MISSED.

    A region is MISSED if no truth pair matches, or if its only site needs a
    missed or an extra allele, or if it was not feasible.  Both tables have one
    row a region.  The pair with the fewest (missed, extra) is taken, of equal
    ones the last; a pair of texts that can be spelled in several ways counts
    with the fewest.
    """
    known = feasible(truth).where("NOT reject").select("region", trie.truth_edges().alias("__truth"))
    rows = feasible(candidates).join(known, "region", "left").withColumn("__edges", trie.candidate_edges())
    best = F.when(~F.col("reject") & F.col("__truth").isNotNull(), trie.best_pair("__truth", "__edges"))
    picks = lambda c: F.transform(F.col("sites"), lambda x, k: F.get(F.concat(F.array(x["ref"]), x["alts"]), F.get(F.col(f"__best.{c}"), k)))
    rows = rows.withColumn("__best", best).select("region", "sites", "__best.missed", "__best.extra", picks("c0").alias("picks0"), picks("c1").alias("picks1"))
    status = F.when(F.col("missed").isNull(), "MISSED").when((F.size("sites") == 1) & (F.col("missed") + F.col("extra") > 0), "MISSED").otherwise("LABELLED")
    rows = rows.withColumn("status", status).select("region", "status", "picks0", "picks1", F.posexplode("sites").alias("k", "site"))
    pick = lambda c: F.when(F.col("status") == "LABELLED", F.get(c, F.col("k"))).alias(f"{c}_allele")
    return rows.select("region", "status", F.col("site.pos").alias("pos"), F.col("site.ref").alias("ref"), F.col("site.alts").alias("alts"), pick("picks0"), pick("picks1"))


def label_alleles(labelled: DataFrame, support: DataFrame) -> DataFrame:
    """Label 1 for supported alleles of the truth genotype, and the site label (1: heterozygous)."""
    rows = labelled.where("status = 'LABELLED'").join(support, ["region", "pos"]).where("support > 0")
    label = (F.col("allele") == F.col("picks0_allele")) | (F.col("allele") == F.col("picks1_allele"))
    return rows.select("region", "pos", "allele", "support", label.cast("int").alias("label"), (F.col("picks0_allele") != F.col("picks1_allele")).cast("int").alias("site_label"))


def label_attach(candidates: DataFrame, labelled: DataFrame) -> DataFrame:
    """Candidate sites (region, pos, ref, alts) with the picked alleles as a genotype; -1 stands for an allele that is not there."""
    picks = labelled.select("region", "pos", "status", "picks0_allele", "picks1_allele")
    rows = candidates.join(picks, ["region", "pos"])
    every = F.concat(F.array("ref"), "alts")
    at = lambda c: F.when(F.col("status") == "LABELLED", (F.coalesce(F.array_position(every, F.col(c)), F.lit(0)) - 1).cast("int")).otherwise(-1)
    return rows.select("region", "pos", "ref", "alts", "status", F.array(at("picks0_allele"), at("picks1_allele")).alias("gt"))


def label_tensors(records: DataFrame, support: DataFrame, longest: int = 80) -> DataFrame:
    """Training rows: each supported allele of a record (chrom, site_start, site_stop, ref, alts, gt) with its label.

    An allele that no read supports, or that is longer than ``longest``, is
    left out; ``site_label`` is 0 if at most one true allele is left, else 1.
    """
    every = F.concat(F.array("ref"), "alts")
    true = F.array_distinct(F.transform("gt", lambda i: F.get(every, i)))
    rows = records.select("chrom", "site_start", "site_stop", true.alias("__true"), F.explode(F.array_distinct(every)).alias("allele"))
    rows = rows.join(support.where((F.col("illumina") + F.col("pacbio") > 0) & (F.length("allele") <= longest)), ["chrom", "site_start", "site_stop", "allele"])
    rows = rows.withColumn("label", F.array_contains("__true", F.col("allele")).cast("int")).drop("__true")
    total = F.sum("label").over(W.partitionBy("chrom", "site_start", "site_stop"))
    return rows.withColumn("site_label", F.when(total <= 1, 0).otherwise(1))


def reconcile(haplotypes: DataFrame, regions: DataFrame, coverage: DataFrame, least_coverage: float = 14, most_sites: int = 10, intended: bool = False) -> DataFrame:
    """Long reads whose haplotype over a region is a combination of its alleles take that combination's alleles (``picks``).

    Only where short reads cover the region by more than ``least_coverage`` on
    average and it has fewer than ``most_sites`` sites.  ``haplotypes`` has
    region, region_start, region_stop, tech, start, end and haplotype;
    ``regions`` has region, seg_start, segment and sites (one row a region);
    ``coverage`` has region and mean.  A read must reach the region's end and
    begin at its start or after it; with ``intended`` it must begin at the
    start or before it.  Combinations are not listed: every read walks through
    the trie of its region's alleles.
    """
    spans = F.col("start") <= F.col("region_start") if intended else F.col("start") >= F.col("region_start")
    covered = coverage.where(F.col("mean") > least_coverage).select("region")
    known = feasible(regions).where(~F.col("reject") & (F.size("sites") < most_sites)).join(covered, "region", "left_semi")
    known = known.select("region", "sites", trie.candidate_edges().alias("__edges"))
    long = haplotypes.where((F.col("tech") == "P") & spans & (F.col("end") >= F.col("region_stop")))
    rows = long.join(known, "region").withColumn("__choice", trie.spelled("haplotype", "__edges")).where("__choice IS NOT NULL")
    picks = F.transform("sites", lambda x, k: F.get(F.concat(F.array(x["ref"]), x["alts"]), F.get("__choice", k)))
    return rows.withColumn("picks", picks).drop("__choice", "__edges", "sites")
