"""Queries over region gates, unions, read mismatches and scored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import examples as E
from strandlake.operators import intervals as I
from strandlake.operators import pileup as P
from strandlake.operators import reads as R
from strandlake.operators import scoring as C
from strandlake.plans.base import query
from strandlake.plans.example_queries import alleles, ex
from strandlake.plans.queries import evidence, kept_reads
from strandlake.plans.sqlbase import with_tables as q
from strandlake.sources import sinks
from strandlake.sources import synthetic as S


@query("region_bounds", q("SELECT chrom, id, tile, greatest(start, tile * 3) AS start, least(stop, tile * 3 + 3) AS stop, start >= tile * 3 AND stop <= tile * 3 + 3 AS strict FROM (SELECT *, unnest(range(start // 3, (stop - 1) // 3 + 1)) AS tile FROM spans)", "spans"))
def _(s, d):
    """Every interval in each of the three-day tiles that it touches."""
    rows = S.order_spans(s, d).withColumn("tile", F.explode(F.expr("sequence(start div 3, (stop - 1) div 3)")))
    lo, hi = F.col("tile") * 3, F.col("tile") * 3 + 3
    inside = I.bounded(rows, lo, hi, strict=True).select("chrom", "id", "tile", F.lit(True).alias("strict"))
    return I.bounded(rows, lo, hi).join(inside, ["chrom", "id", "tile"], "left").select("chrom", "id", "tile", "start", "stop", F.coalesce("strict", F.lit(False)).alias("strict"))


@query("out_of_bounds", q('SELECT chrom, tile, n FROM (SELECT chrom, start // 400 AS tile, count(*) AS n, min(start) - 10 AS lo, max("end") AS hi FROM usable GROUP BY ALL) JOIN lengths USING (chrom) WHERE lo >= 0 AND hi <= length - 30', "usable", "lengths"))
def _(s, d):
    """Regions whose reads begin too early or end beyond the (shortened) chromosome go."""
    return I.in_bounds(R.usable(S.reads(s, d)), S.lengths(s, d).withColumn("length", F.col("length") - 30), 400)


@query("mismatch_count", q("SELECT chrom, read_name, is_reverse, start, count(*) AS mismatches FROM b WHERE rc <> bc GROUP BY ALL", "b"))
def _(s, d):
    return P.mismatch_count(kept_reads(s, d), S.reference(s, d))


@query("resolve_partials", q("SELECT chrom, pos, tech, ref, alt, n FROM counts", "counts"))
def _(s, d):
    return evidence(s, d)[0].withColumn("n", F.col("n").cast("long"))


@query("union_hotspots", q("SELECT chrom, pos FROM evs WHERE tech = 'I' UNION SELECT chrom, pos FROM evs WHERE tech = 'P'", "evs"))
def _(s, d):
    rows = P.snv_evidence(P.with_depth(*evidence(s, d)))
    return I.united(rows.where("tech = 'I'"), rows.where("tech = 'P'"))


@query("concat_shards", q("SELECT shard, chrom, pos FROM (SELECT DISTINCT chrom, pos, pos % 3 AS shard FROM pts)", "pts"))
def _(s, d):
    points = S.events(s, d).distinct()
    return I.in_job_order(*(points.where(F.col("pos") % 3 == k) for k in range(3)))


@query("sort_positions", q("SELECT chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS at FROM (SELECT DISTINCT chrom, pos FROM pts)", "pts"))
def _(s, d):
    return I.ranked(S.events(s, d)).select("chrom", "pos", F.col("at").cast("long").alias("at"))


@query("ambiguous_pairs", q("SELECT chrom, start, stop FROM (SELECT *, coalesce(lead(start) OVER w - stop > 3, true) AND coalesce(start - lag(stop) OVER w > 3, true) AS alone FROM (SELECT chrom, min(start) AS start, max(stop) AS stop FROM spans GROUP BY chrom, id // 50) WINDOW w AS (PARTITION BY chrom ORDER BY start, stop)) WHERE alone AND stop - start <= 60", "spans"))
def _(s, d):
    rows = S.order_spans(s, d).groupBy("chrom", F.floor(F.col("id") / 50).alias("k")).agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return I.lone(rows).select("chrom", "start", "stop")


@query("truth_by_segment", q("SELECT c.chrom, c.start, count(*) AS n FROM confident c JOIN truth t ON c.chrom = t.chrom AND t.pos >= c.start AND t.pos < c.stop GROUP BY ALL", "confident", "truth"))
def _(s, d):
    variants = S.truth(s, d).select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("stop"))
    return I.overlap_join(S.confident(s, d), variants).groupBy("chrom", "start").agg(F.count("*").alias("n"))


@query("truth_support_gate", ex("SELECT site, allele FROM ex WHERE label = 1 AND support > 0"))
def _(s, d):
    rows = alleles(s, d)
    return E.truth_support_gate(rows.where("label = 1"), rows).select("site", "allele")


P3 = "SELECT site, label, (support % 9 + 1) / 11.0 AS p0, (support % 7 + 1) / 9.0 AS p1, 0.5 AS p2, CASE WHEN site % 2 = 0 THEN 0.5 ELSE 0.25 END AS w0, CASE WHEN site % 2 = 0 THEN 0.25 ELSE 0.5 END AS w1, 0.25 AS w2 FROM ex"


@query("mixture_metrics", ex(f"""SELECT site, round(least(t, -1e-8), 6) AS log_probability, round(exp(a + ln(w0) - t), 6) AS posterior, round(acc, 6) AS accuracy, lab AS label_accuracy, round(ce, 6) AS cross_entropy FROM (SELECT *, ln(exp(a + ln(w0) - m) + exp(b + ln(w1) - m) + exp(c + ln(w2) - m)) + m AS t FROM (SELECT *, greatest(a + ln(w0), b + ln(w1), c + ln(w2)) AS m
    FROM (SELECT site, max(w0) AS w0, max(w1) AS w1, max(w2) AS w2, sum(ln(CASE WHEN label = 1 THEN p0 ELSE 1 - p0 END)) AS a, sum(ln(CASE WHEN label = 1 THEN p1 ELSE 1 - p1 END)) AS b, sum(ln(0.5)) AS c, avg(CASE WHEN (mix >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) AS acc, min(CASE WHEN (mix >= 0.5) = (label = 1) THEN 1 ELSE 0 END) AS lab, -avg(ln(CASE WHEN label = 1 THEN mix ELSE 1 - mix END)) AS ce FROM (SELECT *, round(p0 * w0 + p1 * w1 + p2 * w2, 12) AS mix FROM ({P3})) GROUP BY site)))"""))
def _(s, d):
    rows = alleles(s, d).selectExpr("site", "label", "(support % 9 + 1) / 11D AS p0", "(support % 7 + 1) / 9D AS p1", "0.5D AS p2", "if(site % 2 = 0, array(0.5D, 0.25D, 0.25D), array(0.25D, 0.5D, 0.25D)) AS meta")
    out = C.mixture_metrics(rows)
    return out.select("site", F.round("log_probability", 6).alias("log_probability"), F.round("posterior", 6).alias("posterior"), F.round("accuracy", 6).alias("accuracy"), "label_accuracy", F.round("cross_entropy", 6).alias("cross_entropy"))


@query("sink_labelled_vcf", q("SELECT chrom, pos, CASE WHEN pos % 5 = 0 THEN 'UNLABELED' WHEN pos % 7 = 0 THEN 'NO_ALT' ELSE 'PASS' END AS filter, CASE WHEN pos % 5 = 0 OR pos % 7 = 0 THEN '0/0' ELSE g0 || '/' || g1 END AS gt FROM truth WHERE pos % 11 <> 0", "truth"))
def _(s, d):
    status = F.when(F.col("pos") % 11 == 0, "REJECTED").when(F.col("pos") % 5 == 0, "MISSED").otherwise("LABELLED")
    none = (F.col("pos") % 7 == 0) & (F.col("pos") % 5 != 0)
    rows = S.truth(s, d).withColumn("status", status).withColumn("alts", F.when(none, F.array().cast("array<string>")).otherwise(F.col("alts"))).withColumn("gt", F.when(none, F.array(F.lit(0), F.lit(0))).otherwise(F.col("gt")))
    parts = F.split("line", "\t")
    return sinks.labelled_lines(rows).select("chrom", (parts[1].cast("long") - 1).alias("pos"), parts[6].alias("filter"), parts[9].alias("gt"))


@query("contig_features", ex("SELECT site, count(*) AS n, round(list_sum(list(x ORDER BY k)), 6) AS total FROM (SELECT site, k, CASE WHEN k <= 4 THEN support * 0.5 + support + length(allele) ELSE 0 END AS x FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY support DESC, length(allele) DESC, allele DESC) AS k FROM ex) UNION ALL SELECT site, 0, CASE WHEN count(*) < 4 THEN -102.0 * (4 - count(*)) ELSE 0 END + avg(support) + stddev_pop(support) FROM ex GROUP BY site) GROUP BY site".replace("count(*) AS n", "count(*) FILTER (k > 0) AS n")))
def _(s, d):
    rows = alleles(s, d)
    out = E.contig_features(rows.withColumn("score", F.col("support") * 0.5), rows.select("site", F.col("support").alias("depth")))
    sizes = rows.groupBy("site").agg(F.count("*").alias("n"))
    return out.join(sizes, "site").select("site", "n", F.round(F.aggregate("features", F.lit(0.0), lambda t, x: t + x), 6).alias("total"))


@query("bundle_jobs", q("""SELECT chrom, shard, min(start) - 10 AS start, max(stop) + 10 AS stop, CAST(sum(w) AS BIGINT) AS n FROM (SELECT * FROM (WITH RECURSIVE cuts AS (SELECT *, CASE WHEN start - lag(stop) OVER (PARTITION BY chrom ORDER BY start) + 1 >= 40 THEN 1 ELSE 0 END AS cut FROM runs),
    nb AS (SELECT *, sum(cut) OVER (PARTITION BY chrom ORDER BY start) AS block FROM cuts), bl AS (SELECT chrom, block, sum(n) AS w, min(start) AS start, max(stop) AS stop FROM nb GROUP BY ALL),
    walk AS (SELECT *, 0 AS shard, w AS have FROM bl WHERE block = 0 UNION ALL SELECT bl.*, CASE WHEN have >= 64 THEN shard + 1 ELSE shard END, CASE WHEN have >= 64 THEN bl.w ELSE have + bl.w END FROM walk JOIN bl ON bl.chrom = walk.chrom AND bl.block = walk.block + 1) SELECT * FROM walk)) GROUP BY ALL""", "runs"))
def _(s, d):
    """Greedy bundles of at least 64 points, cut at gaps of 40."""
    return I.bundles(I.consecutive_runs(P.hotspots(*evidence(s, d))), 64, 40).select("chrom", "shard", "start", "stop", "n")
