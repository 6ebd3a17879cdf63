"""Queries over variants, scores and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import variants as V
from strandlake.plans.base import query
from strandlake.plans.queries import evidence
from strandlake.plans.sqlbase import code, letter
from strandlake.plans.sqlbase import with_tables as q
from strandlake.operators import pileup as P
from strandlake.sources import synthetic as S

text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def calls(s, d):
    """Alleles of SNV and deletion evidence of both technologies with their share as score, and the reference allele with the rest."""
    share = F.least(F.sum("n") / F.sum("total"), F.lit(1.0))
    alts = P.with_depth(*evidence(s, d)).groupBy("chrom", "pos", "ref", F.col("alt").alias("allele")).agg(share.alias("p"), F.sum("n").alias("n")).where("n >= 2").drop("n")
    # The alleles of a site are one row, so the reference is added without a second pass over the evidence.
    lists = alts.groupBy("chrom", "pos", "ref").agg(F.collect_list(F.struct("allele", "p")).alias("a"))
    rest = F.greatest(1 - F.aggregate("a", F.lit(0.0), lambda t, x: t + x["p"]), F.lit(0.0))
    both = F.concat("a", F.array(F.struct(F.col("ref").alias("allele"), rest.alias("p"))))
    return lists.select("chrom", "pos", "ref", F.explode(both).alias("x")).select("chrom", "pos", "ref", "x.allele", "x.p")


SCORES = """al AS (SELECT chrom, pos, ref, alt AS allele, least(sum(n) / sum(total), 1.0) AS p FROM ev GROUP BY chrom, pos, ref, alt HAVING sum(n) >= 2),
    sc AS (SELECT * FROM al UNION ALL SELECT chrom, pos, ref, ref, greatest(1 - sum(p), 0.0) FROM al GROUP BY chrom, pos, ref),
    pr AS (SELECT x.chrom, x.pos, x.ref, x.allele AS a1, y.allele AS a2, (SELECT exp(sum(ln(CASE WHEN z.allele IN (x.allele, y.allele) THEN z.p ELSE 1 - z.p END + 1e-10))) FROM sc z WHERE z.chrom = x.chrom AND z.pos = x.pos AND z.ref = x.ref) AS p
        FROM sc x JOIN sc y ON x.chrom = y.chrom AND x.pos = y.pos AND x.ref = y.ref AND x.allele <= y.allele)"""

#: Normalised form (pos2, ref2, alt1, alt2) of the rows of a table with chrom, pos, ref and one or two alternatives x1, x2.
NORMAL = f"""n1 AS (SELECT *, (SELECT string_agg({letter(code('pos - 50 + k'))}, '' ORDER BY k) FROM range(50) t(k) WHERE pos - 50 + k >= 0) AS l FROM (SELECT *, CAST(substr(chrom, 2) AS BIGINT) AS cn FROM {{src}})),
    n2 AS (SELECT *, l || ref AS a, l || x1 AS b, l || coalesce(x2, x1) AS c FROM n1),
    n3 AS (SELECT *, list_max(list_filter(range(0, least(length(a), length(b), length(c))), lambda k: right(a, k) = right(b, k) AND right(a, k) = right(c, k))) AS cut FROM n2),
    n4 AS (SELECT * REPLACE (left(a, length(a) - cut) AS a, left(b, length(b) - cut) AS b, left(c, length(c) - cut) AS c) FROM n3),
    n5 AS (SELECT *, list_max(list_filter(range(0, least(length(a), length(b), length(c))), lambda k: left(a, k) = left(b, k) AND left(a, k) = left(c, k))) AS head FROM n4),
    normal AS (SELECT *, pos - length(l) + head AS pos2, substr(a, head + 1) AS ref2, substr(b, head + 1) AS alt1, substr(c, head + 1) AS alt2 FROM n5)"""


def scored(select: str, more: str = "") -> str:
    return q("", "ev").rstrip() + ", " + SCORES + (", " + more if more else "") + " " + select


@query("pair_likelihood", scored("SELECT chrom, pos, ref, a1, a2, round(p, 6) AS p FROM pr"))
def _(s, d):
    return V.pair_likelihood(calls(s, d), ("chrom", "pos", "ref")).select("chrom", "pos", "ref", "a1", "a2", F.round("p", 6).alias("p"))


TOP = "SELECT chrom, pos, ref, a1, a2, p FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos, ref ORDER BY round(p, 9) DESC, a1 DESC, a2 DESC) AS k FROM pr) WHERE k = 1"


@query("top_genotype", scored(f"SELECT chrom, pos, ref, a1, a2, round(-10 * log10(1 - least(p, 1 - 1e-8)), 4) AS qual FROM ({TOP})"))
def _(s, d):
    pairs = V.pair_likelihood(calls(s, d), ("chrom", "pos", "ref")).withColumn("p", F.round("p", 9))
    return V.top_genotype(pairs, ("chrom", "pos", "ref")).select("chrom", "pos", "ref", "a1", "a2", F.round("qual", 4).alias("qual"))


@query("call_sites", scored("SELECT chrom, pos2 AS pos, ref2 AS ref, alt1 || CASE WHEN x2 IS NULL THEN '' ELSE ',' || alt2 END AS alts, gt FROM normal", f"""best AS ({TOP}),
    called AS (SELECT chrom, pos, ref, list_sort(list_distinct(list_filter([a1, a2], lambda x: x <> ref))) AS c, (SELECT list_sort(list(allele)) FROM al WHERE al.chrom = best.chrom AND al.pos = best.pos AND al.ref = best.ref) AS r, a1, a2 FROM best),
    genos AS (SELECT chrom, pos, ref, CASE WHEN len(c) > 0 THEN c ELSE r END AS alts, CASE WHEN len(c) > 0 THEN CASE WHEN a1 = ref THEN 0 ELSE list_position(c, a1) END || '/' || CASE WHEN a2 = ref THEN 0 ELSE list_position(c, a2) END ELSE '0/0' END AS gt FROM called),
    vin AS (SELECT chrom, pos, ref, gt, alts[1] AS x1, alts[2] AS x2 FROM genos), """ + NORMAL.format(src="vin")))
def _(s, d):
    pairs = V.pair_likelihood(calls(s, d), ("chrom", "pos", "ref")).withColumn("p", F.round("p", 9))
    rows = V.number_alleles(V.top_genotype(pairs, ("chrom", "pos", "ref")))
    return V.normalise(rows, S.reference(s, d)).select("chrom", "pos", "ref", F.array_join("alts", ",").alias("alts"), F.array_join("gt", "/").alias("gt"))


@query("mixture_mean", scored("SELECT chrom, pos, ref, a1, a2, round(p * 0.5 + sqrt(p) * 0.25 + p * p * 0.25, 6) AS p FROM pr"))
def _(s, d):
    pairs = V.pair_likelihood(calls(s, d), ("chrom", "pos", "ref"))
    experts = [pairs.withColumn("p", F.expr(e)).withColumn("expert", F.lit(k)) for k, e in enumerate(("p", "sqrt(p)", "p * p"))]
    rows = experts[0].unionByName(experts[1]).unionByName(experts[2]).withColumn("meta", F.expr("array(0.5D, 0.25D, 0.25D)"))
    return V.mixture_mean(rows).withColumn("p", F.round("p", 6))


@query("best_expert", q("SELECT chrom, pos, CASE WHEN pos % 3 >= pos % 5 AND pos % 3 >= pos % 7 THEN 0 WHEN pos % 5 >= pos % 7 THEN 1 ELSE 2 END AS expert FROM truth", "truth"))
def _(s, d):
    return S.truth(s, d).withColumn("meta", F.expr("array(cast(pos % 3 AS double), cast(pos % 5 AS double), cast(pos % 7 AS double))")).select("chrom", "pos", V.best_expert(F.col("meta")).alias("expert"))


@query("phred", q("SELECT chrom, pos, round(-10 * log10(1 - least((pos % 101) / 100, 1 - 1e-8)), 6) AS qual FROM truth", "truth"))
def _(s, d):
    return S.truth(s, d).select("chrom", "pos", F.round(V.phred(F.expr("(pos % 101) / 100")), 6).alias("qual"))


@query("parse_gt", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 3) || ',' || (o_orderkey % 4) END AS gt FROM orders""")
def _(s, d):
    gt = F.expr("CASE o_orderkey % 5 WHEN 0 THEN './.' WHEN 1 THEN concat(o_orderkey % 3, '|', o_orderkey % 4) ELSE concat(o_orderkey % 3, '/', o_orderkey % 4) END")
    return s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), text(V.parse_gt(gt)).alias("gt"))


@query("chrom_order", "SELECT DISTINCT o_custkey % 26 AS k, CASE WHEN o_custkey % 26 BETWEEN 1 AND 22 THEN o_custkey % 26 WHEN o_custkey % 26 = 23 THEN 23 WHEN o_custkey % 26 = 24 THEN 24 END AS ord FROM orders")
def _(s, d):
    name = F.expr("CASE k WHEN 23 THEN 'chrX' WHEN 24 THEN 'Y' WHEN 0 THEN 'chrM' WHEN 25 THEN 'MT' ELSE concat(if(k % 2 = 0, 'chr', ''), k) END")
    return s.read.parquet(f"{d}/orders.parquet").select(F.expr("o_custkey % 26").alias("k")).distinct().select("k", V.chrom_order(name).cast("long").alias("ord"))


@query("chromosome_filter", q("SELECT chrom, count(*) AS n FROM (SELECT CASE WHEN ok % 30 < 22 THEN 'chr' || (1 + ok % 30) WHEN ok % 30 = 22 THEN 'chrX' ELSE 'un' || (ok % 30) END AS chrom FROM reads) WHERE chrom LIKE 'chr%' GROUP BY ALL", "reads"))
def _(s, d):
    ok = F.split("read_name", "-")[0].cast("long") % 30
    rows = S.reads(s, d).select(F.when(ok < 22, F.concat(F.lit("chr"), 1 + ok)).when(ok == 22, "chrX").otherwise(F.concat(F.lit("un"), ok)).alias("chrom"))
    plain = [*map(str, range(1, 23)), "X", "Y"]
    counts = rows.groupBy("chrom").agg(F.count("*").alias("n"))
    mine = counts.where(F.col("chrom").isin(plain) | F.col("chrom").isin([f"chr{c}" for c in plain]))
    style = mine.groupBy(F.col("chrom").startswith("chr").alias("pre")).agg(F.count("*").alias("k"))
    best = style.agg(F.max_by("pre", F.struct("k", "pre")).alias("best"))
    return mine.join(F.broadcast(best), F.col("chrom").startswith("chr") == F.col("best")).select("chrom", "n")


@query("canonical_truth", q("SELECT chrom, pos, ref, CASE WHEN alt < 'M' THEN alt || ',M' ELSE 'M,' || alt END AS alts, CASE WHEN alt < 'M' THEN '1,1' ELSE '2,2' END AS gt FROM truth", "truth"))
def _(s, d):
    rows = S.truth(s, d).withColumn("alts", F.concat(F.array(F.lit("M")), "alts")).withColumn("gt", F.array(F.lit(2)))
    return V.canonical_truth(rows).select("chrom", "pos", "ref", F.array_join("alts", ",").alias("alts"), text("gt").alias("gt"))


@query("alleles_of_gt", q("SELECT chrom, pos, CASE WHEN g0 = 1 THEN alt ELSE ref || ',' || alt END AS alleles FROM truth", "truth"))
def _(s, d):
    return S.truth(s, d).select("chrom", "pos", F.array_join(V.alleles_of_gt(F.col("ref"), F.col("alts"), F.col("gt")), ",").alias("alleles"))


@query("candidate_record", q("SELECT chrom, pos, alt AS alts, '0,0' AS gt, 1 AS at, -1 AS none FROM truth", "truth"))
def _(s, d):
    rows = V.candidate_record(S.truth(s, d).withColumn("alleles", F.concat(F.array("ref"), "alts")))
    return rows.select("chrom", "pos", F.array_join("alts", ",").alias("alts"), text("gt").alias("gt"), V.allele_index(F.col("alleles"), F.get("alts", F.lit(0))).cast("long").alias("at"), V.allele_index(F.col("alleles"), F.lit("N")).cast("long").alias("none"))


@query("site_key", q("SELECT chrom || '_' || pos || '_' || (pos + 1) AS site_key, chrom, pos AS start, pos + 1 AS stop FROM truth", "truth"))
def _(s, d):
    rows = S.truth(s, d).select(F.concat_ws("_", "chrom", "pos", F.col("pos") + 1).alias("site_key"))
    part = F.split("site_key", "_")
    return rows.select("site_key", part[0].alias("chrom"), part[1].cast("long").alias("start"), part[2].cast("long").alias("stop"))


@query("site_type", q("SELECT chrom, pos, pos % 4 = 0 AS indel, CASE WHEN g0 = 1 THEN 0 ELSE 1 END AS site_label FROM truth", "truth"))
def _(s, d):
    rows = S.truth(s, d).withColumn("alleles", F.concat(F.array("ref"), F.when(F.col("pos") % 4 == 0, F.array(F.lit("AC"))).otherwise(F.col("alts"))))
    kinds = F.size(V.alleles_of_gt(F.col("ref"), F.col("alts"), F.col("gt")))
    return rows.select("chrom", "pos", F.exists("alleles", lambda a: F.length(a) != 1).alias("indel"), F.when(kinds <= 1, 0).otherwise(1).cast("long").alias("site_label"))


@query("expand_alleles", q(f"SELECT chrom, pos - 4 AS pos, {' || '.join(letter(code(f'pos - {k}')) for k in (4, 3, 2, 1))} || ref || {letter(code('pos + 1'))} || {letter(code('pos + 2'))} AS ref, {' || '.join(letter(code(f'pos - {k}')) for k in (4, 3, 2, 1))} || alt || {letter(code('pos + 1'))} || {letter(code('pos + 2'))} AS alt FROM truth", "truth"))
def _(s, d):
    rows = S.truth(s, d).withColumn("span_start", F.col("pos") - 4).withColumn("span_stop", F.col("pos") + 3)
    return V.expand_alleles(rows, S.reference(s, d)).select("chrom", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"))


def deletions(s, d):
    """Two-base deletions, written with a base too many on both sides, at every true position."""
    rows = V.reference_slice(S.truth(s, d).drop("ref", "alts"), S.reference(s, d), "pos", "pos + 6", "ref")
    return rows.withColumn("alts", F.array(F.expr("concat(left(ref, 2), right(ref, 2))")))


REF6 = " || ".join(letter(code(f"pos + {k}")) for k in range(6))
LEFT50 = f"(SELECT string_agg({letter(code('pos - 50 + k'))}, '' ORDER BY k) FROM range(50) t(k) WHERE pos - 50 + k >= 0)"


@query("normalise_variant", q("", "truth").rstrip() + f""", v AS (SELECT chrom, cn, pos, {REF6} AS ref FROM truth), w AS (SELECT *, {LEFT50} AS l FROM v), x AS (SELECT *, l || ref AS a, l || left(ref, 2) || right(ref, 2) AS b FROM w),
    y AS (SELECT *, list_max(list_filter(range(0, length(b)), lambda k: right(a, k) = right(b, k))) AS s FROM x), z AS (SELECT *, left(a, length(a) - s) AS a2, left(b, length(b) - s) AS b2 FROM y),
    f AS (SELECT *, list_max(list_filter(range(0, length(b2)), lambda k: left(a2, k) = left(b2, k))) AS p FROM z) SELECT chrom, pos - length(l) + p AS pos, substr(a2, p + 1) AS ref, substr(b2, p + 1) AS alt FROM f""")
def _(s, d):
    return V.normalise(deletions(s, d), S.reference(s, d)).select("chrom", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"))


LINE = "chrom || chr(9) || (pos + 1) || chr(9) || '.' || chr(9) || ref || chr(9) || alt || chr(9) || '30.000000' || chr(9) || 'PASS' || chr(9) || '.' || chr(9) || 'GT' || chr(9) || g0 || '/' || g1"


def lines(s, d):
    return V.vcf_line(S.truth(s, d).withColumn("qual", F.lit(30.0)).withColumn("filter", F.lit("PASS")).withColumn("info", F.lit(".")))


@query("vcf_line", q(f"SELECT chrom, pos, {LINE} AS line FROM truth", "truth"))
def _(s, d):
    return lines(s, d)


@query("sort_vcf", q(f"SELECT CAST(row_number() OVER (ORDER BY cn, pos) AS BIGINT) AS at, {LINE} AS line FROM truth", "truth"))
def _(s, d):
    rows = V.sort_vcf(lines(s, d))
    # The order is told by the neighbours: rank inside a chromosome plus the chromosomes before.
    from pyspark.sql import Window as W

    sizes = rows.groupBy("chrom_ord").count().withColumn("before", F.coalesce(F.sum("count").over(W.orderBy("chrom_ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(W.partitionBy("chrom_ord").orderBy("pos"))
    return rows.withColumn("k", rank).join(F.broadcast(sizes), "chrom_ord").select((F.col("before") + F.col("k")).alias("at"), "line")


@query("alts_of_call", q("SELECT chrom, pos, CASE WHEN pos % 2 = 0 THEN alt ELSE 'N' END AS alts, pos % 2 = 0 AS called FROM truth", "truth"))
def _(s, d):
    rows = S.truth(s, d).select("chrom", "pos", "ref", F.col("ref").alias("a1"), F.when(F.col("pos") % 2 == 0, F.get("alts", F.lit(0))).otherwise(F.col("ref")).alias("a2"), F.array("ref", F.lit("N")).alias("alleles"))
    return V.number_alleles(rows).select("chrom", "pos", F.array_join("alts", ",").alias("alts"), F.exists("gt", lambda g: g > 0).alias("called"))


@query("chromosomes_seen", q("SELECT DISTINCT chrom FROM truth", "truth"))
def _(s, d):
    return S.truth(s, d).select("chrom").distinct()
