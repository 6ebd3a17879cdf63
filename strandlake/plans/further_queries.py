"""Queries over events, regions, predictions, labelling tables, stores and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.operators import haplotypes as H
from strandlake.operators import intervals as I
from strandlake.operators import pileup as P
from strandlake.operators import reads as R
from strandlake.operators import scoring as C
from strandlake.operators import sites as T
from strandlake.operators import variants as V
from strandlake.plans import jobs
from strandlake.plans.base import query
from strandlake.plans.example_queries import alleles, ex, site_reads
from strandlake.plans.queries import kept_reads, stored_reads
from strandlake.plans.site_queries import runs, single_regions, sliced, slices, supported
from strandlake.plans.sqlbase import code, letter
from strandlake.plans.sqlbase import with_tables as q
from strandlake.plans.variant_queries import NORMAL, TOP, calls, scored
from strandlake.shared import fresh_path, written
from strandlake.sources import sinks, text
from strandlake.operators.left_align import left_align
from strandlake.sources import synthetic as S

# ---- events and reads

DEL = f"""SELECT b.chrom, b.read_name, b.is_reverse, b.pos, {letter('rc')} || {letter(code('pos + 1'))} || {letter(code('pos + 2'))} AS ref, {letter('bc')} AS alt, q, 'deletion' AS kind, b.cn
    FROM b JOIN (SELECT DISTINCT chrom AS c2, read_name AS n2, is_reverse AS s2, start AS st2, m FROM once WHERE m IS NOT NULL) ON chrom = c2 AND read_name = n2 AND is_reverse = s2 AND start = st2 WHERE i = m - 1"""


@query("op_alleles", q(f"SELECT chrom, read_name, is_reverse, pos, {letter('rc')} AS ref, {letter('bc')} AS alt, q, 'snv' AS kind FROM b WHERE rc <> bc UNION ALL SELECT chrom, read_name, is_reverse, pos, ref, alt, q, kind FROM ({DEL})", "b", "once"))
def _(s, d):
    return P.op_alleles(stored_reads(s, d), S.reference(s, d)).select("chrom", "read_name", "is_reverse", "pos", "ref", "alt", F.col("q").cast("long").alias("q"), "kind")


@query("left_align_reads", q("", "b", "once").rstrip() + f", ev0 AS (SELECT DISTINCT chrom, pos, ref, alt AS x1, CAST(NULL AS VARCHAR) AS x2 FROM ({DEL})), " + NORMAL.format(src="ev0") + " SELECT DISTINCT chrom, pos2 AS pos, ref2 AS ref, alt1 AS alt FROM normal")
def _(s, d):
    """Read indels as event rows, each different one moved to the left once."""
    events = P.indels(kept_reads(s, d), S.reference(s, d)).select("chrom", "pos", "ref", F.array("alt").alias("alts")).distinct()
    return V.normalise(events, S.reference(s, d)).select("chrom", "pos", "ref", F.get("alts", F.lit(0)).alias("alt")).distinct()


@query("left_align_cigars", q(f"""SELECT chrom, read_name, is_reverse, start + CASE WHEN s = m THEN 2 ELSE 0 END AS start, CASE WHEN m IS NULL OR s = m THEN '40M' ELSE (m - s) || 'M2D' || (40 - m + s) || 'M' END AS cigar FROM
    (SELECT chrom, read_name, is_reverse, start, m, coalesce(min(m - i) FILTER (i < m AND NOT (bc = rc AND {code('pos')} = {code('pos + 2')})) - 1, m) AS s FROM (SELECT b.*, o.m FROM b JOIN (SELECT chrom AS c2, read_name AS n2, is_reverse AS s2, start AS st2, m FROM once) o ON chrom = c2 AND read_name = n2 AND is_reverse = s2 AND start = st2) GROUP BY chrom, read_name, is_reverse, start, m)""", "b", "once"))
def _(s, d):
    """Reads with their own CIGARs rewritten."""
    text = F.expr("array_join(transform(cigar, x -> concat(x.len, substring('MIDNSHP=X', x.op + 1, 1))), '')")
    return left_align(kept_reads(s, d), S.reference(s, d)).select("chrom", "read_name", "is_reverse", "start", text.alias("cigar"))


@query("cigar_alignment", q("SELECT chrom, read_name, is_reverse, start, 40 + CASE WHEN m IS NULL THEN 0 ELSE 2 END AS columns, CASE WHEN m IS NULL THEN 0 ELSE 2 END AS gaps, m AS first_gap FROM once WHERE mapq >= 10", "once"))
def _(s, d):
    gap = F.col("base") == "-"
    return R.mapped_pairs(kept_reads(s, d)).groupBy("chrom", "read_name", "is_reverse", "start").agg(F.count("*").alias("columns"), F.count_if(gap).alias("gaps"), F.min(F.when(gap, F.col("column"))).cast("long").alias("first_gap"))


@query("read_bases_reference", q(f"SELECT chrom, pos // 100 AS tile, {letter('bc')} AS base, {letter('rc')} AS ref_base, count(*) AS n FROM b GROUP BY ALL", "b"))
def _(s, d):
    return P.base_pairs(kept_reads(s, d), S.reference(s, d), 100)


REGIONS = "rg0 AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) > 30 THEN 1 ELSE 0 END AS new FROM hot), rg1 AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY pos) AS k FROM rg0), rg AS (SELECT chrom, min(pos) - 90 AS start, max(pos) + 90 AS stop FROM rg1 GROUP BY chrom, k)"


@query("reads_by_region", q("", "hot", "once").rstrip() + ", " + REGIONS + ' SELECT o.chrom, rg.start AS region_start, o.read_name, o.is_reverse, o.start FROM once o JOIN rg ON o.chrom = rg.chrom AND o.start < rg.stop AND o."end" > rg.start WHERE o.mapq >= 10')
def _(s, d):
    points = jobs.detect_hotspots(S.reads(s, d), S.reference(s, d))
    regions = I.gap_regions(points, 30).select("chrom", (F.col("start") - 75).alias("start"), (F.col("stop") + 75).alias("stop"))
    return T.reads_by_region(jobs.clean_reads(S.reads(s, d)), regions).select("chrom", "region_start", "read_name", "is_reverse", "start")


@query("reads_by_site", sliced("SELECT chrom, site_start, site_stop, read_name, is_reverse, start FROM ov"))
def _(s, d):
    return T.reads_by_site(jobs.clean_reads(S.reads(s, d)), runs(s, d)).select("chrom", "site_start", "site_stop", "read_name", "is_reverse", "start")


@query("reconcile_reads")
def _(s, d):
    """Long reads whose haplotype over a window of 20 bases is a combination of the short reads' alleles."""
    rows = written(slices(s, d), "site-slices")
    window = F.floor(F.col("site_start") / 20) * 20
    regions = rows.select("chrom", "site_start", "site_stop").distinct().withColumn("region_start", window).withColumn("region_stop", F.greatest(F.col("region_start") + 20, F.col("site_stop")))
    regions = regions.withColumn("region_stop", F.max("region_stop").over(W.partitionBy("chrom", "region_start")))
    named = F.concat_ws("_", "chrom", "region_start").alias("region")
    haplotypes = T.read_haplotypes(rows, regions, S.reference(s, d)).select(named, "*")
    found = V.reference_slice(T.allele_support(rows.where("tech = 'I'")), S.reference(s, d), "site_start", "site_stop", "ref")
    sites = found.groupBy("chrom", "site_start", "site_stop", "ref").agg(F.collect_set("allele").alias("alleles")).join(regions, ["chrom", "site_start", "site_stop"])
    sites = V.candidate_record(sites.withColumn("pos", F.col("site_start")))
    lists = sites.groupBy("chrom", "region_start", "region_stop").agg(F.sort_array(F.collect_list(F.struct("pos", "ref", "alts", "gt"))).alias("sites"))
    lists = V.reference_slice(lists.withColumn("seg_start", F.greatest(F.col("region_start") - 6, F.lit(0))), S.reference(s, d), "seg_start", "region_stop + 6", "segment")
    candidates = lists.select(named, "seg_start", "segment", "sites")
    spans = regions.select(named, "chrom", F.col("region_start").alias("start"), F.col("region_stop").alias("stop")).distinct()
    coverage = T.region_coverage(jobs.clean_reads(S.reads(s, d)), spans)
    return H.reconcile(haplotypes, candidates, coverage, least_coverage=5, intended=True).select("region", "read_name", "is_reverse", "start", F.array_join("picks", ",").alias("picks"))


# ---- labelling tables

PAIRS = "SELECT o_custkey AS region, o_orderkey AS ordinal, 'A' || (o_orderkey % 3) AS h0, 'A' || (o_orderkey % 5 % 3) AS h1, o_orderkey % 4 AS missed, o_orderkey % 7 % 3 AS extra FROM orders"


def pairs(s, d):
    return s.read.parquet(f"{d}/orders.parquet").selectExpr("o_custkey AS region", "o_orderkey AS ordinal", "concat('A', o_orderkey % 3) AS h0", "concat('A', o_orderkey % 5 % 3) AS h1", "o_orderkey % 4 AS missed", "o_orderkey % 7 % 3 AS extra")


@query("dedupe_haplotypes", f"SELECT region, ordinal, h0, h1 FROM (SELECT *, row_number() OVER (PARTITION BY region, least(h0, h1), greatest(h0, h1) ORDER BY ordinal) AS k FROM ({PAIRS})) WHERE k = 1")
def _(s, d):
    return H.dedupe_haplotypes(pairs(s, d)).select("region", "ordinal", "h0", "h1")


@query("best_labelling", f"SELECT region, missed, extra, h0, h1 FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY missed, extra, ordinal DESC) AS k FROM ({PAIRS})) WHERE k = 1")
def _(s, d):
    rows = pairs(s, d).withColumn("picks0", F.array("h0")).withColumn("picks1", F.array("h1"))
    return H.best_labelling(rows).select("region", "missed", "extra", F.get("picks0", F.lit(0)).alias("h0"), F.get("picks1", F.lit(0)).alias("h1"))


@query("label_attach", q("SELECT chrom || '_' || pos AS region, CASE WHEN pos % 5 = 0 THEN '-1,-1' WHEN g0 = 1 THEN '1,1' ELSE '0,1' END AS gt FROM truth", "truth"))
def _(s, d):
    found = single_regions(s, d, True)
    sites = found.select("region", F.explode("sites").alias("x")).select("region", "x.*").drop("gt")
    rows = H.label_attach(sites, H.label_sites(single_regions(s, d, False), found))
    return rows.select("region", F.array_join(F.sort_array("gt").cast("array<string>"), ",").alias("gt"))


@query("label_tensors", sliced("""SELECT chrom, site_start, allele, illumina, pacbio, label, CASE WHEN sum(label) OVER (PARTITION BY chrom, site_start) <= 1 THEN 0 ELSE 1 END AS site_label FROM (SELECT s.chrom, s.site_start, s.allele, s.illumina, s.pacbio, CASE WHEN s.allele = t.alt OR (s.allele = t.ref AND t.g0 = 0) THEN 1 ELSE 0 END AS label
    FROM sup s JOIN truth t ON s.chrom = t.chrom AND s.site_start = t.pos AND s.site_stop = t.pos + 1 WHERE s.allele IN (t.ref, t.alt))""").replace("WITH ", "WITH truth AS (SELECT * FROM (" + q("SELECT * FROM truth", "truth") + ")), ", 1))
def _(s, d):
    records = S.truth(s, d).withColumn("site_start", F.col("pos")).withColumn("site_stop", F.col("pos") + 1)
    rows = H.label_tensors(records, T.allele_support(slices(s, d)))
    return rows.select("chrom", "site_start", "allele", "illumina", "pacbio", "label", "site_label")


@query("number_alleles", ex("""SELECT site, array_to_string(alts, ',') AS alts, CASE WHEN called THEN CASE WHEN a1 = 'A' THEN 0 ELSE list_position(alts, a1) END || '/' || CASE WHEN a2 = 'A' THEN 0 ELSE list_position(alts, a2) END ELSE '0/0' END AS gt FROM (SELECT *, CASE WHEN len(c) > 0 THEN c ELSE r END AS alts, len(c) > 0 AS called FROM
    (SELECT *, list_sort(list_distinct(list_filter([a1, a2], lambda x: x <> 'A'))) AS c, list_sort(list_filter(al, lambda x: x <> 'A')) AS r FROM (SELECT site, list(allele) AS al, max(allele) FILTER (k = 1) AS a1, coalesce(max(allele) FILTER (k = 2), max(allele) FILTER (k = 1)) AS a2 FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY support DESC, allele) AS k FROM ex) GROUP BY site))) WHERE len(alts) > 0"""))
def _(s, d):
    top = V.top_two(alleles(s, d), ("site",), "support").groupBy("site").agg(F.max(F.when(F.col("place") == 1, F.col("allele"))).alias("a1"), F.max(F.when(F.col("place") == 2, F.col("allele"))).alias("a2"))
    every = alleles(s, d).groupBy("site").agg(F.collect_list("allele").alias("alleles"))
    rows = top.join(every, "site").withColumn("a2", F.coalesce("a2", "a1")).withColumn("ref", F.lit("A"))
    return V.number_alleles(rows).select("site", F.array_join("alts", ",").alias("alts"), F.array_join("gt", "/").alias("gt"))


# ---- scores and predictions

@query("score_alleles", supported("""SELECT chrom, site_start, allele, round(CASE WHEN i = 0 OR p = 0 THEN support / (i + p) ELSE illumina / i END, 6) AS p0, round(CASE WHEN i = 0 OR p = 0 THEN 0 ELSE pacbio / p END, 6) AS p1, round(CASE WHEN i = 0 OR p = 0 THEN 0 ELSE support / (i + p) END, 6) AS p2, round(CASE WHEN i = 0 OR p = 0 THEN 1 ELSE i / (2 * (i + p)) END, 6) AS m0
    FROM (SELECT *, sum(illumina) OVER w AS i, sum(pacbio) OVER w AS p FROM full_sup WINDOW w AS (PARTITION BY chrom, site_start, site_stop))"""))
def _(s, d):
    rows = written(slices(s, d), "site-slices")
    out = C.support_scores(T.partial_support(rows, T.allele_support(rows)))
    return out.select("chrom", "site_start", "allele", *(F.round(F.get("p", F.lit(k)), 6).alias(f"p{k}") for k in range(3)), F.round(F.get("meta", F.lit(0)), 6).alias("m0"))


META = "array(if(pos % 3 = 0, 0.5D, 0.25D), if(pos % 3 = 1, 0.5D, 0.25D), if(pos % 3 = 2, 0.5D, 0.25D))"
MIXED = """sx AS (SELECT *, unnest([0, 1, 2]) AS e FROM sc), sy AS (SELECT chrom, pos, ref, allele, e, CASE e WHEN 0 THEN p WHEN 1 THEN sqrt(p) ELSE p * p END AS p FROM sx),
    px AS (SELECT x.chrom, x.pos, x.ref, x.e, x.allele AS a1, y.allele AS a2, (SELECT exp(sum(ln(CASE WHEN z.allele IN (x.allele, y.allele) THEN z.p ELSE 1 - z.p END + 1e-10))) FROM sy z WHERE z.chrom = x.chrom AND z.pos = x.pos AND z.ref = x.ref AND z.e = x.e) AS p, CASE WHEN x.pos % 3 = x.e THEN 0.5 ELSE 0.25 END AS w
        FROM sy x JOIN sy y ON x.chrom = y.chrom AND x.pos = y.pos AND x.ref = y.ref AND x.e = y.e AND x.allele <= y.allele)"""


def predictions(s, d):
    rows = calls(s, d).withColumn("p", F.expr("array(p, sqrt(p), p * p)")).withColumn("meta", F.expr(META))
    return C.site_predictions(rows)


@query("sink_predictions", scored("SELECT chrom, pos, ref, e AS expert, a1, a2, round(p, 6) AS p FROM px", MIXED))
def _(s, d):
    path = fresh_path(s, "predictions")
    sinks.write_predictions(predictions(s, d), path)
    return text.read_predictions(s, path).select("chrom", "pos", "ref", F.col("expert").cast("long").alias("expert"), "a1", "a2", F.round("p", 6).alias("p"))


@query("src_predictions", scored("SELECT chrom, count(DISTINCT (pos, ref)) AS sites, count(*) AS pairs, CAST(sum(e) AS BIGINT) AS experts FROM px GROUP BY chrom", MIXED))
def _(s, d):
    path = fresh_path(s, "predictions")
    sinks.write_predictions(predictions(s, d), path)
    return text.read_predictions(s, path).groupBy("chrom").agg(F.count_distinct("pos", "ref").alias("sites"), F.count("*").alias("pairs"), F.sum("expert").alias("experts"))


@query("expert_mix", scored("SELECT chrom, pos, ref, a1, a2, round(sum(p * w), 6) AS p FROM px GROUP BY ALL", MIXED))
def _(s, d):
    rows = predictions(s, d)
    weights = calls(s, d).select("chrom", "pos", "ref", F.expr(META).alias("meta")).distinct()
    return C.expert_mix(rows, weights).withColumn("p", F.round("p", 6))


@query("prepare_vcf", scored("SELECT kind, chrom, pos2 AS pos, ref2 AS ref, alt1 || CASE WHEN x2 IS NULL THEN '' ELSE ',' || alt2 END AS alts, gt FROM normal", MIXED + """,
    kinds AS (SELECT 'expert' || e AS kind, chrom, pos, ref, a1, a2, p FROM px UNION ALL SELECT 'best', chrom, pos, ref, a1, a2, p FROM px WHERE pos % 3 = e UNION ALL SELECT 'mean', chrom, pos, ref, a1, a2, sum(p * w) FROM px GROUP BY ALL),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, chrom, pos, ref ORDER BY round(p, 9) DESC, a1 DESC, a2 DESC) AS k FROM kinds) WHERE k = 1),
    called AS (SELECT kind, chrom, pos, ref, list_sort(list_distinct(list_filter([a1, a2], lambda x: x <> ref))) AS c, (SELECT list_sort(list(allele)) FROM al WHERE al.chrom = best.chrom AND al.pos = best.pos AND al.ref = best.ref) AS r, a1, a2 FROM best),
    genos AS (SELECT kind, chrom, pos, ref, CASE WHEN len(c) > 0 THEN c ELSE r END AS alts, CASE WHEN len(c) > 0 THEN CASE WHEN a1 = ref THEN 0 ELSE list_position(c, a1) END || '/' || CASE WHEN a2 = ref THEN 0 ELSE list_position(c, a2) END ELSE '0/0' END AS gt FROM called),
    vin AS (SELECT kind, chrom, pos, ref, gt, alts[1] AS x1, alts[2] AS x2 FROM genos), """ + NORMAL.format(src="vin")))
def _(s, d):
    rows = predictions(s, d).withColumn("p", F.round("p", 12))
    records, _ = jobs.prepare_vcf(rows, S.reference(s, d))
    return records.select("kind", "chrom", "pos", "ref", F.array_join("alts", ",").alias("alts"), F.array_join("gt", "/").alias("gt"))


# ---- stores

@query("src_rates", "SELECT CAST(l_discount AS DOUBLE) AS rate, CAST(count(*) AS DOUBLE) AS prob FROM lineitem GROUP BY ALL")
def _(s, d):
    counts = s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_discount").cast("double").alias("rate")).agg(F.count("*").alias("n"))
    pairs_ = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rate", "n"))), lambda x: F.concat_ws(": ", x["rate"].cast("string"), x["n"].cast("string"))), ", ")
    return text.rates(counts.agg(F.concat(F.lit("{"), pairs_, F.lit("}")).alias("value")))


def stored(s, d):
    return alleles(s, d).select(F.concat("site", F.lit("_"), F.col("site") + 1).alias("site_key"), F.concat(F.lit("c"), F.col("site") % 5).alias("chrom"), "allele", "label", "support")


@query("src_examples", ex("SELECT site || '_' || (site + 1) AS site_key, 'c' || (site % 5) AS chrom, string_agg(allele || ':' || label || ':' || support, ',' ORDER BY allele) AS alleles FROM ex GROUP BY site"))
def _(s, d):
    path = fresh_path(s, "examples")
    sinks.write_examples(stored(s, d), path)
    keys = stored(s, d).select("site_key")
    return text.read_examples(s, path, keys=keys).select("site_key", "chrom", F.array_join(F.transform("alleles", lambda x: F.concat_ws(":", x["allele"], x["label"].cast("string"), x["support"].cast("string"))), ",").alias("alleles"))


@query("examples_by_number", ex("SELECT ordinal, site_key, allele, support FROM (SELECT *, row_number() OVER (ORDER BY chrom, site_key, allele) - 1 AS ordinal FROM (SELECT site || '_' || (site + 1) AS site_key, 'c' || (site % 5) AS chrom, allele, support FROM ex)) WHERE ordinal BETWEEN 100 AND 899"))
def _(s, d):
    """A store read by the numbers of its rows."""
    path = fresh_path(s, "examples")
    sinks.write_examples(stored(s, d), path)
    return text.read_by_number(s, path, 100, 899).select("ordinal", "site_key", "allele", "support")


@query("shuffled_store")
def _(s, d):
    """A store written in the order of an epoch, read back in that order."""
    path = fresh_path(s, "shuffled")
    sinks.write_shuffled(alleles(s, d), path, epoch=1)
    return s.read.parquet(path).orderBy("ordinal").select("ordinal", "site", "allele", "block", "block_order", "row_order")


@query("compact_examples", ex("SELECT site || '_' || (site + 1) AS site_key, allele, label, support FROM ex"))
def _(s, d):
    """Three stores put together into one with few files."""
    paths, out = [fresh_path(s, "part") for _ in range(3)], fresh_path(s, "compact")
    rows = stored(s, d)
    for k, path in enumerate(paths):
        rows.where(F.pmod(F.xxhash64("site_key"), F.lit(3)) == k).write.parquet(path)
    sinks.compact(paths, out, s, 4)
    return s.read.parquet(out).select("site_key", "allele", "label", "support")


@query("src_file_list", ex("SELECT site % 2 AS part, count(*) AS n, count(DISTINCT site) AS sites FROM ex GROUP BY ALL"))
def _(s, d):
    paths = [fresh_path(s, f"listed{k}") for k in range(2)]
    rows = alleles(s, d)
    for k, path in enumerate(paths):
        rows.where(F.col("site") % 2 == k).coalesce(2).write.parquet(path)
    names = fresh_path(s, "list")
    s.createDataFrame([(p,) for p in paths], "value string").coalesce(1).write.text(names)
    found = text.read_file_list(s, names)
    return found.groupBy(F.regexp_extract("file", r"listed(\d)", 1).cast("long").alias("part")).agg(F.count("*").alias("n"), F.count_distinct("site").alias("sites"))


# ---- jobs

SHARDED = """SELECT h.chrom, h.pos, w.shard FROM hot h JOIN (SELECT chrom, shard, min(start) AS start, max(stop) AS stop FROM (SELECT * FROM (WITH RECURSIVE cuts AS (SELECT *, CASE WHEN start - lag(stop) OVER (PARTITION BY chrom ORDER BY start) + 1 >= 25 THEN 1 ELSE 0 END AS cut FROM runs),
    nb AS (SELECT *, sum(cut) OVER (PARTITION BY chrom ORDER BY start) AS block FROM cuts), bl AS (SELECT chrom, block, count(*) AS w, min(start) AS start, max(stop) AS stop FROM nb GROUP BY ALL), need AS (SELECT chrom, ceil(sum(w) / 20) AS need FROM bl GROUP BY ALL),
    walk AS (SELECT bl.*, 0 AS shard, w AS have, need FROM bl JOIN need USING (chrom) WHERE block = 0 UNION ALL SELECT bl.*, CASE WHEN have >= need THEN shard + 1 ELSE shard END, CASE WHEN have >= need THEN bl.w ELSE have + bl.w END, need FROM walk JOIN bl ON bl.chrom = walk.chrom AND bl.block = walk.block + 1) SELECT * FROM walk)) GROUP BY ALL) w
    ON h.chrom = w.chrom AND h.pos >= w.start AND h.pos < w.stop"""


@query("shard", q(SHARDED, "runs"))
def _(s, d):
    points = written(jobs.detect_hotspots(S.reads(s, d), S.reference(s, d)), "hotspots")
    return jobs.shard(points, 20, 25)


@query("feed_training")
def _(s, d):
    return jobs.feed_training(alleles(s, d), site_reads(s, d), [(0.5, 0.5), (1.0, 0.5)], 16, 4, keep=0.5, cutoff=0.02, most_reads=200)


@query("vcf_from_examples", q("SELECT chrom, pos, ref, CASE WHEN pos % 5 = 0 THEN NULL ELSE alt END AS alts, CASE WHEN pos % 5 <> 0 THEN CASE WHEN g0 = 1 THEN '1/1' ELSE '0/1' END END AS gt FROM truth", "truth"))
def _(s, d):
    """Records of the labelled sites, and the places of those without a true allele."""
    truth = S.truth(s, d).withColumn("stop", F.col("pos") + 1).withColumn("site_key", F.concat_ws("_", "chrom", "pos", "stop"))
    both = F.array(F.struct(F.col("ref").alias("allele"), (F.get("gt", F.lit(0)) == 0).alias("is")), F.struct(F.get("alts", F.lit(0)).alias("allele"), F.lit(True).alias("is")))
    rows = truth.select("site_key", "chrom", F.col("pos").alias("start"), "stop", F.explode(both).alias("x")).select("site_key", "chrom", "start", "stop", "x.allele", (F.col("x.is") & (F.col("start") % 5 != 0)).cast("int").alias("label"))
    records, none = jobs.vcf_from_examples(rows, S.reference(s, d))
    bare = V.reference_slice(none, S.reference(s, d), "start", "stop", "ref").select("chrom", F.col("start").alias("pos"), "ref", F.lit(None).cast("string").alias("alts"), F.lit(None).cast("string").alias("gt"))
    return records.select("chrom", "pos", "ref", F.array_join("alts", ",").alias("alts"), F.array_join("gt", "/").alias("gt")).unionByName(bare)


@query("explain_failures", sliced("""SELECT chrom, pos AS start, pos + 1 AS stop, CASE WHEN n IS NULL THEN 'DID_NOT_RUN' ELSE CASE WHEN NOT ok THEN 'ASSEMBLY' WHEN NOT top THEN 'MODELING' ELSE 'CLASSIFICATION' END || CASE WHEN g0 = 1 THEN '_HOMOZYGOUS' ELSE '_HETEROZYGOUS' END END AS reason FROM
    (SELECT t.chrom, t.pos, t.g0, min(r.site_start) AS n, coalesce(bool_or(s.allele = pre || t.alt || post), false) AND (g0 = 1 OR coalesce(bool_or(s.allele = pre || t.ref || post), false)) AS ok, coalesce(bool_or(s.allele = pre || t.alt || post AND s.k <= 2 - g0), false) AND (g0 = 1 OR coalesce(bool_or(s.allele = pre || t.ref || post AND s.k <= 2), false)) AS top
    FROM truth t LEFT JOIN (SELECT DISTINCT chrom, site_start, site_stop FROM sup) r0 ON false LEFT JOIN (SELECT DISTINCT chrom, site_start, site_stop, CAST(substr(chrom, 2) AS BIGINT) AS cn FROM sup s2 WHERE EXISTS (SELECT 1 FROM confident c WHERE c.chrom = s2.chrom AND c.start <= s2.site_start AND s2.site_stop <= c.stop)) r ON r.chrom = t.chrom AND r.site_start <= t.pos AND r.site_stop > t.pos
    LEFT JOIN LATERAL (SELECT coalesce((SELECT string_agg({a}, '' ORDER BY k) FROM range(r.site_start, t.pos) x(k)), '') AS pre, coalesce((SELECT string_agg({a}, '' ORDER BY k) FROM range(t.pos + 1, r.site_stop) x(k)), '') AS post) ON true
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY chrom, site_start, site_stop ORDER BY support DESC, allele DESC) AS k FROM sup) s ON s.chrom = r.chrom AND s.site_start = r.site_start AND s.site_stop = r.site_stop
    WHERE EXISTS (SELECT 1 FROM confident c WHERE c.chrom = t.chrom AND c.start <= t.pos AND t.pos + 1 <= c.stop) GROUP BY t.chrom, t.pos, t.g0)""".replace("{a}", letter(code("k").replace("cn", "t.cn")))).replace("WITH ", "WITH truth AS (SELECT * FROM (" + q("SELECT * FROM truth", "truth") + ")), confident AS (SELECT * FROM (" + q("SELECT * FROM confident", "confident") + ")), ", 1))
def _(s, d):
    """True variants as failed calls, held against the sites that ran."""
    failures = S.truth(s, d).select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("stop"), "ref", "alts", F.col("gt").alias("gt0"), F.lit(None).cast("array<int>").alias("gt1"))
    support = T.allele_support(written(slices(s, d), "site-slices"))
    features = support.select("chrom", F.col("site_start").alias("start"), F.col("site_stop").alias("stop"), "allele", F.col("support").alias("p"))
    return jobs.explain_failures(failures, features, S.confident(s, d), S.reference(s, d))
