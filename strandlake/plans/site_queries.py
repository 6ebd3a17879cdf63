"""Queries over sites, haplotypes, failures and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import cells
from strandlake.operators import examples as E
from strandlake.operators import failures as X
from strandlake.operators import haplotypes as H
from strandlake.operators import intervals as I
from strandlake.operators import reads as R
from strandlake.operators import sites as T
from strandlake.operators import variants as V
from strandlake.plans import jobs
from strandlake.plans.base import query
from strandlake.plans.example_queries import alleles, ex
from strandlake.plans.queries import stored_reads
from strandlake.plans.sqlbase import letter
from strandlake.plans.sqlbase import with_tables as q
from strandlake.shared import fresh_path, written
from strandlake.sources import synthetic as S
from strandlake.sources import text

SLICES = f"""ov AS (SELECT r.chrom, r.start AS site_start, r.stop AS site_stop, u.tech, u.read_name, u.is_reverse, u.start, u."end", u.m, u.mapq FROM runs r JOIN once u ON r.chrom = u.chrom AND u.start < r.stop AND u."end" > r.start WHERE u.mapq >= 10),
    cell AS (SELECT ov.*, b.pos, b.bc, b.q FROM ov LEFT JOIN b ON b.chrom = ov.chrom AND b.read_name = ov.read_name AND b.is_reverse = ov.is_reverse AND b.start = ov.start AND b.pos >= site_start AND b.pos < site_stop),
    sl AS (SELECT chrom, site_start, site_stop, tech, read_name, is_reverse, start, mapq, coalesce(string_agg({letter('bc')}, '' ORDER BY pos) FILTER (pos IS NOT NULL), '') AS allele, coalesce(min(q), 60) AS min_q,
        CASE WHEN coalesce(site_start IN (start + m, start + m + 1) OR site_stop - 1 IN (start + m, start + m + 1), false) THEN 'Fail' WHEN start > site_start THEN 'LeftPartial' WHEN start = site_start THEN 'Success' WHEN "end" <= site_stop - 1 THEN 'RightPartial' ELSE 'Success' END AS status
        FROM cell GROUP BY chrom, site_start, site_stop, tech, read_name, is_reverse, start, mapq, m, "end"),
    sup AS (SELECT chrom, site_start, site_stop, allele, count(*) FILTER (tech = 'I') AS illumina, count(*) FILTER (tech = 'P') AS pacbio, count(*) AS support FROM sl WHERE status = 'Success' AND min_q >= 10 GROUP BY chrom, site_start, site_stop, allele)"""


def sliced(sql: str) -> str:
    return q("", "runs", "b", "once").rstrip() + ", " + SLICES.rstrip() + ("" if sql.startswith(",") else " ") + sql


def hotspots(s, d, reads):
    return jobs.hotspots_of(reads, S.reference(s, d))


def runs(s, d):
    return I.consecutive_runs(hotspots(s, d, stored_reads(s, d)))


def slices(s, d):
    reads = stored_reads(s, d)
    return T.site_slices(reads, I.consecutive_runs(hotspots(s, d, reads)))


@query("site_slice", sliced("SELECT chrom, site_start, site_stop, read_name, is_reverse, start, allele, min_q, status FROM sl"))
def _(s, d):
    return slices(s, d).select("chrom", "site_start", "site_stop", "read_name", "is_reverse", "start", "allele", F.col("min_q").cast("long").alias("min_q"), "status")


@query("allele_support", sliced("SELECT * FROM sup"))
def _(s, d):
    return T.allele_support(slices(s, d))


@query("site_alleles", sliced("SELECT chrom, site_start, site_stop, string_agg(allele, ',' ORDER BY allele) AS alleles FROM sup GROUP BY ALL"))
def _(s, d):
    return T.site_alleles(T.allele_support(slices(s, d))).withColumn("alleles", F.array_join("alleles", ","))


PARTIAL = """pt AS (SELECT chrom, site_start, site_stop, status, allele AS part, count(*) FILTER (tech = 'I') AS i, count(*) FILTER (tech = 'P') AS p FROM sl WHERE status IN ('LeftPartial', 'RightPartial') AND allele <> '' GROUP BY ALL),
    fit AS (SELECT pt.*, s.allele, count(*) OVER (PARTITION BY pt.chrom, pt.site_start, pt.site_stop, pt.status, pt.part) AS fits FROM pt JOIN sup s ON s.chrom = pt.chrom AND s.site_start = pt.site_start AND s.site_stop = pt.site_stop AND CASE WHEN pt.status = 'LeftPartial' THEN ends_with(s.allele, pt.part) ELSE starts_with(s.allele, pt.part) END),
    cr AS (SELECT chrom, site_start, site_stop, allele, sum(i) AS i, sum(p) AS p FROM fit WHERE fits = 1 GROUP BY ALL),
    full_sup AS (SELECT chrom, site_start, site_stop, allele, CAST(illumina + coalesce(i, 0) AS BIGINT) AS illumina, CAST(pacbio + coalesce(p, 0) AS BIGINT) AS pacbio, CAST(support + coalesce(i, 0) + coalesce(p, 0) AS BIGINT) AS support FROM sup LEFT JOIN cr USING (chrom, site_start, site_stop, allele))"""


def supported(sql: str) -> str:
    return sliced(", " + PARTIAL + " " + sql)


@query("partial_alleles", supported("SELECT * FROM full_sup"))
def _(s, d):
    rows = written(slices(s, d), "site-slices")
    return T.partial_support(rows, T.allele_support(rows))


@query("read_haplotype")
def _(s, d):
    rows = slices(s, d)
    regions = rows.select("chrom", "site_start", "site_stop").distinct().withColumn("region_start", F.floor(F.col("site_start") / 100) * 100)
    regions = regions.withColumn("region_stop", F.greatest(F.col("region_start") + 100, F.col("site_stop")))
    return T.read_haplotypes(rows, regions, S.reference(s, d))


@query("read_features")
def _(s, d):
    reads = stored_reads(s, d)
    rows = written(T.site_slices(reads, I.consecutive_runs(hotspots(s, d, reads))), "site-slices")
    rows = T.read_tensors(reads, rows, S.reference(s, d), total=True)
    return rows.select("chrom", "site_start", "site_stop", "allele", "read_name", "is_reverse", "start", *cells.CHANNELS)


# ---- labelling: every true variant is a region of its own

def single_regions(s, d, wrong: bool):
    rows = V.reference_slice(S.truth(s, d), S.reference(s, d), "greatest(pos - 5, 0)", "pos + 6", "segment")
    alts = F.when(F.col("pos") % 5 == 0, F.array(F.lit("NN"))).otherwise(F.col("alts")) if wrong else F.col("alts")
    site = F.struct("pos", "ref", alts.alias("alts"), "gt")
    return rows.select(F.concat_ws("_", "chrom", "pos").alias("region"), F.expr("greatest(pos - 5, 0)").alias("seg_start"), "segment", F.array(site).alias("sites"))


@query("truth_haplotypes", q("SELECT chrom || '_' || pos AS region, CASE WHEN g0 = 1 THEN 3 ELSE 2 END AS pairs, 1 AS missed FROM truth", "truth"))
def _(s, d):
    return H.truth_haplotypes(single_regions(s, d, False)).groupBy("region").agg(F.count("*").alias("pairs"), F.sum("missed").alias("missed"))


@query("candidate_haplotypes", q("SELECT chrom || '_' || pos AS region, 2 AS haplotypes FROM truth", "truth"))
def _(s, d):
    return H.candidate_haplotypes(single_regions(s, d, True)).groupBy("region").agg(F.count("*").alias("haplotypes"))


@query("label_sites", q("SELECT chrom || '_' || pos AS region, CASE WHEN pos % 5 = 0 THEN 'MISSED' ELSE 'LABELLED' END AS status, CASE WHEN pos % 5 <> 0 THEN CASE WHEN g0 = 1 THEN alt || ',' || alt WHEN ref < alt THEN ref || ',' || alt ELSE alt || ',' || ref END END AS picked FROM truth", "truth"))
def _(s, d):
    rows = H.label_sites(single_regions(s, d, False), single_regions(s, d, True))
    both = F.array_join(F.sort_array(F.array("picks0_allele", "picks1_allele")), ",")
    return rows.select("region", "status", F.when(F.col("status") == "LABELLED", both).alias("picked"))


def several_regions(s, d, wrong: bool, width: int):
    """Truth of windows of ``width`` bases as regions of several sites."""
    alts = F.when(F.col("pos") % 5 == 0, F.array(F.lit("NN"))).otherwise(F.col("alts")) if wrong else F.col("alts")
    rows = S.truth(s, d).withColumn("k", F.floor(F.col("pos") / width)).groupBy("chrom", "k").agg(F.sort_array(F.collect_list(F.struct("pos", "ref", alts.alias("alts"), "gt"))).alias("sites"), F.greatest(F.min("pos") - 5, F.lit(0)).alias("seg_start"), (F.max("pos") + 6).alias("seg_stop"))
    return V.reference_slice(rows.withColumn("region", F.concat_ws("_", "chrom", "k")), S.reference(s, d), "seg_start", "seg_stop", "segment").select("region", "seg_start", "segment", "sites")


@query("label_regions", q("""SELECT chrom || '_' || (pos // 485) AS region, pos, CASE WHEN n = 1 AND pos % 5 = 0 THEN 'MISSED' ELSE 'LABELLED' END AS status, CASE WHEN pos % 5 = 0 THEN CASE WHEN n > 1 THEN ref || ',' || ref END WHEN g0 = 1 THEN alt || ',' || alt ELSE least(ref, alt) || ',' || greatest(ref, alt) END AS picked
    FROM (SELECT *, count(*) OVER (PARTITION BY chrom, pos // 485) AS n FROM truth)""", "truth"))
def _(s, d):
    """Regions of up to five sites; some true alleles are not among the candidates."""
    rows = H.label_sites(several_regions(s, d, False, 485), several_regions(s, d, True, 485))
    both = F.array_join(F.sort_array(F.array("picks0_allele", "picks1_allele")), ",")
    return rows.select("region", "pos", "status", F.when(F.col("status") == "LABELLED", both).alias("picked"))


@query("region_haplotypes", q("SELECT chrom || '_' || (pos // 291) AS region, CAST((product(CASE WHEN g0 = 1 THEN 4 ELSE 3 END) + product(CASE WHEN g0 = 1 THEN 2 ELSE 1 END)) / 2 AS BIGINT) AS pairs, CAST(product(2) AS BIGINT) AS haplotypes FROM truth GROUP BY ALL", "truth"))
def _(s, d):
    """Truth pairs and candidate haplotypes of regions of up to three sites."""
    rows = several_regions(s, d, False, 291)
    pairs = H.truth_haplotypes(rows).groupBy("region").agg(F.count("*").alias("pairs"))
    return pairs.join(H.candidate_haplotypes(rows).groupBy("region").agg(F.count("*").alias("haplotypes")), "region")


@query("haplotype_match", q("SELECT chrom || '_' || pos AS region, CASE WHEN pos % 5 = 0 THEN 1 WHEN g0 = 1 THEN 3 ELSE 2 END AS matches FROM truth", "truth"))
def _(s, d):
    pairs = H.matched(H.truth_haplotypes(single_regions(s, d, False)), H.candidate_haplotypes(single_regions(s, d, True)))
    return pairs.groupBy("region").agg(F.count("*").alias("matches"))


# ---- failures

@query("fraction_pass", ex("SELECT site, a1, CASE WHEN s2 >= t * 0.1 THEN a2 ELSE a1 END AS a2, CASE WHEN s1 >= t * 0.1 THEN 'PASS' ELSE 'FAIL' END AS filter FROM (SELECT site, max(allele) FILTER (k = 1) AS a1, max(allele) FILTER (k = 2) AS a2, coalesce(max(support) FILTER (k = 1), 0) AS s1, coalesce(max(support) FILTER (k = 2), 0) AS s2, greatest(sum(support), 1) AS t FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY support DESC, allele DESC) AS k FROM ex) GROUP BY site)".replace("CASE WHEN s2 >= t * 0.1 THEN a2 ELSE a1 END", "CASE WHEN s2 * 10 >= t THEN a2 ELSE a1 END").replace("s1 >= t * 0.1", "s1 * 10 >= t")))
def _(s, d):
    return X.fraction_pass(alleles(s, d))


@query("top_two_alleles", ex("SELECT site, allele, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY support DESC, allele) AS k FROM ex) WHERE k <= 2"))
def _(s, d):
    return V.top_two(alleles(s, d), ("site",), "support").select("site", "allele", F.col("place").cast("long").alias("place"))


@query("failure_reason", ex("SELECT site, CASE WHEN site % 11 = 0 THEN 'DID_NOT_RUN' WHEN site % 13 = 0 THEN 'CANNOT_ANALYSE' ELSE CASE WHEN miss > 0 THEN 'ASSEMBLY' WHEN wrong > 0 THEN 'MODELING' ELSE 'CLASSIFICATION' END || CASE WHEN n > 1 THEN '_HETEROZYGOUS' ELSE '_HOMOZYGOUS' END END AS reason FROM (SELECT site, count(*) FILTER (label = 1) AS n, count(*) FILTER (label = 1 AND support = 0) AS miss, count(*) FILTER (label = 1 AND k > 2) AS wrong FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY support DESC, allele) AS k FROM ex) GROUP BY site)"))
def _(s, d):
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("site").orderBy(F.desc("support"), "allele"))
    rows = alleles(s, d).withColumn("k", rank)
    pick = lambda test, name: F.collect_list(F.when(test, F.col("allele"))).alias(name)
    lists = rows.groupBy("site").agg(pick(F.col("label") == 1, "truth"), pick(F.col("support") > 0, "found"), pick(F.col("k") <= 2, "top"))
    lists = lists.withColumn("ran", F.col("site") % 11 != 0).withColumn("analysable", F.col("site") % 13 != 0)
    return X.failure_reason(lists).select("site", "reason")


@query("missing_alleles", ex("SELECT site, string_agg(allele, ',' ORDER BY allele) AS missing FROM ex WHERE label = 1 AND support = 0 GROUP BY site"))
def _(s, d):
    return E.missing_alleles(alleles(s, d)).select("site", F.array_join("missing", ",").alias("missing"))


SWEEP = """a AS (SELECT t.chrom, pos AS start, pos + 1 AS stop FROM truth t WHERE EXISTS (SELECT 1 FROM confident c WHERE c.chrom = t.chrom AND c.start <= pos AND pos + 1 <= c.stop)), b2 AS (SELECT chrom, start, stop FROM runs r WHERE EXISTS (SELECT 1 FROM confident c WHERE c.chrom = r.chrom AND c.start <= r.start AND r.stop <= c.stop)),
    j AS (SELECT a.*, b2.start AS b_start, b2.stop AS b_stop FROM a JOIN b2 ON a.chrom = b2.chrom AND a.start < b2.stop AND b2.start < a.stop)
    SELECT *, CASE WHEN start = b_start AND stop = b_stop THEN 'EQUAL' ELSE 'INSIDE' END AS kind FROM j UNION ALL SELECT *, NULL, NULL, 'FIRST_ONLY' FROM a WHERE (chrom, start) NOT IN (SELECT (chrom, start) FROM j) UNION ALL SELECT chrom, NULL, NULL, start, stop, 'SECOND_ONLY' FROM b2 WHERE (chrom, start) NOT IN (SELECT (chrom, b_start) FROM j)"""


@query("three_way_sweep", q("", "runs", "truth", "confident").rstrip() + ", " + SWEEP)
def _(s, d):
    return X.three_way_sweep(S.confident(s, d), S.truth(s, d).selectExpr("chrom", "pos AS start", "pos + 1 AS stop"), runs(s, d))


@query("variant_groups", q("""SELECT site, "at", ref, h0, h1, CASE WHEN h0 = h1 THEN '1/1' WHEN h0 = ref THEN '0/1' WHEN h1 = ref THEN '1/0' ELSE '1/2' END AS gt FROM (SELECT site, min("at") AS "at", string_agg(ref, '' ORDER BY "at") AS ref, string_agg(h0, '' ORDER BY "at") AS h0, string_agg(h1, '' ORDER BY "at") AS h1
    FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY "at") - row_number() OVER (PARTITION BY site, d ORDER BY "at") AS k FROM (SELECT *, ref <> h0 OR ref <> h1 AS d FROM (SELECT chrom || '_' || (pos // 970) AS site, pos AS "at", ref, CASE WHEN g0 = 1 THEN alt ELSE ref END AS h0, CASE WHEN (pos // 97) % 2 = 0 THEN alt ELSE ref END AS h1 FROM truth))) WHERE d GROUP BY site, k)""", "truth"))
def _(s, d):
    rows = S.truth(s, d).selectExpr("concat(chrom, '_', floor(pos / 970)) AS site", "pos AS at", "ref", "if(gt[0] = 1, alts[0], ref) AS h0", "if((pos div 97) % 2 = 0, alts[0], ref) AS h1")
    return X.variant_groups(rows).select("site", "at", "ref", "h0", "h1", "gt")


# ---- jobs

@query("call_variants")
def _(s, d):
    rows = jobs.call_variants(S.reads(s, d), S.reference(s, d))
    return rows.select("chrom", "pos", "ref", F.array_join("alts", ",").alias("alts"), F.array_join("gt", "/").alias("gt"), F.round("qual", 6).alias("qual"))


@query("call_active_regions")
def _(s, d):
    """Calls by way of active regions: capped, cut and reconciled reads."""
    rows = jobs.call_active_regions(stored_reads(s, d), S.reference(s, d), per_base=10.0, least_coverage=5, stored=True)
    return rows.select("chrom", "pos", "ref", F.array_join("alts", ",").alias("alts"), F.array_join("gt", "/").alias("gt"), F.round("qual", 6).alias("qual"))


def share_model():
    """A model over whole read tensors: an allele's share of the reads by technology, weighed by their base quality colours."""
    def run(sites):
        import numpy as np

        out = []
        for x in sites:
            weigh = lambda reads: np.array([r[:, 2].astype(float).sum() for r in reads])
            i, p = weigh(x.illumina), weigh(x.pacbio)
            share = lambda v: np.clip(v / max(v.sum(), 1.0), 0.001, 0.999)
            out.append((np.stack([share(i), share(p), share(i + p)], axis=1), np.array([i.sum(), p.sum(), i.sum() + p.sum()]) / max(2 * (i.sum() + p.sum()), 1.0)))
        return out

    return run


@query("call_by_tensors")
def _(s, d):
    """Calls by a model that gets the read tensors of both technologies and the reference around each site."""
    rows = jobs.call_active_regions(stored_reads(s, d), S.reference(s, d), model=share_model(), width=50, per_base=10.0, least_coverage=5, stored=True)
    return rows.select("chrom", "pos", "ref", F.array_join("alts", ",").alias("alts"), F.array_join("gt", "/").alias("gt"), F.round("qual", 6).alias("qual"))


@query("dump_training")
def _(s, d):
    return jobs.dump_training(S.reads(s, d), S.reference(s, d), S.truth(s, d), S.confident(s, d))


@query("dump_examples")
def _(s, d):
    """The store of a training dump, read back: labels, support and the number of read tensors of every allele."""
    store = fresh_path(s, "training")
    jobs.dump_examples(stored_reads(s, d), S.reference(s, d), S.truth(s, d), S.confident(s, d), store, fresh_path(s, "training-vcf"), width=50, per_base=10.0, only_contained=True, stored=True)
    rows = s.read.parquet(store)
    return rows.select("ordinal", "site_key", "allele", "label", "site_label", "support", "segment", F.size("illumina_reads").alias("n_illumina"), F.size("pacbio_reads").alias("n_pacbio"))


@query("labelled_vcf_of_dump")
def _(s, d):
    """The labelled VCF file of a training dump, every line with its place in it."""
    vcf = fresh_path(s, "training-vcf")
    jobs.dump_examples(stored_reads(s, d), S.reference(s, d), S.truth(s, d), S.confident(s, d), fresh_path(s, "training"), vcf, width=50, labels_by="I", stored=True)
    return text.read_lines(s, vcf).select("ordinal", F.col("value").alias("line"))


@query("detect_hotspots_capped")
def _(s, d):
    """Hotspots of reads that are capped by tile before."""
    return jobs.detect_hotspots(S.reads(s, d), S.reference(s, d), R.TILE_CAPS)
