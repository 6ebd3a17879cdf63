"""Registered queries of the read-pileup part, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import intervals as I
from strandlake.operators import pileup as P
from strandlake.operators import reads as R
from strandlake.plans.base import ORACLE_SQL, QUERIES, query  # noqa: F401
from strandlake.plans.sqlbase import with_tables as q
from strandlake.shared import written
from strandlake.sources import synthetic as S


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return R.mapq_gate(R.first_per_name(R.usable(S.rows(spark, d))))


def kept_reads(spark: SparkSession, d: str) -> DataFrame:
    """Usable reads, one of each name and strand, with a mapping quality of 10 or more; texts are made of the reads that are left."""
    return S.with_texts(_kept(spark, d))


def stored_reads(spark: SparkSession, d: str) -> DataFrame:
    """The same, written without their texts: for plans that look at reads several times."""
    return S.with_texts(written(_kept(spark, d), "kept-reads"))


def evidence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Resolved allele counts, and the reads they come from."""
    rows = stored_reads(spark, d)
    return P.resolve_partials(P.allele_counts(rows, S.reference(spark, d))), rows


# ---- reads

@query("usable_reads", q('SELECT chrom, read_name, start, "end", tech, mapq, is_reverse, flag FROM usable', "usable"))
def _(s, d):
    return R.usable(S.reads(s, d)).select("chrom", "read_name", "start", F.col("end").cast("long").alias("end"), "tech", F.col("mapq").cast("long").alias("mapq"), "is_reverse", F.col("flag").cast("long").alias("flag"))


@query("mapq_gate", q("SELECT chrom, tech, count(*) AS n, min(mapq) AS least FROM reads WHERE mapq >= 10 GROUP BY ALL", "reads"))
def _(s, d):
    return R.mapq_gate(S.reads(s, d)).groupBy("chrom", "tech").agg(F.count("*").alias("n"), F.min("mapq").cast("long").alias("least"))


@query("dedupe_reads", q("SELECT chrom, read_name, is_reverse, start, mapq FROM once", "once"))
def _(s, d):
    return R.first_per_name(R.usable(S.reads(s, d))).select("chrom", "read_name", "is_reverse", "start", F.col("mapq").cast("long").alias("mapq"))


@query("cap_reads")
def _(s, d):
    rows = R.usable(S.reads(s, d)).withColumn("tile", F.floor(F.col("start") / 400))
    return R.capped(rows, 10, ("chrom", "tile")).select("chrom", "tile", "read_name", "start")


@query("hp_tag", q("SELECT chrom, CAST(hp AS BIGINT) AS hp, count(*) AS n FROM reads GROUP BY ALL", "reads"))
def _(s, d):
    return S.reads(s, d).withColumn("hp", R.hp_tag().cast("long")).groupBy("chrom", "hp").agg(F.count("*").alias("n"))


@query("cigar_explode", q("SELECT chrom, pos // 100 AS tile, count(*) AS n, CAST(sum(i) AS BIGINT) AS offsets, CAST(sum(q) AS BIGINT) AS quality, count(*) FILTER (bc = 0) AS a FROM b GROUP BY ALL", "b", src="reads"))
def _(s, d):
    rows = R.bases(R.mapq_gate(S.reads(s, d))).withColumn("tile", F.floor(F.col("pos") / 100))
    return rows.groupBy("chrom", "tile").agg(F.count("*").alias("n"), F.sum("read_offset").alias("offsets"), F.sum("q").alias("quality"), F.count_if(F.col("base") == "A").alias("a"))


@query("run_length", q("""SELECT chrom, read_name, is_reverse, start, high, count(*) AS length, min(pos) AS "first" FROM (SELECT *, row_number() OVER w - row_number() OVER (PARTITION BY chrom, read_name, is_reverse, start, high ORDER BY pos) AS k FROM (SELECT *, q >= 20 AS high FROM b) WINDOW w AS (PARTITION BY chrom, read_name, is_reverse, start ORDER BY pos)) GROUP BY chrom, read_name, is_reverse, start, high, k""", "b"))
def _(s, d):
    rows = R.bases(kept_reads(s, d)).withColumn("high", F.col("q") >= 20)
    return R.run_length(rows, ("chrom", "read_name", "is_reverse", "start"), "pos", "high").select("chrom", "read_name", "is_reverse", "start", "high", "length", "first")


@query("channel_colours", q("""SELECT chrom, tech, CAST(sum(CASE bc WHEN 0 THEN 250 WHEN 2 THEN 180 WHEN 3 THEN 100 ELSE 30 END) AS BIGINT) AS base_colour, CAST(sum(CASE rc WHEN 0 THEN 250 WHEN 2 THEN 180 WHEN 3 THEN 100 ELSE 30 END) AS BIGINT) AS ref_colour,
    CAST(sum(254 * least(q, 40) // 40) AS BIGINT) AS quality_colour, CAST(sum(254 * least(mapq, 60) // 60) AS BIGINT) AS mapq_colour, CAST(sum(CASE WHEN is_reverse THEN 240 ELSE 70 END) AS BIGINT) AS strand_colour, CAST(sum(CASE hp WHEN 1 THEN 120 WHEN 2 THEN 240 ELSE 0 END) AS BIGINT) AS hp_colour FROM b GROUP BY ALL""", "b"))
def _(s, d):
    return P.channel_sums(stored_reads(s, d).withColumn("hp", R.hp_tag()), S.reference(s, d))


@query("mean_coverage", q("SELECT chrom, tech, count(*) AS columns, CAST(sum(total) AS BIGINT) AS total, round(CAST(sum(total) AS DOUBLE) / count(*), 6) AS mean FROM depth GROUP BY ALL", "depth"))
def _(s, d):
    return R.mean_coverage(kept_reads(s, d)).select("chrom", "tech", "columns", "total", F.round("mean", 6).alias("mean"))


@query("read_subregion", q("""SELECT chrom, k * 130 AS sub, read_name, start, "end" FROM (SELECT *, unnest(range(start // 130, ("end" - 1) // 130 + 1)) AS k FROM reads) WHERE (start <= k * 130 AND k * 130 <= "end" - 1) OR (start <= k * 130 + 109 AND k * 130 + 109 <= "end" - 1)""", "reads"))
def _(s, d):
    rows = S.reads(s, d).withColumn("sub", F.explode(F.expr("transform(sequence(start div 130, (end - 1) div 130), k -> k * 130)")))
    return R.in_subregion(rows, F.col("sub"), F.col("sub") + 110).select("chrom", "sub", "read_name", "start", F.col("end").cast("long").alias("end"))


@query("clip_reads", q("""SELECT chrom, read_name, is_reverse, start, region_start, min(pos) AS "first", max(pos) AS "last", count(*) AS bases FROM (SELECT *, count(*) FILTER (pos < region_start) OVER (PARTITION BY chrom, read_name, is_reverse, start, region_start ORDER BY pos DESC) AS l, count(*) FILTER (pos >= region_stop) OVER (PARTITION BY chrom, read_name, is_reverse, start, region_start ORDER BY pos) AS r
    FROM (SELECT b.*, rs AS region_start, re AS region_stop FROM b JOIN (SELECT o.chrom c2, read_name n2, is_reverse s2, o.start st2, c.start AS rs, c.stop AS re FROM once o JOIN confident c ON o.chrom = c.chrom AND o.start < c.stop AND o."end" > c.start) x ON chrom = c2 AND read_name = n2 AND is_reverse = s2 AND start = st2)) WHERE l <= 6 AND r <= 6 GROUP BY ALL""", "b", "once", "confident"))
def _(s, d):
    rows = R.clipped(kept_reads(s, d), S.confident(s, d), 5)
    return rows.select("chrom", "read_name", "is_reverse", "start", "region_start", "first", "last", F.length("clip").cast("long").alias("bases"))


# ---- pileup

@query("pileup_counts", q("SELECT chrom, pos, tech, total FROM depth", "depth"))
def _(s, d):
    return P.depth(kept_reads(s, d))


@query("allele_counts", q("SELECT chrom, pos, tech, ref, alt, kind, n FROM counts", "counts"))
def _(s, d):
    return P.allele_counts(stored_reads(s, d), S.reference(s, d)).withColumn("n", F.col("n").cast("long"))


@query("base_quality_gate", q("SELECT chrom, tech, count(*) AS n FROM b WHERE rc <> bc AND q >= 10 GROUP BY ALL", "b"))
def _(s, d):
    return P.mismatches(kept_reads(s, d), S.reference(s, d)).where("q >= 10").groupBy("chrom", "tech").agg(F.count("*").alias("n"))


@query("snv_evidence", q("SELECT chrom, pos, tech, ref, alt, n, total FROM evs", "evs"))
def _(s, d):
    return P.snv_evidence(P.with_depth(*evidence(s, d))).select("chrom", "pos", "tech", "ref", "alt", "n", "total")


@query("indel_evidence", q("SELECT chrom, pos, tech, ref, alt, n, total FROM evd", "evd"))
def _(s, d):
    return P.indel_evidence(P.with_depth(*evidence(s, d))).select("chrom", "pos", "tech", "ref", "alt", "n", "total")


@query("hybrid_evidence", q("""SELECT DISTINCT chrom, pos FROM (WITH per AS (SELECT chrom, pos, ref, alt, kind, sum(n) FILTER (tech = 'I') AS i, coalesce(sum(n) FILTER (tech = 'P'), 0) AS p FROM counts GROUP BY ALL), t AS (SELECT chrom, pos, sum(total) AS total FROM depth GROUP BY ALL), e AS (SELECT * FROM per JOIN t USING (chrom, pos) WHERE i IS NOT NULL AND (i + p) * 25 >= total * 3)
    SELECT chrom, pos FROM e WHERE kind = 'snv' AND i + p >= 2 UNION ALL SELECT chrom, unnest(range(pos, pos + length(ref))) FROM e WHERE kind <> 'snv' AND i + 2 * p >= 4)""", "counts", "depth"))
def _(s, d):
    return P.hybrid_hotspots(*evidence(s, d))


@query("detect_hotspots", q("SELECT chrom, pos FROM hot", "hot"))
def _(s, d):
    return P.hotspots(*evidence(s, d))


@query("consecutive_runs", q("SELECT chrom, start, stop, n FROM runs", "runs"))
def _(s, d):
    return I.consecutive_runs(P.hotspots(*evidence(s, d)))


# ---- intervals

@query("gap_regions", q("SELECT chrom, min(pos) - 1800 AS start, max(pos) + 1800 AS stop, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY pos) AS k FROM (SELECT chrom, pos, pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) AS gap FROM (SELECT DISTINCT * FROM pts))) GROUP BY chrom, k", "pts"))
def _(s, d):
    return I.gap_regions(S.events(s, d), 3600)


MERGED = "SELECT chrom, min(start) AS start, max(stop) AS stop, count(*) AS n FROM (SELECT *, sum(CASE WHEN start >= m THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, stop, id ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, max(stop) OVER (PARTITION BY chrom ORDER BY start, stop, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {t})) GROUP BY chrom, k"


@query("merge_overlaps", q(MERGED.format(t="spans"), "spans"))
def _(s, d):
    return I.merge_overlaps(S.order_spans(s, d))


@query("bed_widened", q(MERGED.format(t="(SELECT chrom, start - 3 AS start, stop + 3 AS stop, id FROM spans)"), "spans"))
def _(s, d):
    return I.widened(S.order_spans(s, d))


@query("consensus_regions", q(MERGED.format(t="(SELECT chrom, start, stop, id FROM spans UNION ALL SELECT chrom, start + 1, stop + 2, id FROM spans WHERE id % 7 = 0)"), "spans"))
def _(s, d):
    a = S.order_spans(s, d)
    return I.consensus_regions(a, a.where("id % 7 = 0").selectExpr("chrom", "start + 1 AS start", "stop + 2 AS stop"))


@query("overlap_join", q("SELECT r.chrom, r.read_name, r.start, c.start AS region FROM usable r JOIN confident c ON r.chrom = c.chrom AND r.start < c.stop AND c.start < r.\"end\"", "usable", "confident"))
def _(s, d):
    return I.overlap_join(R.usable(S.reads(s, d)).withColumn("stop", F.col("end")), S.confident(s, d)).select("chrom", "read_name", "start", F.col("b_start").alias("region"))


@query("in_confident", q("SELECT chrom, pos FROM hot h WHERE EXISTS (SELECT 1 FROM confident c WHERE c.chrom = h.chrom AND c.start <= pos AND pos < c.stop)", "hot", "confident"))
def _(s, d):
    return I.points_in(P.hotspots(*evidence(s, d)), S.confident(s, d))


@query("confident_sites", q("SELECT DISTINCT chrom, start, stop, n FROM runs r WHERE EXISTS (SELECT 1 FROM confident c WHERE c.chrom = r.chrom AND c.start <= r.start AND r.stop <= c.stop)", "runs", "confident"))
def _(s, d):
    return I.overlap_join(I.consecutive_runs(P.hotspots(*evidence(s, d))), S.confident(s, d), how="left_semi", inside=True)


@query("bed_intersect", q("SELECT r.chrom, greatest(r.start, c.start) AS start, least(r.stop, c.stop) AS stop FROM runs r JOIN confident c ON r.chrom = c.chrom AND r.start < c.stop AND c.start < r.stop", "runs", "confident"))
def _(s, d):
    return I.clip_intersect(I.consecutive_runs(P.hotspots(*evidence(s, d))), S.confident(s, d))


@query("chrom_extent", q("SELECT chrom, min(pos) - 10 AS start, max(pos) + 11 AS stop FROM pts GROUP BY chrom", "pts"))
def _(s, d):
    return I.extent(S.events(s, d))


@query("nearest_within", q("SELECT chrom, pos, CASE WHEN m - pos <= 40 THEN m END AS match FROM (SELECT h.chrom, h.pos, (SELECT min(t.pos) FROM truth t WHERE t.chrom = h.chrom AND t.pos >= h.pos) AS m FROM hot h)", "hot", "truth"))
def _(s, d):
    return I.nearest_within(P.hotspots(*evidence(s, d)), S.truth(s, d), 40)


@query("tile_genome", q("SELECT chrom, s AS start, least(s + 400, length) AS stop FROM (SELECT chrom, length, unnest(range(0, length, 400)) AS s FROM lengths)", "lengths"))
def _(s, d):
    return I.tiles(S.lengths(s, d), 400)


@query("hotspot_islands", q("SELECT chrom, count(*) AS islands, CAST(ceil(count(*) / 20) AS BIGINT) AS shard_size FROM runs GROUP BY chrom", "runs"))
def _(s, d):
    runs = I.consecutive_runs(P.hotspots(*evidence(s, d)))
    return runs.groupBy("chrom").agg(F.count("*").alias("islands"), F.ceil(F.count("*") / 20).alias("shard_size"))


@query("balanced_shards", q("""SELECT chrom, shard, min(start) AS start, max(stop) AS stop, CAST(sum(w) AS BIGINT) AS n FROM (SELECT * FROM (WITH RECURSIVE cuts AS (SELECT *, CASE WHEN start - lag(stop) OVER (PARTITION BY chrom ORDER BY start) + 1 >= 25 THEN 1 ELSE 0 END AS cut FROM runs),
    nb AS (SELECT *, sum(cut) OVER (PARTITION BY chrom ORDER BY start) AS block FROM cuts), bl AS (SELECT chrom, block, count(*) AS w, min(start) AS start, max(stop) AS stop FROM nb GROUP BY ALL), need AS (SELECT chrom, ceil(sum(w) / 20) AS need FROM bl GROUP BY ALL),
    walk AS (SELECT bl.*, 0 AS shard, w AS have, need FROM bl JOIN need USING (chrom) WHERE block = 0 UNION ALL SELECT bl.*, CASE WHEN have >= need THEN shard + 1 ELSE shard END, CASE WHEN have >= need THEN bl.w ELSE have + bl.w END, need FROM walk JOIN bl ON bl.chrom = walk.chrom AND bl.block = walk.block + 1) SELECT * FROM walk)) GROUP BY ALL""", "runs"))
def _(s, d):
    runs = I.consecutive_runs(P.hotspots(*evidence(s, d))).withColumn("one", F.lit(1).cast("long"))
    return I.balanced_shards(runs, 20, 25, "one").select("chrom", "shard", "start", "stop", "n")


#: Runs are shorter than the longest site, so the rule for long sites is left out here.
CLUSTERS = "cl0 AS (SELECT *, CASE WHEN start - lag(stop) OVER (PARTITION BY chrom ORDER BY start) >= 30 THEN 1 ELSE 0 END AS new FROM runs), cl1 AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY start) AS island FROM cl0), cl AS (SELECT chrom, start, stop, CAST(island AS BIGINT) AS island, (row_number() OVER (PARTITION BY chrom, island ORDER BY start) - 1) // 8 AS part FROM cl1)"


@query("capped_clusters", q("", "runs").rstrip() + ", " + CLUSTERS + " SELECT * FROM cl")
def _(s, d):
    runs = I.consecutive_runs(P.hotspots(*evidence(s, d)))
    return I.capped_clusters(runs, 30, 8).select("chrom", "start", "stop", "island", "part")


@query("segment_bounds", q("", "runs").rstrip() + ", " + CLUSTERS + """ SELECT *, greatest("first" - 15, lag("last") OVER w) AS seg_start, least("last" + 15, lead("first") OVER w) AS seg_stop FROM (SELECT chrom, island, part, min(start) AS "first", max(stop) AS "last", count(*) AS n FROM cl GROUP BY ALL) WINDOW w AS (PARTITION BY chrom, island ORDER BY part)""")
def _(s, d):
    return I.segment_bounds(I.capped_clusters(I.consecutive_runs(P.hotspots(*evidence(s, d))), 30, 8))
