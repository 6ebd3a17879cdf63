"""Queries over text formats and training examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import examples as E
from strandlake.operators import sites as T
from strandlake.operators import variants as V
from strandlake.plans.base import query
from strandlake.plans.sqlbase import code, letter
from strandlake.plans.sqlbase import with_tables as q
from strandlake.shared import fresh_path
from strandlake.sources import sinks, text
from strandlake.sources import synthetic as S


# ---- sources and sinks, there and back

@query("src_reads", q("""SELECT chrom, read_name, start, "end", CAST(mapq AS BIGINT) AS mapq, flag, is_reverse, hp, q0 + 5 - 36 * 0 AS first_q0, CASE WHEN m IS NULL THEN '40M' ELSE m || 'M2D' || (40 - m) || 'M' END AS cigar FROM reads""".replace("q0 + 5 - 36 * 0 AS first_q0", "5 + q0 % 36 AS first_q"), "reads"))
def _(s, d):
    path = fresh_path(s, "sam")
    sinks.sam_lines(S.reads(s, d)).write.text(path)
    rows = text.read_sam(s, path)
    cigar = F.expr("array_join(transform(cigar, x -> concat(x.len, substring('MIDNSHP=X', x.op + 1, 1))), '')")
    return rows.select("chrom", "read_name", "start", "end", F.col("mapq").cast("long").alias("mapq"), F.col("flag").cast("long").alias("flag"), "is_reverse", F.coalesce(F.try_element_at("tags", F.lit("HP")), F.lit(0)).cast("long").alias("hp"), F.get("qual", F.lit(0)).cast("long").alias("first_q"), cigar.alias("cigar"))


@query("src_read_regions", q('SELECT r.chrom, c.start AS region_start, read_name, is_reverse, r.start, CAST(mapq AS BIGINT) AS mapq FROM reads r JOIN confident c ON r.chrom = c.chrom AND r.start < c.stop AND r."end" > c.start', "reads", "confident"))
def _(s, d):
    """Reads of all confident regions out of a store; no region reaches the cap of 10,000."""
    path = fresh_path(s, "reads")
    sinks.write_reads(S.reads(s, d), path)
    return text.read_regions(s, path, S.confident(s, d)).select("chrom", "region_start", "read_name", "is_reverse", "start", F.col("mapq").cast("long").alias("mapq"))


@query("src_reference", q(f"SELECT 'c' || cn AS chrom, k AS chunk_id, CAST(sum(({code('k * 10000 + i')}) * (i % 97 + 1)) AS BIGINT) AS digest FROM (SELECT cn, chunk_id AS k FROM chunks), range(10000) v(i) GROUP BY ALL", "chunks"))
def _(s, d):
    chunks = S.reference(s, d)
    line = F.expr("sequence(0, length(seq) - 1, 70)")
    rows = chunks.select("chrom", "chunk_start", "seq", F.explode(line).alias("i")).select((F.substring("chrom", 2, 9).cast("long") * 1_000_000_000_000 + F.col("chunk_start") + F.col("i") + 1).alias("at"), F.expr("substring(seq, i + 1, 70)").alias("value"))
    heads = chunks.select("chrom").distinct().select((F.substring("chrom", 2, 9).cast("long") * 1_000_000_000_000).alias("at"), F.concat(F.lit(">"), "chrom").alias("value"))
    back = text.fasta(rows.unionByName(heads))
    total = F.expr("aggregate(transform(split(seq, ''), (x, i) -> (instr('ACGT', x) - 1) * (i % 97 + 1)), 0L, (a, x) -> a + x)")
    return back.select("chrom", "chunk_id", total.alias("digest"))


@query("src_hotspots", q("SELECT DISTINCT chrom, pos FROM pts", "pts"))
def _(s, d):
    return text.hotspots(sinks.hotspot_lines(S.events(s, d).distinct()))


@query("src_bed", q("SELECT chrom, start - 3 AS start, stop + 3 AS stop FROM confident", "confident"))
def _(s, d):
    return text.bed(sinks.bed_lines(S.confident(s, d)), 3)


@query("src_truth_vcf", q("SELECT chrom, pos, ref, alt, g0, g1 FROM truth", "truth"))
def _(s, d):
    rows = V.vcf_line(S.truth(s, d).withColumn("qual", F.lit(30.0)).withColumn("filter", F.lit("PASS")).withColumn("info", F.lit(".")))
    back = text.vcf(rows.select(F.col("line").alias("value")))
    return back.select("chrom", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"), F.get("gt", F.lit(0)).cast("long").alias("g0"), F.get("gt", F.lit(1)).cast("long").alias("g1"))


def failure_lines(s, d):
    kind = F.expr("CASE pos % 4 WHEN 0 THEN 'FN' WHEN 1 THEN 'TP' ELSE '.' END")
    other = F.expr("CASE pos % 3 WHEN 0 THEN 'FP' ELSE 'TP' END")
    line = F.concat_ws("\t", "chrom", (F.col("pos") + 1).cast("string"), F.lit("."), "ref", F.array_join("alts", ","), F.lit("."), F.lit("."), F.lit("."), F.lit("GT:BD:BVT"), F.concat(F.lit("0/1:"), kind, F.lit(":SNP")), F.concat(F.lit("1|1:"), other, F.when(F.col("pos") % 5 == 0, ":NOCALL").otherwise(":SNP")))
    return S.truth(s, d).select(line.alias("value"))


@query("src_failure_vcf", q("SELECT chrom, pos AS start, pos + 1 AS stop, '0,1' AS gt0, CASE WHEN pos % 5 <> 0 THEN '1,1' END AS gt1 FROM truth WHERE pos % 4 = 0 OR pos % 3 = 0", "truth"))
def _(s, d):
    rows = text.failure_vcf(failure_lines(s, d))
    flat = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return rows.select("chrom", "start", "stop", flat("gt0"), flat("gt1"))


@query("src_contigs", q("SELECT chrom, pos AS start, alt AS allele, CAST(pos % 10 AS BIGINT) AS support FROM truth", "truth"))
def _(s, d):
    line = F.format_string("{'chromosome': '%s', 'start': %d, 'stop': %d, 'contigs': [{'allele': '%s', 'score': 0.5, 'support': %d}]}", "chrom", "pos", F.col("pos") + 1, F.get("alts", F.lit(0)), F.col("pos") % 10)
    return text.contigs(S.truth(s, d).select(line.alias("value"))).select("chrom", "start", "allele", F.col("support").cast("long").alias("support"))


VCF_LINES = """SELECT CAST(row_number() OVER (ORDER BY o, cn, pos) - 1 AS BIGINT) AS ordinal, line FROM (SELECT 0 AS o, 0 AS cn, 0 AS pos, '##fileformat=VCFv4.2' AS line UNION ALL SELECT 1, 0, 0, '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">' UNION ALL SELECT 2, cn, 0, '##contig=<ID=c' || cn || ',length=' || length || '>' FROM lengths
    UNION ALL SELECT 3, 0, 0, array_to_string(['#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO', 'FORMAT', 'SAMPLE1'], chr(9)) UNION ALL SELECT 4, cn, pos, array_to_string([chrom, CAST(pos + 1 AS VARCHAR), '.', ref, alt, '30.000000', 'PASS', '.', 'GT', g0 || '/' || g1], chr(9)) FROM truth)"""


@query("sink_vcf", q(VCF_LINES, "truth", "lengths"))
def _(s, d):
    """A VCF file: every line with its place in it."""
    path = fresh_path(s, "vcf")
    sinks.write_vcf(S.truth(s, d).withColumn("qual", F.lit(30.0)).withColumn("filter", F.lit("PASS")).withColumn("info", F.lit(".")), S.lengths(s, d), path)
    return text.read_lines(s, path).select("ordinal", F.col("value").alias("line"))


@query("sink_bed", q("SELECT chrom || chr(9) || start || chr(9) || stop AS value FROM confident", "confident"))
def _(s, d):
    return sinks.bed_lines(S.confident(s, d))


@query("sink_hotspots", q("SELECT DISTINCT '{''chromosome'': ''' || chrom || ''', ''position'': ' || pos || '}' AS value FROM pts", "pts"))
def _(s, d):
    return sinks.hotspot_lines(S.events(s, d).distinct())


# ---- examples: an order is a site, its lines are alleles

ALLELES = "ex0 AS (SELECT l_orderkey AS site, 'A' || (CASE WHEN l_linenumber % 3 = 0 THEN 'C' ELSE '' END) || (CASE WHEN l_linenumber > 1 THEN chr(CAST(65 + l_linenumber AS INT)) ELSE '' END) AS allele, max(l_partkey % 3 = 0) AS lab, CAST(sum(CAST(l_quantity AS BIGINT) % 20) AS BIGINT) AS support FROM lineitem GROUP BY ALL), ex AS (SELECT site, allele, CASE WHEN lab THEN 1 ELSE 0 END AS label, support FROM ex0)"


def ex(sql: str) -> str:
    return f"WITH {ALLELES} {sql}"


def alleles(s, d):
    rows = s.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey AS site", "concat('A', if(l_linenumber % 3 = 0, 'C', ''), if(l_linenumber > 1, char(65 + l_linenumber), '')) AS allele", "l_partkey % 3 = 0 AS lab", "cast(l_quantity AS bigint) % 20 AS n", "if(l_linestatus = 'F', 'P', 'I') AS tech")
    return rows.groupBy("site", "allele").agg(F.max("lab").cast("int").alias("label"), F.sum("n").alias("support"))


def site_reads(s, d):
    return alleles(s, d).select("site", "allele", "label", F.explode(F.expr("if(support > 0, sequence(1, support), array())")).alias("read"))


@query("trainable_sites", ex("SELECT site, allele, label, support FROM ex WHERE site IN (SELECT site FROM ex GROUP BY site HAVING count(*) >= 2 AND max(label) > 0)"))
def _(s, d):
    return E.trainable_sites(alleles(s, d))


@query("prune_homozygous")
def _(s, d):
    return E.prune_homozygous(alleles(s, d), 0.3)


@query("allele_fraction_qc", ex("SELECT site, allele, label, support FROM ex WHERE site NOT IN (SELECT site FROM (SELECT *, sum(support) OVER (PARTITION BY site) AS t FROM ex) WHERE label > 0.4 AND support < t * 0.25)"))
def _(s, d):
    return E.fraction_qc(alleles(s, d), 0.25)


@query("covered_truth", ex("SELECT site, allele, label, support FROM ex WHERE support > 0 AND site NOT IN (SELECT site FROM ex WHERE label > 0 AND support <= 0) AND site IN (SELECT site FROM ex WHERE support > 0 GROUP BY site HAVING count(*) >= 2)"))
def _(s, d):
    return E.covered_truth(alleles(s, d))


@query("supported_alleles", ex("SELECT site, allele, support FROM ex WHERE support > 0 AND length(allele) <= 80"))
def _(s, d):
    return E.supported(alleles(s, d)).select("site", "allele", "support")


@query("callable_sites", ex("SELECT site, count(*) AS n FROM ex GROUP BY site HAVING max(CASE WHEN allele <> 'A' THEN 1 ELSE 0 END) = 1"))
def _(s, d):
    return E.callable_sites(alleles(s, d), F.lit("A"))


@query("rejects", ex("SELECT status, count(*) AS n FROM (SELECT CASE WHEN length(allele) > 2 THEN 'TOO_LONG' WHEN label = 0 AND support = 0 THEN 'MISSED' ELSE 'DATA' END AS status FROM ex) GROUP BY ALL"))
def _(s, d):
    return E.with_status(alleles(s, d), 2).groupBy("status").agg(F.count("*").alias("n"))


@query("subsample_rates")
def _(s, d):
    return E.subsample(site_reads(s, d), [(0.25, 0.5), (0.5, 0.3), (1.0, 0.2)]).groupBy("rate").agg(F.count("*").alias("reads"), F.count_distinct("site").alias("sites"))


@query("cap_site_reads", ex("SELECT site, CAST(least(sum(support), 30) AS BIGINT) AS reads FROM ex GROUP BY site HAVING sum(support) > 0"))
def _(s, d):
    return E.cap_site_reads(site_reads(s, d), 30).groupBy("site").agg(F.count("*").alias("reads"))


@query("site_depth", "SELECT l_orderkey AS site, CASE WHEN l_linestatus = 'F' THEN 'P' ELSE 'I' END AS tech, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS depth FROM lineitem GROUP BY ALL")
def _(s, d):
    rows = s.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey AS site", "if(l_linestatus = 'F', 'P', 'I') AS tech", "cast(l_quantity AS bigint) AS support")
    return E.site_depth(rows)


@query("label_frequency", ex("SELECT indel, CAST(sum(p) AS BIGINT) AS positive, CAST(sum(n - p) AS BIGINT) AS negative, round(sum(p) / (sum(n) + 1e-15), 6) AS share FROM (SELECT site, max(CASE WHEN length(allele) <> 1 THEN 1 ELSE 0 END) AS indel, CASE WHEN sum(label) <= 1 THEN 1 ELSE 2 END AS p, count(*) AS n FROM ex GROUP BY site) GROUP BY indel"))
def _(s, d):
    return E.label_frequency(alleles(s, d)).withColumn("share", F.round("share", 6))


@query("dataset_length")
def _(s, d):
    return E.dataset_length(alleles(s, d), 16, 4)


@query("max_q", ex("SELECT round(avg(CASE WHEN k > 1 THEN ln(2) ELSE 0 END), 6) AS max_q, count(*) AS sites FROM (SELECT site, sum(label) AS k FROM ex GROUP BY site)"))
def _(s, d):
    sites = alleles(s, d).groupBy("site").agg(F.when(F.sum("label") <= 1, 0).otherwise(1).alias("site_label"))
    return E.max_q(sites).select(F.round("max_q", 6).alias("max_q"), "sites")


@query("split_train_val")
def _(s, d):
    return E.split(alleles(s, d)).groupBy("part").agg(F.count_distinct("site").alias("sites"))


@query("worker_shards")
def _(s, d):
    return E.worker_shards(alleles(s, d), 7)


@query("block_shuffle")
def _(s, d):
    return E.block_shuffle(alleles(s, d), 1).select("site", "allele", "block", "block_order", "row_order")


@query("batch_collate")
def _(s, d):
    return E.collate(alleles(s, d), 16)


@query("ranked_allele_features", ex("SELECT site, string_agg(allele, ',' ORDER BY support * 0.5 DESC, support DESC, allele DESC) AS alleles FROM ex WHERE site IN (SELECT site FROM ex GROUP BY site HAVING count(*) > 1) GROUP BY site"))
def _(s, d):
    rows = E.trainable_sites(alleles(s, d).withColumn("real", F.col("label")).withColumn("label", F.lit(1))).withColumn("score", F.col("support") * 0.5)
    return E.ranked_features(rows).select("site", F.array_join("alleles", ",").alias("alleles"))


@query("pad_or_chop", "SELECT o_orderkey AS id, greatest(8 - CAST(o_orderkey % 13 AS BIGINT), 0) AS zeros FROM orders")
def _(s, d):
    values = F.expr("if(o_orderkey % 13 = 0, cast(array() AS array<int>), array_repeat(1, cast(o_orderkey % 13 AS int)))")
    rows = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), E.pad_or_chop(values, 8).alias("v"))
    return rows.select("id", F.size(F.filter("v", lambda x: x == 0)).cast("long").alias("zeros"))


@query("depth_normalise", ex("SELECT site, round(sum((support - t) / a * (support - t) / a), 6) AS total FROM (SELECT *, avg(support) OVER (PARTITION BY site) AS t, avg(support) OVER () + 1 AS a FROM ex) GROUP BY site"))
def _(s, d):
    rows = alleles(s, d)
    mean = rows.agg((F.avg("support") + 1).alias("a"))
    lists = rows.groupBy("site").agg(F.collect_list(F.col("support").cast("double")).alias("v"), F.avg("support").alias("t")).withColumn("one", F.lit(1)).join(F.broadcast(mean.withColumn("one", F.lit(1))), "one")
    out = E.depth_normalise(F.col("v"), F.col("t"), F.col("a"))
    return lists.select("site", F.round(F.aggregate(out, F.lit(0.0), lambda x, y: x + y * y), 6).alias("total"))


@query("random_pairing")
def _(s, d):
    c = s.read.parquet(f"{d}/customer.parquet")
    rows = c.selectExpr("concat('d', c_nationkey) AS dataset", "concat('c', c_custkey % 5) AS chrom").distinct()
    return E.random_partner(rows, c.selectExpr("c_mktsegment AS partner"))


@query("sink_examples", ex("SELECT site AS site_key, allele FROM (SELECT site, allele, count(*) AS n FROM (SELECT site, allele FROM ex UNION ALL SELECT site, allele FROM ex WHERE support % 5 = 0) GROUP BY ALL) WHERE n % 2 = 1"))
def _(s, d):
    rows = alleles(s, d).withColumnRenamed("site", "site_key")
    return sinks.stored_sites(rows.unionByName(rows.where("support % 5 = 0"))).select("site_key", "allele")


@query("dataset_equality", ex("SELECT site, allele, CASE WHEN site % 7 = 0 THEN 'missing' ELSE 'support' END AS kind FROM ex WHERE site % 7 = 0 OR site % 5 = 0 UNION ALL SELECT site + 1000000000, allele, 'extra' FROM ex WHERE site % 7 = 0"))
def _(s, d):
    """A store against a copy in which some sites have moved and others have another support."""
    a = alleles(s, d)
    b = a.withColumn("support", F.when(F.col("site") % 5 == 0, F.col("support") + 1).otherwise(F.col("support"))).withColumn("site", F.when(F.col("site") % 7 == 0, F.col("site") + 1_000_000_000).otherwise(F.col("site")))
    return E.differences(a, b)


@query("keep_reads", ex("SELECT site, CAST(sum(least(support, 3)) AS BIGINT) AS reads FROM ex WHERE support > 0 GROUP BY site"))
def _(s, d):
    rows = site_reads(s, d)
    return T.keep_reads(rows, rows.where("read <= 3")).groupBy("site").agg(F.count("*").alias("reads"))


@query("add_field", ex("SELECT site, allele, support, CASE WHEN support % 2 = 0 THEN support END AS extra FROM ex"))
def _(s, d):
    rows = alleles(s, d).select("site", "allele", "support")
    return E.added_field(rows, rows.where("support % 2 = 0").select("site", "allele", F.col("support").alias("extra")))


@query("reference_segment", q(f"SELECT chrom, pos, {letter(code('pos - 2'))} || {letter(code('pos - 1'))} || ref || {letter(code('pos + 1'))} AS segment, CASE WHEN ref = 'A' THEN 0 WHEN ref = 'C' THEN 1 WHEN ref = 'G' THEN 2 ELSE 3 END AS hot FROM truth", "truth"))
def _(s, d):
    rows = V.reference_slice(S.truth(s, d), S.reference(s, d), "pos - 2", "pos + 2", "segment")
    one_hot = F.expr("transform(split(segment, ''), x -> transform(array('A', 'C', 'G', 'T'), y -> if(x = y, 1, 0)))")
    return rows.withColumn("h", one_hot).select("chrom", "pos", "segment", (F.array_position(F.get("h", F.lit(2)), 1) - 1).alias("hot"))
