"""Text and Parquet outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.examples import block_shuffle
from strandlake.operators.scans import numbered
from strandlake.operators.variants import UNNUMBERED, chrom_order, header, vcf_line


def sam_lines(reads: DataFrame) -> DataFrame:
    cigar = F.expr("array_join(transform(cigar, x -> concat(x.len, substring('MIDNSHP=X', x.op + 1, 1))), '')")
    qual = F.expr("array_join(transform(qual, x -> char(x + 33)), '')")
    tags = F.expr("array_join(transform(map_entries(tags), x -> concat(x.key, ':i:', x.value)), '\\t')")
    line = F.concat_ws("\t", "read_name", F.col("flag").cast("string"), "chrom", (F.col("start") + 1).cast("string"), F.col("mapq").cast("string"), cigar, F.lit("*"), F.lit("0"), F.lit("0"), "seq", qual, F.when(tags != "", tags))
    return reads.select(line.alias("value"))


def bed_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("stop").cast("string")).alias("value"))


def hotspot_lines(points: DataFrame) -> DataFrame:
    return points.select(F.format_string("{'chromosome': '%s', 'position': %d}", "chrom", "pos").alias("value"))


def write_hotspots(points: DataFrame, path: str, shard: str = "shard") -> None:
    """A folder for each shard."""
    hotspot_lines_with = points.select(F.col(shard), F.format_string("{'chromosome': '%s', 'position': %d}", "chrom", "pos").alias("value"))
    hotspot_lines_with.write.partitionBy(shard).text(path)


def write_bed(rows: DataFrame, path: str) -> None:
    bed_lines(rows).write.text(path)


def vcf_lines(records: DataFrame, chroms: DataFrame) -> DataFrame:
    """Header and records with sort keys; ordered by (ord, chrom, pos), so that no contig is interleaved with another."""
    body = vcf_line(records).select((100_000_000 + F.least(F.coalesce(chrom_order(F.col("chrom")), F.lit(UNNUMBERED)), F.lit(UNNUMBERED))).cast("long").alias("ord"), "chrom", "pos", "line")
    top = header(chroms).select("ord", "chrom", F.lit(-1).cast("long").alias("pos"), "line")
    return top.unionByName(body)


def write_vcf(records: DataFrame, chroms: DataFrame, path: str) -> None:
    """Range partitions in order, each sorted: part files read one after another are one sorted file."""
    rows = vcf_lines(records, chroms)
    keys = ["ord", "chrom", "pos"]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.col("line").alias("value")).write.text(path)


def write_examples(examples: DataFrame, path: str, repeats: str = "delete") -> None:
    """A keyed store of examples, with all their columns, by chromosome.

    A repeated (site, allele) deletes the stored one, so only odd counts stay;
    with ``repeats="first"`` one row of each stays, the least of them.  Rows
    are numbered from 0 in the order of chromosome, site and allele
    (``ordinal``); files are ranges of these numbers, so that examples are
    found by number as well as by key from the files' statistics.
    """
    kept = numbered(stored_sites(examples, repeats), "chrom", "site_key", "allele")
    kept.repartitionByRange("ordinal").sortWithinPartitions("ordinal").write.partitionBy("chrom").parquet(path)


def stored_sites(examples: DataFrame, repeats: str = "delete") -> DataFrame:
    """What stays when a repeated (site, allele) deletes the stored one (or, for ``first``, one row of each): of several rows the least."""
    if repeats not in ("delete", "first"):
        raise ValueError("repeats is delete or first")
    rest = [c for c in examples.columns if c not in ("site_key", "allele")]
    rows = examples.groupBy("site_key", "allele").agg(F.count("*").alias("times"), F.min(F.struct(F.lit(0).alias("__none"), *rest)).alias("row"))
    rows = rows.where("times % 2 = 1") if repeats == "delete" else rows
    return rows.select(*(F.col(c) if c in ("site_key", "allele") else F.col(f"row.`{c}`").alias(c) for c in examples.columns))


def write_shuffled(rows: DataFrame, path: str, epoch: int, blocks: int = 64, seed: int = 13) -> None:
    """A store in the order of an epoch: blocks by hash, rows inside a block by hash; ``ordinal`` numbers the rows."""
    ordered = numbered(block_shuffle(rows, epoch, blocks, seed), "block_order", "block", "row_order", "site", "allele")
    ordered.repartitionByRange("ordinal").sortWithinPartitions("ordinal").write.parquet(path)


def compact(paths: list[str], out: str, spark, files: int = 8) -> None:
    """Many small stores into one with few files."""
    spark.read.parquet(*paths).repartition(files, "site_key").write.parquet(out)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Site predictions by chromosome."""
    predictions.write.partitionBy("chrom").parquet(path)


def write_reads(reads: DataFrame, path: str) -> None:
    """Reads by chromosome, ordered by their start, so that a region's row groups are told by their statistics."""
    reads.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start").write.partitionBy("chrom").parquet(path)


def labelled_lines(records: DataFrame) -> DataFrame:
    """VCF lines of labelled sites (chrom, pos, ref, alts, gt, status): PASS, UNLABELED (no label) or NO_ALT; rejects are left out."""
    kind = F.when(F.col("status") != "LABELLED", "UNLABELED").when(F.size("alts") == 0, "NO_ALT").otherwise("PASS")
    rows = records.where("status NOT IN ('TOO_LONG', 'REJECTED')").withColumn("filter", kind)
    rows = rows.withColumn("alts", F.when(F.size("alts") == 0, F.array(F.lit("."))).otherwise(F.col("alts")))
    rows = rows.withColumn("gt", F.when(F.col("status") == "LABELLED", F.col("gt")).otherwise(F.array(F.lit(0), F.lit(0))))
    return vcf_line(rows.withColumn("qual", F.lit(0.0)).withColumn("info", F.lit(".")))
