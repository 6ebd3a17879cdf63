"""Text formats as DataFrames: SAM, FASTA, BED, VCF, hotspot and contig lines.

Parsers take a DataFrame with a ``value`` column, so they work on
``spark.read.text`` of any store; ``read_*`` are the file forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.intervals import widened
from strandlake.operators.reads import capped
from strandlake.operators.scans import in_ranges, latest, numbered, scanned, total
from strandlake.operators.sites import reads_by_region
from strandlake.operators.variants import canonical_truth, parse_gt

OPS = "MIDNSHP=X"


def sam(lines: DataFrame) -> DataFrame:
    """Aligned reads of SAM text; missing qualities become 40, positions count from 0."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("@") & (F.size(f) >= 11)).select(f.alias("f"))
    cigar = F.expr(f"transform(regexp_extract_all(f[5], '[0-9]+[MIDNSHP=X]', 0), x -> named_struct('op', instr('{OPS}', right(x, 1)) - 1, 'len', cast(left(x, length(x) - 1) AS int)))")
    qual = F.expr("if(f[10] = '*', array_repeat(cast(40 AS smallint), length(f[9])), transform(split(f[10], ''), x -> cast(ascii(x) - 33 AS smallint)))")
    tags = F.expr("map_from_entries(transform(filter(slice(f, 12, size(f)), x -> x LIKE '__:i:%'), x -> struct(left(x, 2), cast(substring(x, 6) AS int))))")
    rows = rows.select(
        F.col("f")[2].alias("chrom"), F.col("f")[0].alias("read_name"), (F.col("f")[3].cast("long") - 1).alias("start"), F.col("f")[9].alias("seq"), qual.alias("qual"), cigar.alias("cigar"),
        F.col("f")[4].cast("int").alias("mapq"), F.col("f")[1].cast("int").alias("flag"), tags.alias("tags"),
    )
    size = F.expr("aggregate(cigar, 0, (a, x) -> a + if(x.op IN (0, 2, 3, 7, 8), x.len, 0))")
    return rows.withColumn("end", F.col("start") + size).withColumn("is_reverse", F.col("flag").bitwiseAND(16) != 0)


def fasta(lines: DataFrame, order: str = "at", chunk: int = 10_000) -> DataFrame:
    """Chunks of a FASTA text; ``order`` numbers its lines (a file name and a line number, say).

    Contig names and line offsets are running values over ranges of lines, so
    neither the contigs nor the lines of one come to one place.  Lines before
    the first head belong to no contig and are left out.
    """
    head = F.col("value").startswith(">")
    rows = in_ranges(lines.select(F.col(order).alias("at"), "value"), "at")
    name, size = F.when(head, F.regexp_extract("value", r"^>(\S+)", 1)), F.when(head, 0).otherwise(F.length("value")).cast("long")
    rows = scanned(rows, [], ["at"], F.col("__part"), stored=True, chrom=latest(name), upto=total(size, own=False))
    first = rows.where(head).select("chrom", F.col("upto").alias("first"))  # one a contig
    rows = rows.where(~head & F.col("chrom").isNotNull()).join(first, "chrom").withColumn("start", F.col("upto") - F.col("first"))
    # A line may go over chunk borders: one piece for each chunk it touches.
    stop = "(start + length(value))"
    rows = rows.where("length(value) > 0").withColumn("chunk_id", F.explode(F.expr(f"sequence(start div {chunk}, ({stop} - 1) div {chunk})")))
    rows = rows.withColumn("piece_start", F.expr(f"greatest(start, chunk_id * {chunk})"))
    piece = F.expr(f"substring(value, cast(piece_start - start AS int) + 1, cast(least({stop}, (chunk_id + 1) * {chunk}) - piece_start AS int))")
    rows = rows.withColumn("piece", piece)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_start", "piece"))), lambda x: x["piece"]), "")
    return rows.groupBy("chrom", "chunk_id").agg(text.alias("seq")).select("chrom", "chunk_id", (F.col("chunk_id") * chunk).alias("chunk_start"), "seq")


def hotspots(lines: DataFrame) -> DataFrame:
    """Points of lines such as {'chromosome': '20', 'position': 5}."""
    x = F.from_json("value", "chromosome string, position long", {"allowSingleQuotes": "true"})
    return lines.select(x["chromosome"].alias("chrom"), x["position"].alias("pos")).where("chrom IS NOT NULL AND pos IS NOT NULL")


def bed(lines: DataFrame, guard: int = 0) -> DataFrame:
    """Intervals; with a guard band they are widened and merged."""
    f = F.split("value", "\t")
    rows = lines.where(F.size(f) >= 3).select(f[0].alias("chrom"), f[1].try_cast("long").alias("start"), f[2].try_cast("long").alias("stop")).where("start IS NOT NULL AND stop IS NOT NULL")
    return widened(rows, guard).select("chrom", "start", "stop") if guard else rows


def vcf(lines: DataFrame) -> DataFrame:
    """Truth records: alts sorted, genotype re-indexed, lines without a genotype left out."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.size(f) >= 10))
    keys, values = F.split(f[8], ":"), F.split(f[9], ":")
    gt = parse_gt(F.get(values, F.array_position(keys, "GT").cast("int") - 1))
    rows = rows.select(f[0].alias("chrom"), (f[1].cast("long") - 1).alias("pos"), f[3].alias("ref"), F.split(f[4], ",").alias("alts"), gt.alias("gt"))
    return canonical_truth(rows.where("gt IS NOT NULL"))


def failure_vcf(lines: DataFrame) -> DataFrame:
    """Two-sample comparison records that are false negative in truth or false positive in the query."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.size(f) >= 11))
    field = lambda sample, key: F.try_element_at(F.map_from_arrays(F.split(f[8], ":"), F.split(f[sample], ":")), F.lit(key))
    rows = rows.select(f[0].alias("chrom"), (f[1].cast("long") - 1).alias("start"), f[3].alias("ref"), F.split(f[4], ",").alias("alts"), *(field(9 + k, n).alias(f"{n.lower()}{k}") for k in (0, 1) for n in ("BD", "BVT", "GT")))
    gt = lambda k: F.when(F.col(f"bvt{k}") != "NOCALL", parse_gt(F.col(f"gt{k}"))).alias(f"gt{k}")
    return rows.where("bd0 = 'FN' OR bd1 = 'FP'").select("chrom", "start", (F.col("start") + F.length("ref")).alias("stop"), "ref", "alts", "bd0", "bd1", "bvt0", "bvt1", gt(0), gt(1))


def contigs(lines: DataFrame) -> DataFrame:
    """Assembly lines: region and contigs with scores."""
    schema = "chromosome string, start long, stop long, contigs array<struct<allele:string,score:double,support:int>>"
    x = F.from_json("value", schema, {"allowSingleQuotes": "true"})
    return lines.select(x["chromosome"].alias("chrom"), x["start"].alias("start"), x["stop"].alias("stop"), F.explode(x["contigs"]).alias("c")).select("chrom", "start", "stop", "c.*")


def read_sam(spark: SparkSession, *paths: str) -> DataFrame:
    return sam(spark.read.text(list(paths)))


def read_bed(spark: SparkSession, path: str, guard: int = 0) -> DataFrame:
    return bed(spark.read.text(path), guard)


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    return vcf(spark.read.text(path))


def read_hotspots(spark: SparkSession, *paths: str) -> DataFrame:
    """Many files at once, with the file each point comes from."""
    return hotspots(spark.read.text(list(paths)))


def read_file_list(spark: SparkSession, list_path: str) -> DataFrame:
    """Inputs that a list file names, one a line: Parquet, with the file of each row."""
    names = [r["value"] for r in spark.read.text(list_path).where("length(value) > 0").collect()]
    return spark.read.parquet(*names).select("*", F.col("_metadata.file_path").alias("file"))


def rates(lines: DataFrame) -> DataFrame:
    """Rows (rate, prob) of a rate distribution written as one literal, {0.5: 0.25, 1.0: 0.75}."""
    pairs = F.regexp_extract_all("value", F.lit(r"([0-9.eE+-]+)\s*:\s*([0-9.eE+-]+)"), 0)
    rows = lines.select(F.explode(pairs).alias("x")).select(F.split("x", ":").alias("x"))
    return rows.select(F.trim(F.get("x", F.lit(0))).cast("double").alias("rate"), F.trim(F.get("x", F.lit(1))).cast("double").alias("prob"))


def read_fasta(spark: SparkSession, *paths: str) -> DataFrame:
    """Chunks of FASTA files.

    A line is ordered by its file, by the part of the file it was read in, and
    by its row in that part.
    """
    rows = spark.read.text(list(paths)).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    number = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")
    return fasta(rows.select("value", F.concat_ws("|", "file_path", number("file_block_start"), number("row")).alias("at")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, value): the lines of a folder's part files, read one file after another and numbered from 0."""
    rows = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return numbered(rows, "file_path", "file_block_start", "row").select("ordinal", "value")


def read_region(spark: SparkSession, path: str, chrom: str, start: int, stop: int) -> DataFrame:
    """Stored reads that overlap [start, stop): the chromosome is a folder, positions are filtered in the scan."""
    return spark.read.parquet(path).where((F.col("chrom") == chrom) & (F.col("start") < stop) & (F.col("end") > start))


def read_regions(spark: SparkSession, path: str, regions: DataFrame, most: int = 10_000, seed: int = 13) -> DataFrame:
    """Stored reads with every region (chrom, start, stop) they overlap, at most ``most`` of each region, chosen by hash; region columns get a ``region_`` prefix."""
    found = reads_by_region(spark.read.parquet(path), regions)
    return capped(found, most, ("chrom", "region_start", "region_stop"), seed)


def read_predictions(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_examples(spark: SparkSession, *paths: str, keys: DataFrame | None = None) -> DataFrame:
    """Stored examples, one row a site with its alleles; only the sites of ``keys`` (site_key) if given."""
    rows = spark.read.parquet(*paths)
    if keys is not None:
        rows = rows.join(keys.select("site_key").distinct(), "site_key", "left_semi")
    rest = [c for c in rows.columns if c not in ("site_key", "chrom")]
    return rows.groupBy("site_key", "chrom").agg(F.sort_array(F.collect_list(F.struct("allele", *(c for c in rest if c != "allele")))).alias("alleles"))


def read_by_number(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last`` of a numbered store, in order: files and row groups without them are passed over by their statistics."""
    return spark.read.parquet(path).where(F.col("ordinal").between(first, last)).orderBy("ordinal")
