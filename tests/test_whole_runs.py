"""Operators that work on whole runs, against the same results base by base, on random reads and odd letters."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import pileup as P
from strandlake.operators import reads as R
from strandlake.sources import synthetic as S

CIGAR = "array<struct<op:int,len:int>>"
SCHEMA = f"chrom string, read_name string, start long, end long, seq string, qual array<smallint>, cigar {CIGAR}, mapq int, is_reverse boolean, flag int, tags map<string,int>, tech string"


def random_reads(n, seed=5, ops_most=9):
    rng, rows, text = random.Random(seed), [], "".join(random.Random(1).choice("ACGTN") for _ in range(20_000))
    for k in range(n):
        ops = [(rng.choice([0, 0, 7, 8]), rng.randint(1, 140))] if k % 3 == 0 else []
        while len(ops) < rng.randint(1, ops_most):
            ops.append((rng.choice([0, 0, 1, 2, 3, 4]), rng.randint(0, 40)))
        start, seq, end = rng.choice([rng.randint(50, 900), rng.randint(9_900, 10_050)]), "", 0
        end = start
        for op, size in ops:
            if op in (0, 7, 8):
                seq += "".join(c if rng.random() < 0.9 else rng.choice("ACGTN") for c in text[end : end + size])
            elif op in (1, 4):
                seq += "".join(rng.choice("ACGTN") for _ in range(size))
            end += size if op in (0, 2, 3, 7, 8) else 0
        rows.append(("c1", f"r{k}", start, end, seq, [rng.randint(0, 60) for _ in seq], ops, rng.randint(0, 70), rng.random() < 0.5, 0, {"HP": rng.randint(1, 2)} if rng.random() < 0.5 else {}, rng.choice("IP")))
    return rows, text


@pytest.fixture(scope="module")
def made(spark):
    rows, text = random_reads(300)
    chunks = spark.createDataFrame([("c1", 0, 0, text[:10_000]), ("c1", 1, 10_000, text[10_000:])], "chrom string, chunk_id long, chunk_start long, seq string")
    return spark.createDataFrame(rows, SCHEMA).cache(), chunks.cache()


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def base_rows(reads, reference):
    rows = R.bases(reads).withColumn("chunk_id", F.floor(F.col("pos") / P.CHUNK)).join(reference.select("chrom", "chunk_id", F.col("seq").alias("chunk_seq")), ["chrom", "chunk_id"])
    return rows.withColumn("ref_base", F.expr("substring(chunk_seq, cast(pos - chunk_id * 10000 AS int) + 1, 1)"))


def test_colours_of_whole_runs(made):
    reads, reference = made[0].withColumn("hp", R.hp_tag()), made[1].where("chunk_id = 0")  # bases without a reference don't count
    slow = base_rows(reads, reference).groupBy("chrom", "tech").agg(*(F.sum(v).alias(k) for k, v in R.colours().items()))
    same(P.channel_sums(reads, reference), slow)


def test_pairs_of_whole_runs(made):
    rows = base_rows(*made).groupBy("chrom", F.floor(F.col("pos") / 100).alias("tile"), "base", "ref_base").agg(F.count("*").alias("n"))
    same(P.base_pairs(*made, 100), rows)


@pytest.mark.parametrize("flank", [0, 5])
def test_clipped_by_operations(spark, made, flank):
    regions = [(300, 420), (500, 501), (860, 9_950), (9_990, 10_020)]
    found = R.clipped(made[0], spark.createDataFrame([("c1", *r) for r in regions], "chrom string, start long, stop long"), flank)
    want = []
    for r in made[0].collect():
        cells, at, off = [], r.start, 0
        for x in r.cigar:
            cells += [(at + i, off + i) for i in range(x.len)] if x.op in (0, 7, 8) else []
            at, off = at + (x.len if x.op in (0, 2, 3, 7, 8) else 0), off + (x.len if x.op in (0, 1, 4, 7, 8) else 0)
        for lo, hi in regions:
            left, right = [c for c in cells if c[0] < lo], [c for c in cells if c[0] >= hi]
            kept = left[max(len(left) - flank - 1, 0) :] + [c for c in cells if lo <= c[0] < hi] + right[: flank + 1]
            if r.start < hi and lo < r.end and kept:
                want.append((r.read_name, lo, kept[0][0], kept[-1][0], "".join(r.seq[o] for _, o in kept)))
    assert sorted((x.read_name, x.region_start, x["first"], x["last"], x.clip) for x in found.collect()) == sorted(want)


def test_no_row_a_base(spark, sf):
    """Reads are not exploded to bases, and texts are not made letter by letter where numbers are as given."""
    from strandlake.plans.registry import QUERIES

    for name in ("channel_colours", "read_bases_reference", "clip_reads"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "sequence(0, (len" not in plan and "read_offset" not in plan, name


def test_operations_written_out(made):
    """Short CIGARs are placed as long ones are."""
    rows = made[0].select("read_name", "start", "cigar")
    long = R.with_ops(rows.withColumn("cigar", F.expr(f"concat(cigar, cast(array(named_struct('op', 5, 'len', 0), named_struct('op', 5, 'len', 0), named_struct('op', 5, 'len', 0)) AS {CIGAR}))")))
    same(R.with_ops(rows).select("read_name", "ops"), long.select("read_name", F.expr("slice(ops, 1, size(ops) - 3)").alias("ops")))


def test_made_reads_of_odd_numbers(spark, tmp_path):
    """Texts cut out of one periodic text are those made position by position, also of negative and missing numbers."""
    path = str(tmp_path)
    spark.range(0, 3000).selectExpr("if(id % 17 = 0, NULL, id * 37 - 30000) AS l_orderkey", "cast(id % 7 AS int) AS l_linenumber", "if(id % 19 = 0, NULL, id * 91 - 90000) AS l_partkey", "id % 1000 AS l_suppkey", "if(id % 5 = 0, 'F', 'O') AS l_linestatus",
        "if(id % 3 = 0, 'R', 'N') AS l_returnflag", "(id % 11) / 100.0D AS l_discount", "if(id % 23 = 0, NULL, cast(id % 90 - 30 AS double)) AS l_quantity").write.parquet(path + "/lineitem.parquet")
    rows = S.rows(spark, path)
    pos = "(start + i + if(i >= coalesce(m, 40), 2, 0))"
    code = f"({S.reference_code(pos, 'cn')} + CASE WHEN {pos} % 97 = 13 AND ok % 2 = 0 THEN 1 WHEN (pk + {pos} * 17) % 211 = 0 THEN 2 ELSE 0 END) % 4"
    slow = rows.selectExpr("chrom", "read_name", "start", f"array_join(transform(sequence(0, 39), i -> {S.base(code)}), '') AS seq", "transform(sequence(0, 39), i -> cast(5 + (q0 + i * 3) % 36 AS smallint)) AS qual")
    same(S.with_texts(rows).select("chrom", "read_name", "start", "seq", "qual"), slow)
    at = "(chunk_id * 10000 + i)"
    chunks = S.reference(spark, path)
    same(chunks.select("chrom", "chunk_id", "seq"), chunks.selectExpr("chrom", "chunk_id", f"array_join(transform(sequence(0, 9999), i -> {S.base(S.reference_code(at, 'cast(substring(chrom, 2) AS bigint)'))}), '') AS seq"))


def test_reads_of_one_operation_are_cut_as_others(spark):
    """A read with an empty operation more is cut by the list of its operations."""
    rows, _ = random_reads(120, seed=11, ops_most=1)
    reads = spark.createDataFrame(rows, SCHEMA).cache()
    regions = spark.createDataFrame([("c1", a, b) for a, b in [(100, 160), (300, 310), (500, 900), (9_950, 9_990), (9_995, 10_060)]], "chrom string, start long, stop long")
    padded = reads.withColumn("cigar", F.expr(f"concat(cigar, cast(array(named_struct('op', 5, 'len', 0)) AS {CIGAR}))"))
    assert R.cut_reads(reads, regions).count() > 30
    same(R.cut_reads(reads, regions), R.cut_reads(padded, regions))


def test_one_kind_of_records(spark):
    from strandlake.operators import scoring as C

    rows = spark.createDataFrame([("c1", p, "A", e, a, b, x / (p + e), [0.5, 0.25, 0.25]) for p in (30, 60) for e in range(3) for a, b, x in (("A", "A", 0.2), ("A", "C", 9.0), ("C", "C", 0.3))], "chrom string, pos long, ref string, expert int, a1 string, a2 string, p double, meta array<double>")
    chunk = spark.createDataFrame([("c1", 0, "GTTCA" * 2_000)], "chrom string, chunk_id long, seq string")
    exact = lambda df: df.withColumns({"p": F.round("p", 9), "qual": F.round("qual", 9)})  # sums of doubles follow the order of rows
    every = exact(C.prepared(rows, chunk)[0])
    for kind in ("mean", "best", "expert1"):
        same(exact(C.prepared(rows, chunk, kind)[0]), every.where(F.col("kind") == kind))
