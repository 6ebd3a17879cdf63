"""Aligned reads, reference and truth derived from the ``lineitem`` table.

The driver's tables hold no reads; these are made from them with integer
arithmetic, so that they grow with the table and other engines can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bases of one reference chunk.
CHUNK = 10_000
CHROMS = 5
READ = 40


def genome_size(spark: SparkSession, sf_dir: str) -> int:
    """Positions of each chromosome; the count comes from the Parquet footers."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 3


def reference_code(pos: str, cn: str) -> str:
    return f"(({pos} * 7 + ({pos} * {pos}) % 101 + {cn} * 13) % 4)"


def base(code: str) -> str:
    return f"substring('ACGT', cast({code} AS int) + 1, 1)"


#: The code of a position comes again after so many, and that of the next chromosome is one more: all texts are pieces of one.
PERIOD, _REACH = 404, 404 + READ + 2
_ONCE = ["".join("ACGT"[(p * 7 + p * p % 101 + cn) % 4] for p in range(PERIOD)) for cn in range(4)]
_TEXT = "".join(t + t[: _REACH - PERIOD] for t in _ONCE)
#: Columns that ``with_texts`` takes away again.
_RAW = ("cn", "ok", "pk", "q0", "m")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads without their texts, qualities and operations, but with the numbers these are made of: gates and choices among reads need no more."""
    g = genome_size(spark, sf_dir)
    found = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "1 + l_orderkey % 5 AS cn", "l_orderkey AS ok", "l_partkey AS pk", "l_suppkey AS sk",
        "concat(l_orderkey, '-', l_linenumber) AS read_name",
        f"(l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % ({g} - 80) + 20 AS start",
        "if(l_linestatus = 'F', 'P', 'I') AS tech", "l_returnflag = 'R' AS is_reverse",
        "cast(round(l_discount * 100) AS bigint) * 6 AS mapq", "cast(l_quantity AS bigint) AS q0",
    )
    found = found.withColumn("d", F.expr("start + 5 + pmod(200 - (start + 5), 389)"))
    found = found.withColumn("m", F.expr("if(ok % 3 = 0 AND d <= start + 34, cast(d - start AS int), NULL)"))
    return found.selectExpr(
        "concat('c', cn) AS chrom", "read_name", "start", f"start + {READ} + if(m IS NULL, 0, 2) AS end", "cast(mapq AS int) AS mapq", "is_reverse",
        "cast(1 + if(sk % 10 <> 0, 2, 0) + if(is_reverse, 16, 0) + if(sk % 29 = 0, 256, 0) + if(pk % 37 = 0, 1024, 0) AS int) AS flag", "tech", *_RAW,
    )


def _text(at: str, n: str, more: int = 0) -> str:
    """Reference text as bytes, ``at`` from the read's start; each code ``more`` larger."""
    return f"substring(X'{_TEXT.encode().hex()}', cast((cn + {more}) % 4 * {_REACH} + start % {PERIOD} + {at} + 1 AS int), {n})"


def _seq() -> str:
    """A read's text: a piece of the reference with at most two bases changed.

    Positions that are 13 mod 97 are at most one in a read, and so are those for which (pk + 17 * pos) % 211 is 0
    (17 * 149 is 1 mod 211).  Negative or missing numbers go position by position.
    """
    pos = "(start + i + if(i >= coalesce(m, 40), 2, 0))"
    code = f"({reference_code(pos, 'cn')} + CASE WHEN {pos} % 97 = 13 AND ok % 2 = 0 THEN 1 WHEN (pk + {pos} * 17) % 211 = 0 THEN 2 ELSE 0 END) % 4"
    slow = f"array_join(transform(sequence(0, {READ - 1}), i -> {base(code)}), '')"
    plain = f"if(m IS NULL, {_text('0', READ)}, concat({_text('0', 'm')}, {_text('m + 2', f'{READ} - m')}))"
    first, second = "cast(pmod(13 - start, 97) AS int)", "cast(pmod(211 - pk % 211 * 149 - start, 211) AS int)"
    place = lambda o: f"CASE WHEN m IS NULL OR {o} < m THEN {o} WHEN {o} < m + 2 THEN {READ} ELSE {o} - 2 END"
    put = lambda seq, o, more, test: f"CASE WHEN {test}({place(o)}) < {READ} THEN overlay({seq} PLACING {_text(o, 1, more)} FROM ({place(o)}) + 1) ELSE {seq} END"
    return f"CASE WHEN start >= 0 AND ok >= 0 AND pk >= 0 THEN cast({put(put(plain, second, 2, ''), first, 1, 'ok % 2 = 0 AND ')} AS string) ELSE {slow} END"


def _qual() -> str:
    """Qualities: three rows of values, each of which comes again after twelve, hold them all."""
    of = lambda r: "array(" + ", ".join(f"{5 + (r + i * 3) % 36}S" for i in range(READ + 12)) + ")"
    at = f"cast(q0 % 36 div 3 + 1 AS int), {READ}"
    slow = f"transform(sequence(0, {READ - 1}), i -> cast(5 + (q0 + i * 3) % 36 AS smallint))"
    return f"CASE WHEN q0 < 0 OR q0 IS NULL THEN {slow} WHEN q0 % 3 = 0 THEN slice({of(0)}, {at}) WHEN q0 % 3 = 1 THEN slice({of(1)}, {at}) ELSE slice({of(2)}, {at}) END"


def with_texts(found: DataFrame) -> DataFrame:
    """Whole reads of ``rows``, or of those that are left of them."""
    op = lambda code, n: f"named_struct('op', {code}, 'len', {n})"
    return found.selectExpr(
        "chrom", "read_name", "start", "end", f"{_seq()} AS seq", f"{_qual()} AS qual",
        f"if(m IS NULL, array({op(0, READ)}), array({op(0, 'm')}, {op(2, 2)}, {op(0, f'{READ} - m')})) AS cigar", "mapq", "is_reverse", "flag",
        "if(pk % 4 = 0, map('HP', cast(1 + pk % 2 AS int)), map()) AS tags", "tech", "concat('s', ok % 2) AS sample",
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``reads`` table: one row a line item, 40 bases, an optional deletion of two."""
    return with_texts(rows(spark, sf_dir))


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``reference`` table in chunks: (chrom, chunk_id, chunk_start, seq), for every chunk that a read begins in, and the one after it."""
    g = genome_size(spark, sf_dir)
    start = f"(l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % ({g} - 80) + 20"
    ids = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("1 + l_orderkey % 5 AS cn", f"({start}) div {CHUNK} AS at").distinct()
    ids = ids.selectExpr("cn", "explode(array(at, at + 1)) AS chunk_id").distinct()
    pos = f"(chunk_id * {CHUNK} + i)"
    slow = f"array_join(transform(sequence(0, {CHUNK - 1}), i -> {base(reference_code(pos, 'cn'))}), '')"
    whole = f"substring(repeat(substring('{''.join(_ONCE)}', cast(cn % 4 * {PERIOD} + 1 AS int), {PERIOD}), {CHUNK // PERIOD + 2}), cast(chunk_id * {CHUNK} % {PERIOD} + 1 AS int), {CHUNK})"
    return ids.selectExpr("concat('c', cn) AS chrom", "chunk_id", f"chunk_id * {CHUNK} AS chunk_start", f"CASE WHEN cn >= 0 AND chunk_id >= 0 THEN {whole} ELSE {slow} END AS seq")


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, length): chromosomes end where their last read does."""
    return reads(spark, sf_dir).groupBy("chrom").agg(F.max("end").cast("long").alias("length"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True variants: SNVs at positions that orders name, each 13 mod 97; positions that many orders name are one variant."""
    g = genome_size(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("1 + o_orderkey % 5 AS cn", f"((o_orderkey * 7919 + o_custkey) % (({g} + 83) div 97)) * 97 + 13 AS pos").distinct()
    return rows.selectExpr("concat('c', cn) AS chrom", "pos", f"{base(reference_code('pos', 'cn'))} AS ref", f"array({base('(' + reference_code('pos', 'cn') + ' + 1) % 4')}) AS alts", "if((pos div 97) % 3 = 0, array(1, 1), array(0, 1)) AS gt")


def confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confident intervals [1000k, 1000k + 800) at the thousands that customers name."""
    g = genome_size(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("1 + c_custkey % 5 AS cn", f"c_custkey * 31 % ({g} div 1000 + 1) AS k").distinct()
    return rows.selectExpr("concat('c', cn) AS chrom", "k * 1000 AS start", "k * 1000 + 800 AS stop")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on many small axes: a user is a chromosome, the minute of an event its position."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.selectExpr("cast(user_id AS string) AS chrom", "unix_seconds(cast(ts AS timestamp)) AS pos")


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals on many axes: a customer is a chromosome, an order spans some days."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = "cast(floor(unix_seconds(cast(o_orderdate AS timestamp)) / 86400) AS bigint)"
    return rows.selectExpr("concat('k', o_custkey % 97) AS chrom", f"{day} AS start", f"{day} + 1 + o_orderkey % 3 AS stop", "o_orderkey AS id")


def doubles(*names: str) -> list[Column]:
    return [F.col(n).cast("double").alias(n) for n in names]
