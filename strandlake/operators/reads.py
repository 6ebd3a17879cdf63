"""Aligned reads: gates, CIGAR decoding, clipping, base colours and tensors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.operators.intervals import overlap_join

#: CIGAR codes: 0 M, 1 I, 2 D, 3 N, 4 S, 5 H, 6 P, 7 =, 8 X (fixed values of the format).
BOTH, READ_ONLY, REF_ONLY = "(0, 7, 8)", "(1, 4)", "(2, 3)"


def usable(reads: DataFrame) -> DataFrame:
    """Mapped, primary, no duplicate, unpaired or properly paired, mapping quality over 0."""
    flag = F.col("flag")
    return reads.where((flag.bitwiseAND(4 | 256 | 2048 | 1024) == 0) & ((flag.bitwiseAND(1) == 0) | (flag.bitwiseAND(2) != 0)) & (F.col("mapq") > 0))


def mapq_gate(reads: DataFrame, least: int = 10) -> DataFrame:
    return reads.where(F.col("mapq") >= least)


def first_per_name(reads: DataFrame, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """The first read of each name and strand, in coordinate order (never by its text, which then need not be read)."""
    # Names first, since they differ; a row number would have Spark sort all rows before the shuffle as well, in search of rows to drop.
    w = W.partitionBy("read_name", *keys, "is_reverse").orderBy("start", "end", "mapq", "flag")
    return reads.withColumn("__after", F.lag(F.lit(1)).over(w)).where("__after IS NULL").drop("__after")


def capped(reads: DataFrame, most: int, keys: tuple[str, ...], seed: int = 13) -> DataFrame:
    """At most ``most`` reads of each region, a uniform choice by hash: the same on every run."""
    w = W.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), "read_name", "is_reverse", "start"), "read_name", "start")
    return reads.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


#: Tiles of a technology and the most reads that begin in one, in detection (fixed values).
TILE_CAPS = {"I": (400, 10_000), "P": (10_000, 1_000)}


def capped_tiles(reads: DataFrame, caps: dict[str, tuple[int, int]] = TILE_CAPS, seed: int = 13) -> DataFrame:
    """By technology at most so many of the reads that begin in one tile; technologies that are not named take the largest cap, in the widest tiles."""
    of = [F.coalesce(*(F.when(F.col("tech") == t, v[k]) for t, v in caps.items()), F.lit(max(v[k] for v in caps.values()))) for k in (0, 1)]
    w = W.partitionBy("chrom", "tech", "__tile").orderBy(F.xxhash64(F.lit(seed), "read_name", "is_reverse", "start"), "read_name", "start")
    rows = reads.withColumn("__tile", F.floor(F.col("start") / of[0])).withColumn("__n", F.row_number().over(w))
    # With a constant bound Spark drops rows before they are shuffled.
    return rows.where((F.col("__n") <= max(n for _, n in caps.values())) & (F.col("__n") <= of[1])).drop("__tile", "__n")


def hp_tag() -> Column:
    return F.coalesce(F.try_element_at("tags", F.lit("HP")), F.lit(0))


#: Operations that are placed in one go: a list of parts is extended, not one of operations, so long CIGARs stay near linear.
PART = 64
_OPS = "array<struct<op:int,len:int,ref:bigint,off:int>>"


def _few(n: int) -> str:
    """The operations of a CIGAR of ``n``, written out: such expressions are compiled, folds are not."""
    ref, off, made = "cast(start AS bigint)", "0", []
    for k in range(n):
        x = f"cigar[{k}]"
        made.append(f"named_struct('op', {x}.op, 'len', {x}.len, 'ref', {ref}, 'off', {off})")
        ref, off = f"{ref} + if({x}.op IN {BOTH} OR {x}.op IN {REF_ONLY}, {x}.len, 0)", f"{off} + if({x}.op IN {BOTH} OR {x}.op IN {READ_ONLY}, {x}.len, 0)"
    return f"array({', '.join(made)})"


def with_ops(reads: DataFrame) -> DataFrame:
    """Adds ``ops``: the CIGAR's operations with their first reference position and read offset (from 0), in order."""
    placed = f"""flatten(aggregate(sequence(0, greatest(size(cigar) - 1, 0) div {PART}), named_struct('ref', cast(start AS bigint), 'off', 0, 'of', cast(array() AS array<{_OPS}>)),
        (a, k) -> aggregate(slice(cigar, k * {PART} + 1, {PART}), named_struct('ref', a.ref, 'off', a.off, 'of', cast(array() AS {_OPS})),
            (b, x) -> named_struct(
                'ref', b.ref + if(x.op IN {BOTH} OR x.op IN {REF_ONLY}, x.len, 0),
                'off', b.off + if(x.op IN {BOTH} OR x.op IN {READ_ONLY}, x.len, 0),
                'of', concat(b.of, array(named_struct('op', x.op, 'len', x.len, 'ref', b.ref, 'off', b.off)))),
            b -> named_struct('ref', b.ref, 'off', b.off, 'of', concat(a.of, array(b.of)))), a -> a.of))"""
    short = " ".join(f"WHEN {n} THEN cast({_few(n)} AS {_OPS})" for n in (1, 2, 3))
    return reads.withColumn("ops", F.expr(f"CASE size(cigar) {short} ELSE {placed} END"))


def cigar_ops(reads: DataFrame) -> DataFrame:
    """One row a CIGAR operation: index, op, length, first reference position and read offset (from 0)."""
    rows = with_ops(reads).withColumn("n_ops", F.size("cigar"))
    return rows.select("*", F.posexplode("ops").alias("op_index", "__op")).select(*reads.columns, "n_ops", "op_index", F.col("__op.op").alias("op"), F.col("__op.len").alias("len"), F.col("__op.ref").alias("ref_pos"), F.col("__op.off").alias("offset"))


def bases(reads: DataFrame) -> DataFrame:
    """One row an aligned base: (pos, offset, base, q)."""
    ops = cigar_ops(reads).where(f"op IN {BOTH} AND len > 0")
    rows = ops.withColumn("__i", F.explode(F.expr("sequence(0, len - 1)")))
    return rows.withColumns({
        "pos": F.col("ref_pos") + F.col("__i"),
        "read_offset": F.col("offset") + F.col("__i"),
    }).withColumns({"base": F.expr("substring(seq, read_offset + 1, 1)"), "q": F.expr("cast(get(qual, read_offset) AS int)")}).drop("__i")


def indel_alleles(ops: DataFrame) -> DataFrame:
    """Deletions and insertions of CIGAR operations, without the reference text of deletions.

    A deletion is anchored one base to the left; an insertion too, as a left
    partial (nothing known to its left) when it is the first operation, a right
    partial when it is the last, else full.  ``alt`` is the read's text with
    its base before (``N`` gates look at it as well).
    """
    rows = ops.where(f"op = 1 OR op IN {REF_ONLY}").where("op <> 3")
    alt = F.expr("""CASE WHEN op = 2 THEN if(offset > 0, substring(seq, offset, 1), '')
        WHEN op_index = 0 THEN substring(seq, offset + 1, len) ELSE substring(seq, offset, len + 1) END""")
    kind = F.expr("CASE WHEN op = 2 THEN 'deletion' WHEN op_index = 0 THEN 'left' WHEN op_index = n_ops - 1 THEN 'right' ELSE 'insertion' END")
    q = F.expr("CASE WHEN op = 2 THEN if(offset > 0, get(qual, offset - 1), 60) WHEN op_index = 0 THEN array_min(slice(qual, offset + 1, len)) ELSE array_min(slice(qual, offset, len + 1)) END")
    return rows.withColumns({"pos": F.col("ref_pos") - 1, "alt": alt, "kind": kind, "q": q.cast("int")})


#: Intensities of letters; all others are 0 (fixed values).
SHADES = {"A": 250, "G": 180, "T": 100, "C": 30}


def colours() -> dict[str, Column]:
    """Base, quality, mapping quality, strand and haplotype as 0-254 intensities (fixed values)."""
    shade = lambda c: F.expr(f"CASE {c} {' '.join(f"WHEN '{x}' THEN {n}" for x, n in SHADES.items())} ELSE 0 END")
    level = lambda c, top: F.floor(254 * F.least(F.col(c), F.lit(top)) / top).cast("int")
    return {
        "base_colour": shade("base"), "ref_colour": shade("ref_base"), "quality_colour": level("q", 40), "mapq_colour": level("mapq", 60),
        "strand_colour": F.when(F.col("is_reverse"), 240).otherwise(70), "hp_colour": F.expr("CASE hp WHEN 1 THEN 120 WHEN 2 THEN 240 ELSE 0 END"),
    }


def mapped_pairs(reads: DataFrame) -> DataFrame:
    """The alignment of a read column by column: (column, state, pos, base), where a gap is ``-`` and a clip has no column."""
    ops = cigar_ops(reads).where(f"op IN {BOTH} OR op IN (1, 2, 3)").withColumn("__i", F.explode(F.expr("if(len > 0, sequence(0, len - 1), array())")))
    rows = ops.withColumns({
        "state": F.expr(f"CASE WHEN op IN {BOTH} THEN 'M' WHEN op = 1 THEN 'I' ELSE 'D' END"),
        "pos": F.expr("if(op = 1, NULL, ref_pos + __i)"),
        "base": F.expr(f"if(op IN {REF_ONLY}, '-', substring(seq, offset + __i + 1, 1))"),
    })
    before = f"aggregate(filter(slice(cigar, 1, op_index), x -> x.op NOT IN (4, 5, 6)), 0, (a, x) -> a + x.len)"
    return rows.withColumn("column", F.expr(before) + F.col("__i")).drop("__i", "op", "len", "op_index", "ref_pos", "offset", "n_ops")


def run_length(rows: DataFrame, keys: tuple[str, ...], order: str, state: str) -> DataFrame:
    """Runs of equal neighbouring states: (keys, run, state, length)."""
    w = W.partitionBy(*keys).orderBy(order)
    new = F.coalesce((F.col(state) != F.lag(state).over(w)).cast("int"), F.lit(0))
    out = rows.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return out.groupBy(*keys, "run", state).agg(F.count("*").alias("length"), F.min(order).alias("first"))


def clipped(reads: DataFrame, regions: DataFrame, flank: int) -> DataFrame:
    """Reads cut to the regions (chrom, start, stop) they overlap: at most flank + 1 read bases stay beyond each edge.

    Deleted bases do not count.  All is told from the operations, so a read is
    neither exploded nor regrouped.  An insertion that is left at an edge of the
    cut read becomes a soft clip: ``left_clip`` and ``right_clip`` count its
    bases.  One row a (read, region): (first, last, clip, left_clip, right_clip).
    """
    keyed = reads.withColumn("stop", F.col("end")).withColumn("read_start", F.col("start"))
    rows = overlap_join(keyed, regions.select("chrom", "start", "stop")).withColumnsRenamed({"b_start": "region_start", "b_stop": "region_stop"}).drop("b_chrom", "stop")
    # Bases that stay are neighbours in the read's row of aligned bases: at most so many are left out on each side.
    count = lambda n: f"aggregate(__m, 0, (a, x) -> a + cast(greatest(least({n}, x.len), 0) AS int))"
    rows = with_ops(rows).withColumn("__m", F.expr(f"filter(ops, x -> x.op IN {BOTH} AND x.len > 0)")).where("size(__m) > 0")
    rows = rows.withColumns({"__skip": F.expr(f"greatest({count('region_start - x.ref')} - {flank + 1}, 0)"), "__drop": F.expr(f"greatest({count('x.ref + x.len - region_stop')} - {flank + 1}, 0)")})
    piece = "named_struct('ref', x.ref + {s}, 'off', x.off + {s}, 'len', {n})"
    one = "transform(__m, x -> " + piece.format(s="__skip", n="x.len - __skip - __drop") + ")"
    cut = f"""aggregate(__m, named_struct('skip', __skip, 'take', {count('x.len')} - __skip - __drop, 'of', cast(array() AS array<struct<ref:bigint,off:int,len:int>>)),
        (a, x) -> named_struct('skip', greatest(a.skip - x.len, 0), 'take', a.take - greatest(least(x.len - a.skip, a.take), 0),
            'of', if(a.skip < x.len AND a.take > 0, concat(a.of, array({piece.format(s='a.skip', n='least(x.len - a.skip, a.take)')})), a.of)), a -> a.of)"""
    rows = rows.withColumn("__m", F.expr(f"if(size(__m) = 1, {one}, {cut})"))
    rows = rows.withColumns({
        "first": F.expr("__m[0].ref"), "last": F.expr("element_at(__m, -1).ref + element_at(__m, -1).len - 1"), "__from": F.expr("__m[0].off"), "__to": F.expr("element_at(__m, -1).off + element_at(__m, -1).len - 1"),
        "clip": F.expr("array_join(transform(__m, x -> substring(seq, x.off + 1, x.len)), '')"),
    })
    # An insertion right before the first or right after the last base that stays.
    edge = lambda at: f"aggregate(filter(ops, x -> x.op = 1 AND {at}), 0, (a, x) -> a + x.len)"
    key = ("chrom", "read_name", "is_reverse", "start", "region_start", "region_stop")
    return rows.select(*key, "first", "last", "clip", F.expr(edge("x.off + x.len = __from")).alias("left_clip"), F.expr(edge("x.off = __to + 1")).alias("right_clip"))


def cut_reads(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Reads cut to the disjoint regions (chrom, start, stop) they overlap: one row a (read, region) with the columns of reads.

    Bases, qualities and operations outside of the region go, as do clips and
    insertions at its edges; all by arithmetic on the operations, so that only
    what lies near a region goes on.
    """
    spans = regions.select("chrom", "start", "stop")
    rows = overlap_join(with_ops(reads).withColumn("stop", F.col("end")), spans).withColumnsRenamed({"b_start": "__lo", "b_stop": "__hi"}).drop("b_chrom", "stop")
    own = f"x.op IN {BOTH} OR x.op IN {REF_ONLY}"
    kept = f"""transform(filter(ops, x -> x.len > 0 AND CASE WHEN {own} THEN x.ref < __hi AND x.ref + x.len > __lo WHEN x.op = 1 THEN x.ref > greatest(__lo, start) AND x.ref < __hi ELSE false END), x -> named_struct(
        'op', x.op, 'len', if(x.op = 1, x.len, cast(least(__hi, x.ref + x.len) - greatest(__lo, x.ref) AS int)),
        'off', x.off + if(x.op IN {BOTH}, cast(greatest(__lo - x.ref, 0) AS int), 0)))"""
    # A read of one aligned operation is cut at once.
    first = "get(ops, 0)"
    rows = rows.withColumn("__solo", F.expr(f"coalesce(size(ops) = 1 AND {first}.op IN {BOTH} AND {first}.ref < __hi AND {first}.ref + {first}.len > __lo AND {first}.len > 0, false)"))
    one = f"array(named_struct('op', {first}.op, 'len', cast(least(__hi, {first}.ref + {first}.len) - greatest(__lo, {first}.ref) AS int), 'off', {first}.off + cast(greatest(__lo - {first}.ref, 0) AS int)))"
    rows = rows.withColumn("__kept", F.expr(f"if(__solo, {one}, {kept})"))
    rows = rows.withColumns({"__from": F.expr("coalesce(get(__kept, 0).off, 0)"), "__n": F.expr(f"if(__solo, get(__kept, 0).len, aggregate(filter(__kept, x -> x.op IN {BOTH} OR x.op = 1), 0, (a, x) -> a + x.len))")})
    new = {
        "seq": F.expr("substring(seq, __from + 1, __n)"), "qual": F.expr("slice(qual, __from + 1, __n)"), "cigar": F.expr("if(__solo, array(named_struct('op', get(__kept, 0).op, 'len', get(__kept, 0).len)), transform(__kept, x -> named_struct('op', x.op, 'len', x.len)))"),
        "start": F.greatest("start", "__lo"), "end": F.least("end", "__hi"),
    }
    return rows.select(*((new[c].cast(reads.schema[c].dataType.simpleString()).alias(c) if c in new else F.col(c)) for c in reads.columns))


def in_subregion(reads: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Reads whose span holds the first or the last base of [start, stop)."""
    first, last = F.col("start"), F.col("end") - 1
    return reads.where(((first <= start) & (start <= last)) | ((first <= stop - 1) & (stop - 1 <= last)))


def mean_coverage(reads: DataFrame, least: int = 10) -> DataFrame:
    """Mean over covered columns of reads with enough mapping quality, by chromosome and technology."""
    per = bases(mapq_gate(reads, least)).groupBy("chrom", "tech", "pos").count()
    return per.groupBy("chrom", "tech").agg(F.count("*").alias("columns"), F.sum("count").alias("total"), F.avg("count").alias("mean"))
