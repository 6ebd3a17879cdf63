"""Per-position depth, allele counts, evidence gates and hotspot positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.operators import reads as R
from strandlake.operators.variants import reference_slice

CHUNK = 10_000
#: Bases that are compared at once; a piece without a difference is passed over whole.
PIECE = 100
#: Evidence gates (fixed values): share 0.12 = 3/25, least count 2, indel alleles of at most 100.
SHARE_NUM, SHARE_DEN, LEAST, LONGEST = 3, 25, 2, 100


def aligned_runs(reads: DataFrame) -> DataFrame:
    """Aligned runs of reads, cut at chunk borders, with their read text and qualities; two or three rows a read."""
    ops = R.cigar_ops(reads).where(f"op IN {R.BOTH} AND len > 0")
    rows = ops.withColumn("chunk_id", F.explode(F.expr(f"sequence(cast(floor(ref_pos / {CHUNK}) AS bigint), cast(floor((ref_pos + len - 1) / {CHUNK}) AS bigint))")))
    rows = rows.withColumn("run_start", F.greatest("ref_pos", F.col("chunk_id") * CHUNK)).withColumn("run_stop", F.least(F.col("ref_pos") + F.col("len"), (F.col("chunk_id") + 1) * CHUNK))
    at = "cast(offset + run_start - ref_pos AS int)"
    size = "cast(greatest(run_stop - run_start, 0) AS int)"  # a filter on chunks may be tried on a run after its text is
    return rows.withColumns({"run_seq": F.expr(f"substring(seq, {at} + 1, {size})"), "run_qual": F.expr(f"slice(qual, {at} + 1, {size})")})


def with_reference(runs: DataFrame, reference: DataFrame) -> DataFrame:
    """The reference text under each run: an equi-join on (chromosome, chunk).

    Chunks are held in pieces, of which a run takes those that it touches: a
    text would be walked over from its beginning, and bytes are copied whole.
    They are hashed, a task's share at once, so the runs need not be sorted.
    """
    # In an array of one the text is made once, not for every piece.
    pieces = f"get(transform(array(cast(seq AS binary)), s -> transform(sequence(0, {CHUNK // PIECE - 1}), k -> cast(substring(s, k * {PIECE} + 1, {PIECE}) AS string))), 0)"
    chunks = reference.select("chrom", "chunk_id", F.expr(pieces).alias("__pieces")).hint("shuffle_hash")
    rows = runs.join(chunks, ["chrom", "chunk_id"])
    first, last = f"cast(run_start - chunk_id * {CHUNK} AS int)", f"cast(run_stop - chunk_id * {CHUNK} - 1 AS int)"
    text = f"array_join(slice(__pieces, {first} div {PIECE} + 1, cast(greatest({last} div {PIECE} - {first} div {PIECE} + 1, 0) AS int)), '')"
    return rows.withColumn("run_ref", F.expr(f"substring({text}, {first} % {PIECE} + 1, {last} - {first} + 1)")).drop("__pieces")


def _events(reads: DataFrame) -> DataFrame:
    """(chrom, tech, chunk_id, pos, d): +1 where an aligned run begins and -1 where it ends.

    A read gives two events and not one row a base.  A leading insertion counts
    once more at its anchor.
    """
    runs = aligned_runs(reads).select("chrom", "tech", "chunk_id", "run_start", "run_stop")
    lead = R.cigar_ops(reads.where("get(cigar, 0).op = 1")).where("op = 1 AND op_index = 0 AND ref_pos > 0").select("chrom", "tech", F.floor((F.col("ref_pos") - 1) / CHUNK).alias("chunk_id"), (F.col("ref_pos") - 1).alias("run_start"), F.col("ref_pos").alias("run_stop"))
    rows = runs.unionByName(lead)
    ends = F.array(F.struct(F.col("run_start").alias("pos"), F.lit(1).cast("long").alias("d")), F.struct(F.col("run_stop").alias("pos"), F.lit(-1).cast("long").alias("d")))
    return rows.select("chrom", "tech", "chunk_id", F.explode(ends).alias("e")).select("chrom", "tech", "chunk_id", "e.*")


def depth(reads: DataFrame) -> DataFrame:
    """(chrom, pos, tech, total): a running sum of events that never leaves its chunk, so chromosomes are dealt over many tasks."""
    w = W.partitionBy("chrom", "tech", "chunk_id").orderBy("pos")
    steps = _events(reads).groupBy("chrom", "tech", "chunk_id", "pos").agg(F.sum("d").alias("d")).withColumn("total", F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("next", F.lead("pos").over(w))
    return steps.where("total > 0").select("chrom", F.explode(F.sequence("pos", F.col("next") - 1)).alias("pos"), "tech", "total")


def depth_at(reads: DataFrame, points: DataFrame) -> DataFrame:
    """The depth of both technologies at some points only: no row for any other position is made."""
    asked = points.select("chrom", "pos").distinct().select("chrom", F.explode(F.array(F.lit("I"), F.lit("P"))).alias("tech"), F.floor(F.col("pos") / CHUNK).alias("chunk_id"), "pos", F.lit(0).cast("long").alias("d"), F.lit(1).alias("asked"))
    rows = _events(reads).withColumn("asked", F.lit(0)).unionByName(asked)
    w = W.partitionBy("chunk_id", "chrom", "tech").orderBy("pos").rangeBetween(W.unboundedPreceding, 0)
    return rows.withColumn("total", F.sum("d").over(w)).where("asked = 1 AND total > 0").select("chrom", "pos", "tech", "total")


def mismatches(reads: DataFrame, reference: DataFrame) -> DataFrame:
    """Bases that differ from the reference: only pieces of a run that differ are looked at base by base."""
    rows = with_reference(aligned_runs(reads), reference).where("run_seq <> run_ref")
    keep = ("chrom", "tech", "read_name", "is_reverse", "mapq", "run_start", "run_qual")
    rows = rows.select(*keep, "run_seq", "run_ref", F.explode(F.expr(f"sequence(0, (length(run_seq) - 1) div {PIECE})")).alias("__k"))
    rows = rows.select(*keep, (F.col("__k") * PIECE).alias("__at"), *(F.expr(f"substring({c}, __k * {PIECE} + 1, {PIECE})").alias(c) for c in ("run_seq", "run_ref"))).where("run_seq <> run_ref")
    rows = rows.withColumn("__i", F.explode(F.expr("sequence(0, length(run_seq) - 1)"))).where("substring(run_seq, __i + 1, 1) <> substring(run_ref, __i + 1, 1)")
    return rows.select(
        "chrom", "tech", "read_name", "is_reverse", "mapq", (F.col("run_start") + F.col("__at") + F.col("__i")).alias("pos"),
        F.expr("substring(run_ref, __i + 1, 1)").alias("ref"), F.expr("substring(run_seq, __i + 1, 1)").alias("alt"), F.expr("cast(get(run_qual, __at + __i) AS int)").alias("q"),
    )


def mismatch_count(reads: DataFrame, reference: DataFrame) -> DataFrame:
    """Mismatched bases of each read that has any."""
    return mismatches(reads.withColumn("read_name", F.struct("read_name", "start")), reference).groupBy("chrom", F.col("read_name.read_name").alias("read_name"), "is_reverse", F.col("read_name.start").alias("start")).agg(F.count("*").alias("mismatches"))


def indels(reads: DataFrame, reference: DataFrame) -> DataFrame:
    """Deletion and insertion evidence with reference text."""
    some = reads.where("size(cigar) > 1 OR get(cigar, 0).op IN (1, 2)")  # others have none
    rows = reference_slice(R.indel_alleles(R.cigar_ops(some)), reference, "pos", "pos + if(op = 2, len + 1, 1)", "ref", any_length=True)
    alt = F.expr("if(op = 2 AND alt = '', substring(ref, 1, 1), alt)")
    return rows.select("chrom", "tech", "read_name", "is_reverse", "mapq", "pos", "ref", alt.alias("alt"), "q", "kind")


def allele_counts(reads: DataFrame, reference: DataFrame, least_q: int = 10) -> DataFrame:
    """(chrom, pos, tech, ref, alt, kind, n): gated evidence; indels count 2 for Illumina, 1 for PacBio."""
    snv = mismatches(reads, reference).withColumn("kind", F.lit("snv"))
    rows = snv.unionByName(indels(reads, reference)).where((F.col("q") >= least_q) & ~F.contains(F.col("ref"), F.lit("N")) & ~F.contains(F.col("alt"), F.lit("N")))
    weight = F.when((F.col("kind") != "snv") & (F.col("tech") == "I"), 2).otherwise(1)
    return rows.groupBy("chrom", "pos", "tech", "ref", "alt", "kind").agg(F.sum(weight).alias("n"))


def resolve_partials(counts: DataFrame) -> DataFrame:
    """Partial insertions are credited to the one full allele they match, else dropped.

    The alleles of a position (no more than its reads) are one row: which full
    alleles a partial fits does not depend on counts, so both sides resolve
    there without further joins.
    """
    rows = counts.groupBy("chrom", "pos", "tech").agg(F.collect_list(F.struct("ref", "alt", "kind", "n")).alias("a"), F.bool_or(F.col("kind").isin("left", "right")).alias("parts"))
    rows = rows.withColumn("whole", F.expr("filter(a, x -> x.kind NOT IN ('left', 'right'))"))
    part = lambda side, test: f"aggregate(filter(a, p -> p.kind = '{side}' AND {test}(x.alt, p.alt) AND size(filter(whole, y -> {test}(y.alt, p.alt))) = 1), 0L, (t, p) -> t + p.n)"
    credit = f"named_struct('ref', x.ref, 'alt', x.alt, 'n', x.n + {part('left', 'endswith')} + {part('right', 'startswith')})"
    # Most positions have no partial.
    rows = rows.select("chrom", "pos", "tech", F.explode(F.expr(f"if(parts, transform(whole, x -> {credit}), transform(a, x -> named_struct('ref', x.ref, 'alt', x.alt, 'n', x.n)))")).alias("x"))
    return rows.select("chrom", "pos", "tech", "x.ref", "x.alt", "x.n")


def with_depth(counts: DataFrame, reads: DataFrame) -> DataFrame:
    """Allele counts with the depth of their technology at their position.

    Counts are put among the events of the reads, so that one running sum gives
    the depth just where it is asked for: no table of depths, no join.
    """
    rows = _events(reads).withColumns({"ref": F.lit(None).cast("string"), "alt": F.lit(None).cast("string"), "n": F.lit(None).cast("long")})
    asked = counts.select("chrom", "tech", F.floor(F.col("pos") / CHUNK).alias("chunk_id"), "pos", F.lit(0).cast("long").alias("d"), "ref", "alt", F.col("n").cast("long").alias("n"))
    w = W.partitionBy("chunk_id", "chrom", "tech").orderBy("pos").rangeBetween(W.unboundedPreceding, 0)
    return rows.unionByName(asked).withColumn("total", F.sum("d").over(w)).where("ref IS NOT NULL AND total > 0").select("chrom", "pos", "tech", "ref", "alt", "n", "total")


#: Gates as conditions in integers, so that they are exact.
SNV = f"length(ref) = 1 AND length(alt) = 1 AND n * {SHARE_DEN} >= total * {SHARE_NUM} AND n >= {LEAST}"
INDEL = f"NOT (length(ref) = 1 AND length(alt) = 1) AND greatest(length(ref), length(alt)) <= {LONGEST} AND n * {SHARE_DEN} >= total * {SHARE_NUM} AND n >= if(tech = 'I', {2 * LEAST}, {LEAST})"


def snv_evidence(rows: DataFrame) -> DataFrame:
    """Single bases with enough share and count."""
    return rows.where(SNV)


def indel_evidence(rows: DataFrame) -> DataFrame:
    return rows.where(INDEL)


def marked(rows: DataFrame, beyond: int = 1) -> DataFrame:
    """Positions that indels mark: from the anchor to ``beyond`` bases past the reference allele."""
    return rows.select("chrom", F.explode(F.expr(f"sequence(pos, pos + length(ref) - 1 + {beyond})")).alias("pos"))


def hotspots(counts: DataFrame, reads: DataFrame) -> DataFrame:
    """Distinct differing positions, the union over technologies; one pass over the counts for both gates."""
    spots = F.expr(f"CASE WHEN {SNV} THEN array(pos) WHEN {INDEL} THEN sequence(pos, pos + length(ref)) ELSE array() END")
    return with_depth(counts, reads).select("chrom", F.explode(spots).alias("pos")).distinct()


def hybrid_hotspots(counts: DataFrame, reads: DataFrame, include_pacbio_keys: bool = False) -> DataFrame:
    """Positions from both technologies together, on the Illumina alleles (or all, if asked)."""
    total = depth_at(reads, counts)
    per = counts.groupBy("chrom", "pos", "ref", "alt").agg(F.sum(F.when(F.col("tech") == "I", F.col("n"))).alias("i"), F.coalesce(F.sum(F.when(F.col("tech") == "P", F.col("n"))), F.lit(0)).alias("p"))
    if not include_pacbio_keys:
        per = per.where("i IS NOT NULL")
    per = per.withColumn("i", F.coalesce("i", F.lit(0))).join(total.groupBy("chrom", "pos").agg(F.sum("total").alias("total")), ["chrom", "pos"])
    share = f"(i + p) * {SHARE_DEN} >= total * {SHARE_NUM}"
    single = "length(ref) = 1 AND length(alt) = 1"
    snv = per.where(f"{single} AND {share} AND i + p >= {LEAST}").select("chrom", "pos")
    indel = per.where(f"NOT ({single}) AND {share} AND i + 2 * p >= {2 * LEAST}")
    return snv.unionByName(marked(indel, 0)).distinct()


def with_reference_base(bases: DataFrame, reference: DataFrame) -> DataFrame:
    """Aligned bases with the reference base under each: an equi-join on (chromosome, chunk)."""
    chunks = reference.select("chrom", "chunk_id", F.col("seq").cast("binary").alias("__seq"))
    rows = bases.withColumn("chunk_id", F.floor(F.col("pos") / CHUNK)).join(chunks, ["chrom", "chunk_id"])
    return rows.withColumn("ref_base", F.expr(f"cast(substring(__seq, cast(pos - chunk_id * {CHUNK} AS int) + 1, 1) AS string)")).drop("__seq", "chunk_id")


#: Letters that are counted in texts as a whole; any other is looked at by itself.
LETTERS = "ACGT"


def letters(text: str, weight: dict[str, int]) -> str:
    """The sum of the weights of a text's letters."""
    return " + ".join(f"{n} * (length({text}) - length(replace({text}, '{x}', '')))" for x, n in weight.items())


def base_pairs(reads: DataFrame, reference: DataFrame, width: int) -> DataFrame:
    """(chrom, tile, base, ref_base, n): aligned bases of each tile by their letter and that of the reference.

    Letters of a run's piece of the reference are counted as if the read had the
    same; where it differs, that is put right.
    """
    rows = with_reference(aligned_runs(reads), reference)
    rows = rows.select("chrom", "run_start", "run_stop", "run_seq", "run_ref", F.explode(F.expr(f"sequence(cast(floor(run_start / {width}) AS bigint), cast(floor((run_stop - 1) / {width}) AS bigint))")).alias("tile"))
    at, n = f"cast(greatest(tile * {width} - run_start, 0) AS int) + 1", f"cast(least((tile + 1) * {width}, run_stop) - greatest(tile * {width}, run_start) AS int)"
    rows = rows.select("chrom", "tile", *(F.expr(f"substring({c}, {at}, {n})").alias(c) for c in ("run_seq", "run_ref")))
    rows = rows.select("*", *(F.expr(letters("run_ref", {x: 1})).cast("long").alias(f"n{x}") for x in LETTERS))
    known = " + ".join(f"n{x}" for x in LETTERS)
    rows = rows.withColumn("__i", F.explode(F.expr(f"sequence(-1, if(run_seq = run_ref AND {known} = length(run_ref), -1, length(run_ref) - 1))")))
    base, ref = "substring(run_seq, __i + 1, 1)", "substring(run_ref, __i + 1, 1)"
    odd = f"{ref} NOT IN ({', '.join(repr(x) for x in LETTERS)})"
    rows = rows.where(f"__i < 0 OR {base} <> {ref} OR {odd}")
    cell = lambda b, r, k: f"named_struct('base', {b}, 'ref_base', {r}, 'n', {k})"
    cells = f"""CASE WHEN __i < 0 THEN array({', '.join(cell(repr(x), repr(x), f'n{x}') for x in LETTERS)}) WHEN {odd} THEN array({cell(base, ref, '1L')})
        ELSE array({cell(base, ref, '1L')}, {cell(ref, ref, '-1L')}) END"""
    rows = rows.select("chrom", "tile", F.explode(F.expr(cells)).alias("x")).select("chrom", "tile", "x.*").where("n <> 0")
    return rows.groupBy("chrom", "tile", "base", "ref_base").agg(F.sum("n").alias("n")).where("n > 0")


def channel_sums(reads: DataFrame, reference: DataFrame) -> DataFrame:
    """Sums of the colours (``reads.colours``) of all aligned bases by chromosome and technology; reads have their ``hp``.

    What a read says by itself is summed by chunk, so that for the reference
    colours only the places of runs are moved.
    """
    c = R.colours()
    shade = {x: R.SHADES[x] for x in LETTERS}
    runs = aligned_runs(reads)
    size = F.col("run_stop") - F.col("run_start")
    whole = {"base_colour": F.expr(letters("run_seq", shade)), **{k: c[k] * size for k in ("mapq_colour", "strand_colour", "hp_colour")}}
    own = runs.groupBy("chrom", "tech", "chunk_id").agg(*(F.sum(v).alias(k) for k, v in whole.items()), F.lit(None).cast("long").alias("quality_colour"))
    levels = runs.select("chrom", "tech", "chunk_id", F.explode("run_qual").alias("q")).groupBy("chrom", "tech", "chunk_id", "q").agg(F.count("*").alias("n"))
    levels = levels.groupBy("chrom", "tech", "chunk_id").agg(F.sum(c["quality_colour"] * F.col("n")).alias("quality_colour"))
    own = own.unionByName(levels.select("chrom", "tech", "chunk_id", *(F.lit(None).cast("long").alias(k) for k in whole), "quality_colour"))
    own = own.join(reference.select("chrom", "chunk_id"), ["chrom", "chunk_id"], "left_semi").groupBy("chrom", "tech").agg(*(F.sum(k).alias(k) for k in own.columns[3:]))
    under = with_reference(runs.select("chrom", "tech", "chunk_id", "run_start", "run_stop"), reference).groupBy("chrom", "tech").agg(F.sum(F.expr(letters("run_ref", shade))).alias("ref_colour"))
    return own.join(under, ["chrom", "tech"]).select("chrom", "tech", *c)


def op_alleles(reads: DataFrame, reference: DataFrame) -> DataFrame:
    """Every difference from the reference, one row a read and event: mismatch, deletion, insertion, left or right partial."""
    return mismatches(reads, reference).withColumn("kind", F.lit("snv")).unionByName(indels(reads, reference))
