"""Variant records: alleles, genotypes, normalisation and VCF lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.shared import written

CHUNK = 10_000
#: Contigs without a number come after all that have one.
UNNUMBERED = 10_000_000


def reference_slice(rows: DataFrame, reference: DataFrame, start: str, stop: str, out: str = "slice", any_length: bool = False) -> DataFrame:
    """Adds the reference text of [start, stop); equi-joins on chunks.

    A span may go over one chunk border.  With ``any_length`` it may go over
    any number: longer spans are put together from all chunks that they touch.
    Without, such a span is an error.
    """
    a = reference.select("chrom", F.col("chunk_id").alias("__chunk"), F.col("seq").cast("binary").alias("__a")).hint("shuffle_hash")  # bytes: a piece is found at once
    b = reference.select("chrom", (F.col("chunk_id") - 1).alias("__chunk"), F.col("seq").cast("binary").alias("__b")).hint("shuffle_hash")
    keyed = rows.withColumn("__start", F.expr(f"greatest({start}, 0)")).withColumn("__chunk", F.floor(F.col("__start") / CHUNK))
    far = F.coalesce(F.expr(f"({stop}) > (__chunk + 2) * {CHUNK}"), F.lit(False))
    joined = (keyed.where(~far) if any_length else keyed).join(a, ["chrom", "__chunk"], "left").join(b, ["chrom", "__chunk"], "left")
    at, n = f"cast(__start - __chunk * {CHUNK} AS int)", f"cast(greatest(({stop}) - __start, 0) AS int)"
    text = F.expr(f"cast(concat(substring(__a, {at} + 1, {n}), substring(coalesce(__b, X''), 1, greatest({at} + {n} - {CHUNK}, 0))) AS string)")
    if not any_length:
        text = F.when(far & (F.length("__b") == CHUNK), F.raise_error(F.lit("a span goes over more than two reference chunks")).cast("string")).otherwise(text)
    near = joined.withColumn(out, text).drop("__a", "__b", "__start", "__chunk")
    if not any_length:
        return near
    row = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    pieces = keyed.where(far).select("chrom", "__start", F.expr(f"cast(({stop}) AS bigint)").alias("__stop"), row.alias("__row"), F.monotonically_increasing_id().alias("__id"), "__chunk")
    pieces = pieces.withColumn("__from", F.col("__chunk")).withColumn("__chunk", F.explode(F.sequence(F.col("__from"), F.floor((F.col("__stop") - 1) / CHUNK))))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__chunk", F.col("__a").cast("string").alias("s")))), lambda x: x["s"]), "")
    pieces = pieces.join(a, ["chrom", "__chunk"], "left").groupBy("__id").agg(F.first("__row").alias("__row"), F.first("__start").alias("__start"), F.first("__stop").alias("__stop"), F.first("__from").alias("__from"), whole.alias("__text"))
    cut = F.expr(f"substring(__text, cast(__start - __from * {CHUNK} AS int) + 1, cast(__stop - __start AS int))")
    return near.unionByName(pieces.select("__row.*", cut.alias(out)))


def phred(p: Column) -> Column:
    return -10 * F.log10(1 - F.least(p, F.lit(1 - 1e-8)))


def parse_gt(gt: Column) -> Column:
    """'a|b' or 'a/b' as integers; anything else is null."""
    parts = F.split(gt, r"[|/]")
    ints = F.transform(parts, lambda x: x.try_cast("int"))
    return F.when((F.size(parts) >= 1) & F.forall(ints, lambda x: x.isNotNull()), ints)


def chrom_order(chrom: Column) -> Column:
    """Number of a chromosome: X is 23, Y is 24, a name that ends in a whole number is that number; any other name has none."""
    name = F.regexp_replace(chrom, "^chr", "")
    return F.when(name == "X", 23).when(name == "Y", 24).otherwise(F.regexp_extract(name, r"^[A-Za-z]*(\d+)$", 1).try_cast("int"))


def alleles_of_gt(ref: Column, alts: Column, gt: Column) -> Column:
    every = F.concat(F.array(ref), alts)
    return F.array_distinct(F.transform(gt, lambda i: F.get(every, i)))


def canonical_truth(rows: DataFrame) -> DataFrame:
    """Alts sorted, genotype re-indexed by allele, a single call doubled."""
    rows = rows.withColumn("__old", F.concat(F.array("ref"), "alts")).withColumn("alts", F.sort_array("alts"))
    rows = rows.withColumn("__new", F.concat(F.array("ref"), "alts"))
    gt = F.transform("gt", lambda i: (F.array_position("__new", F.get("__old", i)) - 1).cast("int"))
    rows = rows.withColumn("gt", F.when(F.size("gt") == 1, F.concat(gt, gt)).otherwise(gt))
    return rows.drop("__old", "__new")


def candidate_record(rows: DataFrame) -> DataFrame:
    """Site alleles as a record: alts without the reference, default genotype 0/0."""
    return rows.withColumn("alts", F.array_remove("alleles", F.col("ref"))).withColumn("gt", F.array(F.lit(0), F.lit(0)))


def allele_index(alleles: Column, allele: Column) -> Column:
    return (F.array_position(alleles, allele) - 1).cast("int")


def number_alleles(rows: DataFrame) -> DataFrame:
    """Genotype of the called pair (a1, a2): reference 0, alts 1..n in sorted order.

    If only the reference is called, the other alleles of the site become alts
    with genotype 0/0; a site with no other allele gives no row.
    """
    called = F.array_sort(F.array_except(F.array_distinct(F.array("a1", "a2")), F.array("ref")))
    rest = F.array_sort(F.array_except("alleles", F.array("ref")))
    rows = rows.withColumn("alts", F.when(F.size(called) > 0, called).otherwise(rest)).where(F.size("alts") > 0)
    index = lambda a: F.when(F.col(a) == F.col("ref"), 0).otherwise(F.array_position("alts", F.col(a)).cast("int"))
    return rows.withColumn("gt", F.when(F.size(called) > 0, F.array(index("a1"), index("a2"))).otherwise(F.array(F.lit(0), F.lit(0))))


def normalise(rows: DataFrame, reference: DataFrame, width: int = 50) -> DataFrame:
    """Left-aligned, parsimonious (pos, ref, alts).

    ``width`` reference bases go before every allele; the longest common suffix
    is cut, leaving a base in each, then the longest common prefix.  A row whose
    suffix reaches the context has only come as far to the left as that; it
    goes on from there with ten times the context (half a chunk at most), as
    often as it takes, so no row is lost however far it moves.  The input is
    written once; later rounds see the few rows that still move.
    """
    todo = rows.where("exists(alts, a -> a <> ref)")
    done = None
    while True:
        cut = written(_cut(todo, reference, width), "normalised")
        part = cut.where("NOT __short").select(rows.columns)
        done = part if done is None else done.unionByName(part)
        todo = cut.where("__short").select(*(F.col(f"__{c}").alias(c) if c in ("pos", "ref", "alts") else F.col(c) for c in rows.columns))
        if todo.isEmpty():
            return done
        width = min(width * 10, CHUNK // 2)


def _cut(rows: DataFrame, reference: DataFrame, width: int) -> DataFrame:
    """One round; ``__short`` rows could move further, and ``__pos``, ``__ref``, ``__alts`` is where they have come to."""
    out = reference_slice(rows, reference, f"pos - {width}", "pos", "__left").withColumn("__left", F.coalesce("__left", F.lit("")))
    out = out.withColumn("__all", F.expr("transform(concat(array(ref), alts), a -> concat(__left, a))"))
    least = "array_min(transform(__all, a -> length(a)))"
    # Lengths are tried from the longest: the first that all alleles share.
    out = out.withColumn("__s", F.expr(f"coalesce(array_max(filter(sequence(0, {least} - 1), k -> size(array_distinct(transform(__all, a -> right(a, k)))) = 1)), 0)"))
    out = out.withColumn("__short", F.expr(f"__s >= {least} - 1 AND pos > length(__left) AND length(__left) > 0"))
    out = out.withColumn("__all", F.expr("transform(__all, a -> left(a, length(a) - __s))"))
    out = out.withColumns({"__pos": F.expr("pos - length(__left)"), "__ref": F.expr("__all[0]"), "__alts": F.expr("slice(__all, 2, size(__all))")})
    out = out.withColumn("__p", F.expr(f"coalesce(array_max(filter(sequence(0, {least} - 1), k -> size(array_distinct(transform(__all, a -> left(a, k)))) = 1)), 0)"))
    out = out.withColumn("__all", F.expr("transform(__all, a -> substring(a, __p + 1))"))
    out = out.withColumns({"pos": F.expr("pos - length(__left) + __p"), "ref": F.expr("__all[0]"), "alts": F.expr("slice(__all, 2, size(__all))")})
    return out.drop("__left", "__all", "__s", "__p")


def vcf_line(rows: DataFrame, sample: str = "SAMPLE1") -> DataFrame:
    """Tab-separated records, positions from 1; rows whose alts all equal the reference give none."""
    line = F.concat_ws(
        "\t", "chrom", (F.col("pos") + 1).cast("string"), F.lit("."), "ref", F.array_join("alts", ","),
        F.format_string("%f", "qual"), F.coalesce("filter", F.lit("PASS")), F.coalesce("info", F.lit(".")), F.lit("GT"), F.array_join("gt", "/"),
    )
    return rows.where("exists(alts, a -> a <> ref)").select("chrom", "pos", line.alias("line"))


def expand_alleles(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Alleles grown to [span_start, span_stop) with reference text on both sides."""
    out = reference_slice(rows, reference, "span_start", "pos", "__pre", any_length=True)
    out = reference_slice(out, reference, "pos + length(ref)", "span_stop", "__post", any_length=True)
    grow = lambda c: F.concat("__pre", c, "__post")
    return out.withColumn("alts", F.transform("alts", grow)).withColumn("ref", grow(F.col("ref"))).withColumn("pos", F.col("span_start")).drop("__pre", "__post")


def sort_vcf(rows: DataFrame) -> DataFrame:
    """A total order by chromosome and position: range partitions, each sorted.

    Chromosomes with a number come first, in their order, then the others by
    name; none is interleaved with another.
    """
    return rows.withColumn("chrom_ord", chrom_order(F.col("chrom"))).orderBy(F.asc_nulls_last("chrom_ord"), "chrom", "pos")


def pair_likelihood(scores: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Likelihood of every unordered allele pair of a site: exp of the sum of log probabilities over all its alleles.

    The alleles of a site are one row (they are few), so no self-join is needed.
    """
    lists = scores.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("allele", "p"))).alias("a"))
    pairs = F.expr("flatten(transform(a, (u, i) -> transform(slice(a, i + 1, size(a)), v -> named_struct('a1', u.allele, 'a2', v.allele))))")
    rows = lists.withColumn("pr", F.explode(pairs))
    terms = F.expr("transform(a, x -> ln(x.p * if(x.allele = pr.a1 OR x.allele = pr.a2, 1D, 0D) + (1 - x.p) * if(x.allele = pr.a1 OR x.allele = pr.a2, 0D, 1D) + 1e-10D))")
    total = F.exp(F.aggregate(terms, F.lit(0.0), lambda t, x: t + x))
    return rows.select(*keys, F.col("pr.a1").alias("a1"), F.col("pr.a2").alias("a2"), total.alias("p"))


def mixture_mean(predictions: DataFrame) -> DataFrame:
    """Experts' pair probabilities weighted by the site's meta weights."""
    w = F.get("meta", F.col("expert"))
    return predictions.groupBy("chrom", "pos", "ref", "a1", "a2").agg(F.sum(F.col("p") * w).alias("p"))


def best_expert(meta: Column) -> Column:
    return (F.array_position(meta, F.array_max(meta)) - 1).cast("int")


def top_genotype(pairs: DataFrame, keys: tuple[str, ...] = ("chrom", "pos")) -> DataFrame:
    """The best pair by (likelihood, pair), with its quality and the alleles of the site."""
    best = F.max(F.struct("p", "a1", "a2")).alias("best")
    alleles = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("a1", "a2"))))).alias("alleles")
    rows = pairs.groupBy(*keys).agg(best, alleles)
    return rows.select(*keys, "best.a1", "best.a2", "best.p", phred(F.col("best.p")).alias("qual"), "alleles")


def top_two(rows: DataFrame, keys: tuple[str, ...], by: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.desc(by), "allele")
    return rows.withColumn("place", F.row_number().over(w)).where("place <= 2")


def call_sites(scores: DataFrame, reference: DataFrame) -> DataFrame:
    """Allele scores (chrom, pos, ref, allele, p) to normalised, numbered calls."""
    pairs = pair_likelihood(scores, ("chrom", "pos", "ref"))
    calls = number_alleles(top_genotype(pairs, ("chrom", "pos", "ref")))
    return normalise(calls, reference)


def header(chroms: DataFrame, sample: str = "SAMPLE1") -> DataFrame:
    """VCF header lines: file format, contigs with their lengths, columns; ``ord``, then ``chrom``, keeps them in order and before all records."""
    top = chroms.sparkSession.createDataFrame([(0, "##fileformat=VCFv4.2"), (1, '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">'), (20_000_000, f"#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{sample}")], "ord long, line string").select("ord", F.lit("").alias("chrom"), "line")
    contigs = chroms.select((10 + F.least(F.coalesce(chrom_order(F.col("chrom")), F.lit(UNNUMBERED)), F.lit(UNNUMBERED))).cast("long").alias("ord"), "chrom", F.format_string("##contig=<ID=%s,length=%d>", "chrom", "length").alias("line"))
    return top.unionByName(contigs)
