"""Reads at sites: sliced alleles, support, read haplotypes and tensors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.operators import cells
from strandlake.operators import reads as R
from strandlake.operators.intervals import overlap_join
from strandlake.operators.variants import reference_slice
from strandlake.shared import ship

#: Quality of a deleted base (a fixed value).
DELETED_Q = 60


def columns_of(reads: DataFrame, lo: str, hi: str) -> DataFrame:
    """Read text by reference position of [lo, hi): aligned bases, '' for deleted ones, insertions at the base before.

    Operations are cut to the range before anything is exploded.
    """
    ops = R.cigar_ops(reads).where(f"len > 0 AND ref_pos <= {hi} AND ref_pos + len >= {lo}")
    inside = f"sequence(cast(greatest({lo} - ref_pos, 0) AS int), cast(least({hi} - ref_pos, len) AS int) - 1)"
    flat = ops.where(f"(op IN {R.BOTH} OR op = 2) AND ref_pos < {hi} AND ref_pos + len > {lo}").withColumn("__i", F.explode(F.expr(inside)))
    flat = flat.withColumns({
        "pos": F.expr("ref_pos + __i"), "part": F.lit(0), "text": F.expr("if(op = 2, '', substring(seq, offset + __i + 1, 1))"),
        "q": F.expr(f"cast(if(op = 2, {DELETED_Q}, get(qual, offset + __i)) AS int)"),
    }).drop("__i")
    added = ops.where(f"op = 1 AND ref_pos - 1 >= {lo} AND ref_pos - 1 < {hi}").withColumns({
        "pos": F.expr("ref_pos - 1"), "part": F.lit(1), "text": F.expr("substring(seq, offset + 1, len)"), "q": F.expr("cast(array_min(slice(qual, offset + 1, len)) AS int)"),
    })
    return flat.unionByName(added)


def reads_by_site(reads: DataFrame, sites: DataFrame) -> DataFrame:
    """Every read with every site (start, stop) it overlaps, as site_start and site_stop."""
    rows = overlap_join(reads.withColumn("stop", F.col("end")), sites.select("chrom", "start", "stop"))
    return rows.withColumnsRenamed({"b_start": "site_start", "b_stop": "site_stop"}).drop("b_chrom", "stop")


def reads_by_region(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Every read with every region (chrom, start, stop, ...) it overlaps, whose columns get a ``region_`` prefix."""
    rows = overlap_join(reads.withColumn("stop", F.col("end")), regions)
    return rows.withColumnsRenamed({f"b_{c}": f"region_{c}" for c in regions.columns if c != "chrom"}).drop("b_chrom", "stop")


#: Reads of at most so many bases lie in two bins at the most.
SHORT = 1024


def at_sites(reads: DataFrame, sites: DataFrame) -> DataFrame:
    """Every read with every site it overlaps, where a long read is moved once, however many sites it covers.

    Of long reads only keys and coordinates are spread over bins and joined; the
    sites of a read, as one list, then meet the read itself.  Short ones meet
    their sites at once.
    """
    places = sites.select("chrom", "start", "stop").distinct().hint("shuffle_hash")
    size = F.col("end") - F.col("start")
    near = overlap_join(reads.where(size <= SHORT).withColumn("stop", F.col("end")), places, width=SHORT)
    near = near.select(*reads.columns, F.col("b_start").alias("site_start"), F.col("b_stop").alias("site_stop"))
    key = ["chrom", "tech", "read_name", "is_reverse", "start"]
    far = reads.where(size > SHORT)
    pairs = overlap_join(far.select(*key, F.col("end").alias("stop")), places)
    lists = pairs.groupBy(*key).agg(F.collect_set(F.struct(F.col("b_start").alias("site_start"), F.col("b_stop").alias("site_stop"))).alias("__sites"))
    rows = far.join(lists, key).select(*reads.columns, F.inline("__sites"))
    return near.unionByName(rows.where("start < site_stop AND site_start < end"))


def site_slices(reads: DataFrame, sites: DataFrame) -> DataFrame:
    """Every read at every site [site_start, site_stop) it overlaps: its allele text, least quality and status.

    Status is Success, Fail (a deletion on the first or last base), LeftPartial
    or RightPartial (the read begins or ends inside, or with an insertion).
    The operations that touch the site are told by arithmetic, so a read is
    neither exploded nor regrouped, however long it is.
    """
    # A read of one aligned operation needs no list of operations: its part of a site is told at once.
    rows = at_sites(reads, sites).withColumn("solo", F.expr(f"coalesce(size(cigar) = 1 AND get(cigar, 0).op IN {R.BOTH}, false)"))
    rows = R.with_ops(rows.withColumn("till", F.expr("start + if(solo, get(cigar, 0).len, 0)")))
    aligned = f"(x.op IN {R.BOTH} OR x.op = 2)"
    near = f"""filter(ops, x -> x.len > 0 AND if(x.op = 1, x.ref - 1 >= site_start - 1 AND x.ref - 1 <= site_stop, {aligned} AND x.ref <= site_stop AND x.ref + x.len >= site_start))"""
    lead = "coalesce(ops[0].op = 1 AND ops[0].len > 0 AND ops[0].ref - 1 >= site_start - 1 AND ops[0].ref - 1 <= site_stop, false)"
    tail = "coalesce(size(ops) > 1 AND ops[size(ops) - 1].op = 1 AND ops[size(ops) - 1].len > 0 AND ops[size(ops) - 1].ref - 1 >= site_start - 1 AND ops[size(ops) - 1].ref - 1 <= site_stop, false)"
    rows = rows.withColumns({"ins_first": F.expr(f"if(solo, false, {lead})"), "ins_last": F.expr(f"if(solo, false, {tail})"), "near": F.expr(f"if(solo, NULL, {near})")}).drop("ops")
    rows = rows.where("if(solo, till > start AND start <= site_stop AND till >= site_start, size(near) > 0)")
    # What of an operation lies in the site: read offset and bases (an insertion as a whole, at the base before it).
    cut = """transform(filter(near, x -> if(x.op = 1, x.ref - 1 >= site_start AND x.ref - 1 < site_stop, x.ref < site_stop AND x.ref + x.len > site_start)), x -> named_struct(
        'op', x.op, 'off', if(x.op = 1, x.off, x.off + cast(greatest(site_start - x.ref, 0) AS int)),
        'n', if(x.op = 1, x.len, cast(least(site_stop, x.ref + x.len) - greatest(site_start, x.ref) AS int))))"""
    rows = rows.withColumn("cut", F.expr(f"if(solo, NULL, {cut})"))
    at, n = "cast(greatest(site_start - start, 0) AS int) + 1", "cast(greatest(least(site_stop, till) - greatest(site_start, start), 0) AS int)"
    text = F.expr(f"if(solo, substring(seq, {at}, {n}), array_join(transform(cut, x -> if(x.op = 2, '', substring(seq, x.off + 1, x.n))), ''))")
    least = F.expr(f"if(solo, cast(array_min(slice(qual, {at}, {n})) AS int), array_min(transform(cut, x -> cast(if(x.op = 2, {DELETED_Q}, array_min(slice(qual, x.off + 1, x.n))) AS int))))")
    has = lambda at: F.expr(f"if(solo, start <= {at} AND {at} < till, exists(near, x -> {aligned} AND x.ref <= {at} AND {at} < x.ref + x.len))")
    bare = lambda at: F.expr(f"if(solo, false, exists(near, x -> x.op = 2 AND x.ref <= {at} AND {at} < x.ref + x.len) AND NOT exists(near, x -> x.op = 1 AND x.ref - 1 = {at}))")
    rows = rows.withColumns({"allele": text, "min_q": least, "h0": has("site_start"), "hb": has("site_start - 1"), "h1": has("site_stop - 1"), "ha": has("site_stop"), "d0": bare("site_start"), "d1": bare("site_stop - 1")})
    status = F.expr("""CASE WHEN d0 OR d1 THEN 'Fail' WHEN NOT h0 THEN 'LeftPartial' WHEN NOT hb THEN if(ins_first, 'LeftPartial', 'Success')
        WHEN NOT h1 THEN 'RightPartial' WHEN NOT ha THEN if(ins_last, 'RightPartial', 'Success') ELSE 'Success' END""")
    return rows.withColumn("status", status).select("chrom", "site_start", "site_stop", "tech", "read_name", "is_reverse", "start", "end", "mapq", "allele", "min_q", "status")


def gated(slices: DataFrame, least_mapq: int = 10, least_q: int = 10) -> DataFrame:
    """Successful slices with enough mapping and base quality and no unknown base."""
    return slices.where((F.col("status") == "Success") & (F.col("mapq") >= least_mapq) & (F.col("min_q") >= least_q) & ~F.contains(F.col("allele"), F.lit("N")))


def supporting(slices: DataFrame) -> DataFrame:
    """The slices whose read supports an allele: those that pass the gates, and partial ones that fit one allele of their site only, with that allele."""
    key, good = ["chrom", "site_start", "site_stop"], gated(slices)
    known = good.groupBy(*key).agg(F.collect_set("allele").alias("__known"))
    part = slices.where("status IN ('LeftPartial', 'RightPartial') AND allele <> ''").join(known, key)
    part = part.withColumn("__fit", F.expr("filter(__known, x -> if(status = 'LeftPartial', endswith(x, allele), startswith(x, allele)))")).where("size(__fit) = 1")
    return good.unionByName(part.withColumn("allele", F.col("__fit")[0]).select(*slices.columns))


def allele_support(slices: DataFrame, least_mapq: int = 10, least_q: int = 10) -> DataFrame:
    """Reads for each (site, allele) by technology that pass the gates."""
    good = gated(slices, least_mapq, least_q)
    return good.groupBy("chrom", "site_start", "site_stop", "allele").agg(F.count_if(F.col("tech") == "I").alias("illumina"), F.count_if(F.col("tech") == "P").alias("pacbio"), F.count("*").alias("support"))


def site_alleles(support: DataFrame) -> DataFrame:
    return support.groupBy("chrom", "site_start", "site_stop").agg(F.sort_array(F.collect_set("allele")).alias("alleles"))


def partial_support(slices: DataFrame, support: DataFrame) -> DataFrame:
    """Support with partial reads: a partial text counts for an allele only if it fits exactly one.

    A read with a left partial is not tried on its right.  The alleles and the
    partial texts of a site are one row (no more than its reads).
    """
    key = ["chrom", "site_start", "site_stop"]
    part = slices.where("status IN ('LeftPartial', 'RightPartial') AND allele <> ''").groupBy(*key, "status", F.col("allele").alias("part")).agg(F.count_if(F.col("tech") == "I").alias("illumina"), F.count_if(F.col("tech") == "P").alias("pacbio"))
    lists = part.groupBy(*key).agg(F.collect_list(F.struct("status", "part", "illumina", "pacbio")).alias("parts"))
    rows = support.groupBy(*key).agg(F.collect_list(F.struct("allele", "illumina", "pacbio")).alias("a")).join(lists, key, "left")
    fits = "if(p.status = 'LeftPartial', endswith({x}.allele, p.part), startswith({x}.allele, p.part))"
    mine = f"filter(parts, p -> {fits.format(x='x')} AND size(filter(a, y -> {fits.format(x='y')})) = 1)"
    more = lambda c: f"x.{c} + if(parts IS NULL, 0L, aggregate({mine}, 0L, (t, p) -> t + p.{c}))"
    rows = rows.select(*key, F.explode(F.expr(f"transform(a, x -> named_struct('allele', x.allele, 'illumina', {more('illumina')}, 'pacbio', {more('pacbio')}))")).alias("x")).select(*key, "x.*")
    return rows.withColumn("support", F.col("illumina") + F.col("pacbio"))


def read_haplotypes(slices: DataFrame, regions: DataFrame, reference: DataFrame, flank: int = 6) -> DataFrame:
    """Each read's successful alleles stitched with reference text over a region's sites (region_start, region_stop)."""
    ok = slices.where("status = 'Success'").join(regions, ["chrom", "site_start", "site_stop"])
    key = ["chrom", "region_start", "region_stop", "tech", "read_name", "is_reverse", "start", "end"]
    per = ok.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("site_start", "site_stop", "allele"))).alias("s"))
    per = per.withColumn("lo", F.col("region_start") - flank).withColumn("hi", F.col("region_stop") + flank)
    per = reference_slice(per, reference, "lo", "hi", "ref")
    fold = """aggregate(s, named_struct('at', lo, 'h', ''), (a, x) -> named_struct('at', x.site_stop,
        'h', concat(a.h, substring(ref, cast(a.at - lo AS int) + 1, cast(x.site_start - a.at AS int)), x.allele)),
        a -> concat(a.h, substring(ref, cast(a.at - lo AS int) + 1)))"""
    return per.withColumn("haplotype", F.expr(fold)).select(*key, "haplotype")


def read_tensors(reads: DataFrame, slices: DataFrame, reference: DataFrame, width: int = 150, total: bool = False) -> DataFrame:
    """Seven channels of ``width`` cells for every read that supports an allele (``supporting``), centred on the site.

    Cells hold base, quality, mapping quality, strand, reference base, position
    and haplotype colours; at a deletion the gap keeps the read's other colours,
    an insertion's least quality goes to its anchor (the last writer wins).
    Cells are filled for batches of reads at once (``cells``), so no row a cell
    is made; with ``total`` each channel is the sum of its cells.
    """
    key = ["chrom", "site_start", "site_stop", "allele", "tech", "read_name", "is_reverse", "start"]
    ok = supporting(slices).select(*key).distinct()
    rows = reads.withColumn("hp", R.hp_tag()).join(ok, ["read_name", "start", "chrom", "tech", "is_reverse"])
    rows = rows.withColumn("lo", F.floor((F.col("site_start") + F.col("site_stop")) / 2) - width // 2)
    rows = reference_slice(rows, reference, "lo", f"lo + {width}", "ref").select(*dict.fromkeys([*key, *cells.TAKEN]))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"{c} {kinds[c]}" for c in key] + [f"{c} {'bigint' if total else 'array<smallint>'}" for c in cells.CHANNELS])
    ship(reads.sparkSession)
    return rows.mapInArrow(cells.writer(key, width, R.SHADES, DELETED_Q, total), schema)


def region_coverage(reads: DataFrame, regions: DataFrame, tech: str = "I") -> DataFrame:
    """(region, mean): mean depth of one technology over the covered columns of each region (region, chrom, start, stop)."""
    rows = regions.select("region", "chrom", "start", "stop")
    found = overlap_join(reads.where(F.col("tech") == tech).select("chrom", "start", F.col("end").alias("stop")), rows)
    # Covered columns are the union of the reads' parts inside the region: +1 and -1 events, no row a base.
    parts = found.select(F.col("b_region").alias("region"), F.greatest("start", "b_start").alias("a"), F.least("stop", "b_stop").alias("b"))
    events = parts.select("region", F.explode(F.array(F.struct(F.col("a").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("b").alias("pos"), F.lit(-1).alias("d")))).alias("e")).groupBy("region", "e.pos").agg(F.sum("e.d").alias("d"))
    w = W.partitionBy("region").orderBy("pos")
    steps = events.withColumn("depth", F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("size", F.lead("pos").over(w) - F.col("pos")).where("depth > 0")
    return steps.groupBy("region").agg((F.sum(F.col("depth") * F.col("size")) / F.sum("size")).alias("mean"))


def keep_reads(reads: DataFrame, kept: DataFrame, keys: tuple[str, ...] = ("site", "allele", "read")) -> DataFrame:
    """Applies stored read numbers to the reads of each (site, allele)."""
    return reads.join(kept.select(*keys), list(keys), "left_semi")
