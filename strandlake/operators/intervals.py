"""Intervals and points on a chromosome axis: overlap joins, islands, clusters, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.operators.scans import CELL, highest, latest, range_cell, scanned, total
from strandlake.shared import written


def bins(start: Column, stop: Column, width: int) -> Column:
    """Bins that [start, stop) touches."""
    return F.sequence(F.floor(start / width).cast("long"), F.floor((F.greatest(stop, start + 1) - 1) / width).cast("long"))


def overlap_join(a: DataFrame, b: DataFrame, width: int = 1024, how: str = "inner", key: str = "chrom", inside: bool = False) -> DataFrame:
    """Pairs of overlapping [start, stop) intervals of two tables (columns of b get a ``b_`` prefix).

    Both sides are spread over bins and joined on (key, bin), so a chromosome
    is dealt over many tasks; a pair is kept only in the bin where the later of
    the two begins, which makes a distinct unnecessary.  ``how`` is inner or
    left_semi (rows of a with a partner, each once; repeated rows stay
    repeated); ``inside`` asks for a inside b.
    """
    if how == "left_semi":  # a row may be found in several of its bins
        a = a.withColumn("__row", F.monotonically_increasing_id())
    left = a.withColumn("__bin", F.explode(bins(F.col("start"), F.col("stop"), width)))
    right = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns)).withColumn("b___bin", F.explode(bins(F.col("b_start"), F.col("b_stop"), width)))
    # The bin first: rows are sorted by a number that differs, not by a name that seldom does.
    on = (left["__bin"] == right["b___bin"]) & (left[key] == right[f"b_{key}"]) & (left["start"] < right["b_stop"]) & (right["b_start"] < left["stop"])
    if inside:
        on = on & (right["b_start"] <= left["start"]) & (left["stop"] <= right["b_stop"])
    if how == "left_semi":
        return left.join(right, on, "left_semi").dropDuplicates(["__row"]).drop("__bin", "__row")
    later = F.floor(F.greatest("start", "b_start") / width)
    return left.join(right, on & (F.col("__bin") == later)).drop("__bin", "b___bin")


def points_in(points: DataFrame, intervals: DataFrame, width: int = 1024) -> DataFrame:
    """Points inside at least one interval: a point has one bin, so no row is repeated."""
    right = intervals.select(F.col("chrom").alias("c"), F.col("start").alias("s"), F.col("stop").alias("e"), F.explode(bins(F.col("start"), F.col("stop"), width)).alias("b"))
    left = points.withColumn("__bin", F.floor(F.col("pos") / width))
    on = (F.col("chrom") == F.col("c")) & (F.col("__bin") == F.col("b")) & (F.col("pos") >= F.col("s")) & (F.col("pos") < F.col("e"))
    return left.join(right, on, "left_semi").drop("__bin")


def islands(points: DataFrame, gap: int, keys: tuple[str, ...] = ("chrom",), pos: str = "pos", width: int = CELL) -> DataFrame:
    """Numbers groups of points whose neighbours are at most ``gap`` apart."""
    cell = range_cell(F.col(pos), width)
    rows = scanned(points, [*keys], [pos], cell, __before=latest(F.col(pos), own=False))
    rows = rows.withColumn("__new", F.coalesce((F.col(pos) - F.col("__before") > gap).cast("int"), F.lit(0)))
    return scanned(rows, [*keys], [pos, -F.col("__new")], cell, island=total(F.col("__new"))).drop("__new", "__before")


def ranked(points: DataFrame, width: int = CELL) -> DataFrame:
    """Distinct positions with their rank on their chromosome, from 1."""
    return scanned(points.select("chrom", "pos").distinct(), ["chrom"], ["pos"], range_cell(F.col("pos"), width), at=total())


def consecutive_runs(points: DataFrame) -> DataFrame:
    """Runs of adjacent positions as [start, stop)."""
    rows = islands(points.select("chrom", "pos").distinct(), 1)
    return rows.groupBy("chrom", "island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"), F.count("*").alias("n")).drop("island")


def gap_regions(points: DataFrame, gap: int = 30) -> DataFrame:
    """Points linked over gaps of at most ``gap``, widened by half of it on both sides."""
    rows = islands(points.select("chrom", "pos").distinct(), gap)
    half = gap // 2
    return rows.groupBy("chrom", "island").agg((F.min("pos") - half).alias("start"), (F.max("pos") + half).alias("stop"), F.count("*").alias("n")).drop("island")


def chained(intervals: DataFrame, touching: bool = False, out: str = "island", width: int = CELL) -> DataFrame:
    """Numbers chains of overlapping intervals; intervals that only touch are in one chain if asked for."""
    cell, stop = range_cell(F.col("start"), width), F.col("__before")
    rows = scanned(intervals, ["chrom"], ["start", "stop"], cell, __before=highest(F.col("stop"), own=False))
    new = (F.col("start") > stop) if touching else (F.col("start") >= stop)
    rows = rows.withColumn("__new", F.coalesce(new.cast("int"), F.lit(0)))
    return scanned(rows, ["chrom"], ["start", "stop", -F.col("__new")], cell, **{out: total(F.col("__new"))}).drop("__new", "__before")


def merge_overlaps(intervals: DataFrame, touching: bool = False, width: int = CELL) -> DataFrame:
    """Merged intervals of each chromosome; intervals that only touch stay apart unless asked for."""
    rows = chained(intervals.select("chrom", "start", "stop"), touching, width=width)
    return rows.groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n")).drop("island")


def widened(intervals: DataFrame, guard: int = 3) -> DataFrame:
    """Intervals grown on both sides and merged."""
    return merge_overlaps(intervals.select("chrom", (F.col("start") - guard).alias("start"), (F.col("stop") + guard).alias("stop")))


def capped_clusters(sites: DataFrame, gap: int = 30, cap: int = 8, longest: int = 80, width: int = CELL) -> DataFrame:
    """Clusters of sites: linked when the gap is below ``gap``, at most ``cap`` in one.

    A site longer than ``longest`` ends the cluster before it and is dropped,
    but one that meets an empty cluster is kept; so in a run of long sites
    every second one stays, counted from the state before the run.

    That is an automaton with two states (cluster empty or not): a short site
    leads to "not empty" whatever the state, a long one changes it.  So the
    state follows from the number of long sites since the last short one, which
    two running values tell.
    """
    order, cell = ["start", "stop", "__tie"], range_cell(F.col("start"), width)
    scan = lambda rows, **scans: scanned(rows, ["chrom"], order, cell, **scans)
    rows = sites.withColumns({"__long": F.col("stop") - F.col("start") > longest, "__tie": F.xxhash64(*(c for c, kind in sites.dtypes if not kind.startswith("map")))})
    rows = scan(rows, __longs=total(F.col("__long").cast("int")))
    rows = scan(rows, __reset=latest(F.when(~F.col("__long"), F.col("__longs"))))
    since = F.col("__longs") - F.coalesce("__reset", F.lit(0))
    # After a short site a run of long ones begins with a dropped one; at the start of a chromosome with a kept one.
    rows = rows.withColumn("__kept", ~F.col("__long") | F.when(F.col("__reset").isNull(), since % 2 == 1).otherwise(since % 2 == 0))
    rows = scan(rows, __dropped=total((~F.col("__kept")).cast("int"))).where("__kept")
    rows = scan(rows, __stop=latest(F.col("stop"), own=False), __past=latest(F.col("__dropped"), own=False), __number=total())
    new = F.coalesce((F.col("start") - F.col("__stop") >= gap) | (F.col("__dropped") != F.col("__past")), F.lit(False))
    rows = rows.withColumn("__new", new)
    rows = scan(rows, island=total(F.col("__new").cast("int")), __first=latest(F.when(F.col("__new"), F.col("__number"))))
    rows = rows.withColumn("part", F.floor((F.col("__number") - F.coalesce("__first", F.lit(1))) / cap))
    return rows.drop(*(c for c in rows.columns if c.startswith("__")))


def segment_bounds(clusters: DataFrame, reach: int = 15) -> DataFrame:
    """Reference span of each part of a cluster, grown by ``reach`` but not into the parts beside it."""
    span = clusters.groupBy("chrom", "island", "part").agg(F.min("start").alias("first"), F.max("stop").alias("last"), F.count("*").alias("n"))
    span = scanned(span, ["chrom", "island"], ["part"], F.floor(F.col("part") / 4096), __left=latest(F.col("last"), own=False))
    span = scanned(span, ["chrom", "island"], [-F.col("part")], F.floor(-F.col("part") / 4096), __right=latest(F.col("first"), own=False))
    left = F.greatest(F.col("first") - reach, F.col("__left"))  # nulls don't count
    right = F.least(F.col("last") + reach, F.col("__right"))
    return span.withColumn("seg_start", left).withColumn("seg_stop", right).drop("__left", "__right")


def balanced_shards(runs: DataFrame, max_shards: int = 500, min_gap: int = 25, size: str = "n", least: int | None = None, width: int = CELL) -> DataFrame:
    """Greedy shards in order: a cut comes at the first gap of ``min_gap`` once a shard has enough.

    Enough is the chromosome's sum over ``max_shards``, or ``least`` if given.
    Islands between possible cuts (a block) are summed first.  From running
    sums every block knows where a shard that begins with it ends; the blocks
    that do begin a shard are then reached from the first one by jumps of
    doubled length, so no task follows a chromosome from end to end.
    """
    cell = range_cell(F.col("start"), width)
    rows = scanned(runs, ["chrom"], ["start", "stop"], cell, __stop=latest(F.col("stop"), own=False))
    rows = rows.withColumn("cut", F.coalesce((F.col("start") - F.col("__stop") + 1 >= min_gap).cast("int"), F.lit(0)))
    rows = scanned(rows, ["chrom"], ["start", "stop"], cell, block=total(F.col("cut")))
    blocks = rows.groupBy("chrom", "block").agg(F.sum(size).alias("w"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("islands"))
    in_order = lambda df, **scans: scanned(df, ["chrom"], ["block"], F.floor(F.col("block") / 4096), **scans)
    blocks = written(in_order(blocks, upto=total(F.col("w"), own=False)), "blocks")
    need = blocks.groupBy("chrom").agg(F.greatest(F.lit(1), F.ceil(F.sum("w") / max_shards) if least is None else F.lit(least)).alias("need"))
    # For each block the first one whose running sum is large enough: the last one seen from the right.
    here = blocks.select("chrom", F.col("upto").alias("v"), F.lit(0).alias("asks"), F.col("block").alias("at"))
    asked = blocks.join(need, "chrom").select("chrom", (F.col("upto") + F.col("need")).alias("v"), F.lit(1).alias("asks"), F.col("block").alias("at"))
    seen = scanned(here.unionByName(asked), ["chrom"], [-F.col("v"), "asks", -F.col("at")], F.floor(-F.col("v") / width), to=latest(F.when(F.col("asks") == 0, F.col("at")), own=False))
    jumps = written(seen.where("asks = 1 AND to IS NOT NULL").select("chrom", F.col("at").alias("block"), "to"), "jumps")
    cuts = blocks.where("block = 0").select("chrom", "block")
    known = 0
    while (count := cuts.count()) > known:
        known = count
        cuts = written(cuts.unionByName(cuts.join(jumps, ["chrom", "block"]).select("chrom", F.col("to").alias("block"))).distinct(), "cuts")
        jumps = written(jumps.join(jumps.select("chrom", F.col("block").alias("to"), F.col("to").alias("further")), ["chrom", "to"]).select("chrom", "block", F.col("further").alias("to")), "jumps")
    first = cuts.where("block > 0").select("chrom", "block", F.lit(1).alias("first"))
    placed = in_order(blocks.join(first, ["chrom", "block"], "left"), shard=total(F.col("first")))
    return placed.groupBy("chrom", "shard").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("w").alias("n"), F.sum("islands").alias("islands"))


def tiles(lengths: DataFrame, width: int) -> DataFrame:
    """[start, stop) tiles of each (chrom, length)."""
    rows = lengths.where("length > 0").select("chrom", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(width).cast("long"))).alias("start"))
    return rows.select("chrom", "start", F.least(F.col("start") + width, F.col("length")).alias("stop"))


def equal_tiles(lengths: DataFrame, n: int) -> DataFrame:
    """n equal tiles of each chromosome and one for the remainder."""
    step = F.floor(F.col("length") / n)
    rows = lengths.withColumn("step", step).select("chrom", "length", "step", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("k"))
    rows = rows.withColumn("start", F.col("k") * F.col("step")).withColumn("stop", F.when(F.col("k") == n, F.col("length")).otherwise((F.col("k") + 1) * F.col("step")))
    return rows.where("start < stop").select("chrom", "start", "stop")


def clip_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """The parts of a that lie in b."""
    rows = overlap_join(a, b)
    return rows.select("chrom", F.greatest("start", "b_start").alias("start"), F.least("stop", "b_stop").alias("stop"))


def nearest_within(a: DataFrame, b: DataFrame, tolerance: int = 3, width: int = 100_000) -> DataFrame:
    """As-of match: each a with the next b at most ``tolerance`` further on.

    One pass over the union, bin by bin: a point of b is copied into the bins
    from which it can be reached, so a chromosome is dealt over many tasks.
    """
    reach = F.sequence(F.floor((F.col("pos") - tolerance) / width), F.floor(F.col("pos") / width))
    rows = a.select("chrom", "pos", F.lit(0).alias("side"), F.floor(F.col("pos") / width).alias("bin")).unionByName(b.select("chrom", "pos", F.lit(1).alias("side"), F.explode(reach).alias("bin")))
    # From the right: the last b seen is the next one.
    w = W.partitionBy("chrom", "bin").orderBy(F.desc("pos"), F.desc("side")).rowsBetween(W.unboundedPreceding, 0)
    after = F.last(F.when(F.col("side") == 1, F.col("pos")), ignorenulls=True).over(w)
    rows = rows.withColumn("next", after).where("side = 0")
    return rows.select("chrom", "pos", F.when(F.col("next") - F.col("pos") <= tolerance, F.col("next")).alias("match"))


def consensus_regions(*callers: DataFrame) -> DataFrame:
    """Union of several callers' intervals, merged."""
    rows = callers[0].select("chrom", "start", "stop")
    for c in callers[1:]:
        rows = rows.unionByName(c.select("chrom", "start", "stop"))
    return merge_overlaps(rows)


def extent(points: DataFrame, guard: int = 10) -> DataFrame:
    """Span of each chromosome's points, grown by ``guard``."""
    return points.groupBy("chrom").agg((F.min("pos") - guard).alias("start"), (F.max("pos") + 1 + guard).alias("stop"))


def bounded(regions: DataFrame, lo: Column, hi: Column, strict: bool = False) -> DataFrame:
    """Regions against [lo, hi): strict keeps those wholly inside, lax clamps them; what is empty then goes."""
    if strict:
        return regions.where((F.col("start") >= lo) & (F.col("stop") <= hi))
    rows = regions.withColumn("start", F.greatest("start", lo)).withColumn("stop", F.least("stop", hi))
    return rows.where("start < stop")


def in_bounds(reads: DataFrame, lengths: DataFrame, width: int, reach: int = 10) -> DataFrame:
    """Tiles of reads (chrom, tile, n) whose reads begin no nearer than ``reach`` to the start and end inside the chromosome."""
    per = reads.groupBy("chrom", F.floor(F.col("start") / width).alias("tile")).agg(F.count("*").alias("n"), (F.min("start") - reach).alias("lo"), F.max("end").alias("hi"))
    return per.join(lengths, "chrom").where("lo >= 0 AND hi <= length").select("chrom", "tile", "n")


def lone(items: DataFrame, gap: int = 3, longest: int = 60, width: int = CELL) -> DataFrame:
    """Items of at most ``longest`` that have no neighbour within ``gap`` on their chromosome.

    Equal items are neighbours: a number, written by the first scan, gives them one order for both scans.
    """
    rows = items.withColumn("__row", F.monotonically_increasing_id())
    rows = scanned(rows, ["chrom"], ["start", "stop", "__row"], range_cell(F.col("start"), width), __stop=latest(F.col("stop"), own=False))
    rows = scanned(rows, ["chrom"], [-F.col("start"), -F.col("stop"), -F.col("__row")], F.floor(-F.col("start") / width), __start=latest(F.col("start"), own=False))
    far = F.coalesce(F.col("__start") - F.col("stop") > gap, F.lit(True)) & F.coalesce(F.col("start") - F.col("__stop") > gap, F.lit(True))
    return rows.where(far & (F.col("stop") - F.col("start") <= longest)).drop("__start", "__stop", "__row")


def united(*points: DataFrame) -> DataFrame:
    """Distinct positions of several sources."""
    rows = points[0].select("chrom", "pos")
    for p in points[1:]:
        rows = rows.unionByName(p.select("chrom", "pos"))
    return rows.distinct()


def in_job_order(*shards: DataFrame) -> DataFrame:
    """Shards one after another, each with its number."""
    rows = shards[0].withColumn("shard", F.lit(0).cast("long"))
    for k, s in enumerate(shards[1:], 1):
        rows = rows.unionByName(s.withColumn("shard", F.lit(k).cast("long")))
    return rows


def bundles(runs: DataFrame, least: int = 1024, min_gap: int = 256, reach: int = 10) -> DataFrame:
    """Greedy bundles of at least ``least`` points, cut at gaps of ``min_gap``, their spans grown by ``reach``."""
    rows = balanced_shards(runs, min_gap=min_gap, least=least)
    return rows.select("chrom", "shard", (F.col("start") - reach).alias("start"), (F.col("stop") + reach).alias("stop"), "n", "islands")
