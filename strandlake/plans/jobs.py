"""End-to-end jobs: compositions of operators, from reads to calls and from truth to training examples.

Tables that several later steps need (hotspots, slices, candidate sites) are
written to the shared folder once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.operators import examples as E
from strandlake.operators import failures as X
from strandlake.operators import haplotypes as H
from strandlake.operators import intervals as I
from strandlake.operators import pileup as P
from strandlake.operators import reads as R
from strandlake.operators import scoring as C
from strandlake.operators import sites as T
from strandlake.operators import variants as V
from strandlake.operators.tensors import TECHS, Model, site_tensors, tensor_scores
from strandlake.shared import written
from strandlake.sources import sinks

#: A scorer adds ``p`` (three experts) and ``meta`` (their weights) to (chrom, site_start, site_stop, allele, illumina, pacbio, support).
Scorer = Callable[[DataFrame], DataFrame]


def clean_reads(reads: DataFrame, least_mapq: int = 10) -> DataFrame:
    return R.mapq_gate(R.first_per_name(R.usable(reads)), least_mapq)


def stored_reads(reads: DataFrame, least_mapq: int = 10, stored: bool = False) -> DataFrame:
    """Clean reads, written once: their evidence, depth and slices are all taken from this table.

    ``stored`` says, here and in the jobs, that ``reads`` are clean and come from a written table already.
    """
    return reads if stored else written(clean_reads(reads, least_mapq), "clean-reads")


def detect_hotspots(reads: DataFrame, reference: DataFrame, caps: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Differing positions, the union over technologies; ``caps`` bounds the reads of a tile (``reads.TILE_CAPS``)."""
    rows = clean_reads(reads)
    return hotspots_of(written(R.capped_tiles(rows, caps) if caps else rows, "clean-reads"), reference)


def hotspots_of(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """The same over stored clean reads."""
    counts = written(P.allele_counts(rows, reference), "allele-counts")
    return P.hotspots(P.resolve_partials(counts), rows)


def capped_reads(reads: DataFrame, points: DataFrame, per_base: float, gap: int = 30, flank: int = 75) -> DataFrame:
    """Reads of the active regions around some points: of those that overlap a region (with flanks), at most ``per_base`` for each of its bases.

    A read that several regions keep is one row.
    """
    regions = I.gap_regions(points, gap).select("chrom", F.greatest(F.col("start") - flank, F.lit(0)).alias("start"), (F.col("stop") + flank).alias("stop"), F.ceil((F.col("stop") - F.col("start")) * per_base).alias("most"))
    found = T.reads_by_region(reads, regions)
    order = W.partitionBy("chrom", "region_start").orderBy(F.xxhash64(F.lit(13), "read_name", "is_reverse", "start"), "read_name", "start")
    kept = found.withColumn("__n", F.row_number().over(order)).where("__n <= region_most")
    key = ["chrom", "read_name", "is_reverse", "start"]
    return reads.join(kept.select(key).distinct(), key, "left_semi")


def site_support(reads: DataFrame, reference: DataFrame, per_base: float | None = None) -> DataFrame:
    """Alleles with support at every run of hotspot positions, with the site's reference text.

    Partial reads count for the one allele they fit.  With ``per_base`` the
    reads of each active region are capped first.
    """
    return support_of(candidate_slices(reads, reference, per_base)[1], reference)


def candidate_slices(reads: DataFrame, reference: DataFrame, per_base: float | None = None, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """(reads, slices) at every run of hotspot positions."""
    rows = stored_reads(reads, stored=stored)
    points = written(hotspots_of(rows, reference), "hotspots")
    if per_base is not None:
        rows = capped_reads(rows, points, per_base)
    return rows, written(T.site_slices(rows, I.consecutive_runs(points)), "site-slices")


def reconciled(slices: DataFrame, rows: DataFrame, sites: DataFrame, reference: DataFrame, least_coverage: float = 14, cap: int = 1024) -> DataFrame:
    """Slices in which long reads that spell a combination of the short reads' alleles over a cluster of sites take these alleles.

    Sites (chrom, start, stop) are clustered (linked below a gap of 30, at most
    ``cap`` in one); a read has to hold a cluster whole.
    """
    spans = ["chrom", "region_start", "region_stop"]
    read = ["chrom", "tech", "read_name", "is_reverse", "start"]
    parts = I.capped_clusters(sites.select("chrom", "start", "stop"), 30, cap)
    whole = parts.groupBy("chrom", "island", "part").agg(F.min("start").alias("region_start"), F.max("stop").alias("region_stop"))
    placed = parts.join(whole, ["chrom", "island", "part"]).select("chrom", F.col("start").alias("site_start"), F.col("stop").alias("site_stop"), "region_start", "region_stop")
    placed = written(placed.withColumn("region", F.concat_ws("_", *spans)), "clusters")
    found = V.reference_slice(T.allele_support(slices.where("tech = 'I'")), reference, "site_start", "site_stop", "ref")
    found = found.groupBy("chrom", "site_start", "site_stop", "ref").agg(F.collect_set("allele").alias("alleles")).join(placed, ["chrom", "site_start", "site_stop"])
    found = written(V.candidate_record(found.withColumn("pos", F.col("site_start"))).withColumn("alts", F.array_sort("alts")), "cluster-sites")
    lists = found.groupBy("region", *spans).agg(F.sort_array(F.collect_list(F.struct("pos", "ref", "alts", "gt"))).alias("sites"))
    lists = V.reference_slice(lists.withColumn("seg_start", F.greatest(F.col("region_start") - 6, F.lit(0))), reference, "seg_start", "region_stop + 6", "segment", any_length=True)
    haplotypes = T.read_haplotypes(slices, placed.select("chrom", "site_start", "site_stop", "region_start", "region_stop"), reference)
    haplotypes = haplotypes.withColumn("region", F.concat_ws("_", *spans))
    coverage = T.region_coverage(rows, placed.select("region", "chrom", F.col("region_start").alias("start"), F.col("region_stop").alias("stop")).distinct())
    picks = H.reconcile(haplotypes, lists.select("region", "seg_start", "segment", "sites"), coverage, least_coverage, intended=True)
    at = lists.select("region", F.transform("sites", lambda x: x["pos"]).alias("at"))
    picks = picks.join(at, "region").select(*read, F.explode(F.arrays_zip("at", "picks")).alias("x")).select(*read, F.col("x.at").alias("site_start"), F.col("x.picks").alias("__pick"))
    out = slices.join(picks, [*read, "site_start"], "left")
    taken = F.col("__pick").isNotNull()
    return out.withColumn("allele", F.coalesce("__pick", "allele")).withColumn("status", F.when(taken, "Success").otherwise(F.col("status"))).select(*slices.columns)


def active_slices(reads: DataFrame, reference: DataFrame, per_base: float | None = None, least_coverage: float = 14, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """(reads, slices) of active regions: reads are capped by region, cut to it once, and long ones reconciled with short ones."""
    rows = stored_reads(reads, stored=stored)
    points = written(hotspots_of(rows, reference), "hotspots")
    if per_base is not None:
        rows = capped_reads(rows, points, per_base)
    regions = I.gap_regions(points, 30).select("chrom", "start", "stop")  # disjoint, 15 bases or more around every site
    rows = written(R.cut_reads(rows, regions), "cut-reads")
    sites = written(I.consecutive_runs(points), "candidate-runs")
    slices = written(T.site_slices(rows, sites), "site-slices")
    return rows, written(reconciled(slices, rows, sites, reference, least_coverage), "reconciled-slices")


def support_of(slices: DataFrame, reference: DataFrame) -> DataFrame:
    """Alleles with support at every site, with the site's reference text; partial reads count for the one allele they fit."""
    support = T.partial_support(slices, T.allele_support(slices)).where("support > 0 AND length(allele) <= 80")
    return V.reference_slice(support, reference, "site_start", "site_stop", "ref")


def call_active_regions(reads: DataFrame, reference: DataFrame, model: Model | None = None, width: int = 150, per_base: float | None = None, least_coverage: float = 14, scorer: Scorer = C.support_scores, stored: bool = False) -> DataFrame:
    """Normalised calls by way of active regions.

    With a ``model`` every site's read tensors of both technologies and the
    reference around it are scored by it; else ``scorer`` scores the support.
    """
    rows, slices = active_slices(reads, reference, per_base, least_coverage, stored)
    support = support_of(slices, reference)
    if model is None:
        scored = scorer(support)
    else:
        scored = support.join(tensor_scores(site_tensors(rows, slices, reference, width), model, width), ["chrom", "site_start", "site_stop", "allele"])
    return prepare_vcf(C.site_predictions(scored.withColumn("pos", F.col("site_start"))), reference, "mean")[0].drop("kind")


def predict_sites(reads: DataFrame, reference: DataFrame, scorer: Scorer = C.support_scores, per_base: float | None = None) -> DataFrame:
    """Site predictions of three experts at every candidate site with another allele than the reference."""
    scored = scorer(site_support(reads, reference, per_base)).withColumn("pos", F.col("site_start"))
    return C.site_predictions(scored)


def call_variants(reads: DataFrame, reference: DataFrame, scorer: Scorer = C.support_scores, per_base: float | None = None) -> DataFrame:
    """Normalised calls of the mixture of experts, with genotype and quality."""
    return prepare_vcf(predict_sites(reads, reference, scorer, per_base), reference, "mean")[0].drop("kind")


def prepare_vcf(predictions: DataFrame, reference: DataFrame, only: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Records of every expert, the best one and the mean (by ``kind``, or of one kind only), and the chosen experts as intervals."""
    return C.prepared(written(predictions, "predictions"), reference, only)


def shard(points: DataFrame, max_shards: int = 500, min_gap: int = 25) -> DataFrame:
    """Hotspot positions with the shard of their chromosome: greedy, by runs of adjacent positions."""
    runs = I.consecutive_runs(points)
    shards = I.balanced_shards(runs.withColumn("one", F.lit(1).cast("long")), max_shards, min_gap, "one")
    spots = points.select("chrom", "pos", F.col("pos").alias("start"), (F.col("pos") + 1).alias("stop"))
    return I.overlap_join(spots, shards.select("chrom", "start", "stop", "shard"), width=65_536).select("chrom", "pos", F.col("b_shard").alias("shard"))


def feed_training(examples: DataFrame, reads: DataFrame, rates: list[tuple[float, float]], batch: int, workers: int = 8, keep: float = 1.0, cutoff: float = 0.0, most_reads: int | None = None, seed: int = 13) -> DataFrame:
    """Batches of training sites with their part (train or validation).

    Sites with a true and a second allele; homozygous ones pruned; sites whose
    true alleles have too small a share dropped; reads (site, allele, read)
    kept by a rate drawn for each site and capped; sites that lose a true
    allele dropped; then split and put into batches.
    """
    rows = E.fraction_qc(E.prune_homozygous(E.trainable_sites(examples), keep, seed), cutoff)
    kept = E.subsample(reads, rates, seed)
    if most_reads is not None:
        kept = E.cap_site_reads(kept, most_reads, seed)
    left = kept.groupBy("site", "allele").agg(F.count("*").alias("support"))
    rows = rows.drop("support").join(left, ["site", "allele"], "left").withColumn("support", F.coalesce("support", F.lit(0).cast("long")))
    split = E.split(E.covered_truth(rows), seed=seed)
    parts = [E.collate(split.where(F.col("part") == p), batch, workers).withColumn("part", F.lit(p)) for p in ("train", "validation")]
    return parts[0].unionByName(parts[1])


def vcf_from_examples(examples: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalised records of labelled examples, and the sites that have no true allele."""
    sites = examples.select("site_key", "chrom", "start", "stop").distinct()
    records, none = E.examples_as_records(examples, V.reference_slice(sites, reference, "start", "stop", "ref").select("site_key", "ref"))
    return V.normalise(records, reference), none


def explain_failures(failures: DataFrame, features: DataFrame, confident: DataFrame, reference: DataFrame) -> DataFrame:
    return X.explained(failures, features, confident, reference)


def labelled_candidates(support: DataFrame, reference: DataFrame, truth: DataFrame, confident: DataFrame, only_contained: bool = False) -> tuple[DataFrame, DataFrame]:
    """(candidate sites, labelled sites) inside confident regions.

    Candidate sites that overlap a confident region (``only_contained``: that
    lie inside one) are clustered (linked below a gap of 30, eight at most); a
    cluster with the reference text around it is a region, and all confident
    truths inside it are matched against its candidates.
    """
    sites = support.groupBy("chrom", F.col("site_start").alias("start"), F.col("site_stop").alias("stop"), "ref").agg(F.collect_set("allele").alias("alleles"))
    sites = written(I.overlap_join(sites, confident, how="left_semi", inside=only_contained), "candidate-sites")
    parts = I.capped_clusters(sites, 30, 8)
    spans = I.segment_bounds(parts)
    spans = spans.select("chrom", "island", "part", F.greatest("seg_start", F.lit(0)).alias("seg_start"), "seg_stop").withColumn("region", F.concat_ws("_", "chrom", "seg_start"))
    text = V.reference_slice(spans, reference, "seg_start", "seg_stop", "segment")
    placed = parts.join(text, ["chrom", "island", "part"])
    found = V.candidate_record(placed.withColumn("pos", F.col("start"))).where("size(alts) > 0").withColumn("alts", F.array_sort("alts"))
    listed = lambda rows: rows.groupBy("region", "seg_start", "segment").agg(F.sort_array(F.collect_list(F.struct("pos", "ref", "alts", "gt"))).alias("sites"))
    known = I.points_in(truth, confident).withColumns({"start": F.col("pos"), "stop": F.col("pos") + F.length("ref")})
    known = I.overlap_join(known, text.select("chrom", F.col("seg_start").alias("start"), F.col("seg_stop").alias("stop"), "region", "segment"), inside=True)
    known = known.select(F.col("b_region").alias("region"), F.col("b_start").alias("seg_start"), F.col("b_segment").alias("segment"), "pos", "ref", "alts", "gt")
    return found, H.label_sites(listed(known), listed(found.select("region", "seg_start", "segment", "pos", "ref", "alts", "gt")))


def dump_training(reads: DataFrame, reference: DataFrame, truth: DataFrame, confident: DataFrame) -> DataFrame:
    """Labelled alleles of candidate sites inside confident regions."""
    support = site_support(reads, reference)
    found, labelled = labelled_candidates(support, reference, truth, confident)
    keyed = support.select("chrom", F.col("site_start").alias("start"), "allele", "support").join(found.select("chrom", "start", "region", "pos"), ["chrom", "start"])
    return H.label_alleles(labelled, keyed.select("region", "pos", "allele", "support"))


def dump_examples(reads: DataFrame, reference: DataFrame, truth: DataFrame, confident: DataFrame, store: str, vcf: str | None = None, width: int = 150, per_base: float | None = None, only_contained: bool = False, labels_by: str | None = None, stored: bool = False) -> None:
    """Writes labelled sites as a keyed store of examples, and (with ``vcf``) the labelled records as VCF lines.

    A row of the store is a supported allele of a site: its label and the
    site's, its support by technology, the reference segment around the site,
    and the read tensors of both technologies (``tensors.site_tensors``).
    With ``labels_by`` (a technology) only alleles that this one supports are
    true, and sites that have no true allele left are not stored.
    """
    rows, slices = candidate_slices(reads, reference, per_base, stored)
    support = written(support_of(slices, reference), "site-support")
    found, labelled = labelled_candidates(support, reference, truth, confident, only_contained)
    labelled, found = written(labelled, "labelled-sites"), written(found.select("chrom", "start", "stop", "region", "pos", "ref", "alts"), "found-sites")
    if vcf is not None:
        lines = sinks.labelled_lines(H.label_attach(found, labelled).join(found.select("region", "pos", "chrom"), ["region", "pos"]))
        V.sort_vcf(lines).select(F.col("line").alias("value")).write.text(vcf)
    keyed = support.withColumnsRenamed({"site_start": "start", "site_stop": "stop"}).join(found.drop("ref", "alts"), ["chrom", "start", "stop"])
    alleles = H.label_alleles(labelled, keyed.select("region", "pos", "allele", "support")).join(keyed.select("region", "pos", "chrom", "start", "stop", "allele", "illumina", "pacbio"), ["region", "pos", "allele"])
    if labels_by is not None:
        alleles = alleles.withColumn("label", F.when(F.col(TECHS[labels_by]) > 0, F.col("label")).otherwise(0))
        alleles = alleles.join(alleles.where("label = 1").select("region", "pos").distinct(), ["region", "pos"], "left_semi")
    seen = site_tensors(rows, slices, reference, width)
    seen = seen.select("chrom", F.col("site_start").alias("start"), F.col("site_stop").alias("stop"), "segment", F.explode("alleles").alias("x"))
    seen = seen.select("chrom", "start", "stop", "segment", F.col("x.allele").alias("allele"), *(F.col(f"x.{t}").alias(f"{t}_reads") for t in TECHS.values()))
    alleles = alleles.withColumn("site_key", F.concat_ws("_", "chrom", "start", "stop")).drop("region", "pos").join(seen, ["chrom", "start", "stop", "allele"], "left")
    sinks.write_examples(alleles, store)
