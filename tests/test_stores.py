"""Files and stores: training dumps, reads of many regions, caps by tile."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandlake.operators import reads as R
from strandlake.plans import jobs
from strandlake.shared import fresh_path
from strandlake.sources import sinks, text
from strandlake.sources import synthetic as S


def tables(spark, sf):
    return S.reads(spark, sf), S.reference(spark, sf), S.truth(spark, sf), S.confident(spark, sf)


@pytest.fixture(scope="module")
def dump(spark, sf):
    store, vcf = fresh_path(spark, "training"), fresh_path(spark, "training-vcf")
    jobs.dump_examples(*tables(spark, sf), store, vcf, width=50)
    return spark.read.parquet(store).collect(), [r["value"] for r in text.read_lines(spark, vcf).orderBy("ordinal").collect()]


def test_a_dump_holds_the_labelled_alleles_with_their_tensors(spark, sf, dump):
    labels = Counter((r["region"].rsplit("_", 1)[0], r["pos"], r["allele"], r["label"], r["site_label"], r["support"]) for r in jobs.dump_training(*tables(spark, sf)).collect())
    rows, _ = dump
    assert Counter((r["chrom"], r["start"], r["allele"], r["label"], r["site_label"], r["support"]) for r in rows) == labels
    assert sorted(r["ordinal"] for r in rows) == list(range(len(rows))) and rows
    for r in rows:
        assert r["site_key"] == f"{r['chrom']}_{r['start']}_{r['stop']}" and len(r["segment"]) == 50
        assert (len(r["illumina_reads"]), len(r["pacbio_reads"])) == (r["illumina"], r["pacbio"]) and r["support"] == r["illumina"] + r["pacbio"]
        assert all(len(x) == 7 * 50 for x in r["illumina_reads"] + r["pacbio_reads"])


def test_the_vcf_of_a_dump_is_ordered_and_agrees_with_the_store(dump):
    rows, lines = dump
    fields = [x.split("\t") for x in lines]
    places = [(f[0], int(f[1])) for f in fields]
    assert places == sorted(places) and {f[6] for f in fields} <= {"PASS", "UNLABELED", "NO_ALT"}
    passed = {(f[0], int(f[1]) - 1): f for f in fields if f[6] == "PASS"}
    assert {(r["chrom"], r["start"]) for r in rows} <= set(passed)
    for r in rows:
        f = passed[r["chrom"], r["start"]]
        true = {([f[3], *f[4].split(",")])[int(g)] for g in f[9].split("/")}
        assert r["label"] == int(r["allele"] in true) and r["site_label"] == int(len(true) > 1)


def test_labels_by_one_technology_and_sites_inside_confident_regions(spark, sf, dump):
    reads, reference, truth, confident = tables(spark, sf)
    store = fresh_path(spark, "training")
    jobs.dump_examples(reads, reference, truth, confident, store, width=50, only_contained=True, labels_by="I")
    rows = spark.read.parquet(store).collect()
    inside = [(r["chrom"], r["start"], r["stop"]) for r in confident.collect()]
    assert rows and {(r["site_key"], r["allele"]) for r in rows} <= {(r["site_key"], r["allele"]) for r in dump[0]}
    for r in rows:
        assert any(c == r["chrom"] and a <= r["start"] and r["stop"] <= b for c, a, b in inside)
        assert r["label"] == 0 or r["illumina"] > 0
    assert {r["site_key"] for r in rows} == {r["site_key"] for r in rows if r["label"] == 1}


def test_reads_of_regions_are_those_that_overlap_and_are_capped(spark, sf):
    reads, confident = S.reads(spark, sf), S.confident(spark, sf)
    path = fresh_path(spark, "reads")
    sinks.write_reads(reads, path)
    spans = [(r["chrom"], r["start"], r["stop"]) for r in confident.collect()]
    want = Counter((c, a) for r in reads.select("chrom", "start", "end").collect() for c, a, b in spans if r["chrom"] == c and r["start"] < b and r["end"] > a)
    count = lambda most: {(r["chrom"], r["region_start"]): r["count"] for r in text.read_regions(spark, path, confident, most).groupBy("chrom", "region_start").count().collect()}
    assert count(10_000) == dict(want)
    assert count(5) == {k: min(n, 5) for k, n in want.items()}


def test_tiles_are_capped_by_technology(spark, sf):
    reads = jobs.clean_reads(S.reads(spark, sf))
    caps = {"I": (100, 7), "P": (1000, 30)}
    tile = lambda rows: Counter((r["chrom"], r["tech"], r["start"] // caps[r["tech"]][0]) for r in rows.select("chrom", "tech", "start").collect())
    every, kept = tile(reads), R.capped_tiles(reads, caps)
    assert tile(kept) == Counter({k: min(n, caps[k[1]][1]) for k, n in every.items()})
    again = R.capped_tiles(reads.repartition(7), caps)
    assert sorted(kept.select("read_name").collect()) == sorted(again.select("read_name").collect())
    # Reads of another technology take the largest cap, in the widest tiles.
    other = reads.withColumn("tech", F.lit("X"))
    sizes = Counter((r["chrom"], r["start"] // 1000) for r in other.select("chrom", "start").collect())
    assert R.capped_tiles(other, caps).count() == sum(min(n, 30) for n in sizes.values())


def test_capped_hotspots_are_those_of_the_capped_reads(spark, sf):
    reads, reference = S.reads(spark, sf), S.reference(spark, sf)
    points = lambda rows: {(r["chrom"], r["pos"]) for r in rows.collect()}
    assert points(jobs.detect_hotspots(reads, reference, {"I": (400, 10**6), "P": (400, 10**6)})) == points(jobs.detect_hotspots(reads, reference))
    few = {"I": (100, 7), "P": (1000, 30)}
    assert points(jobs.detect_hotspots(reads, reference, few)) == points(jobs.hotspots_of(R.capped_tiles(jobs.clean_reads(reads), few), reference))


def test_lines_of_files_in_their_order(spark):
    path = fresh_path(spark, "lines")
    spark.range(5000).repartitionByRange(6, "id").sortWithinPartitions("id").selectExpr("cast(id AS string) AS value").write.text(path)
    assert [(r["ordinal"], r["value"]) for r in text.read_lines(spark, path).orderBy("ordinal").collect()] == [(k, str(k)) for k in range(5000)]


def test_supporting_reads_are_those_that_are_counted(spark):
    """Reads that fail a gate support nothing; partial ones count for the one allele they fit."""
    from strandlake.operators import sites as T

    rows = [("full", "ACC", 60, 30, "Success"), ("again", "AGC", 60, 30, "Success"), ("low", "ACC", 60, 9, "Success"), ("unmapped", "ACC", 9, 30, "Success"), ("odd", "ANC", 60, 30, "Success"), ("failed", "ACC", 60, 30, "Fail"),
            ("left", "CC", 60, 5, "LeftPartial"), ("both", "C", 60, 30, "LeftPartial"), ("right", "AG", 60, 30, "RightPartial"), ("neither", "T", 60, 30, "RightPartial"), ("empty", "", 60, 30, "RightPartial")]
    slices = spark.createDataFrame([("c", 5, 8, "I", n, False, 0, 9, m, a, q, s) for n, a, m, q, s in rows], "chrom string, site_start long, site_stop long, tech string, read_name string, is_reverse boolean, start long, end long, mapq int, allele string, min_q int, status string")
    found = {r["read_name"]: r["allele"] for r in T.supporting(slices).collect()}
    assert found == {"full": "ACC", "again": "AGC", "left": "ACC", "right": "AGC"}
    assert {r["allele"]: r["support"] for r in T.partial_support(slices, T.allele_support(slices)).collect()} == Counter(found.values())
    assert T.supporting(slices.limit(0)).count() == 0
