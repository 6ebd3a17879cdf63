"""Small cases with results worked out by hand, and random ones against slow loops."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import haplotypes as H
from strandlake.operators import intervals as I
from strandlake.operators import pileup as P
from strandlake.operators import reads as R
from strandlake.operators import scoring as C
from strandlake.operators import sites as T
from strandlake.operators import variants as V
from strandlake.plans import jobs
from strandlake.plans.example_queries import alleles
from strandlake.plans.registry import QUERIES
from strandlake.sources import sinks, text

REF = "ACGATACCGTACGGATCGGATCGT"
READ_SCHEMA = "chrom string, read_name string, start long, end long, seq string, qual array<smallint>, cigar array<struct<op:int,len:int>>, mapq int, is_reverse boolean, flag int, tags map<string,int>, tech string"


def read(name, seq, cigar, qual, mapq, reverse, start=9, tags=None, tech="I"):
    span = sum(n for op, n in cigar if op in (0, 2, 3))
    return ("c", name, start, start + span, seq, [qual] * len(seq), cigar, mapq, reverse, 0, tags or {}, tech)


@pytest.fixture(scope="module")
def three(spark):
    rows = [read("r0", "TAATCG", [(0, 2), (2, 3), (0, 4)], 26, 30, True), read("r1", "TAACGGATCG", [(0, 2), (1, 1), (0, 7)], 30, 44, False), read("r2", "TGCGGATCG", [(0, 9)], 15, 75, False, tags={"HP": 2})]
    return spark.createDataFrame(rows, READ_SCHEMA)


@pytest.fixture(scope="module")
def reference(spark):
    return spark.createDataFrame([("c", 0, 0, REF)], "chrom string, chunk_id long, chunk_start long, seq string")


def test_counts_at_one_site(three, reference):
    counts = {(r.pos, r.ref, r.alt): r.n for r in P.allele_counts(three, reference, 0).collect()}
    assert counts == {(10, "ACGG", "A"): 2, (10, "A", "AA"): 2, (10, "A", "G"): 1}
    total = {r.pos: r.total for r in P.depth(three).collect()}
    assert total[10] == 3 and total[11] == 2


def test_no_hotspot_with_default_gates(three, reference):
    counts = P.resolve_partials(P.allele_counts(three, reference))
    assert P.hotspots(counts, three).count() == 0


def test_alleles_at_one_site(spark, three):
    sites = spark.createDataFrame([("c", 10, 15)], "chrom string, start long, stop long")
    found = {r.read_name: (r.allele, r.min_q, r.status) for r in T.site_slices(three, sites).collect()}
    assert found == {"r0": ("AA", 26, "Success"), "r1": ("AACGGA", 30, "Success"), "r2": ("GCGGA", 15, "Success")}


def test_tensor_cells(spark, three, reference):
    sites = spark.createDataFrame([("c", 10, 15)], "chrom string, start long, stop long")
    rows = T.read_tensors(three, T.site_slices(three, sites), reference, width=10).where("read_name = 'r2'").first()
    at = 10 - 7  # the window is 7-16
    assert (rows.base[at], rows.ref[at], rows.q[at], rows.m[at], rows.s[at], rows.p[at], rows.h[at]) == (180, 250, 95, 254, 70, 240, 240)


def test_partial_insertions(spark):
    rows = [("c", 5, "I", "A", "ACC", "insertion", 4), ("c", 5, "I", "A", "AGC", "insertion", 2), ("c", 5, "I", "A", "CC", "left", 2), ("c", 5, "I", "A", "C", "left", 8), ("c", 5, "I", "A", "AG", "right", 2), ("c", 5, "I", "A", "TT", "left", 2)]
    counts = spark.createDataFrame(rows, "chrom string, pos long, tech string, ref string, alt string, kind string, n long")
    assert {r.alt: r.n for r in P.resolve_partials(counts).collect()} == {"ACC": 6, "AGC": 4}


def test_normalisation(spark):
    ref = spark.createDataFrame([("c", 0, 0, "GGGCACACACAGGG")], "chrom string, chunk_id long, chunk_start long, seq string")
    rows = spark.createDataFrame([("c", 7, "CA", [""]), ("c", 3, "CAC", ["CAT"]), ("c", 3, "CAC", ["CAC"])], "chrom string, pos long, ref string, alts array<string>")
    found = {(r.pos, r.ref, r.alts[0]) for r in V.normalise(rows, ref).collect()}
    assert found == {(2, "GCA", "G"), (5, "C", "T")}


def test_normalisation_against_a_loop(spark):
    rng = random.Random(7)
    genome = "".join(rng.choice("AC") for _ in range(400))

    def loop(pos, ref, alt):
        while True:
            if ref and alt and ref[-1] == alt[-1] and (len(ref) > 1 and len(alt) > 1 or pos > 0):
                if len(ref) == 1 or len(alt) == 1:
                    pos -= 1
                    ref, alt = genome[pos] + ref, genome[pos] + alt
                ref, alt = ref[:-1], alt[:-1]
            elif not ref or not alt:
                pos -= 1
                ref, alt = genome[pos] + ref, genome[pos] + alt
            else:
                break
        while len(ref) > 1 and len(alt) > 1 and ref[0] == alt[0]:
            pos, ref, alt = pos + 1, ref[1:], alt[1:]
        return pos, ref, alt

    cases = []
    for k in range(300):
        pos, n = rng.randrange(60, 380), rng.randrange(1, 6)
        ref = genome[pos : pos + n]
        alt = "".join(rng.choice("AC") for _ in range(rng.randrange(1, 6)))
        if ref != alt:
            cases.append((k, "c", pos, ref, [alt]))
    rows = spark.createDataFrame(cases, "k long, chrom string, pos long, ref string, alts array<string>")
    chunk = spark.createDataFrame([("c", 0, 0, genome)], "chrom string, chunk_id long, chunk_start long, seq string")
    found = {r.k: (r.pos, r.ref, r.alts[0]) for r in V.normalise(rows, chunk).collect()}
    assert found == {k: loop(p, r, a[0]) for k, _, p, r, a in cases}


def test_genotype_and_quality(spark):
    scores = spark.createDataFrame([("s", "A", 0.9), ("s", "C", 0.8)], "site string, allele string, p double")
    pairs = V.pair_likelihood(scores)
    assert {(r.a1, r.a2): round(r.p, 6) for r in pairs.collect()} == {("A", "C"): 0.72, ("A", "A"): 0.18, ("C", "C"): 0.08}
    best = V.top_genotype(pairs, ("site",)).first()
    assert (best.a1, best.a2, round(best.qual, 6)) == ("A", "C", 5.52842)


def test_islands_and_merging(spark):
    points = spark.createDataFrame([("c", p) for p in (100, 101, 102, 110, 150)], "chrom string, pos long")
    assert sorted((r.start, r.stop) for r in I.consecutive_runs(points).collect()) == [(100, 103), (110, 111), (150, 151)]
    assert sorted((r.start, r.stop) for r in I.gap_regions(points, 30).collect()) == [(85, 125), (135, 165)]
    spans = spark.createDataFrame([("c", 0, 5), ("c", 5, 7), ("c", 6, 9)], "chrom string, start long, stop long")
    merged = I.merge_overlaps(spans)
    assert sorted((r.start, r.stop) for r in merged.collect()) == [(0, 5), (5, 9)]
    assert sorted((r.start, r.stop) for r in I.merge_overlaps(merged).collect()) == [(0, 5), (5, 9)]


def test_long_sites_in_clusters(spark):
    def slow(sites, gap=30, cap=3, longest=80):
        out, cluster = [], []
        for s, e in sites:
            if e - s > longest and cluster:
                out.append(cluster)
                cluster = []
                continue
            if not cluster:
                cluster = [(s, e)]
            elif s - cluster[-1][1] < gap and len(cluster) < cap:
                cluster.append((s, e))
            else:
                out.append(cluster)
                cluster = [(s, e)]
        return sorted(map(tuple, out + [cluster] if cluster else out))

    rng = random.Random(3)
    for _ in range(5):
        at, sites = 0, []
        for _ in range(40):
            at += rng.randrange(1, 60)
            size = rng.choice([1, 5, 100, 120])
            sites.append((at, at + size))
            at += size
        df = spark.createDataFrame([("c", *s) for s in sites], "chrom string, start long, stop long")
        rows = I.capped_clusters(df, 30, 3).groupBy("island", "part").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("c")).collect()
        assert sorted(tuple((x.start, x.stop) for x in r.c) for r in rows) == slow(sites)


def test_labels(spark):
    def region(alts, gt):
        site = [(103, "T", alts, gt)]
        return spark.createDataFrame([("r", 100, "ACGTACGT", site)], "region string, seg_start long, segment string, sites array<struct<pos:long,ref:string,alts:array<string>,gt:array<int>>>")

    truth = region(["G"], [0, 1])
    good = H.label_sites(truth, region(["G"], [0, 0])).first()
    assert good.status == "LABELLED" and {good.picks0_allele, good.picks1_allele} == {"T", "G"}
    assert H.label_sites(truth, region(["C"], [0, 0])).first().status == "MISSED"


def test_labels_of_ten_sites(spark):
    """Seven and more truth sites, nine and more candidate sites are labelled; eleven are not."""
    schema = "region string, seg_start long, segment string, sites array<struct<pos:long,ref:string,alts:array<string>,gt:array<int>>>"
    rows = [(f"r{n}", 100, "ACGT" * 30, [(103 + 8 * k, "T", ["G"], [0, 1]) for k in range(n)]) for n in (2, 7, 10, 11)]
    regions = spark.createDataFrame(rows, schema)
    found = H.label_sites(regions, regions).collect()
    assert {(r.region, r.status) for r in found} == {("r2", "LABELLED"), ("r7", "LABELLED"), ("r10", "LABELLED"), ("r11", "MISSED")}
    assert all({r.picks0_allele, r.picks1_allele} == {"T", "G"} for r in found if r.region != "r11")


def test_truth_inside_a_run(spark, monkeypatch):
    """A true variant at a later position of a candidate site labels its allele."""
    genome = "ACGT" * 100
    rows = [("c", 100, 103, a, n, "ACG") for a, n in (("ACG", 9), ("ATG", 8))]
    support = spark.createDataFrame(rows, "chrom string, site_start long, site_stop long, allele string, support long, ref string")
    monkeypatch.setattr(jobs, "site_support", lambda reads, reference: support)
    chunk = spark.createDataFrame([("c", 0, 0, genome)], "chrom string, chunk_id long, chunk_start long, seq string")
    truth = spark.createDataFrame([("c", 101, "C", ["T"], [1, 1])], "chrom string, pos long, ref string, alts array<string>, gt array<int>")
    confident = spark.createDataFrame([("c", 0, 400)], "chrom string, start long, stop long")
    found = jobs.dump_training(None, chunk, truth, confident).collect()
    assert {(r.allele, r.label, r.site_label) for r in found} == {("ACG", 0, 0), ("ATG", 1, 0)}


def test_clip_lengths(spark, three):
    regions = spark.createDataFrame([("c", 11, 14)], "chrom string, start long, stop long")
    for r in R.clipped(three, regions, 0).collect():
        assert r["first"] >= 10 and r["last"] <= 14 + 3 and len(r.clip) <= r["last"] - r["first"] + 1


# ---- nothing is lost

def test_shifts_over_chunks(spark):
    """A deletion in a run of 24,998 equal bases moves to its start, over three chunks of the reference."""
    genome = "C" + "A" * 24_998 + "G" + "ACGT" * 1_250
    chunks = spark.createDataFrame([("c", k, k * 10_000, genome[k * 10_000 : (k + 1) * 10_000]) for k in range(3)], "chrom string, chunk_id long, chunk_start long, seq string")
    rows = spark.createDataFrame([("c", p, "AA", ["A"]) for p in (24_990, 9_990, 3_000, 5)] + [("c", 25_000, "A", ["T"])], "chrom string, pos long, ref string, alts array<string>")
    found = sorted((r.pos, r.ref, r.alts[0]) for r in V.normalise(rows, chunks).collect())
    assert found == [(0, "CA", "C")] * 4 + [(25_000, "A", "T")]


def test_slices_of_the_reference(spark):
    chunks = spark.createDataFrame([("c", k, k * 10_000, "ACGT" * 2_500) for k in range(3)], "chrom string, chunk_id long, chunk_start long, seq string")
    rows = spark.createDataFrame([("c", 9_998, 10_003), ("c", 29_998, 30_050), ("c", -3, 2)], "chrom string, a long, b long")
    assert sorted(r.slice for r in V.reference_slice(rows, chunks, "a", "b").collect()) == ["AC", "GT", "GTACG"]
    with pytest.raises(Exception, match="two reference chunks"):
        V.reference_slice(spark.createDataFrame([("c", 9_998, 25_000)], "chrom string, a long, b long"), chunks, "a", "b").collect()


def test_semi_join_keeps_repeated_rows(spark):
    a = spark.createDataFrame([("c", 0, 5_000, {"x": 1}), ("c", 0, 5_000, {"x": 1}), ("c", 9_000, 9_001, {})], "chrom string, start long, stop long, tags map<string,int>")
    b = spark.createDataFrame([("c", 10, 20), ("c", 4_000, 4_100)], "chrom string, start long, stop long")
    assert [r.start for r in I.overlap_join(a, b, how="left_semi").collect()] == [0, 0]
    assert I.overlap_join(a, b).count() == 4


def test_overlaps_against_a_loop(spark):
    rng = random.Random(2)
    make = lambda n: [("c" + str(rng.randrange(2)), s, s + rng.choice([1, 30, 5_000])) for s in (rng.randrange(20_000) for _ in range(n))]
    a, b = make(80), make(80)
    df = [spark.createDataFrame(x, "chrom string, start long, stop long") for x in (a, b)]
    found = sorted((r.chrom, r.start, r.stop, r.b_start, r.b_stop) for r in I.overlap_join(*df).collect())
    assert found == sorted((*x, y[1], y[2]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])


def test_nearest_against_a_loop(spark):
    rng = random.Random(5)
    a, b = [[("c", rng.randrange(3_000)) for _ in range(200)] for _ in range(2)]
    df = [spark.createDataFrame(x, "chrom string, pos long") for x in (a, b)]
    found = sorted((r.pos, -1 if r.match is None else r.match) for r in I.nearest_within(*df, tolerance=9, width=100).collect())
    after = lambda p: min((q for _, q in b if p <= q <= p + 9), default=-1)
    assert found == sorted((p, after(p)) for _, p in a)


# ---- reads against slow loops

def slow_cells(start, seq, qual, cigar):
    """(pos, part, text, q, op index) of a read."""
    out, ref, off = [], start, 0
    for k, (op, n) in enumerate(cigar):
        if op in (0, 7, 8):
            out += [(ref + i, 0, seq[off + i], qual[off + i], k) for i in range(n)]
        elif op == 2:
            out += [(ref + i, 0, "", 60, k) for i in range(n)]
        elif op == 1:
            out.append((ref - 1, 1, seq[off : off + n], min(qual[off : off + n]), k))
        ref += n if op in (0, 2, 3, 7, 8) else 0
        off += n if op in (0, 1, 4, 7, 8) else 0
    return out


def random_reads(rng, n, operations=9):
    rows = []
    for k in range(n):
        ops = []
        for _ in range(rng.randint(1, operations)):
            op = rng.choice([0, 0, 0, 1, 2, 4, 7])
            if not ops or ops[-1][0] != op:
                ops.append((op, rng.randint(1, 6)))
        size = sum(m for op, m in ops if op in (0, 1, 4, 7))
        span = sum(m for op, m in ops if op in (0, 2, 7))
        start = rng.randint(10, 60)
        rows.append(("c", f"r{k}", start, start + span, "".join(rng.choice("ACGT") for _ in range(size)), [rng.randint(2, 40) for _ in range(size)], ops, 30, False, 0, {}, rng.choice("IP")))
    return rows


def test_site_slices_against_a_loop(spark):
    rng = random.Random(11)
    rows = random_reads(rng, 150)
    sites = [(s, s + rng.choice([1, 2, 5])) for s in range(12, 80, 7)]
    expect = {}
    for _, name, start, stop, seq, qual, cigar, *_ in rows:
        cells = slow_cells(start, seq, qual, cigar)
        for a, b in sites:
            near = [c for c in cells if a - 1 <= c[0] <= b]
            if stop <= a or start >= b or not near:
                continue
            inside = sorted(c for c in near if a <= c[0] < b)
            has = lambda at: any(c[0] == at and c[1] == 0 for c in near)  # noqa: E731, B023
            bare = lambda at: any(c[0] == at and c[1] == 0 and not c[2] for c in near) and not any(c[0] == at and c[1] for c in near)  # noqa: E731, B023
            first, last = any(c[1] and c[4] == 0 for c in near), any(c[1] and c[4] == len(cigar) - 1 > 0 for c in near)
            status = "Fail" if bare(a) or bare(b - 1) else "LeftPartial" if not has(a) or not has(a - 1) and first else "Success" if not has(a - 1) else "RightPartial" if not has(b - 1) or not has(b) and last else "Success"
            expect[name, a, b] = ("".join(c[2] for c in inside), min((c[3] for c in inside), default=None), status)
    df = spark.createDataFrame(rows, READ_SCHEMA)
    found = T.site_slices(df, spark.createDataFrame([("c", *x) for x in sites], "chrom string, start long, stop long")).collect()
    assert {(r.read_name, r.site_start, r.site_stop): (r.allele, r.min_q, r.status) for r in found} == expect


def test_long_cigars(spark):
    """Thousands of operations are placed as a loop places them."""
    rng = random.Random(12)
    rows = random_reads(rng, 3, operations=3_000)
    for r in R.with_ops(spark.createDataFrame(rows, READ_SCHEMA)).collect():
        ref, off, expect = r.start, 0, []
        for op, n in r.cigar:
            expect.append((op, n, ref, off))
            ref, off = ref + (n if op in (0, 2, 3, 7, 8) else 0), off + (n if op in (0, 1, 4, 7, 8) else 0)
        assert [tuple(x) for x in r.ops] == expect


def test_depth_and_counts_against_a_loop(spark):
    rng = random.Random(13)
    rows = random_reads(rng, 120)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    chunk = spark.createDataFrame([("c", 0, 0, genome)], "chrom string, chunk_id long, chunk_start long, seq string")
    df = spark.createDataFrame(rows, READ_SCHEMA)
    total, counts = {}, {}
    for _, _, start, _, seq, qual, cigar, *_, tech in rows:
        if cigar[0][0] == 1:
            total[start - 1, tech] = total.get((start - 1, tech), 0) + 1
        for pos, part, base, q, k in slow_cells(start, seq, qual, cigar):
            if part == 0 and base:
                total[pos, tech] = total.get((pos, tech), 0) + 1
                if base != genome[pos] and q >= 10:
                    counts[pos, tech, genome[pos], base] = counts.get((pos, tech, genome[pos], base), 0) + 1
    assert {(r.pos, r.tech): r.total for r in P.depth(df).collect()} == total
    found = P.allele_counts(df, chunk).where("kind = 'snv'")
    assert {(r.pos, r.tech, r.ref, r.alt): r.n for r in found.collect()} == counts
    at = P.with_depth(found.select("chrom", "pos", "tech", "ref", "alt", "n"), df).collect()
    assert {(r.pos, r.tech, r.ref, r.alt): (r.n, r.total) for r in at} == {k: (n, total[k[:2]]) for k, n in counts.items()}


def test_reconciled_reads(spark):
    reads = [("r", 10, 20, "P", "a", 10, 25, "ACGT"), ("r", 10, 20, "P", "b", 12, 25, "ACGT"), ("r", 10, 20, "P", "c", 8, 25, "ACGT"), ("r", 10, 20, "P", "d", 10, 15, "ACGT"), ("r", 10, 20, "I", "e", 10, 25, "ACGT"), ("r", 10, 20, "P", "f", 10, 25, "TTTT"), ("s", 10, 20, "P", "g", 10, 25, "ACGT")]
    haplotypes = spark.createDataFrame(reads, "region string, region_start long, region_stop long, tech string, read_name string, start long, end long, haplotype string")
    sites = [(100, "A", ["C"], [0, 0]), (103, "T", ["G"], [0, 0])]
    candidates = spark.createDataFrame([("r", 100, "ACGT", sites), ("s", 100, "ACGT", sites)], "region string, seg_start long, segment string, sites array<struct<pos:long,ref:string,alts:array<string>,gt:array<int>>>")
    coverage = spark.createDataFrame([("r", 14.5), ("s", 14.0)], "region string, mean double")
    names = lambda **k: sorted(r.read_name for r in H.reconcile(haplotypes, candidates, coverage, **k).collect())
    assert {tuple(r.picks) for r in H.reconcile(haplotypes, candidates, coverage).collect()} == {("A", "T")}
    assert names() == ["a", "b"] and names(intended=True) == ["a", "c"] and names(most_sites=2) == []


def test_region_coverage(spark):
    reads = spark.createDataFrame([("c", 0, 10, "I"), ("c", 5, 12, "I"), ("c", 0, 50, "P")], "chrom string, start long, end long, tech string")
    regions = spark.createDataFrame([("r", "c", 4, 14)], "region string, chrom string, start long, stop long")
    assert T.region_coverage(reads, regions).collect()[0].mean == (6 + 7) / 8  # columns 4-11 are covered


def test_reasons_of_failures(spark):
    genome = "ACGTACGTACGTACGTACGT"
    chunk = spark.createDataFrame([("c", 0, 0, genome)], "chrom string, chunk_id long, chunk_start long, seq string")
    failures = [("c", 2, 3, "G", ["T"], [0, 1], None), ("c", 6, 7, "G", ["T"], [1, 1], None), ("c", 10, 11, "G", ["T"], [1, 1], None), ("c", 14, 15, "G", ["T"], [1, 1], None), ("c", 16, 17, "A", ["T"], [0, 1], None), ("c", 16, 18, "AC", ["A"], [0, 1], None), ("c", 100, 101, "A", ["T"], [1, 1], None)]
    fails = spark.createDataFrame(failures, "chrom string, start long, stop long, ref string, alts array<string>, gt0 array<int>, gt1 array<int>")
    features = [("c", 1, 4, "CGT", 0.9), ("c", 1, 4, "CTT", 0.8), ("c", 6, 7, "G", 0.9), ("c", 6, 7, "T", 0.5), ("c", 10, 11, "G", 0.9), ("c", 16, 17, "A", 0.9)]
    sites = spark.createDataFrame(features, "chrom string, start long, stop long, allele string, p double")
    found = jobs.explain_failures(fails, sites, spark.createDataFrame([("c", 0, 20)], "chrom string, start long, stop long"), chunk).collect()
    assert {r.start: r.reason for r in found} == {2: "CLASSIFICATION_HETEROZYGOUS", 6: "MODELING_HOMOZYGOUS", 10: "ASSEMBLY_HOMOZYGOUS", 14: "DID_NOT_RUN", 16: "CANNOT_ANALYSE"}


def test_model_scores(spark):
    rows = spark.createDataFrame([("c", 1, 2, "A", [0.2, 0.4]), ("c", 1, 2, "C", [0.6, 0.8])], "chrom string, site_start long, site_stop long, allele string, features array<double>")
    predict = lambda x: x[:, [0, 1, 0]]
    alone = {r.allele: (r.p, r.meta) for r in C.model_scores(rows, predict).collect()}
    assert alone == {"A": ([0.2, 0.0, 0.0], [1.0, 0.0, 0.0]), "C": ([0.6, 0.0, 0.0], [1.0, 0.0, 0.0])}
    mixed = C.model_scores(rows, predict, lambda x: x[:, [0, 1, 1]]).collect()
    assert {(r.allele, *[round(x, 6) for x in r.p + r.meta]) for r in mixed} == {("A", 0.2, 0.4, 0.2, 0.4, 0.6, 0.6), ("C", 0.6, 0.8, 0.6, 0.4, 0.6, 0.6)}


# ---- files

def test_files_there_and_back(spark, three, tmp_path):
    sinks.sam_lines(three).write.text(f"{tmp_path}/sam")
    back = {r.read_name: r for r in text.read_sam(spark, f"{tmp_path}/sam").collect()}
    for r in three.collect():
        b = back[r.read_name]
        assert (b.start, b.end, b.seq, list(b.qual), [tuple(x) for x in b.cigar], b.mapq, b.tags) == (r.start, r.end, r.seq, list(r.qual), [tuple(x) for x in r.cigar], r.mapq, r.tags)
    (tmp_path / "g.fa").write_text(">a first\n" + "\n".join("ACGTT" * 14 for _ in range(300)) + "\n>b\nGGG\n")
    chunks = {(r.chrom, r.chunk_id): r.seq for r in text.read_fasta(spark, f"{tmp_path}/g.fa").collect()}
    assert chunks["a", 0] + chunks["a", 1] + chunks["a", 2] == "ACGTT" * 14 * 300 and chunks["b", 0] == "GGG"
    spans = spark.createDataFrame([("c", 5, 9), ("c", 7, 20), ("d", 0, 3)], "chrom string, start long, stop long")
    sinks.write_bed(spans, f"{tmp_path}/bed")
    assert sorted(map(tuple, text.read_bed(spark, f"{tmp_path}/bed").collect())) == sorted(map(tuple, spans.collect()))
    points = spark.createDataFrame([("c", 5, 0), ("c", 6, 1)], "chrom string, pos long, shard int")
    sinks.write_hotspots(points, f"{tmp_path}/spots")
    assert sorted(map(tuple, text.read_hotspots(spark, f"{tmp_path}/spots").collect())) == [("c", 5), ("c", 6)]
    records = spark.createDataFrame([("chr2", 9, "A", ["G"], [0, 1], 30.0), ("chr1", 90, "A", ["C", "T"], [1, 2], 30.0), ("chr1", 7, "A", ["G"], [1, 1], 30.0)], "chrom string, pos long, ref string, alts array<string>, gt array<int>, qual double").withColumns({"filter": F.lit("PASS"), "info": F.lit(".")})
    sinks.write_vcf(records, spark.createDataFrame([("chr1", 1000), ("chr2", 500)], "chrom string, length long"), f"{tmp_path}/vcf")
    lines = [x for p in sorted((tmp_path / "vcf").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines[0] == "##fileformat=VCFv4.2" and [x.split("\t")[:2] for x in lines if x[0] != "#"] == [["chr1", "8"], ["chr1", "91"], ["chr2", "10"]]
    assert sorted((r.chrom, r.pos, r.alts, r.gt) for r in text.read_vcf(spark, f"{tmp_path}/vcf").collect()) == [("chr1", 7, ["G"], [1, 1]), ("chr1", 90, ["C", "T"], [1, 2]), ("chr2", 9, ["G"], [0, 1])]
    names = [("chrM", 1), ("chrEBV", 2), ("chrM", 4), ("chrUn_1", 3), ("chr1", 5), ("chrUn_1", 9), ("chr10", 1), ("chr2", 1), ("chrX", 1)]
    odd = spark.createDataFrame([(c, p, "A", ["G"], [0, 1], 30.0) for c, p in names], records.drop("filter", "info").schema).withColumns({"filter": F.lit("PASS"), "info": F.lit(".")})
    sinks.write_vcf(odd, spark.createDataFrame([(c, 100) for c in {c for c, _ in names}], "chrom string, length long"), f"{tmp_path}/vcf2")
    lines = [x for p in sorted((tmp_path / "vcf2").glob("part-*")) for x in p.read_text().splitlines()]
    order = ["chr1", "chr2", "chr10", "chrX", "chrEBV", "chrM", "chrUn_1"]
    assert [x.split("\t")[0] for x in lines if x[0] != "#"] == sorted((c for c, _ in names), key=order.index)
    assert [x.split("=")[2].split(",")[0] for x in lines if "contig" in x] == order
    sinks.write_reads(three, f"{tmp_path}/reads")
    assert text.read_region(spark, f"{tmp_path}/reads", "c", 17, 18).count() == 3 and text.read_region(spark, f"{tmp_path}/reads", "c", 0, 9).count() == 0


# ---- queries without SQL: what must hold for any choice by hash

def test_choices_by_hash(spark, sf):
    run = lambda name: QUERIES[name](spark, sf).toPandas()
    rows = alleles(spark, sf).toPandas()
    sites = rows.groupby("site").size()
    pruned = run("prune_homozygous")
    assert set(sites[sites > 1].index) <= set(pruned.site) and len(pruned) < len(rows)
    split = run("split_train_val").set_index("part").sites
    assert split.sum() == len(sites) and 0.85 < split["train"] / split.sum() < 0.95
    shards = run("worker_shards")
    assert shards.groupby("worker").site.nunique().nunique() == 1 and not shards.site.duplicated().any() and shards.worker.nunique() == 7
    batches = run("batch_collate")
    assert sum(map(len, batches.alleles_per_site)) == len(sites) and sum(map(len, batches.labels)) == len(rows) and max(map(len, batches.alleles_per_site)) == 16
    assert sum(map(sum, batches.reads_per_site)) == sum(map(sum, batches.reads_per_allele)) == rows.support.sum()
    rates = run("subsample_rates").set_index("rate")
    assert set(rates.index) <= {0.25, 0.5, 1.0} and rates.reads.sum() < rows.support.sum()
    order = run("block_shuffle")
    assert len(order) == len(rows) and order.groupby("block").block_order.nunique().max() == 1
    stored = run("shuffled_store")
    assert list(stored.ordinal) == list(range(len(rows))) and sorted(zip(stored.site, stored.allele, strict=True)) == sorted(zip(rows.site, rows.allele, strict=True))
    assert stored[["block_order", "block", "row_order"]].apply(tuple, axis=1).is_monotonic_increasing and not stored.site.is_monotonic_increasing
    capped = run("cap_reads")
    assert capped.groupby(["chrom", "tile"]).size().max() == 10
    assert run("random_pairing").groupby(["dataset", "chrom"]).partner.nunique().max() == 1
    length = run("dataset_length").iloc[0]
    assert length.workers == 4 and length.batches <= len(sites) // 16 // 4
    fed = run("feed_training")
    assert set(fed.part) == {"train", "validation"} and all(sum(x) > 0 for x in fed.reads_per_site)


def test_queries_of_whole_jobs(spark, sf):
    run = lambda name: QUERIES[name](spark, sf).toPandas()
    clusters = run("capped_clusters")
    assert clusters.groupby(["chrom", "island", "part"]).size().max() <= 8
    bounds = run("segment_bounds")
    assert len(bounds) == clusters.groupby(["chrom", "island", "part"]).ngroups and (bounds.seg_start <= bounds["first"]).all() and (bounds.seg_stop >= bounds["last"]).all()
    sweep = run("three_way_sweep")
    assert sweep.kind[sweep.start.isna()].eq("SECOND_ONLY").all() and sweep.kind[sweep.b_start.isna()].eq("FIRST_ONLY").all()
    calls = run("call_variants")
    assert not calls.duplicated(["chrom", "pos", "ref", "alts"]).any() and (calls.qual <= 80.000001).all() and (calls.alts != calls.ref).all()
    labelled = run("dump_training")
    assert set(labelled.label) == {0, 1} and labelled.groupby(["region", "pos"]).label.sum().max() <= 2
