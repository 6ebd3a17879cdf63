"""The calling job by way of active regions, against the variants that reads were made from, and its parts against loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import reads as R
from strandlake.operators import sites as T
from strandlake.operators import tensors
from strandlake.plans import jobs

SCHEMA = "chrom string, read_name string, start long, end long, seq string, qual array<smallint>, cigar array<struct<op:int,len:int>>, mapq int, is_reverse boolean, flag int, tags map<string,int>, tech string, sample string"


def genome(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def read_of(text, variants, start, stop):
    """(seq, cigar) of a haplotype's read over [start, stop); variants: (pos, ref, alt), sorted, with the base before indels."""
    seq, cigar, at = "", [], start

    def put(op, n):
        if n and cigar and cigar[-1][0] == op:
            cigar[-1] = (op, cigar[-1][1] + n)
        elif n:
            cigar.append((op, n))

    for pos, ref, alt in variants:
        if pos < start or pos + len(ref) + 3 > stop:
            continue
        put(0, pos - at + 1)
        seq += text[at:pos] + alt[0]
        if len(alt) > 1:
            put(1, len(alt) - 1)
            seq += alt[1:]
        put(2, len(ref) - 1)
        at = pos + len(ref)
    put(0, stop - at)
    return seq + text[at:stop], cigar


def simulated(rng, text, haplotypes, every=4):
    rows = []
    for tech, n in (("I", 120), ("P", 700)):
        for k, start in enumerate(range(0, len(text) - n, every if tech == "I" else 4 * every)):
            seq, cigar = read_of(text, haplotypes[k % 2], start, start + n)
            rows.append(("c", f"{tech}{k}", start, start + n, seq, [30] * len(seq), cigar, 60, k % 3 == 0, 0, {}, tech, "s"))
    return rows


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(12)
    text = genome(rng, 3000)
    other = lambda p: "ACGT"[("ACGT".index(text[p]) + 1) % 4]
    spots = {400: (1, 1), 700: (0, 1), 712: (1, 0), 1100: (1, 1), 1500: (0, 1), 1900: (1, 0), 2300: (0, 1)}
    variants = {}
    for p in spots:
        if p == 1100:
            while text[p + 1] == text[p] or text[p + 1] == text[p + 3]:
                text = text[:p] + genome(rng, 4) + text[p + 4 :]
            variants[p] = (p, text[p : p + 3], text[p])
        elif p == 1900:
            variants[p] = (p, text[p], text[p] + other(p) + other(p + 1))
        else:
            variants[p] = (p, text[p], other(p))
    haplotypes = [sorted(variants[p] for p in spots if spots[p][h]) for h in (0, 1)]
    reads = spark.createDataFrame(simulated(rng, text, haplotypes), SCHEMA).repartition(4)
    chunk = spark.createDataFrame([("c", 0, 0, text)], "chrom string, chunk_id long, chunk_start long, seq string")
    return reads, chunk, text, {p: (variants[p], spots[p]) for p in spots}


def spelled(text, calls):
    """The text with every alternative put in, which tells whether two records say the same."""
    out = set()
    for pos, ref, alt in calls:
        assert text[pos : pos + len(ref)] == ref
        out.add(text[:pos] + alt + text[pos + len(ref) :])
    return out


def test_calls_are_the_true_variants(case):
    reads, chunk, text, truth = case
    calls = jobs.call_active_regions(reads, chunk, least_coverage=5).collect()
    assert spelled(text, [(r.pos, r.ref, a) for r in calls for a in r.alts]) == spelled(text, [v for v, _ in truth.values()])


def test_cut_reads_give_the_same_slices(spark, case):
    reads, _, text, truth = case
    sites = spark.createDataFrame([("c", p, p + 3) for p in truth] + [("c", 2000, 2001)], "chrom string, start long, stop long")
    regions = spark.createDataFrame([("c", p - 15, p + 18) for p in truth if p not in (700, 712)] + [("c", 685, 730), ("c", 1980, 2020)], "chrom string, start long, stop long")
    keys = ["read_name", "site_start", "allele", "min_q", "status"]
    whole = T.site_slices(reads, sites).select(*keys)
    cut = R.cut_reads(reads, regions)
    assert cut.columns == reads.columns and cut.agg(F.max(F.length("seq"))).first()[0] <= 50
    assert sorted(map(tuple, T.site_slices(cut, sites).select(*keys).collect())) == sorted(map(tuple, whole.collect()))
    for r in cut.collect():
        assert len(r.seq) == len(r.qual) == sum(n for op, n in r.cigar if op in (0, 1)) and r.end - r.start == sum(n for op, n in r.cigar if op in (0, 2))


def linear_model():
    """A deterministic model of all that it gets (made here, so that it goes to the workers by value)."""
    def linear(sites):
        value = lambda x: float(x.astype(float).sum() % 97) / 97 if x.size else 0.0
        out = []
        for s in sites:
            p = np.array([[0.1 + 0.8 * value(i), 0.1 + 0.8 * value(q), 0.3] for i, q in zip(s.illumina, s.pacbio, strict=True)])
            out.append((p, np.array([0.5, 0.25, 0.25]) if s.segment.count("A") % 2 else np.array([0.2, 0.2, 0.6])))
        return out

    return linear


@pytest.mark.parametrize("batch", [1024, 2])
def test_tensors_reach_the_model(case, batch):
    """Scores of whole sites against the model called on arrays that are put together row by row."""
    reads, chunk, text, _ = case
    rows, slices = jobs.active_slices(reads, chunk, least_coverage=5)
    width = 20
    got = {(r.site_start, r.allele): (r.p, r.meta) for r in tensors.tensor_scores(tensors.site_tensors(rows, slices, chunk, width), linear_model(), width, batch).collect()}
    per = {}
    for r in T.read_tensors(rows, slices, chunk, width).collect():
        per.setdefault((r.site_start, r.site_stop), {}).setdefault(r.allele, {"I": [], "P": []})[r.tech].append([r[c] for c in tensors.CHANNELS])
    expect = {}
    for (start, stop), alleles in per.items():
        lo = (start + stop) // 2 - width // 2
        stack = lambda x: np.array(x, dtype=np.int16).reshape(len(x), 7, width)
        names = sorted(alleles)
        [(p, meta)] = linear_model()([tensors.Site(text[lo : lo + width], names, [stack(alleles[a]["I"]) for a in names], [stack(alleles[a]["P"]) for a in names])])
        expect |= {(start, a): (list(row), list(meta)) for a, row in zip(names, p, strict=True)}
    assert got == expect and len(got) >= 12


def test_calls_by_a_model(case):
    """A model that believes every allele with a fifth of the reads finds the true variants and genotypes."""
    reads, chunk, text, truth = case

    def share(sites):
        out = []
        for s in sites:
            n = np.array([len(i) + len(p) for i, p in zip(s.illumina, s.pacbio, strict=True)], float)
            out.append((np.repeat(np.where(5 * n >= n.sum(), 0.99, 0.01)[:, None], 3, axis=1), np.array([1.0, 0.0, 0.0])))
        return out

    calls = jobs.call_active_regions(reads, chunk, model=share, width=20, least_coverage=5).collect()
    assert spelled(text, [(r.pos, r.ref, a) for r in calls for a in r.alts]) == spelled(text, [v for v, _ in truth.values()])
    zygosity = {frozenset(spelled(text, [(r.pos, r.ref, r.alts[0])])): len(set(r.gt)) for r in calls}
    assert zygosity == {frozenset(spelled(text, [v])): len(set(gt)) for v, gt in truth.values()}
