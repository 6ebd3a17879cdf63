"""Scans in cells of a key, and what is built on them, against loops; cells are small, so that every case goes over their borders."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import haplotypes as H
from strandlake.operators import intervals as I
from strandlake.operators import pileup as P
from strandlake.operators import variants as V
from strandlake.operators.scans import highest, latest, range_cell, scanned, total


def test_running_values(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 1, 2, 5])) for i in range(200)]
    df = spark.createDataFrame(rows, "c string, pos long, v long")
    v = F.col("v")
    got = scanned(df, ["c"], ["pos"], range_cell(F.col("pos"), 7), s=total(v), n=total(own=False), m=highest(v, own=False), last=latest(v, own=False)).collect()
    expect = []
    for key in ("a", "b", None):
        s = n = 0
        most = last = None
        for c, p, x in rows:
            if c == key:
                s += x or 0
                expect.append((c, p, x, s, n, most, last))
                n += 1
                if x is not None:
                    most, last = max(most or 0, x), x
    order = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, got), key=order) == sorted(expect, key=order)
    assert scanned(df.limit(0), ["c"], ["pos"], range_cell(F.col("pos")), s=total(v)).count() == 0


def spans(rng, n, far=400, long=30):
    out = [(rng.choice("ab"), s, s + rng.randrange(0, long)) for s in (rng.randrange(far) for _ in range(n))]
    return out + out[:5]


def test_islands_over_borders(spark):
    rng = random.Random(2)
    points = [(rng.choice("ab"), rng.randrange(600)) for _ in range(160)]
    rows = I.islands(spark.createDataFrame(points, "chrom string, pos long"), 4, width=9).collect()
    expect = []
    for c in "ab":
        k, before = 0, None
        for p in sorted(p for x, p in points if x == c):
            k += before is not None and p - before > 4
            expect.append((c, p, k))
            before = p
    assert sorted(map(tuple, rows)) == sorted(expect)
    at = I.ranked(spark.createDataFrame(points, "chrom string, pos long"), width=9).collect()
    assert sorted(map(tuple, at)) == sorted((c, p, k + 1) for c in "ab" for k, p in enumerate(sorted({p for x, p in points if x == c})))


@pytest.mark.parametrize("touching", [False, True])
def test_merging_over_borders(spark, touching):
    rows = spans(random.Random(3), 60)
    got = I.merge_overlaps(spark.createDataFrame(rows, "chrom string, start long, stop long"), touching, width=11).collect()
    expect = []
    for c in "ab":
        open_ = None
        for s, e in sorted((s, e) for x, s, e in rows if x == c):
            if open_ and (s <= open_[1] if touching else s < open_[1]):
                open_ = (open_[0], max(open_[1], e), open_[2] + 1)
            else:
                expect += [(c, *open_)] if open_ else []
                open_ = (s, e, 1)
        expect.append((c, *open_))
    assert sorted(map(tuple, got)) == sorted(expect)


def test_clusters_over_borders(spark):
    rng = random.Random(4)
    at, sites = 0, []
    for _ in range(150):
        at += rng.randrange(1, 60)
        size = rng.choice([1, 5, 100, 120])
        sites.append((at, at + size))
        at += size
    out, cluster = [], []
    for s, e in sites:
        if e - s > 80 and cluster:
            out.append(cluster)
            cluster = []
        elif cluster and s - cluster[-1][1] < 30:
            cluster.append((s, e))
        else:
            out += [cluster] if cluster else []
            cluster = [(s, e)]
    out += [cluster] if cluster else []
    expect = sorted(tuple(c[i : i + 3]) for c in out for i in range(0, len(c), 3))
    df = spark.createDataFrame([("c", *s, [1]) for s in sites], "chrom string, start long, stop long, more array<int>")
    rows = I.capped_clusters(df, 30, 3, width=70)
    assert rows.columns == ["chrom", "start", "stop", "more", "island", "part"]
    got = rows.groupBy("island", "part").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("c")).collect()
    assert sorted(tuple((x.start, x.stop) for x in r.c) for r in got) == expect


def test_lone_items_over_borders(spark):
    rows = spans(random.Random(5), 40, 900, 6)[:-5]
    got = I.lone(spark.createDataFrame(rows, "chrom string, start long, stop long"), width=13).collect()
    expect = []
    for c in "ab":
        own = sorted((s, e) for x, s, e in rows if x == c)
        for i, (s, e) in enumerate(own):
            if (i == 0 or s - own[i - 1][1] > 3) and (i + 1 == len(own) or own[i + 1][0] - e > 3):
                expect.append((c, s, e))
    assert sorted(map(tuple, got)) == sorted(expect)


def test_equal_items_are_not_lone(spark):
    """Far from all others, but two or three times the same: none of them is alone, in whatever order ties come."""
    rows = [("a", 100 * k, 100 * k + 5, f"{k}-{n}") for k in range(40) for n in range(1 + k % 3)]
    random.Random(4).shuffle(rows)
    got = I.lone(spark.createDataFrame(rows, "chrom string, start long, stop long, name string"), width=250)
    assert got.columns == ["chrom", "start", "stop", "name"]
    assert sorted(r.name for r in got.collect()) == sorted(f"{k}-0" for k in range(0, 40, 3))


@pytest.mark.parametrize("options", [{"max_shards": 7}, {"max_shards": 500}, {"least": 40}, {"least": 1}])
def test_greedy_shards(spark, options):
    rng = random.Random(6)
    rows = []
    for c in "ab":
        at = 0
        for _ in range(70):
            at += rng.choice([1, 10, 30, 80])
            n = rng.randrange(0, 12)
            rows.append((c, at, at + n + 1, n))
            at += n + 1
    rows.append(("z", 5, 6, 0))
    got = I.balanced_shards(spark.createDataFrame(rows, "chrom string, start long, stop long, n long"), min_gap=25, width=50, **options).collect()
    expect = []
    for c in "abz":
        own = [r for r in rows if r[0] == c]
        need = max(1, options.get("least") or -(-sum(r[3] for r in own) // options["max_shards"]))
        shards, have = [[]], 0
        for k, r in enumerate(own):
            if k and r[1] - own[k - 1][2] + 1 >= 25 and have >= need:
                shards.append([])
                have = 0
            shards[-1].append(r)
            have += r[3]
        expect += [(c, k, x[0][1], x[-1][2], sum(r[3] for r in x), len(x)) for k, x in enumerate(shards)]
    assert sorted((r.chrom, r.shard, r.start, r.stop, r.n, r.islands) for r in got) == sorted(expect)


def test_no_window_holds_a_chromosome(spark):
    """Windows run inside a cell, or over the cells of a chromosome; none over the rows of a chromosome."""
    points = spark.createDataFrame([("c", 1)], "chrom string, pos long")
    items = spark.createDataFrame([("c", 1, 2, 1)], "chrom string, start long, stop long, n long")
    for df in (I.islands(points, 1), I.consecutive_runs(points), I.gap_regions(points), I.merge_overlaps(items), I.capped_clusters(items), I.lone(items), I.ranked(points)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.split("\n") if "Window [" in line]
        assert windows and all("__scan_cell" in line.rsplit("[", 2)[1] or "__scan_cell" in line.rsplit("[", 1)[1] or "__scan_at" in line for line in windows), windows


# ---- spans over many chunks

def test_spans_over_many_chunks(spark):
    rng = random.Random(7)
    genome = "".join(rng.choice("ACGT") for _ in range(35_500))
    chunks = spark.createDataFrame([("c", k, k * V.CHUNK, genome[k * V.CHUNK : (k + 1) * V.CHUNK]) for k in range(4)], "chrom string, chunk_id long, chunk_start long, seq string")
    rows = [("c", 5, 9), ("c", 9_990, 10_020), ("c", 124, 33_000), ("c", 0, 35_500), ("c", 20_000, 40_000), ("c", 9_999, 30_001), ("c", -3, 12)]
    df = spark.createDataFrame(rows, "chrom string, start long, stop long")
    got = V.reference_slice(df, chunks, "start", "stop", any_length=True).collect()
    assert len(got) == len(rows) and all(r.slice == genome[max(r.start, 0) : r.stop] for r in got)
    read = [("c", "r", 100, 13_050, genome[100:125] + genome[13_025:13_050], [30] * 50, [(0, 25), (2, 12_900), (0, 25)], 60, False, 0, {}, "P", "s")]
    reads = spark.createDataFrame(read, "chrom string, read_name string, start long, end long, seq string, qual array<smallint>, cigar array<struct<op:int,len:int>>, mapq int, is_reverse boolean, flag int, tags map<string,int>, tech string, sample string")
    assert [r.ref for r in P.indels(reads, chunks).collect()] == [genome[124:13_025]]


# ---- labels

SITES = "region string, seg_start long, segment string, sites array<struct<pos:long,ref:string,alts:array<string>,gt:array<int>>>"


def text_of(region, choice):
    _, start, segment, sites = region
    at, out = start, ""
    for (p, ref, alts, _), c in zip(sites, choice, strict=True):
        out += segment[at - start : max(p - start, at - start)] + [ref, *alts][c]
        at = p + len(ref)
    return out + segment[at - start :]


def slow_labels(truth, candidate):
    """All pairs of truth haplotypes and all candidate haplotypes, listed."""
    known = {}
    for choice in itertools.product(*(range(1 + len(x[2])) for x in candidate[3])):
        known.setdefault(text_of(candidate, choice), choice)
    per = [list(dict.fromkeys([(0, 0), (g[0], 0), (0, g[0]), (g[1], 0), (0, g[1]), tuple(g)])) for *_, g in truth[3]]
    ways = {}
    for choice in itertools.product(*map(enumerate, per)):
        ordinal = missed = extra = 0
        for (o, g), (_, ref, alts, gt) in zip(choice, truth[3], strict=True):
            every, ordinal = [ref, *alts], ordinal * 6 + o
            true, picked = {every[k] for k in gt}, {every[k] for k in g}
            missed, extra = missed + len(true - picked), extra + len(picked - true)
        ways[tuple(g for _, g in choice)] = (missed, extra, -ordinal)
    best = None
    for gs, cost in ways.items():
        twin = tuple((v, u) for u, v in gs)
        h0, h1 = (text_of(truth, [g[side] for g in gs]) for side in (0, 1))
        if not (twin != gs and twin in ways and ways[twin][2] > cost[2]) and h0 in known and h1 in known and (best is None or cost < best[0]):
            best = (cost, known[h0], known[h1])
    if best is None or (len(candidate[3]) == 1 and best[0][0] + best[0][1]):
        return [(p, "MISSED", None, None) for p, *_ in candidate[3]]
    return [(p, "LABELLED", [ref, *alts][best[1][k]], [ref, *alts][best[2][k]]) for k, (p, ref, alts, _) in enumerate(candidate[3])]


def random_region(rng, name, n, segment):
    sites, at = [], 100 + rng.randrange(1, 4)
    for _ in range(n):
        size = rng.choice([1, 1, 1, 2, 3])
        if at + size >= 99 + len(segment):
            break
        ref = segment[at - 100 : at - 100 + size]
        alts = [a for a in dict.fromkeys(rng.choice([rng.choice("AC"), ref[:1], ref + rng.choice("AC"), ref[0] * 2, ref[::-1]]) for _ in range(rng.choice([1, 2]))) if a != ref] or ["G"]
        sites.append((at, ref, alts, [rng.randrange(len(alts) + 1) for _ in range(2)]))
        at += size + rng.choice([0, 1, 2, 5])
    return name, 100, segment, sites


def test_labels_against_a_list_of_all_haplotypes(spark):
    """Up to five sites a region, in repeats where the same text can be spelled in many ways."""
    rng = random.Random(7)
    truths, candidates = [], []
    for i in range(250):
        segment = "".join(rng.choice("AC" if i % 2 else "ACGT") for _ in range(rng.choice([12, 20, 30])))
        truth = random_region(rng, f"r{i}", rng.randrange(0, 6), segment)
        other = random_region(rng, f"r{i}", rng.randrange(0, 6), segment)
        if rng.random() < 0.7:
            sites = [(p, r, a[::-1] if rng.random() < 0.5 else a, g) for p, r, a, g in truth[3] if rng.random() < 0.9]
            other = (f"r{i}", 100, segment, sites)
        truths.append(truth)
        candidates.append(other)
    got = {}
    for r in H.label_sites(spark.createDataFrame(truths, SITES), spark.createDataFrame(candidates, SITES)).collect():
        got.setdefault(r.region, []).append((r.pos, r.status, r.picks0_allele, r.picks1_allele))
    labelled = 0
    for truth, candidate in zip(truths, candidates, strict=True):
        expect = slow_labels(truth, candidate)
        assert sorted(got.get(truth[0], [])) == sorted(expect), (truth, candidate)
        labelled += bool(expect) and expect[0][1] == "LABELLED"
    assert labelled > 100


def test_many_sites_with_two_alternatives(spark):
    """Ten sites of two alternatives each: 60 million pairs if they were listed."""
    segment = "ACGTTGCA" * 30
    sites = [(103 + 20 * k, segment[3 + 20 * k], ["GG", "TTT"], [1, 2]) for k in range(10)]
    rows = H.label_sites(*[spark.createDataFrame([("big", 100, segment, sites)], SITES)] * 2).collect()
    assert len(rows) == 10 and {(r.status, r.picks0_allele, r.picks1_allele) for r in rows} == {("LABELLED", "GG", "TTT")}


# ---- long reads

def test_long_reads_are_moved_once(spark):
    """What goes through the join by bins holds keys only, and a read of 15,000 bases gives the slices that a loop gives."""
    from strandlake.operators import sites as T

    rng = random.Random(8)
    genome = "".join(rng.choice("ACGT") for _ in range(16_000))
    schema = "chrom string, read_name string, start long, end long, seq string, qual array<smallint>, cigar array<struct<op:int,len:int>>, mapq int, is_reverse boolean, flag int, tags map<string,int>, tech string, sample string"
    reads = spark.createDataFrame([("c", f"r{k}", 10 * k, 10 * k + 15_000, genome[10 * k : 10 * k + 15_000], [30] * 15_000, [(0, 15_000)], 60, False, 0, {}, "P", "s") for k in range(4)], schema)
    spots = [(p, p + rng.randrange(1, 4)) for p in range(5, 15_900, 60)]
    slices = T.site_slices(reads, spark.createDataFrame([("c", *s) for s in spots], "chrom string, start long, stop long"))
    got = {(r.read_name, r.site_start): r.allele for r in slices.where("status = 'Success'").collect()}
    expect = {(f"r{k}", a): genome[a:b] for k in range(4) for a, b in spots if a >= 10 * k and b <= 10 * k + 15_000}
    assert got.items() >= {k: v for k, v in expect.items() if 10 * int(k[0][1:]) < k[1] < 10 * int(k[0][1:]) + 14_990}.items() and set(got) <= set(expect)
    plan = slices._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "Join" in line and "__bin" in line)
    below = "\n".join(plan[at : at + 4])
    assert "seq#" not in below and "qual#" not in below


# ---- left alignment

def one_by_one(seq, start, cigar, genome):
    """Indels moved base by base while the base before them matches and the mismatches stay the same."""
    def mismatches(ops):
        r, q, n = start, 0, 0
        for op, k in ops:
            if op in (0, 7, 8):
                n += sum(seq[q + i] != genome[r + i] for i in range(k))
            r, q = r + (k if op in (0, 2, 3, 7, 8) else 0), q + (k if op in (0, 1, 4, 7, 8) else 0)
        return n, q

    def put(ops, op, k):
        if k and ops and ops[-1][0] == op:
            ops[-1] = (op, ops[-1][1] + k)
        elif k:
            ops.append((op, k))

    done, rest = [], list(cigar)
    while rest:
        op, k = rest.pop(0)
        moved = 0
        while op in (1, 2) and done and done[-1][0] in (0, 7):
            r = start + sum(n for o, n in done if o in (0, 2, 3, 7, 8))
            q = sum(n for o, n in done if o in (0, 1, 4, 7, 8))
            kind, n = done[-1]
            if kind == 0 and seq[q - 1] != genome[r - 1]:
                break
            tail = [(kind, moved + 1)] + rest
            new = done[:-1] + ([(kind, n - 1)] if n > 1 else []) + [(op, k)] + tail
            if mismatches(new) != mismatches(done + [(op, k)] + ([(kind, moved)] if moved else []) + rest):
                break
            done, moved = done[:-1] + ([(kind, n - 1)] if n > 1 else []), moved + 1
            left = kind
            if n == 1:
                break
        if moved:
            done.append((op, k))
            done.append((left, moved))
        else:
            put(done, op, k)
        if rest and done and rest[0][0] == done[-1][0]:
            rest[0] = (rest[0][0], rest[0][1] + done.pop()[1])
    out, r, q = [], start, 0
    for op, k in done:
        n = out[-1][1] if out else 0
        if out and op in (1, 2) and out[-1][0] == 3 - op and n == k and (seq[q - k : q] == genome[r : r + k] if op == 2 else seq[q : q + k] == genome[r - k : r]):
            out.pop()
            put(out, 0, k)
        else:
            put(out, op, k)
        r, q = r + (k if op in (0, 2, 3, 7, 8) else 0), q + (k if op in (0, 1, 4, 7, 8) else 0)
    while out and out[0][0] == 2:
        start += out.pop(0)[1]
    if out and out[0][0] == 1:
        out[0] = (4, out[0][1])
    return start, out


def test_left_alignment(spark):
    from strandlake.operators.left_align import left_align

    told = "ACGATATATACCAGTATATATATATACATATATATATATAGGATACGATA"
    cases = [(told, "CAGTATATATATATATATATATATATAGG", 11, [(0, 22), (2, 2), (0, 7)])]
    rng = random.Random(9)
    for k in range(220):
        genome = "".join(rng.choice(["AT", "A", "CAC", "G", "TTT"]) for _ in range(90))
        start, seq, cigar = rng.randrange(0, 5), "", []
        at = start
        if k % 5 == 0:
            cigar.append((4, 3))
            seq += "GGG"
        for j in range(rng.randrange(1, 6)):
            n = rng.choice([1, 2, 5, 12, 75 if k % 9 == 0 and j == 0 else 3])
            if at + n + 8 > len(genome):
                break
            cigar.append((7 if k % 7 == 0 else 0, n))
            seq += "".join(g if k % 7 == 0 or rng.random() > 0.05 else rng.choice("ACGT") for g in genome[at : at + n])
            at += n
            size = rng.choice([1, 2, 2, 3])
            if rng.random() < 0.5:
                cigar.append((2, size))
                at += size
            else:
                cigar.append((1, size))
                seq += rng.choice([genome[at : at + size], seq[-size:], "AT"[:size]]).ljust(size, "A")[:size]
        if k % 3:
            cigar.append((0, 4))
            seq += genome[at : at + 4]
        cases.append((genome, seq, start, cigar))
    schema = "chrom string, read_name string, start long, end long, seq string, cigar array<struct<op:int,len:int>>, other string"
    span = lambda cigar: sum(n for o, n in cigar if o in (0, 2, 3, 7, 8))
    reads = spark.createDataFrame([(f"c{k}", f"r{k}", s, s + span(c), q, c, "x") for k, (_, q, s, c) in enumerate(cases)], schema)
    chunks = spark.createDataFrame([(f"c{k}", 0, 0, g) for k, (g, *_) in enumerate(cases)], "chrom string, chunk_id long, chunk_start long, seq string")
    found = {r.read_name: (r.start, [tuple(x) for x in r.cigar]) for r in left_align(reads, chunks).collect()}
    assert found["r0"] == (11, [(0, 16), (2, 2), (0, 13)])
    for k, (genome, seq, start, cigar) in enumerate(cases):
        assert found[f"r{k}"] == one_by_one(seq, start, cigar, genome), cases[k]
        assert sum(n for o, n in found[f"r{k}"][1] if o in (0, 1, 4, 7, 8)) == len(seq)
    assert sum(found[f"r{k}"][1] != c for k, (*_, c) in enumerate(cases)) > 80


# ---- files and stores

def test_fasta_of_many_contigs(spark, tmp_path):
    """Thousands of contigs of uneven lines, over several files."""
    from strandlake.sources import text

    rng = random.Random(10)
    expect = {}
    for f in range(3):
        lines = []
        for k in range(1200):
            seq = "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 3, 50, 130])))
            expect[f"s{f}_{k}"] = seq
            lines.append(f">s{f}_{k} more")
            lines += [seq[i : i + 40] for i in range(0, len(seq), 40)]
        (tmp_path / f"{f}.fa").write_text("\n".join(lines) + "\n")
    got = {}
    for r in text.read_fasta(spark, *(f"{tmp_path}/{f}.fa" for f in range(3))).orderBy("chrom", "chunk_id").collect():
        got[r.chrom] = got.get(r.chrom, "") + r.seq
    assert got == {c: s for c, s in expect.items() if s}


def test_examples_by_key_and_number(spark, tmp_path):
    from strandlake.sources import sinks, text

    rng = random.Random(11)
    rows = [(f"k{i:03d}", rng.choice("ACGT"), f"c{i % 3}", [i, i + 1], "ACGT", i % 2) for i in range(120)]
    rows += rows[:30] + rows[:10] + [("k005", rows[5][1], "c2", [99], "T", 0)]
    df = spark.createDataFrame(rows, "site_key string, allele string, chrom string, feature array<int>, segment string, site_label int").repartition(5)
    sinks.write_examples(df, f"{tmp_path}/a")
    counts = {}
    for r in rows:
        counts.setdefault(r[:2], []).append(r)
    kept = sorted((min(v, key=lambda r: (r[2:],)) for v in counts.values() if len(v) % 2), key=lambda r: (r[2], r[0], r[1]))
    got = text.read_by_number(spark, f"{tmp_path}/a", 0, 10**6).collect()
    assert [(r.ordinal, r.site_key, r.allele, r.chrom, r.feature, r.segment, r.site_label) for r in got] == [(k, *r) for k, r in enumerate(kept)]
    assert [r.ordinal for r in text.read_by_number(spark, f"{tmp_path}/a", 40, 49).collect()] == list(range(40, 50))
    keys = spark.createDataFrame([("k050",), ("k000",)], "site_key string")
    assert {r.site_key for r in text.read_examples(spark, f"{tmp_path}/a", keys=keys).collect()} <= {"k050", "k000"}
    sinks.write_examples(df, f"{tmp_path}/b", repeats="first")
    assert spark.read.parquet(f"{tmp_path}/b").count() == len(counts)
