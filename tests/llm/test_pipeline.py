"""The pipeline's stages one after another."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm import shingle_sets
from strandlake.llm.common import table, written


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
        assert docs.count() <= before
        before = docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert "batch_id" in docs.columns and before > 0


def test_similar_documents_go(spark, sf):
    """Later copies with a five-word similarity of 0.8 or a little more go; 0.75 and less stays."""
    rng = random.Random(6)
    rows, similar = [], set()
    for k in range(120):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 150, 400]))]
        edits = list(base)
        target = rng.choice([0.6, 0.7, 0.82, 0.9])
        own = {tuple(base[i : i + 5]) for i in range(len(base) - 4)}
        for at in rng.sample(range(len(base)), len(base)):
            other = {tuple(edits[i : i + 5]) for i in range(len(edits) - 4)}
            if len(own & other) / len(own | other) <= target:
                break
            edits[at] = f"x{rng.randrange(10**9)}"
        other = {tuple(edits[i : i + 5]) for i in range(len(edits) - 4)}
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(edits))]
        if len(own & other) >= 0.8 * len(own | other):
            similar.add(2 * k + 1)
    docs = spark.createDataFrame([*rows, (500, None), (501, ""), (501, ""), (None, "a b")], "doc_id long, text string")
    kept = [r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, sf).collect()]
    gone = {i for i, _ in rows} - set(kept)
    assert gone <= similar and len(gone) >= 0.95 * len(similar) > 20
    assert kept.count(500) == 1 and kept.count(501) == 0 and kept.count(None) == 1


def test_short_similar_documents_go(spark, sf):
    """Of texts of one to eight shingles every copy at 0.8 or more goes (one or two words appended or put in front), and no other."""
    rng = random.Random(8)
    rows, similar = [], set()
    for k in range(400):
        n = rng.randint(1, 8)
        base = [f"w{rng.randrange(10**6)}" for _ in range(n + 4)]
        more = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([1, 1, 2]))]
        other = base + more if k % 2 else more + base
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other).upper())]
        if n >= 0.8 * (n + len(more)):
            similar.add(2 * k + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"__kept": F.lit(1), "id": F.lit("x"), "node": F.lit(2), "row": F.lit(3)})
    kept = corpus_pipeline.simhash_dedup(spark, docs, sf)
    assert kept.columns == docs.columns
    assert {i for i, _ in rows} - {r.doc_id for r in kept.collect()} == similar and len(similar) > 100


@pytest.mark.parametrize("small", [256, 2])
def test_near_pieces_meet(spark, monkeypatch, small):
    """Sketches that differ in a bit of every sixteen, or in more, meet just as all pairs say; in small and large groups."""
    monkeypatch.setattr(shingle_sets, "SMALL", small)
    rng = np.random.default_rng(9)
    words = rng.integers(0, 1 << 64, (20, shingle_sets.WORDS), np.uint64)
    bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
    rows = [*bits]
    for k in range(20):
        for share in (0, 0.05, 0.15, 0.2):
            one = bits[k].copy()
            if share:
                one ^= rng.random(len(one)) < share
            else:
                one[np.arange(0, len(one), 16) + rng.integers(0, 16, len(one) // 16)] ^= 1
            rows.append(one)
    sketches = np.packbits(np.array(rows), axis=1, bitorder="little").view("<u8")
    nodes = [(k, k // 2 if k < 20 else k, s.tobytes()) for k, s in enumerate(sketches)]
    df = spark.createDataFrame(nodes, "node long, root long, sketch binary")
    pieces = np.packbits(np.array(rows)[:, shingle_sets.NEAR * 64 :][:, :384].reshape(len(rows), -1, 24), axis=2, bitorder="little")
    expect, linked = set(), set()
    for a in range(len(rows)):
        for b in range(a):
            near = np.bitwise_count(sketches[a, : shingle_sets.NEAR] ^ sketches[b, : shingle_sets.NEAR]).sum() <= shingle_sets.NEAR_BITS
            if near and (np.bitwise_count(pieces[a] ^ pieces[b]).sum(axis=1) <= 2).any():
                linked |= {a, b}
                if nodes[a][1] != nodes[b][1] and np.bitwise_count(sketches[a] ^ sketches[b]).sum() <= shingle_sets.ALL_BITS:
                    expect.add((b, a))
    assert {(k, k + 20 + 3 * k) for k in range(20)} <= expect  # the first copy of each: one bit of every sixteen
    dealt = shingle_sets._dealt(df, True)
    assert {tuple(r) for r in shingle_sets._met(dealt, shingle_sets.apart, "a long, b long").collect()} == expect
    assert {x for r in shingle_sets.nearest_pairs(df).collect() for x in r} == linked
    # Here, with the bound on small groups.
    assert set(shingle_sets.apart(dealt.toPandas()).itertuples(index=False, name=None)) == expect
    found = shingle_sets.nearest(shingle_sets._dealt(df, False).toPandas())
    assert {*found["node"], *found["other"]} == linked
