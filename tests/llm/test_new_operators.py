"""License scans, conversation tries and whitening against brute force, and odd tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import license_index, prefix_trie, whitening

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


# ---- license scans

def base_scan(text):
    words = WORDS.findall((text or "").translate(UPPER))
    at, labels = [], set()
    for phrase, label in {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def scanned(df, **options):
    return [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, set(filter(None, r.labels.split(","))), r.score) for r in license_index.scan(df, **options).collect()]


def test_license_base_of_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = scanned(docs)
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert len(found) == len(rows)
    for i, *base, labels, score in found:
        assert tuple(base) == base_scan(rows[i])
        assert set(filter(None, base[-1].split(","))) <= labels and 0 <= score <= 1
    notice = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "licensed under the GNU General Public License, version 3.": "gpl-3.0"}
    for i, *_, labels, _ in found:
        assert {label for text, label in notice.items() if text in (rows[i] or "")} == labels - {"cc-by", "gpl", "reserved"}


def test_license_odd_rows(spark):
    texts = [
        None, "", "CC-BY", "cc\x00BY cc by", "CC BY", "KCC BY İ", "ACC BY", "All rights reserved. all\nRIGHTS-reserved all rights", "GNU General Public License " * 3, "É CC by É", "x " * 50_000 + "CC BY",
        "general public K license", "the mit \U0001F600 license", "cc cc by by",
    ]
    df = spark.createDataFrame([(k // 2 if k else None, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, row int").withColumn("f", F.lit(1)).withColumn("id", F.lit(2)).withColumn("label", F.lit("x"))
    found = sorted(((r[0] is not None, r[0] or 0), r[1:6]) for r in scanned(df))
    assert [x[1] for x in found] and sorted(map(repr, (x[1] for x in found))) == sorted(map(repr, map(base_scan, texts)))
    assert scanned(df.limit(0)) == []
    assert license_index.scan(df).columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def slow_scan(texts, templates, rare, per_file, least, slack):
    """Votes counted document by document."""
    import math

    words = [WORDS.findall((t or "").translate(UPPER)) for t in texts]
    idf = lambda w: math.log((len(texts) + 1) / (sum(w in set(x) for x in words) + 1)) + 1
    kept = [sorted(set(license_index.plain_words(t.text)), key=lambda w: (-idf(w), w))[:rare] for t in templates]
    every = sorted({w for k in kept for w in k}, key=lambda w: (-idf(w), w))
    out = []
    for doc in words:
        own = [w for w in every if w in doc][:per_file]
        got, best = set(), 0.0
        for t, index in zip(templates, kept, strict=True):
            text = license_index.plain_words(t.text)
            starts = lambda p: {i - j for i in range(len(doc)) for j in range(len(text)) if doc[i : i + len(p)] == p == text[j : j + len(p)]}  # noqa: B023, E731
            votes = {w: starts([w]) for w in index if w in own}
            phrases = [starts(p.split()) for p in t.phrases]
            for cell in {s // slack + d for v in votes.values() for s in v for d in (-1, 0)}:
                inside = lambda v: any(s // slack in (cell, cell + 1) for s in v)  # noqa: B023, E731
                share = sum(idf(w) for w, v in votes.items() if inside(v)) / sum(map(idf, index))
                if share >= least and all(map(inside, phrases)):
                    got.add(t.label)
                    best = max(best, share)
        out.append((got, best))
    return out


def test_license_templates_against_a_loop(spark):
    rng = np.random.default_rng(5)
    templates, texts = license_index.TEMPLATES, []
    for k in range(60):
        words = " ".join(rng.choice(["la", "der", "the", "of", "copy", "software", "license"], rng.integers(0, 30)))
        body = license_index.plain_words(templates[k % len(templates)].text)
        body = [w for w in body if rng.random() > 0.02 * (k % 5)]
        for _ in range(k % 4):
            body.insert(int(rng.integers(0, len(body) + 1)), "inserted")
        texts.append(f"{words}\n{' '.join(body).upper()}\n{words}" if k % 6 else words)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for options in ({"rare": 12, "per_file": 48, "least": 0.7, "slack": 8}, {"rare": 5, "per_file": 4, "least": 0.5, "slack": 2}):
        expect = slow_scan(texts, templates, **options)
        found = {r[0]: r for r in scanned(df, **options)}
        for k, (labels, score) in enumerate(expect):
            assert found[k][6] == labels | set(filter(None, base_scan(texts[k])[-1].split(","))) and abs(found[k][7] - min(score, 1)) < 1e-9
    assert sum(bool(x[0]) for x in expect) > 20


# ---- whitening

def check_whitening(rows, vectors, components=16):
    """rows of the operator against integers and numpy; vectors: (id, list of finite floats) that take part."""
    groups = {}
    for i, v in vectors:
        groups.setdefault(len(v), []).append((i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]))
    expect_rows = 0
    for d, own in groups.items():
        fit = sorted({tuple(x) for _, x in own})
        n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        y = np.array([[n * a - s for a, s in zip(x, total, strict=True)] for x in fit], dtype=float) / n
        cov = y.T @ y / n
        values, axes = np.linalg.eigh(cov)
        values, axes = values[::-1], axes[:, ::-1]
        k = int((values[:components] > 1e-9 * max(cov.trace(), 1e-300)).sum())
        expect_rows += len(own) * k
        if not k:
            continue
        mine = [r for r in rows if r.vec_id in {i for i, _ in own}]
        found = {}
        for r in mine:
            found.setdefault((r.vec_id, r.deviation), {})[r.component] = r
        got = {}
        for i, x in own:
            dev = sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True))
            per = found[i, dev]
            assert sorted(per) == list(range(1, k + 1)) and {r.n for r in per.values()} == {n}
            for c in range(k):
                assert abs(per[c + 1].explained / (values[c] / cov.trace()) - 1) < 1e-6 and per[c + 1].identity_error <= 1e-4
            got[tuple(x)] = [per[c + 1].whitened for c in range(k)]
        w = np.array([got[x] for x in fit])
        assert np.abs(np.cov(w.T, bias=True).reshape(k, k) - np.eye(k)).max() < 1e-8
        # The axes follow from the rows: y is projected on them; they satisfy cov @ axis = value * axis.
        axis = np.linalg.lstsq(y, w * np.sqrt(values[:k]), rcond=None)[0]
        assert np.abs(cov @ axis - axis * values[:k]).max() < 1e-7 * values[0]
    assert len(rows) == expect_rows


def test_whitening_of_all_vectors(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    check_whitening(whitening.whiten(table).collect(), [(r.vec_id, r.embedding) for r in table.collect()])


def test_whitening_odd_vectors(spark):
    rng = np.random.default_rng(2)
    nan, inf = float("nan"), float("inf")
    good = [(i, list(map(float, rng.normal(size=3)))) for i in range(40)] + [(i, list(map(float, rng.normal(size=20)))) for i in range(40, 90)]
    good += [(100, good[0][1]), (100, good[1][1]), (101, [5.0]), (102, [5.0]), (103, [1.0, 2.0]), (104, [2.0, 4.0]), (105, [4.0, 8.0])]
    bad = [(1, None), (2, [nan, 1.0, 1.0]), (3, [inf, 0.0, 0.0]), (4, [None, 0.0, 0.0]), (5, [])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumn("component", F.lit(1)).withColumn("d", F.lit("x")).withColumn("i", F.lit(3)).repartition(5)
    check_whitening(whitening.whiten(df).collect(), good)
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.where("embedding IS NULL")).collect() == []
    no_id = whitening.whiten(df.withColumn("vec_id", F.lit(None).cast("long")))
    assert no_id.where("vec_id IS NULL").count() == 40 * 3 + 50 * 16 + 2 * 3 + 3
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, -1e300]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert len(huge) == 6 and all(np.isfinite(r.whitened) and r.deviation is None for r in huge)


@pytest.mark.parametrize("values", [list(range(1, 41)), [1.0] * 10 + [2.0] * 5 + [3 + 1e-9 * i for i in range(9)], [1 + 1e-12 * i for i in range(30)], [1.0] * 20, [0.0] * 5 + [1e-9, 1e-5, 1, 1e6], [1, 1 + 1e-15, 5, 5 + 1e-7, 5 + 2e-7, 9, 9 + 1e-4], [3.0]])
def test_eigenpairs_of_clustered_values(values):
    rng = np.random.default_rng(1)
    n = len(values)
    q = np.linalg.qr(rng.normal(size=(n, n)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (3 * np.eye(n) - q.T @ q) / 2
    a = (q * np.array(values, np.longdouble)) @ q.T
    a = (a + a.T) / 2
    w, x = whitening.eigenpairs(a)
    size = float(np.abs(a).max())
    assert np.abs(a @ x - x * w).max() <= 1e-17 * size and np.abs(x.T @ x - np.eye(n)).max() <= 1e-17 and (np.diff(w) <= 0).all()
    assert np.abs(w - np.sort(np.array(values))[::-1]).max() <= 1e-16 * size


# ---- conversation tries

def slow_trie(rows):
    """rows: (conv_id, turn, role, text); whole rebuilt conversations in memory."""
    stored = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        stored.setdefault(c, []).append((role or "", text or ""))
    members = {}
    for c, own in stored.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(stored.get(c - int(np.fmod(c, 100)), [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append((c, len(whole)))
    out = {}
    for node, own in members.items():
        below = [x for x in members if x[: len(node)] == node]
        inner = {x[:-1] for x in members if x}
        ends = ",".join(str(c) for c, n in sorted(own) if n == len(node))
        out[min(own)[0], len(node)] = (
            min(members[node[:-1]])[0] if node else None, len(own), sum(x[:-1] == node for x in members if x), sum(x not in inner for x in below),
            sum((len(members[x]) - 1) * (len(x[-1][1]) if x else 0) for x in below), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def check_trie(df, rows, **options):
    found = prefix_trie.prefix_trie(df, **options).collect()
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found}
    assert len(got) == len(found) and got == slow_trie(rows)
    return found


def test_trie_of_given_conversations(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    found = check_trie(table, rows)
    texts = {}
    for c, _, role, text in sorted(rows, key=lambda r: r[:2]):
        texts.setdefault(c, []).append((role, text))
    assert all(r.ref_place <= len(texts[r.ref_conv_id]) for r in found if r.depth)


def test_trie_of_odd_conversations(spark):
    rng = np.random.default_rng(3)
    rows = [(None, 1, "a", "b"), (7, None, None, None), (7, 0, "", ""), (-150, 1, "u", "x"), (-100, 1, "u", "x"), (5_000_000_000, 2, "u", "é😀")]
    for c in [*range(0, 40), *range(100, 130), *range(250, 260)]:
        rows += [(c, t, "u", rng.choice(["a", "b", "", "same words"])) for t in range(int(rng.integers(0, 9)))]
    rows += [(c, 3, "u", "same") for c in (300, 301) for _ in range(3)]
    rows += [(400, t, "u", str(t % 3)) for t in range(60)]
    rows = [(None if c is None else int(c), None if t is None else int(t), r, None if x is None else str(x)) for c, t, r, x in rows]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"place": F.lit(1), "part": F.lit("x"), "depth": F.lit(2), "f": F.lit(0), "n": F.lit(1)}).repartition(5)
    check_trie(df, rows)
    check_trie(df, rows, attempts=(((3, 3, 3, 3), 1), prefix_trie.ATTEMPTS[1]))  # collisions are found, and all is done again
    with pytest.raises(RuntimeError):
        prefix_trie.prefix_trie(df, attempts=(((3, 3, 3, 3), 1),))
    assert prefix_trie.prefix_trie(df.limit(0)).collect() == []


def test_trie_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CELL", 7)
    monkeypatch.setattr(prefix_trie, "PIECE", 2)
    rows = [(c, t, "u", f"{t * (c % 3 == 0)}") for c in range(30) for t in range(30 + c)] + [(c, 0, "u", "one") for c in range(200, 300)]
    check_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), rows)


def test_fingerprints_compose():
    """The product of a head and a moved part is the fingerprint of the whole sequence."""
    import random

    rng = random.Random(4)
    m = prefix_trie.Monoid(*prefix_trie.ATTEMPTS[0])
    for p, base in zip(m.primes, m.bases, strict=True):
        mul = lambda x, y: (x[0] + y[0], (x[1] + pow(base, x[0], p) * y[1]) % p)  # noqa: B023, E731
        turns = [(1, rng.randrange(p) * base % p) for _ in range(9)]
        for a in range(10):
            whole = (0, 0)
            for t in turns:
                whole = mul(whole, t)
            left = right = (0, 0)
            for t in turns[:a]:
                left = mul(left, t)
            for t in turns[a:]:
                right = mul(right, t)
            assert mul(left, right) == whole
