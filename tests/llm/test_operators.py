"""The other training-data operators against brute force, and odd tables."""

import base64
import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import decision_rules, importance, line_dedup, link_trust, packing, rabitq, simhash, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD_DOCS = [(1, None, 1), (None, "a b c d e", 2), (2, "", 3), (3, "a b c\n\na b c", 4), (3, "a b c\n\na b c", 4), (4, "x " * 30_000, 5), (5, "\t \n", 6)]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD_DOCS, "doc_id long, text string, n_words long").withColumn("component_id", F.lit(0)).withColumn("id", F.lit(0)).withColumn("length", F.lit(0))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


def test_bucket_ends_are_optimal():
    rng = random.Random(0)
    for _ in range(60):
        m = rng.randint(1, 8)
        lengths, counts, k = sorted(rng.sample(range(1, 40), m)), [rng.randint(1, 9) for _ in range(m)], rng.randint(1, 4)
        cost = lambda ends: sum(c * min(e for e in ends if e >= n) for n, c in zip(lengths, counts, strict=True))  # noqa: E731, B023
        best = min(cost([*e, lengths[-1]]) for q in range(k) for e in itertools.combinations(lengths[:-1], min(q, m - 1)))
        assert cost(packing.optimal_ends(lengths, counts, k)) == best


def test_bucket_ends_of_many_lengths():
    """Lengths over 511 count exactly: against the plain programme in the square of the lengths."""
    rng = random.Random(8)
    lengths = sorted(rng.sample(range(1, 60_000), 300))
    counts = [rng.randint(1, 50) for _ in lengths]
    upto = np.concatenate([[0], np.cumsum(counts)])
    for k in (1, 2, 5, 16):
        cost = np.array(lengths) * upto[1:]
        for _ in range(1, k):
            cost = np.array([min([cost[j], *(cost[i] + lengths[j] * (upto[j + 1] - upto[i + 1]) for i in range(j))]) for j in range(len(lengths))])
        ends = packing.optimal_ends(lengths, counts, k)
        assert len(ends) <= k and sum(c * min(e for e in ends if e >= n) for n, c in zip(lengths, counts, strict=True)) == cost[-1]


def test_rows_without_ids_are_dealt_out(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b").alias("text"))
    rows = packing.pack(df, packing.word_length(F.col("text")), buckets=2, budget=30, rows_a_part=100).toPandas()
    assert len(rows) == 3000 and not rows.duplicated(["batch_id", "slot"]).any() and rows.batch_id.nunique() == 300


def test_batches(docs, odd):
    rows = packing.pack(docs, packing.word_length(F.col("text")), buckets=6, budget=4096).toPandas()
    assert len(rows) == docs.count() and (rows.length <= rows.padded_length).all() and not rows.duplicated(["batch_id", "slot"]).any()
    sizes = rows.groupby("batch_id").agg(n=("length", "size"), p=("padded_length", "max"), bucket=("bucket", "max"))
    assert ((sizes.n * sizes.p <= 4096) | (sizes.n == 1)).all()
    full = np.maximum(4096 // sizes.p, 1)
    assert (sizes.n < full).groupby(sizes.bucket).sum().max() <= 1  # only the last of a bucket has room
    assert packing.pack(odd, packing.word_length(F.col("text"))).count() == len(ODD_DOCS)
    assert packing.pack(odd.limit(0), F.lit(None).cast("int")).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a", None), (2, None, ""), (3, "u\nv", "é"), (5, "x", "é"), (5, "x", "é"), (None, "q", "é"), (None, None, None), (9, "big", "x" * 3_000_000), (4, "http://b/ü", "é")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1)).withColumn("bundle", F.lit("z"))
    last = {}
    for p, _, h in rows:
        if p is not None:
            last[h or ""] = max(last.get(h or "", -1), p)
    expect = []
    for p, _, h in rows:
        data, first = (h or "").encode(), p is None or last[h or ""] == p
        expect.append((p or 0, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", 0 if first else last[h or ""]))
    found = warc.round_trip(df).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in found) == sorted(expect)
    assert {r.payload.decode() for r in found if r.page_id == 9} == {"x" * 3_000_000}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_random_access(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    index = warc.write_archive(pages, str(tmp_path))
    got = warc.fetch(spark, index, str(tmp_path), [3, 17]).collect()
    assert {warc.parse(r.record)[0]["WARC-Record-ID"] for r in got} == {"<urn:page:3>", "<urn:page:17>"}


def nearest(ids, vectors, k=20):
    out = []
    for i in range(len(ids)):
        if ids[i] % 20 == 0:
            scores = (vectors * vectors[i]).sum(axis=1)
            best = [j for j in np.lexsort((ids, -scores)) if j != i][:k]
            out += [(int(ids[i]), n + 1, int(ids[j]), float(scores[j])) for n, j in enumerate(best)]
    return sorted(out)


def test_neighbours(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = table.toPandas()
    expect = nearest(rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float))
    found = sorted(map(tuple, rabitq.nearest(table).collect()))
    assert len({x[:3] for x in found} & {x[:3] for x in expect}) >= 0.9 * len(expect)


def test_neighbours_of_odd_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(90)]
    rows += [(100, None), (120, [0.0, 0.0, 0.0]), (140, [1.0, None, 2.0]), (160, [float("nan"), 1.0, 1.0]), (180, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (20, [1.0, 1.0, 1.0]), (40, [3.0, 4.0]), (41, [-1.0, 2.0]), (41, [-1.0, 2.0]), (60, [7.0])]
    rows += [(i % 30 * 2, [rng.choice([-1.0, 0.0, 2.0]) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vid", F.lit(1)).withColumn("ids", F.lit(2))
    fine = [(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and x == x for x in v) and any(v)]
    expect = []
    for n in {len(v) for _, v in fine}:  # a query meets vectors of its own length
        expect += nearest(np.array([i for i, v in fine if len(v) == n]), np.array([v for _, v in fine if len(v) == n]))
    assert sorted(map(tuple, rabitq.nearest(df).collect())) == sorted(expect)
    assert rabitq.nearest(df.limit(0)).count() == 0


def test_many_blocks_give_the_rows_of_one(spark, monkeypatch):
    assert rabitq.blocks(1_000_000, 50_000, 64) == (62, 1) and rabitq.blocks(1_000_000, 50_000, 16_384) == (977, 196)
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 12)))], "vec_id long, embedding array<double>")
    ask = lambda: sorted(map(tuple, rabitq.nearest(df, every=5).collect()))
    one = ask()
    monkeypatch.setattr(rabitq, "ROW_BYTES", 150 * 8 * 12)
    monkeypatch.setattr(rabitq, "QUERY_BYTES", 30 * 8 * 12)
    assert rabitq.blocks(400, 80, 12) == (3, 3)
    many = ask()
    assert [r[:3] for r in many] == [r[:3] for r in one] and len(one) == 80 * 20
    assert np.allclose([r[3] for r in many], [r[3] for r in one], rtol=1e-12)


def test_resampling(docs, labels, odd):
    rows = importance.resample(docs, labels).join(labels, "doc_id").toPandas()
    good, bad = rows[(rows.quality == 1) & (rows.toxic == 0)], rows[rows.quality == 0]
    assert good.kept.mean() > 0.95 and bad.kept.mean() < good.kept.mean()
    assert importance.resample(odd, labels).count() == len(ODD_DOCS)
    assert importance.resample(odd.limit(0), labels.limit(0)).count() == 0
    assert importance.keep_sampled(odd, labels.limit(0)).columns == odd.columns


def test_resampling_against_a_loop(docs, labels):
    """Weights and kept rows by plain dictionaries; the held-back third and the draw are told by the same hashes."""
    good = importance.labelled(docs, labels, 20_000).withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(1))).select("doc_id", (F.pmod(F.xxhash64(F.lit(31), "doc_id"), F.lit(3)) == 0).alias("held"))
    known = {r.doc_id: r.held for r in good.collect()}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    raw, target = collections.Counter(), collections.Counter()
    for i, text in rows:
        grams = importance.ngrams(text).tolist() if text else []
        raw.update(grams)
        if known.get(i) is False:
            target.update(grams)
    size = 1 << importance.BITS
    ratio = lambda g: np.log((target[g] + 1) / (sum(target.values()) + size)) - np.log((raw[g] + 1) / (sum(raw.values()) + size))
    ratios = {g: ratio(g) for g in raw}
    weights = {i: sum(ratios[g] for g in importance.ngrams(text).tolist()) if text else 0.0 for i, text in rows}
    found = {r.doc_id: r for r in importance.resample(docs, labels).collect()}
    assert all(abs(found[i].log_weight - w) < 1e-6 * max(1, abs(w)) for i, w in weights.items())
    held = sorted(weights[i] for i, h in known.items() if h and i in weights)
    k = sum(w >= held[max(int(np.ceil(0.002 * len(held))) - 1, 0)] - 1e-9 for w in weights.values())
    keys = sorted((r.gumbel_key for r in found.values()), reverse=True)
    assert {i for i, r in found.items() if r.kept} == {i for i, r in found.items() if r.gumbel_key >= keys[k - 1]}


def test_kth_largest(spark):
    table = spark.range(20_000).select((F.rand(3) * 100).alias("v")).persist()
    values = sorted((r.v for r in table.collect()), reverse=True)
    for k in (1, 7, 500, 19_999, 20_000):
        assert importance.kth_largest(table, "v", k) == values[k - 1]


def slow_fingerprint(text):
    import xxhash

    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hashes = [xxhash.xxh64(" ".join(words[k : k + 4]).encode(), seed=42).intdigest() for k in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, radius=4):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(values, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= radius and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_simhash(docs, odd):
    rows = docs.limit(150)
    found = {r.doc_id: r for r in simhash.near_duplicates(rows).collect()}
    prints = {r.doc_id: slow_fingerprint(r.text) for r in rows.collect()}
    assert {i: int(r.fingerprint, 16) for i, r in found.items()} == prints
    root = components(sorted(set(prints.values())))
    least = collections.defaultdict(lambda: 1 << 62)
    for i, v in prints.items():
        least[root[v]] = min(least[root[v]], i)
    assert {i: r.component_id for i, r in found.items()} == {i: least[root[v]] for i, v in prints.items()}
    assert simhash.near_duplicates(odd).count() == len(ODD_DOCS)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 3").count() == 1 and kept.where("doc_id IS NULL").count() == 1


def test_ball_links_of_crowds(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 50)
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(8)]
    values = {x ^ (sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 8))) & (2**64 - 1)) for x in centres for _ in range(40)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    links = simhash.ball_links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    found = {r.node: r.root for r in simhash.components(links).collect()}
    assert {v: found.get(v, v) for v in signed} == components(signed)


def slow_counts(text):
    words, seen, covered = WORD.findall(text or ""), collections.defaultdict(list), set()
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    for places in seen.values():
        if len(places) > 1:
            covered.update(p + k for p in places for k in range(8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, labels, odd):
    rules = decision_rules.learn(docs, labels)
    for table in (docs, odd):
        rows = decision_rules.judge(table, rules).collect()
        expect = sorted((r.doc_id or 0, *slow_counts(r.text)) for r in table.collect())
        assert sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == expect
        assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in rows)
    good = decision_rules.judge(docs, rules).join(labels.where("quality = 1"), "doc_id").where("NOT base_failed")
    assert good.where("NOT kept").count() <= 0.02 * good.count()
    assert decision_rules.learn(docs, labels.limit(0)) == []
    assert decision_rules.keep_good(odd, rules).columns == odd.columns


def slow_removed(rows):
    lines = sorted(((i, k, frozenset(WORD.findall(x))) for i, t in rows if i is not None and t is not None for k, x in enumerate(t.split("\n"))), key=lambda x: x[:2])
    gone, before = collections.defaultdict(list), []
    for i, k, words in lines:
        if words:
            if any(9 * len(words & other) >= 4 * (len(words) + len(other)) for other in before):
                gone[i].append(k)
            before.append(words)
    return gone


def test_line_dedup(docs):
    table = docs.limit(120)
    rows = [(r.doc_id, r.text) for r in table.collect()]
    gone = slow_removed(rows)
    assert {r.doc_id: r.removed_lines for r in line_dedup.report(table).collect()} == {i: ",".join(map(str, gone.get(i, []))) for i, _ in rows}
    kept = {r.doc_id: r.text for r in line_dedup.without_similar_lines(table).collect()}
    assert kept == {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


def test_line_dedup_of_alike_lines(spark):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(30)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(30)] = f"x{rng.randrange(500)}"
        rows.append((i, " ".join(words) + "\na b c d e\na b c d " + "ef"[i % 2]))
    found = line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = slow_removed(rows)
    assert {r.doc_id: r.removed_lines for r in found} == {i: ",".join(map(str, gone.get(i, []))) for i, _ in rows}


def test_line_dedup_of_frequent_words(spark, monkeypatch):
    """Lines of few different words: all are frequent, so lines meet on pairs; some lines are long, some have odd gaps."""
    monkeypatch.setattr(line_dedup, "FREQUENT", 4)
    monkeypatch.setattr(line_dedup, "WIDE_FROM", 8)
    rng = random.Random(9)
    vocabulary = [f"v{k}" for k in range(45)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(1, 3)):
            words = rng.sample(vocabulary, rng.choice([1, 3, 4, 5, 9, 10, 30, 40]))
            lines.append(rng.choice([" ", "  ", "\t", " \x0b"]).join(words))
            if rng.random() < 0.4:
                lines.append(" ".join(w for w in words if rng.random() > 0.07))
        rows.append((i, "\n".join(lines)))
    found = line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = slow_removed(rows)
    assert {r.doc_id: r.removed_lines for r in found} == {i: ",".join(map(str, gone.get(i, []))) for i, _ in rows}


def test_near_copies_meet_once_for_each_run_of_shared_words(spark, monkeypatch):
    """Near copies of a long line share most words of their prefixes, but do not meet at each of them; no pair is lost by that."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(150)] = f"x{rng.randrange(500)}"
        rows.append((i, " ".join(words)))
    table = spark.createDataFrame(rows, "id long, text string")
    words = [set(t.split()) for _, t in rows]
    alike = {(a, b) for b in range(40) for a in range(b) if 9 * len(words[a] & words[b]) >= 4 * (len(words[a]) + len(words[b]))}
    for frequent in (32, 1 << 12):  # words in most lines are frequent; they are not, but near it
        monkeypatch.setattr(line_dedup, "FREQUENT", frequent)
        bits, limit = line_dedup.rarity(table)
        lines = line_dedup.line_sets(table, bits).withColumn("open", F.lit(1))
        pairs = [(r.id_a, r.id_b) for r in line_dedup.met(line_dedup.entries(lines, 7 if frequent > 32 else limit)).collect()]
        assert alike <= set(pairs) and all(a < b for a, b in pairs)
        assert len(pairs) < 8 * len(set(pairs))  # a prefix has over 30 words


def test_lines_meet_by_one_shuffle_and_short_prefixes(spark):
    """Of the shorter line only a ninth of its words is looked up: the rest is left out behind the one shuffle, before rows are sorted and meet."""
    rng = random.Random(11)
    rows = []
    for i in range(60):
        words = rng.sample([f"w{k}" for k in range(200)], rng.randint(4, 60))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[rng.randint(0, len(words) // 5):]))]
    table = spark.createDataFrame(rows, "id long, text string")
    words = [set(t.split()) for _, t in rows]
    alike = {(a, b) for b in range(120) for a in range(b) if 9 * len(words[a] & words[b]) >= 4 * (len(words[a]) + len(words[b]))}
    bits, limit = line_dedup.rarity(table)
    assert spark.conf.get(line_dedup.FIRST_MAP, None) in (None, "16")  # as it was
    found = line_dedup.met(line_dedup.entries(line_dedup.line_sets(table, bits).withColumn("open", F.lit(1)).where("n > 3"), limit))
    assert {x for x in alike if min(len(words[k]) for k in x) > 3} <= {(r.id_a, r.id_b) for r in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and re.search(r"Filter \([^\n]*room[^\n]*\n[^\n]*(ShuffleRead|ShuffleQueryStage|Exchange)", plan)


def test_line_dedup_of_large_ids(spark):
    rows = [(2**63 - 1, "a b c d"), (-(2**63), "a b c d\np q r s\na b c d"), (5, "p q r s")]
    found = line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.removed_lines for r in found} == {2**63 - 1: "0", -(2**63): "2", 5: "0"}


def test_line_dedup_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "a b c\na b c"), (None, "a b c"), (2, None)], "doc_id long, text string").withColumns({"__id": F.lit(1), "__removed": F.lit(2), "id": F.lit(3), "line_no": F.lit(4)})
    kept = line_dedup.without_similar_lines(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.text) == [(0, "a b c"), (1, "a b c")]


def test_line_dedup_of_repeated_ids(spark):
    """Rows that share an id are documents of their own: no line goes because of another row's line of that number."""
    rows = [(1, "alpha beta gamma delta"), (2, "only here one two three"), (2, "alpha beta gamma delta"), (3, "p q r s\nt u v w"), (3, "t u v w\nsomething else"), (None, "p q r s"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "part": F.lit("x"), "number": F.lit(2)}).repartition(3)
    kept = line_dedup.without_similar_lines(df)
    texts = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert kept.columns == df.columns and texts[0] == (0, "p q r s") and texts[1:4] == [(1, "alpha beta gamma delta"), (2, ""), (2, "only here one two three")]
    rest = [t for i, t in texts if i == 3]
    assert rest in (["", "p q r s\nt u v w", "something else"], ["", "p q r s", "t u v w\nsomething else"])
    found = sorted((r.doc_id or 0, r.n_lines, r.n_removed) for r in line_dedup.report(df).collect())
    assert found[:4] == [(0, 1, 0), (1, 1, 0), (2, 1, 0), (2, 1, 1)] and sum(x[2] for x in found) == 2


def test_line_dedup_of_odd_tables(odd):
    found = line_dedup.report(odd).collect()
    assert sorted((r.doc_id or 0, r.n_lines, r.n_removed) for r in found) == [(0, 1, 0), (1, 0, 0), (2, 1, 0), (3, 3, 1), (3, 3, 2), (4, 1, 0), (5, 2, 0)]
    assert line_dedup.report(odd.limit(0)).count() == 0


def test_url_rules_and_trust(spark):
    rows = [
        (1, "http://good.org/fr/x", '<a href="http://mid.io/a">'), (2, "http://mid.io/", '<a href="//far.io/">'), (3, "http://farm.io/q", '<a href="https://BAD.net/x">x</a>'), (4, "HTTP://x.BAD.net:80/", None), (5, None, "x"),
        (6, "abc", None), (7, "http://far.io?x://y/", None), (9, "http://bad.net/", None), (10, "http://a.example.net/en/1", None), (11, "http://a.example.net/de/1", None), (12, "http://example.com/de/", None), (12, "http://example.com/de/", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit("z"))
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in link_trust.judge(df).collect()}
    assert found == {
        1: ("good.org", "/fr/x", "org/fr/", "allow"), 2: ("mid.io", "/", None, "allow"), 3: ("farm.io", "/q", None, "block"), 4: ("x.bad.net:80", "/", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"),
        7: ("far.io", "", None, "allow"), 9: ("bad.net", "/", "net/", "block"), 10: ("a.example.net", "/en/1", "example.net/en/", "allow"), 11: ("a.example.net", "/de/1", "net/", "block"), 12: ("example.com", "/de/", "example.com/de/", "block"),
    }
    assert link_trust.judge(df.limit(0)).count() == 0


def test_propagation_against_a_loop(spark):
    rng = random.Random(4)
    hosts = [f"h{k}" for k in range(30)]
    edges = {(rng.choice(hosts), rng.choice(hosts)): rng.randint(1, 5) for _ in range(90)}
    edges = {e: n for e, n in edges.items() if e[0] != e[1]}
    seeds = {"h0": 1.0, "h7": 0.5}
    total = collections.Counter()
    for (a, _), n in edges.items():
        total[a] += n
    score = {h: 0.15 * seeds.get(h, 0.0) for h in hosts}
    for _ in range(200):
        new = {h: 0.15 * seeds.get(h, 0.0) for h in hosts}
        for (a, b), n in edges.items():
            new[b] += 0.85 * score[a] * n / total[a]
        score = new
    df = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long")
    found = {r.host: r.score for r in link_trust.propagate(df, spark.createDataFrame(list(seeds.items()), "host string, seed double")).collect()}
    assert all(abs(found.get(h, 0.0) - x) < 1e-4 for h, x in score.items())


def test_url_trust_with_other_columns(spark):
    df = spark.createDataFrame([(1, "http://a.net/x", None)], "page_id long, url string, html string").withColumns({c: F.lit("z") for c in ("host", "path", "verdict", "ruled")})
    assert [(r.host, r.verdict) for r in link_trust.judge(df).collect()] == [("a.net", "block")]


def test_warc_of_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    index = warc.write_archive(pages, str(tmp_path))
    assert index.count() == 0 and warc.fetch(spark, index, str(tmp_path), [1]).count() == 0
