"""Token counts and BPE against the libraries."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandlake.llm import bpe, token_counts

ODD = [
    "", " ", "  a", "a  b", "a\nb", "a \n b", "<s> x </s>", "é é ﬁ", "　x", "\u0000a", "a▁b", "\t\tx", "salve   ", "\n", "\n\n a", "  \n  ", "it's I'll 'S DON'T", "ΑΣ Σ ΣΑΣ", "İstanbul", "<|endoftext|>",
    "a<|startoftext|> b <|endoftext|><|ENDOFTEXT|>", "x\x85y\x1cz\xa0q", "日本語のテキスト 漢字", "😀 😀😀 👨‍👩‍👧", "Ⅷ ½ ²3 ٣", "ǅ ẞ ß", "á̀", "가각 가", "....!!!???", "a" * 500, " " * 333 + "b" + " " * 77, "▁▁▁",
]


@pytest.fixture(scope="module")
def texts(spark, sf):
    rng = random.Random(1)
    alphabet = "  \n\tabcdeTHE'sé日😀ß.,!0199  　Σİ<|>▁"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    return ODD + made + [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def test_counts_are_the_library_s(texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    table, library = token_counts.counter(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert [table.count(t) for t in texts] == [len(library.encode(t)) for t in texts]


def test_every_prefix_and_budget(texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    table, library = token_counts.counter(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in [*texts[: len(ODD) + 1500], "aa   bbbbbb cc", "ab" * 400]:
        slow = [len(library.encode(text[:n])) for n in range(len(text) + 1)]
        assert table.prefix_counts(text) == slow
        for budget in (0, 1, 2, 3, 9, 200):
            assert table.fit(text, budget) == max(n for n, c in enumerate(slow) if c <= budget)


def test_prefix_tables(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(1, None), (2, ""), (3, "a  b c"), (None, "xyz" * 30), (3, "a  b c")]
    table = token_counts.prefix_tables(spark.createDataFrame(rows, "doc_id long, text string").withColumn("counts", F.lit(1)), path)
    asked = table.select("doc_id", "counts", token_counts.tokens_of_prefix(F.col("counts"), F.lit(2)).alias("two"), token_counts.chars_within(F.col("counts"), F.lit(3)).alias("fits")).collect()
    assert len(asked) == 5
    for r in asked:
        text = {1: "", 2: "", 3: "a  b c", None: "xyz" * 30}[r.doc_id]
        slow = [len(library.encode(text[:n])) for n in range(len(text) + 1)]
        assert r.counts == slow and r.two == slow[min(2, len(text))] and r.fits == max(n for n, c in enumerate(slow) if c <= 3)


def test_units_whose_count_falls_back():
    """A spaceless unit may end at 255 tokens with 256 at a prefix before."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    table, library = token_counts.counter(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng, met = random.Random(4), 0
    for _ in range(40):
        unit = "".join(rng.choice(["tion", "the", "ing", "straße", "qu", "x", "ver", "ation", "er", "z"]) for _ in range(600))
        counts = table.prefixes("▁" + unit)[0][1:]
        for n in [n for n in range(1, len(unit) + 1) if counts[n] < 256 <= max(counts[: n + 1])][:3]:
            met += 1
            assert table.count(unit[:n]) == len(library.encode(unit[:n])) and table.fit(unit[:n], 10_000) == n
            assert list(table.prefix_counts_of(unit[:n])) == counts[: n + 1]
    assert met


def test_ids_and_decoding_are_the_library_s(texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = bpe.encoder(path), Tokenizer.from_file(path)
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_ids_of_every_code_point():
    """Letters, numbers, lower case and white space are what the library takes for such: all code points of scripts and symbols."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = bpe.encoder(path), Tokenizer.from_file(path)
    points = [*range(1, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x18000, 1), *range(0x1B000, 0x20000), *range(0x20000, 0x110000, 97)]
    points = [c for c in points if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}?{chr(c)}1" for c in points]
    found = library.encode_batch(texts, add_special_tokens=False)
    assert [hex(c) for c, t, e in zip(points, texts, found, strict=True) if own.encode(t) != e.ids] == []


def test_words_met_again_are_encoded_once(monkeypatch):
    """A full memo loses what was not met lately, not the frequent words, and stays within its bound."""
    monkeypatch.setattr(bpe, "MEMO_WORDS", 40)
    own, seen = bpe.Encoder(public_tokenizers.path("word_bpe_49k.json")), []
    encode = own.encode_word
    own.encode_word = lambda word: seen.append(word) or encode(word)
    texts = [f"Salve, salve! {' '.join('x' * k + 'q' * j for j in range(1, 6))}" for k in range(1, 60)]
    out = [own.encoded(t) for t in texts]
    assert seen.count("salve") == 1 and len(seen) == 59 * 5 + 3
    assert all(len(m) + len(m.old) <= 40 for m in (own.word_pairs, own.chunk_pairs))
    assert out == [bpe.Encoder(public_tokenizers.path("word_bpe_49k.json")).encoded(t) for t in texts[:1]] + [(" ".join(map(str, own.encode(t))), own.decode(own.encode(t))) for t in texts[1:]]


def test_pair_table_is_plain_merging():
    own, rng = bpe.encoder(public_tokenizers.path("word_bpe_49k.json")), random.Random(5)
    assert own.ordered and all(own.merge(t) == [t] for t in own.begins) and len(own.begins) == len(own.ids)
    inner, every = [t for t in own.begins if bpe.MARK not in t], list(own.begins)
    same = [t for t in every if t[0] in "ahel!.-" and len(set(t) - {bpe.MARK}) == 1]
    pairs = [(rng.choice(inner), rng.choice(every)) for _ in range(5000)] + [(a, b) for a in same for b in same if a[0] == b[0] and bpe.MARK not in a]
    assert [p for p in pairs if own.may_follow(*p) != (own.merge("".join(p)) == list(p))] == []


@pytest.mark.parametrize("merges", [["a b", "b c", "ab c", "a bc", "abc a"], ["ab c", "b c", "a b", "abc b", "c a</w>"], ["a a", "aa a", "aa aa", "b a</w>"]])
def test_vocabularies_with_other_merges(tmp_path, merges):
    """Tokens of two merges, and parts that are made after their merge."""
    import json

    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    names = dict.fromkeys([*bpe.byte_alphabet().values(), *(c + bpe.END for c in bpe.byte_alphabet().values()), *("".join(m.split()) for m in merges)])
    spec["model"] |= {"vocab": {t: i for i, t in enumerate(names)}, "merges": [m.split() for m in merges]}
    spec["added_tokens"] = []
    path = tmp_path / "small.json"
    path.write_text(json.dumps(spec))
    own, library, rng = bpe.Encoder(str(path)), Tokenizer.from_file(str(path)), random.Random(6)
    for text in ["".join(rng.choice("aaabbcc ") for _ in range(rng.randint(1, 20))) for _ in range(2000)]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_odd_tables(spark):
    rows = [(1, None, 5), (None, "a b", 6), (2, "", 7), (1, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    counted = token_counts.count_tokens(df, public_tokenizers.path("piece_bpe_32k.model"), limit=1)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in counted.collect()) == [(0, 3, 2, True), (1, 0, 0, False), (1, 0, 0, False), (2, 0, 0, False)]
    assert bpe.encoding_digest(df, public_tokenizers.path("word_bpe_49k.json")).count() == 4
    assert bpe.encode_texts(df.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0
