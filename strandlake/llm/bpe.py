"""Backtracking byte-pair encoder and offset-table decoder (operator 6).

Aho-Corasick finds every vocabulary token inside a pre-token.  From the left the
longest token is tried; it may stand after the one before it only if merging
the two strings gives exactly this pair (the pair-compatibility table).  If no
token fits, the last one is taken back and its end is marked as dead, so every
position is left at most once and the exact merges come out in linear time.
Decoding copies slices of one byte string by an offset table.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from strandlake.llm.common import map_pandas

END = "</w>"
#: One character that no byte-level alphabet has stands for the end of a word.
MARK = "␂"
#: Chunks, and pre-tokens, that a worker remembers before it starts afresh, and the characters up to which one is remembered: together they bound the bytes.
MEMO_WORDS, MEMO_CHARS = 250_000, 256
#: The split pattern of the vocabulary file (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> dict[int, str]:
    """Byte -> character: printable Latin-1 stands for itself, the rest goes from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def odd_characters():
    """The characters that are letters or numbers here, but not to the patterns of the tokenizers library, which know an older Unicode; letters that the library lowers in another way than Python; and the least character of both."""
    import regex
    from tokenizers import Regex, normalizers, pre_tokenizers

    named = "".join(regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000)))
    left = "".join(x for x, _ in pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed").pre_tokenize_str(named))
    lower = normalizers.Lowercase().normalize_str
    table = {ord(c): lower(c) for c in regex.findall(r"[\p{Lu}\p{Lt}]", named) if lower(c) != c.lower()}
    return frozenset(left), table, min([*left, *map(chr, table)], default=chr(0x10FFFF))


class Encoder:
    def __init__(self, vocab_file: str):
        import ahocorasick
        import regex

        with open(vocab_file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or model["unk_token"] is not None:
            raise ValueError("only byte-level BPE with word ends is supported")
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if split["pattern"] != {"Regex": PATTERN}:
            raise ValueError("the split pattern is not the supported one")
        self.words = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}"))
        self.gap = regex.compile(r"\p{White_Space}+")
        self.odd, self.lowered, self.least = odd_characters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        marked = lambda t: t[: -len(END)] + MARK if t.endswith(END) else t
        self.ids = {marked(t): i for t, i in model["vocab"].items()}
        self.rank = {(marked(a), marked(b)): k for k, (a, b) in enumerate(model["merges"])}
        self.bytes = byte_alphabet()
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        top = max(names) + 1
        pieces = [names.get(i, "").encode() for i in range(top)]
        self.blob, self.offsets = b"".join(pieces), [0]
        for p in pieces:
            self.offsets.append(self.offsets[-1] + len(p))
        self.matcher = ahocorasick.Automaton()
        #: Token -> rank and parts of its merge; every part is made before it is merged, and no token by two merges.
        self.made = {a + b: (k, a, b) for (a, b), k in self.rank.items()}
        self.ordered = len(self.made) == len(model["merges"]) and all(self.made.get(p, (-1,))[0] < k for pair, k in self.rank.items() for p in pair)
        #: Token that merging gives -> those of them it begins with, itself included, short ones first.
        self.begins: dict[str, list[str]] = {}
        for t in sorted(self.ids, key=len):
            if self.is_made(t):
                self.begins[t] = [p for k in range(1, len(t)) if (p := t[:k]) in self.begins] + [t]
                self.matcher.add_word(t, (len(t) - 1, self.begins[t]))
        self.matcher.make_automaton()
        #: The pair table, by the left token.
        self.after: dict[str, dict[str, bool]] = {t: {} for t in self.begins}
        self.n_pairs = 0
        self.word_pairs, self.chunk_pairs = Memo(self.word_pair), Memo(self.chunk_pair)

    def merge(self, text: str) -> list[str]:
        """Plain BPE of a short string; only used to fill the tables."""
        parts = list(text)
        if len(parts) > 1 and parts[-1] == MARK:
            parts[-2:] = [parts[-2] + MARK]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def is_made(self, token: str) -> bool:
        """Whether merging the characters of a token gives this token."""
        if not self.ordered:
            return self.merge(token) == [token]
        if len(token) - token.endswith(MARK) == 1:
            self.made[token] = -1, "", ""
            return True
        rank, a, b = self.made.get(token, (-1, "", ""))
        return a in self.begins and b in self.begins and self.apart(a, b, rank)

    def apart(self, left: str, right: str, limit: int) -> bool:
        """Whether merging left + right gives just these two before the merge of rank ``limit``.

        Their merges are undone, the latest first.  The two parts that then meet
        must not have a merge before the one undone; of equal ranks the left one
        comes first.
        """
        rank, made = self.rank.get, self.made
        while rank((left, right), limit) >= limit:
            (a, _, inner), (b, outer, _) = made[left], made[right]
            if a > b:
                left, limit = inner, a
            elif b >= 0:
                right, limit = outer, b + 1
            else:
                return True
        return False

    def may_follow(self, left: str, right: str) -> bool:
        ok = self.after[left].get(right)
        if ok is None:
            if self.n_pairs > 2_000_000:
                for pairs in self.after.values():
                    pairs.clear()
                self.n_pairs = 0
            ok = self.apart(left, right, 1 << 30) if self.ordered else self.merge(left + right) == [left, right]
            self.after[left][right] = ok
            self.n_pairs += 1
        return ok

    def encode_word(self, word: str) -> list[int]:
        """Token ids of one pre-token."""
        # Printable ASCII stands for itself in the byte alphabet.
        plain = word.isascii() and word.isprintable()
        text = (word if plain else "".join(map(self.bytes.__getitem__, word.encode()))) + MARK
        n = len(text)
        starts: list[list[str]] = [[]] * n
        for end, (back, begins) in self.matcher.iter(text):
            starts[end - back] = begins  # of the longest, which comes last
        after, dead, path, tries = self.after, [False] * (n + 1), [], []
        known, at, k = None, 0, len(starts[0]) - 1
        while at < n:
            options = starts[at]
            while k >= 0:
                token = options[k]
                if not dead[at + len(token)] and (known is None or (ok := known(token)) or (ok is None and self.may_follow(path[-1], token))):
                    break
                k -= 1
            if k >= 0:
                path.append(token)
                tries.append(k)
                known = after[token].get
                at += len(token)
                k = len(starts[at]) - 1 if at < n else 0
            else:
                dead[at] = True
                at -= len(path.pop())
                known = after[path[-1]].get if path else None
                k = tries.pop() - 1
        return [self.ids[t] for t in path]

    def chunks(self, text: str) -> Iterator[str]:
        """What stands between white space, and special tokens by themselves.

        No pre-token holds white space and no character composes with it, so
        each chunk can be normalised and encoded by itself.
        """
        for part in self.cut.split(text) if self.special and "<|" in text else [text]:
            if part in self.special:
                yield part
            elif any(c in part for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split only
                yield from filter(None, self.gap.split(part))
            else:
                yield from part.split()

    def chunk_pair(self, chunk: str) -> tuple[str, str]:
        """Decimal ids of a chunk, and its decoded text, each joined by one space."""
        if chunk in self.special:
            ids = [self.special[chunk]]
            return str(ids[0]), self.decode(ids)
        # Each character is lowered by itself: no final sigma.
        if chunk.isascii():
            chunk = chunk.lower()
            words = [chunk] if chunk.isalpha() else self.words.findall(chunk)
        else:
            chunk = unicodedata.normalize("NFC", chunk)
            if odd := max(chunk) >= self.least:
                chunk = chunk.translate(self.lowered)
            chunk = chunk.replace("Σ", "σ").lower()
            words = self.split(chunk) if odd else self.words.findall(chunk)
        if len(words) == 1:
            return self.word_pairs[words[0]]
        return joined(map(self.word_pairs.__getitem__, words))

    def word_pair(self, word: str) -> tuple[str, str]:
        ids = self.encode_word(word)
        return " ".join(map(str, ids)), self.decode(ids)

    def split(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk with odd characters, which count as neither letters nor numbers."""
        shown = "".join("\u2603" if c in self.odd else c for c in chunk)
        return [chunk[m.start() : m.end()] for m in self.words.finditer(shown)]

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encoded(text)[0].split()]

    def encoded(self, text: str) -> tuple[str, str]:
        """Decimal ids, and the decoded text, each joined by one space."""
        return joined(map(self.chunk_pairs.__getitem__, self.chunks(text)))

    def decode(self, ids) -> str:
        at, blob, top = self.offsets, self.blob, len(self.offsets) - 1
        return b" ".join([blob[at[i] : at[i + 1]] for i in ids if 0 <= i < top and at[i] < at[i + 1]]).decode()


def joined(pairs) -> tuple[str, str]:
    pairs = list(pairs)
    return " ".join([ids for ids, _ in pairs]), " ".join([text for _, text in pairs])


class Memo(dict):
    """Results of a function. A full memo becomes the old half; what is met again is taken over from it, the rest goes with the next one."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> tuple[str, str]:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS // 2:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


@lru_cache(maxsize=2)
def encoder(vocab_file: str) -> Encoder:
    return Encoder(vocab_file)


def encode_texts(docs: DataFrame, vocab_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids (array<int>) of every whole text.

    A null text is encoded as an empty one (no ids); a null id stays null;
    repeated rows give one row each; other columns are not looked at.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(vocab_file)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "ids": [e.encode(t) for t in pdf["text"].fillna("")]})

    return _mapped(docs, run, "ids array<int>", id_col, text_col)


def decode_ids(encoded: DataFrame, vocab_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Token strings of the ids, joined by one space (null ids: an empty text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(vocab_file)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "decoded": ["" if x is None else e.decode(x) for x in pdf["text"]]})

    return _mapped(encoded, run, "decoded string", id_col, ids_col)


def encoding_digest(docs: DataFrame, vocab_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count and SHA-256 of ids and of the decoded text, without moving the ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(vocab_file)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for pdf in batches:
            both = [e.encoded(t) for t in pdf["text"].fillna("")]
            yield pd.DataFrame({
                "id": pdf["id"],
                "n_tokens": [ids.count(" ") + 1 if ids else 0 for ids, _ in both],
                "ids_sha256": [sha(ids) for ids, _ in both],
                "decoded_sha256": [sha(text) for _, text in both],
            })

    return _mapped(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col)


def _mapped(df: DataFrame, run, columns: str, id_col: str, value_col: str) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.selectExpr(f"`{id_col}` AS id", f"`{value_col}` AS text")
    return map_pandas(rows, run, f"id {kind}, {columns}").withColumnRenamed("id", id_col)
