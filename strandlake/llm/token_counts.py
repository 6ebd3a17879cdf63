"""Exact token counts at every prefix of a text (operator 4).

The counts are those of a SentencePiece BPE model.  A prefix of length i of a
unit ends in exactly one token t for which the prefix without t is encoded with
a last token that may stand before t; ``count[i] = count[i - len(t)] + 1``.
Candidates for t come from Aho-Corasick matches, and whether t may stand after
another token from a table of pairs.  So one pass over a unit stores the exact count at *every* prefix.  The counts of
all prefixes of a text follow from those of its units (``prefix_counts``), and questions such as "how many tokens has
this prefix" or "how much of the text fits into 4096 tokens" are answered from them without encoding anything again.

No piece of such a model has a space mark after another character, so a text
falls into units that begin at spaces, and counts of units add up.  Short units
are counted once and remembered in a bounded table of each Python worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import map_pandas

SPACE = "▁"
#: Units that a worker remembers before it starts afresh, and the characters up to which one is remembered: together they bound the bytes.
MEMO_UNITS, MEMO_CHARS = 600_000, 64
#: Marks at the end of a unit that are tried as a cut.
TAIL = ".,;:!?%&$*#|"


class PrefixCounter(dict):
    """Maps a unit to its exact token count; ``stored`` has the counts of all its prefixes.

    A unit is what follows a space (which it does not contain), or a line
    feed and what follows it.  ``stored[unit][i]`` is the count of the first i
    characters, with the space's mark before them.
    """

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.rank: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                self.rank[sp.id_to_piece(i)] = -sp.get_score(i)
        probe = "a  ́éﬁ\t b"
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("only models with the identity normaliser and a dummy prefix are supported")
        if any(SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE)) for p in self.rank):
            raise ValueError("a piece goes across a space")
        self.runs = {len(p) for p in self.rank if not p.strip(SPACE)}
        self.pieces = list(self.rank)
        self.matcher = ahocorasick.Automaton()
        for i, piece in enumerate(self.pieces):
            if self.merge(piece) == [piece]:
                self.matcher.add_word(piece, (i, len(piece)))
        self.matcher.make_automaton()
        self.valid: dict[int, bool] = {}
        #: Characters that stand side by side in a piece; between others a unit can be cut.
        self.joined = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        if any("\n" in pair for pair in self.joined):
            raise ValueError("a piece goes across a line end")
        self.stored: dict[str, bytes | list[int]] = {}
        self.bare: dict[str, list[int]] = {}

    def merge(self, text: str) -> list[str]:
        """Plain BPE of a short string; only used to fill the pair table."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = self.rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """Pair table: does merging the two strings give just this pair?"""
        if len(self.valid) > 2_000_000:
            self.valid.clear()
        a, b = self.pieces[left], self.pieces[right]
        ok = self.valid[left << 20 | right] = self.merge(a + b) == [a, b]
        return ok

    def prefixes(self, unit: str) -> tuple[list[int], list[int]]:
        """Token count and last token of every prefix (-1: a character that falls back to bytes)."""
        n, valid = len(unit), self.valid
        count, last, done = [0] * (n + 1), [-1] * (n + 1), 0
        for end, (piece, size) in self.matcher.iter(unit):
            if end < done:  # its token is known
                continue
            if end > done:
                done = self.fall_back(unit, count, done, end)
            before = last[end + 1 - size]
            if before < 0 or (ok := valid.get(before << 20 | piece)) or (ok is None and self.may_follow(before, piece)):
                done = end + 1
                count[done], last[done] = count[done - size] + 1, piece
        if done < n:
            self.fall_back(unit, count, done, n)
        return count, last

    @staticmethod
    def fall_back(unit: str, count: list[int], done: int, to: int) -> int:
        for k in range(done, to):
            count[k + 1] = count[k] + len(unit[k].encode())
        return to

    def counts(self, unit: str, mark: str) -> list[int]:
        """Counts of all prefixes; marks at the end are counted by themselves if no piece joins them on."""
        k = len(unit.rstrip(TAIL))
        if 0 < k < len(unit) and unit[k - 1 : k + 1] not in self.joined:
            if (end := self.bare.get(unit[k:])) is None:
                end = self.prefixes(unit[k:])[0]
                if len(unit) - k <= MEMO_CHARS:
                    self.bare[unit[k:]] = end
            start = self.prefix_counts_of(unit[:k]) if mark else self.prefixes(unit[:k])[0]
            return [*start, *(start[-1] + c for c in end[1:])]
        return self.prefixes(mark + unit)[0][len(mark) :]

    def __missing__(self, unit: str) -> int:
        found = self.unit_counts(unit)
        if len(unit) <= MEMO_CHARS:
            if len(self) >= MEMO_UNITS:
                for known in (self, self.stored, self.bare):
                    known.clear()
            self.stored[unit] = bytes(found) if max(found) < 256 else found  # a prefix may count more than the whole
            self[unit] = found[-1]
        return found[-1]

    def unit_counts(self, unit: str) -> list[int]:
        if unit[0] != "\n":
            return self.counts(unit, SPACE)
        rest = self.counts(unit[1:], "") if len(unit) > 1 else [0]
        return [0, *(1 + c for c in rest)]

    def alone(self, unit: str) -> list[bool]:
        """For every prefix of the unit: does the mark before it stay a token of its own?"""
        last = self.prefixes(SPACE + unit)[1]
        out = [True]  # the bare mark
        for i in range(2, len(last)):
            before = i - (len(self.pieces[last[i]]) if last[i] >= 0 else 1)
            out.append(before > 0 and out[before - 1])
        return out

    def run(self, n: int) -> int:
        """Tokens of n space marks in a row: equal ranks, so the leftmost pair goes first."""
        blocks: list[int] = []
        for _ in range(n):
            blocks.append(1)
            while len(blocks) > 1 and blocks[-2] + blocks[-1] in self.runs:
                blocks[-2:] = [blocks[-2] + blocks[-1]]
        return len(blocks)

    @staticmethod
    def units(text: str) -> list[str]:
        """'' stands for a space after which no character of the unit follows."""
        return text.replace(SPACE, " ").replace("\n", " \n").split(" ") if text else []

    def count(self, text: str) -> int:
        units = self.units(text)
        if "" not in units:
            return sum(map(self.__getitem__, units))
        total = spaces = 0
        for unit in units:
            if unit == "":
                total += self.run(spaces + 1) - self.run(spaces)
                spaces += 1
            else:
                total += self[unit]
                if spaces and unit[0] != "\n":
                    total += self.after_spaces(spaces, self.alone(unit)[-1])
                spaces = 0
        return total

    def after_spaces(self, spaces: int, alone: bool) -> int:
        """What a unit counts more after a run of spaces, whose marks may merge with its own."""
        return self.run(spaces + alone) - alone - self.run(spaces)

    def prefix_counts_of(self, unit: str) -> bytes | list[int]:
        if (found := self.stored.get(unit)) is None:
            found = self.unit_counts(unit)
        return found

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of text[:n] for every n from 0 to the length of the text."""
        out, total, spaces = [0], 0, 0
        for k, unit in enumerate(self.units(text)):
            if unit == "":
                total += self.run(spaces + 1) - self.run(spaces)
                spaces += 1
                if k:  # the first mark stands before the text
                    out.append(total)
                continue
            counts, line = self.prefix_counts_of(unit), unit[0] == "\n"
            if k and not line:  # the space itself
                out.append(total + self.run(spaces + 1) - self.run(spaces))
            if spaces and not line:
                more = [self.after_spaces(spaces, x) for x in self.alone(unit)]
                out += [total + c + m for c, m in zip(counts[1:], more[1:], strict=True)]
            else:
                out += [total + c for c in counts[1:]]
            total, spaces = out[-1], 0
        return out

    def fit(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens (a longer prefix may have fewer tokens than a shorter one)."""
        return int(np.flatnonzero(np.array(self.prefix_counts(text)) <= budget)[-1])


@lru_cache(maxsize=2)
def counter(model_file: str) -> PrefixCounter:
    return PrefixCounter(model_file)


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes, tokens, and what fits into ``limit`` tokens, for every whole text.

    No shuffle: each batch of rows is counted where it is read.  A null text
    counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows
    give one row each; other columns of the input are not looked at.
    ``fits_chars`` is the number of characters that the budget holds, told from
    the prefix counts (the whole text if it is not over the limit).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = counter(model_file)
        for pdf in batches:
            texts = pdf["text"].fillna("").tolist()
            tokens = [table.count(t) for t in texts]
            yield pd.DataFrame({
                "id": pdf["id"],
                "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": tokens,
                "over_limit": [n > limit for n in tokens],
                "fits_chars": [table.fit(t, limit) if n > limit else len(t) for t, n in zip(texts, tokens, strict=True)],
            })

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    out = map_pandas(rows, run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, fits_chars long")
    return out.withColumnRenamed("id", id_col)


def prefix_tables(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts): the exact token count of every prefix of every whole text, from 0 to all its characters.

    Null texts are empty (one count, 0); ids may be null or repeated (a row each); other columns are not looked at.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = counter(model_file)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "counts": [np.array(table.prefix_counts(t), np.int32) for t in pdf["text"].fillna("")]})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return map_pandas(rows, run, f"id {kind}, counts array<int>").withColumnRenamed("id", id_col)


def tokens_of_prefix(counts: Column, chars: Column) -> Column:
    """Tokens of the first ``chars`` characters, from a prefix table (beyond the text: those of all of it)."""
    return F.get(counts, F.least(F.greatest(chars, F.lit(0)), F.size(counts) - 1))


def chars_within(counts: Column, budget: Column) -> Column:
    """Characters of the longest prefix within a token budget, from a prefix table (0 at least)."""
    last = F.size(counts) - F.array_position(F.transform(F.reverse(counts), lambda c: (c <= budget).cast("int")), 1)
    return F.greatest(last, F.lit(0)).cast("int")
