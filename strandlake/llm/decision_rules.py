"""Quality rules as learned decision lists (operator 8, DataFrame functions only).

Sequential covering over labelled documents: a rule is grown one threshold at a
time by information gain, pruned on rows that did not grow it, and added to an
ordered list; the documents it covers go, and the next rule is grown.  Every
step is one grouped count over the binned measures of the labelled sample, so
the driver only sees (measure, bin) counts.  The list becomes one ordered
``CASE WHEN`` expression that Spark evaluates next to the text.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import words_of, written

#: Words in a window that may repeat.
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Measures that conditions may be about.
MEASURES = ("n_words", "word_length", "symbol_share", "upper_share", "mark_share", "dup_line_share", "repeat_share", "distinct_share", "words_per_line")
Q = "__quality_"


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def column(self, m: Column) -> Column:
        c = m[self.measure]
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds a value once inside an expression, so that Spark never evaluates it for every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quality(text: Column) -> Column:
    """A struct of ``b`` (base counts) and ``m`` (measures) of a whole text.

    Repeated windows are found by sorting the hashes of the text's own windows,
    O(n log n) in its words; only texts with a repeated hash are sorted.
    """
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<bigint>")

    def hashes(w: Column) -> Column:
        n = F.size(w)
        return F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(F.slice(w, i + 1, WINDOW)))).otherwise(none)

    def ordered(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(pairs))

    def twice(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        found = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        return F.sort_array(F.transform(found, lambda x: x["at"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW))))
        return F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0))

    def counts(w: Column, line: Column) -> Column:
        repeats = let(hashes(w), lambda h: let(ordered(h), lambda s: let(twice(s), covered)))
        chars = F.length(F.array_join(w, ""))
        found = {
            "n_words": F.size(w), "word_chars": chars, "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
            "n_dup_lines": F.size(line) - F.size(F.array_distinct(line)), "n_repeat_words": repeats,
            "n_lines": F.size(line), "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
            "n_marks": F.regexp_count(text, F.lit("[!?]")), "n_distinct": F.size(F.array_distinct(w)),
        }
        return F.struct(*(c.cast("long").alias(k) for k, c in found.items()))

    def measures(b: Column) -> Column:
        per = lambda x, y: b[x] / F.greatest(b[y], F.lit(1))
        found = {
            "n_words": b["n_words"], "word_length": per("word_chars", "n_words"), "symbol_share": per("n_symbols", "n_words"),
            "upper_share": per("n_upper", "word_chars"), "mark_share": per("n_marks", "n_words"), "dup_line_share": per("n_dup_lines", "n_lines"),
            "repeat_share": per("n_repeat_words", "n_words"), "distinct_share": per("n_distinct", "n_words"), "words_per_line": per("n_words", "n_lines"),
        }
        return F.struct(b.alias("b"), F.struct(*(found[m].cast("double").alias(m) for m in MEASURES)).alias("m"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(words_of(text), lambda w: let(let(lines, lambda line: counts(w, line)), measures))


def base_failed(q: Column) -> Column:
    b = q["b"]
    return (b["n_words"] < 20) | (b["n_repeat_words"] * 100 > b["n_words"] * 30)


def covers(rule: Rule, m: Column) -> Column:
    return reduce(and_, (c.column(m) for c in rule), F.lit(True))


def verdict(rules: list[Rule], q: Column) -> Column:
    """Number of the first rule that covers the row (0: the base rule), else null."""
    out = F.when(base_failed(q), F.lit(0))
    for k, rule in enumerate(rules, 1):
        out = out.when(covers(rule, q["m"]), F.lit(k))
    return out.otherwise(F.lit(None).cast("int"))


def learn(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, bins: int = 64, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.97, min_cover: int = 5, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """Rules that cover low-quality documents, best first.

    ``max_labels`` bounds the labelled rows that are looked at (chosen by hash
    of the id): it bounds the broadcast and the learner's table.  Labels that
    are null are left out; of several labels of an id the largest counts.  With
    no labels, or none of one kind, the list is empty.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(Q + "id")).agg((F.max("quality") == 0).cast("int").alias("bad"))
    total = known.count()
    if not total:
        return []
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(Q + "id")), F.lit(1_000_000))
    known = known.where(bucket < math.ceil(1_000_000 * max_labels / total)).limit(max_labels + max_labels // 10)
    rows = docs.select(F.col(id_col).alias(Q + "id"), F.col(text_col).alias("text")).join(F.broadcast(known), Q + "id")
    grow = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(Q + "id")), F.lit(3)) > 0
    sample = written(rows.select(quality(F.col("text")).alias("q"), "bad", grow.alias("grow")), "rule-sample")
    sample = sample.where(~base_failed(F.col("q"))).select(F.col("q.m").alias("m"), "bad", "grow")
    edges_row = sample.select(*(F.percentile_approx(F.col("m")[m], [k / bins for k in range(bins)], 10_000).alias(m) for m in MEASURES)).first()
    edges = {m: _with_middles(sorted(set(edges_row[m] or []))) for m in MEASURES}
    if not any(edges.values()):
        return []
    bin_of = lambda m: F.size(F.filter(F.array(*map(F.lit, edges[m])), lambda e: e < F.col("m")[m]))
    binned = written(sample.select("m", "bad", "grow", F.array(*(bin_of(m) for m in MEASURES)).alias("bin")), "rule-bins")
    rules: list[Rule] = []
    left = binned
    while len(rules) < max_rules:
        rule = _prune(left, _grow(left, edges, max_conditions), min_precision, min_cover)
        if not rule:
            break
        rules.append(rule)
        left = left.where(~covers(rule, F.col("m")))
    return rules


def _with_middles(edges: list[float]) -> list[float]:
    return sorted({*edges, *((a + b) / 2 for a, b in zip(edges, edges[1:], strict=False))})


def _grow(rows: DataFrame, edges: dict[str, list[float]], max_conditions: int) -> Rule:
    rule: Rule = ()
    rows = rows.where("grow")
    while len(rule) < max_conditions:
        counts = rows.where(covers(rule, F.col("m"))).select("bad", F.posexplode("bin").alias("of", "k")).groupBy("of", "k").agg(F.sum("bad").alias("p"), F.count("*").alias("n")).collect()
        per: dict[int, dict[int, tuple[int, int]]] = {}
        for r in counts:
            per.setdefault(r["of"], {})[r["k"]] = (r["p"], r["n"] - r["p"])
        if not per:
            break
        everyone = next(iter(per.values())).values()
        all_p, all_n = sum(x[0] for x in everyone), sum(x[1] for x in everyone)
        if not all_p or not all_n:
            break
        best, ties = 0.0, []  # equal gains of one measure: the middle threshold is taken
        for m, of in sorted(per.items()):
            name, p, n = MEASURES[m], 0, 0
            for k, edge in enumerate(edges[name]):  # bin k holds values of (edge k-1, edge k]
                p, n = p + of.get(k, (0, 0))[0], n + of.get(k, (0, 0))[1]
                for above, cp, cn in ((False, p, n), (True, all_p - p, all_n - n)):
                    if cp and cp + cn < all_p + all_n:
                        gain = cp * (math.log2(cp / (cp + cn)) - math.log2(all_p / (all_p + all_n)))
                        c = Condition(name, above, float(edge))
                        if gain > best + 1e-9:
                            best, ties = gain, [c]
                        elif ties and gain > best - 1e-9 and (ties[0].measure, ties[0].above) == (name, above):
                            ties.append(c)
        if not ties:
            break
        rule += (ties[len(ties) // 2],)
    return rule


def _prune(rows: DataFrame, rule: Rule, min_precision: float, min_cover: int) -> Rule:
    """The shortest start of the rule that is as precise as any on the rows held back; none if it isn't precise enough."""
    if not rule:
        return ()
    firsts = [rule[: k + 1] for k in range(len(rule))]
    of = lambda test, name: [F.sum(F.when(test, F.col("bad"))).alias(f"p{name}"), F.sum(F.when(test, 1)).alias(f"n{name}")]
    seen = rows.where(~F.col("grow")).agg(*(c for k, x in enumerate(firsts) for c in of(covers(x, F.col("m")), k))).first()
    scored = [((seen[f"p{k}"] or 0) / (seen[f"n{k}"] or 1), -k, seen[f"p{k}"] or 0) for k in range(len(firsts))]
    precision, k, cover = max(scored)
    return firsts[-k] if precision >= min_precision and cover >= min_cover else ()


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: base counts, ``base_failed``, ``rule`` (the first that covers it) and ``kept``.

    No shuffle.  A null or empty text has no words and fails the base rule; ids
    may be null or repeated (a row each); other columns are not looked at.
    """
    rows = docs.select(F.col(id_col), quality(F.col(text_col)).alias(Q))
    q = F.col(Q)
    rows = rows.withColumn(Q + "rule", verdict(rules, q))
    return rows.select(id_col, *(q["b"][c].alias(c) for c in BASE), base_failed(q).alias("base_failed"), F.col(Q + "rule").alias("rule"), F.col(Q + "rule").isNull().alias("kept"))


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that no rule covers."""
    return docs.where(let(quality(F.col(text_col)), lambda q: verdict(rules, q).isNull()))
