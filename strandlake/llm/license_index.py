"""License scans with a positional rare-token index (operator 12, DataFrame functions only).

The templates' words are weighted by their document frequency over the whole
table, and only the rarest words of each template are indexed, with their
positions.  A document's highest-weighted licence words are looked up; a word
at ``at`` that stands at ``offset`` in a template votes for a start at
``at - offset``.  Votes for the same start, or one a few words beside it, are
put together: they must carry most of the template's indexed weight, and its
mandatory phrases must stand at their places.

A text is split into words twice: once to count document frequencies, once to
find the places of indexed words and phrases.  Everything after that works on
these places; texts are neither written nor shuffled.
"""

from __future__ import annotations

import itertools
import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import written
from strandlake.llm.decision_rules import let

#: What lies between words of a lower-cased text.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases of the base scan and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    """A licence text or notice, and phrases of it that must be there at their places."""

    label: str
    text: str
    phrases: tuple[str, ...]


# Public licence notices and key paragraphs of public licence texts.
TEMPLATES = (
    Template("mit", "Released under the MIT License.", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("permission to use copy modify", "is hereby granted")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    Template("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", ("unless required by applicable law",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("endorse or promote products",)),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license", "version 3")),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("free software", "gnu general public license")),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc by nc",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0.", ("cc by sa",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ("waived all copyright",)),
)


def plain_words(text: str) -> list[str]:
    """The words of a licence text, which is ASCII."""
    return [w for w in re.split(GAP, text.lower()) if w]


def text_words(text: Column) -> Column:
    """The words of a text after lower-casing A-Z; none of a null text.

    ``lower`` also changes letters outside of ASCII.  That only matters for the
    two that would become ASCII letters, so these are replaced before.
    """
    text = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı"))
    return F.array_remove(F.split(F.lower(text), GAP), "")


def document_frequency(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each template word.

    At most one row a template word comes to the driver.
    """
    vocabulary = sorted({w for t in templates for w in plain_words(t.text)})
    held = F.array_intersect(text_words(F.col(text_col)), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("word")).groupBy("word").count().collect()
    counts = {r["word"]: r["count"] for r in rows}
    return counts.pop("", 0), counts


@dataclass(frozen=True)
class Index:
    """Weights of the indexed words; postings (key, kind, template, offset); total weight, words and anchors of each template."""

    weight: dict[str, float]
    postings: tuple[tuple[str, int, int, int], ...]
    whole: tuple[float, ...]
    words: tuple[tuple[str, ...], ...]
    anchors: tuple[tuple[str, ...], ...]
    templates: tuple[Template, ...]

    def phrases(self) -> list[str]:
        return sorted({p for t in self.templates for p in t.phrases})


def build_index(n_docs: int, frequency: dict[str, int], templates: tuple[Template, ...] = TEMPLATES, rare: int = 12, least: float = 0.7) -> Index:
    """Indexes the ``rare`` words of highest inverse document frequency of each template, at all their places.

    Its anchors are the rarest of them without which a text can't reach the
    share ``least`` of their weight: a text without an anchor need not be
    looked at for this template.
    """
    weight, postings, whole, words_of, anchors = {}, [], [], [], []
    idf = lambda w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) + 1
    for k, t in enumerate(templates):
        words = plain_words(t.text)
        kept = sorted(set(words), key=lambda w: (-idf(w), w))[:rare]
        weight |= {w: idf(w) for w in kept}
        whole.append(sum(map(idf, kept)))
        upto = list(itertools.accumulate(map(idf, kept)))
        words_of.append(tuple(kept))
        anchors.append(tuple(kept[: 1 + sum(x <= (1 - least) * whole[-1] + 1e-9 for x in upto)]))
        postings += [(w, 0, k, at) for at, w in enumerate(words) if w in kept]
        for p in t.phrases:
            own = p.split()
            starts = [at for at in range(len(words)) if words[at : at + len(own)] == own]
            if not starts:
                raise ValueError(f"template {t.label} does not hold its phrase {p!r}")
            postings += [(p, 1, k, at) for at in starts]
    return Index(weight, tuple(postings), tuple(whole), tuple(words_of), tuple(anchors), templates)


def _found(words: Column, index: Index, per_file: int) -> Column:
    """Struct of n, places of base phrases, templates to look at, and places of phrases and indexed words for these."""
    phrases = [*BASE, *(p for p in index.phrases() if p not in BASE)]
    ranked = sorted(index.weight, key=lambda w: (-index.weight[w], w))
    spots = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(*ranked, *{p.split()[0] for p in phrases}))
    spots = F.when(F.size(words) > 0, spots).otherwise(F.array().cast("array<int>"))

    def stands(phrase: str, s: Column) -> Column:
        same = lambda i: reduce(lambda a, b: a & b, (F.coalesce(F.get(words, i + k) == w, F.lit(False)) for k, w in enumerate(phrase.split())))
        return F.transform(F.filter(s, same), lambda i: F.struct(i.alias("at"), F.lit(phrase).alias("key"), F.lit(1).alias("kind")))

    number = lambda w: F.array_position(F.array(*map(F.lit, ranked)), w).cast("int")
    lists = lambda of: F.array(*(F.array(*(F.lit(ranked.index(w) + 1) for w in words)) for words in of))

    def looked_up(hits: Column) -> Column:
        """The file's rarest words by number, the templates with an anchor among them, and the hits on words of these."""
        numbered = F.transform(hits, lambda x: F.struct(x["at"], number(x["key"]).alias("number")))
        own = lambda h: F.slice(F.array_sort(F.array_distinct(F.transform(h, lambda x: x["number"]))), 1, per_file)
        live = lambda o: F.filter(F.sequence(F.lit(0), F.lit(len(index.templates) - 1)), lambda k: F.arrays_overlap(F.get(lists(index.anchors), k), o))
        wanted = lambda o, k: F.array_intersect(o, F.flatten(F.transform(k, lambda t: F.get(lists(index.words), t))))
        mark = lambda x: F.struct(x["at"].alias("at"), F.get(F.array(*map(F.lit, ranked)), x["number"] - 1).alias("key"), F.lit(0).alias("kind"))
        kept = lambda h, w: F.transform(F.filter(h, lambda x: F.array_contains(w, x["number"])), mark)
        found = let(numbered, lambda h: let(own(h), lambda o: let(live(o), lambda k: F.struct(k.alias("live"), let(wanted(o, k), lambda w: kept(h, w)).alias("marks")))))
        none = F.struct(F.array().cast("array<int>").alias("live"), F.slice(hits, 1, 0).alias("marks"))
        return F.when(F.size(hits) > 0, found).otherwise(none)

    def gathered(s: Column) -> Column:
        hits = F.transform(F.filter(s, lambda i: F.get(words, i).isin(*ranked)), lambda i: F.struct(i.alias("at"), F.get(words, i).alias("key"), F.lit(0).alias("kind")))
        base = F.concat(*(stands(p, s) for p in BASE))
        places = F.concat(*(stands(p, s) for p in index.phrases()))
        return let(let(hits, looked_up), lambda x: F.struct(F.size(words).alias("n"), base.alias("base"), x["live"].alias("live"), F.when(F.size(x["live"]) > 0, F.concat(places, x["marks"])).otherwise(x["marks"]).alias("marks")))

    return let(spots, gathered)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, rare: int = 12, per_file: int = 48, least: float = 0.7, slack: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document (id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    The base columns tell where the phrases of ``BASE`` stand (all places, the
    smallest and the largest start).  ``labels`` adds those of templates of
    which the document holds, in a window of ``2 * slack`` possible starts, at
    least the share ``least`` of the indexed weight and all mandatory phrases;
    ``score`` is the largest such share, or 0.  ``per_file`` bounds the
    different licence words that are looked up for a document (the rarest
    ones), not their places.

    A null or empty text has no words: counts of 0, no places, empty labels.
    Ids may be null or repeated: a row each.  Other columns are not looked at;
    an empty table gives no rows.
    """
    index = build_index(*document_frequency(docs, templates, text_col), templates, rare, least)
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), let(text_words(F.col(text_col)), lambda w: _found(w, index, per_file)).alias("f"))
    found = written(found, "license-places")
    posting = lambda p: F.struct(F.lit(p[0]).alias("key"), F.lit(p[1]).alias("kind"), F.lit(p[2]).alias("template"), F.lit(p[3]).alias("offset"), F.lit(index.weight.get(p[0], 0.0) if p[1] == 0 else 0.0).alias("weight"))
    postings = found.sparkSession.range(1).select(F.inline(F.array(*map(posting, index.postings))))
    facts = found.sparkSession.range(1).select(F.inline(F.array(*(F.struct(F.lit(k).alias("template"), F.lit(t.label).alias("label"), F.lit(index.whole[k]).alias("whole"), F.lit(len(set(t.phrases))).alias("needed")) for k, t in enumerate(templates)))))
    # Bounded by the templates: both are broadcast.
    votes = found.select("row", "f.live", F.inline("f.marks")).join(F.broadcast(postings), ["key", "kind"]).where(F.array_contains("live", F.col("template")))
    cell = F.floor((F.col("at") - F.col("offset")) / slack)
    votes = votes.select("row", "template", "key", "kind", "weight", F.explode(F.array(cell - 1, cell)).alias("window")).distinct()
    met = votes.groupBy("row", "template", "window").agg(F.sum("weight").alias("have"), F.sum("kind").alias("phrases")).join(F.broadcast(facts), "template")
    share = F.least(F.col("have") / F.col("whole"), F.lit(1.0))
    met = met.where((share >= least) & (F.col("phrases") == F.col("needed"))).groupBy("row").agg(F.collect_set("label").alias("found"), F.max(share).alias("share"))
    base = F.array_distinct(F.transform("f.base", lambda x: reduce(lambda c, p: c.when(x["key"] == p, BASE[p]), BASE, F)))
    at = F.transform("f.base", lambda x: x["at"])
    rows = found.join(met, "row", "left").withColumn("base", base)
    every = F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>"))))
    text = lambda labels: F.array_join(F.array_sort(labels), ",")
    return rows.select(
        F.col("id").alias(id_col), F.col("f.n").cast("long").alias("n_words"), F.size("f.base").cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"), text(F.col("base")).alias("base_labels"), text(every).alias("labels"), F.coalesce("share", F.lit(0.0)).alias("score"),
    )
