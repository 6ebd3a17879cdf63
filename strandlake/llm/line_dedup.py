"""Line dedup by an exact set-similarity join (operator 9, DataFrame functions only).

The words of a line are a set.  Words are ordered by rarity (rarest first); two
sets of Jaccard 0.8 or more share at least ceil(0.8 n) words, so their first
shared word is among the first n - ceil(0.8 n) + 1 words of both, and their
second one among one word more.  Lines meet on their first shared word; where
that word is frequent, on it together with the second, so that no frequent word
makes a large group.  Where groups may be large, a meeting is left out if the
word before is shared as well, since the lines have met there: near copies meet
once for each run of shared words and not at every word.  Length, position and
parity filters drop pairs that cannot reach the bound, and what is left is
verified on the words.  A line is removed if a line before it (by document id,
then line number) is similar.

Rarity is counted over all documents in a table of 2**18 word classes, of fixed
size; ties are ordered by hash.  Any total order gives whole results; rarity
only makes the groups small.  Equal sets are one entry from the start, so a
line that a third of all rows repeat costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strandlake.llm.common import WORD_GAP, written
from strandlake.operators.scans import scanned, total

CLASSES = 1 << 18
#: Words are ordered by keys: bits of the count of their class, then 57 bits of hash.
HASH_BITS = 57
#: A word is frequent if its class has this count, and this share of all words (so that there are not too many of them).
FREQUENT, FREQUENT_SHARE = 4096, 1 << 16
#: Words of counts within this many bits of a frequent one's may make large groups: they carry the word before them.
CROWDED_BITS = 2
#: Sets of more words than this have parities of 128 bits, others of 64.
WIDE_FROM = 72
#: Spark setting: keys (a power of two) that the first map of an aggregation takes; all word classes fit, so that hardly any word is looked up in two maps.
FIRST_MAP, FIRST_MAP_BITS = "spark.sql.codegen.aggregate.fastHashMap.capacityBit", "20"
#: Bits of the sieve for lines to verify.
SIEVE = 1 << 22
PLACE = ["id", "line_no"]

#: Similar sets differ in at most a ninth of their words together; lengths are within 4/5; the first line comes before the second.
ALIKE = f"9 * if(least(n_a, n_b) > {WIDE_FROM}, bit_count(even_a ^ even_b) + bit_count(odd_a ^ odd_b), bit_count(even_a ^ odd_a ^ even_b ^ odd_b)) <= n_a + n_b"
BEFORE = "(id_a < id_b OR (id_a = id_b AND line_no_a < line_no_b))"
CLOSE = f"{ALIKE} AND 5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b) AND {BEFORE}"


def split_words(text: Column, odd: Column) -> Column:
    """Words of a text without line ends, and empty strings; ``odd`` tells whether it may hold other gaps than the space (then the slower pattern is used)."""
    return F.when(odd, F.split(text, WORD_GAP)).otherwise(F.split(text, " "))


def odd_gaps(text: Column) -> Column:
    return F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\v")) | F.contains(text, F.lit("\f"))


def split_lines(rows: DataFrame) -> DataFrame:
    return rows.withColumn("odd_text", odd_gaps(F.col("text"))).select("id", "odd_text", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def word_class(h: Column) -> Column:
    return h.bitwiseAND(CLASSES - 1).cast("int")


def rarity(rows: DataFrame) -> tuple[Column, int]:
    """Bits of the corpus count of every word class, as a constant array, and the bits from which a word is frequent.

    The driver gets the bits of 2**18 classes at most, as 64 strings.
    """
    words = split_lines(rows).select(F.explode(split_words(F.col("line"), F.col("odd_text"))).alias("w")).where("w <> ''").select(F.xxhash64("w").alias("h"))
    counts = words.groupBy(word_class(F.col("h")).alias("c")).count()
    lists = counts.groupBy(F.col("c").bitwiseAND(63).alias("part")).agg(
        F.array_join(F.collect_list(F.concat_ws(":", F.col("c").cast("string"), F.length(F.bin("count")).cast("string"))), " ").alias("of"), F.sum("count").alias("words")
    )
    conf = rows.sparkSession.conf
    before = conf.get(FIRST_MAP, None)
    conf.set(FIRST_MAP, FIRST_MAP_BITS)
    try:
        lists = lists.collect()
    finally:
        conf.unset(FIRST_MAP) if before is None else conf.set(FIRST_MAP, before)
    bits, total = [0] * CLASSES, 0
    for row in lists:
        total += row["words"]
        for pair in row["of"].split():
            c, n = pair.split(":")
            bits[int(c)] = int(n)
    return F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>"), max(FREQUENT, total // FREQUENT_SHARE).bit_length()


def fold(words: str, bit: str) -> Column:
    """XOR over all words of one bit each (an SQL expression of the word x): sets differ in at least as many words as folds in bits."""
    return F.expr(f"aggregate({words}, 0L, (a, x) -> a ^ ({bit}))")


def line_sets(rows: DataFrame, bits: Column) -> DataFrame:
    """Every line: size of its word set, parities, two min-hashes, a hash of the set, and its first words by rarity."""
    hashes = F.array_distinct(F.array_remove(F.transform(split_words(F.col("line"), F.col("odd_text")), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))
    lines = split_lines(rows).select(*PLACE, hashes.alias("h"))
    # Never null, so that arrays of keys are sorted as plain longs.
    key = lambda h: F.shiftleft(F.coalesce(F.get(bits, word_class(h)), F.lit(0).cast("long")), HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - HASH_BITS))
    lines = lines.select(*PLACE, F.size("h").alias("n"), F.array_min("h").alias("near_1"), F.array_max("h").alias("near_2"), F.sort_array(F.transform("h", key)).alias("w"))
    # Words with an odd bit 6 have their parity apart; short sets have all in one.
    odd = F.when(F.col("n") > WIDE_FROM, fold("w", "shiftleft(shiftright(x, 6) & 1, cast(x & 63 AS int))")).otherwise(F.lit(0).cast("long"))
    lines = lines.select("*", fold("w", "shiftleft(1L, cast(x & 63 AS int))").alias("every"), odd.alias("odd"))
    prefix = F.expr("slice(w, 1, n - cast(ceil(n * 4 / 5) AS int) + 2)")  # one more than the prefix
    return lines.select(*PLACE, "n", "near_1", "near_2", F.xxhash64("w").alias("s"), F.expr("every ^ odd").alias("even"), "odd", prefix.alias("prefix"))


def sides(rows: DataFrame, on: list[str], columns: list[str]) -> list[DataFrame]:
    return [rows.select(*on, *(F.col(c).alias(f"{c}_{side}") for c in columns)) for side in "ab"]


PAIR = ["id_a", "line_no_a", "id_b", "line_no_b"]
FILTERED = [*PLACE, "n", "even", "odd"]


def entries(lines: DataFrame, frequent: int) -> DataFrame:
    """A row for each key on which a line meets others.

    A word is a key by itself, or if it is frequent its pairs with the words
    after it.  ``room`` is 9 times what can be shared if no word before is,
    nor any between the two of a pair.
    ``prev`` is the word before the key's word (before the second of a pair
    unless they are neighbours) where groups may be large, else 0.
    """
    words = "slice(prefix, 1, size(prefix) - 1)"
    pairs = f"""flatten(transform({words}, (w, i) -> if(shiftrightunsigned(w, {HASH_BITS}) < {frequent},
        array(struct(i AS at, w AS k, get(prefix, i - 1) AS prev)),
        transform(slice(prefix, i + 2, size(prefix)), (x, j) -> struct(i + j AS at, xxhash64(w, x) AS k, get(prefix, if(j = 0, i - 1, i + j)) AS prev)))))"""
    # Words are in the order of their counts: the last one tells whether any is frequent; few lines have such a word.
    lines = lines.withColumn("pairs", F.expr(f"if(shiftrightunsigned(get(prefix, size(prefix) - 2), {HASH_BITS}) < {frequent}, NULL, {pairs})"))
    rows = lines.select(*FILTERED, "open", "prefix", "pairs", F.posexplode(F.expr(f"if(pairs IS NULL, {words}, pairs.k)")).alias("pos", "k"))
    rows = rows.withColumn("at", F.expr("if(pairs IS NULL, pos, get(pairs, pos).at)"))
    prev = f"""if(shiftrightunsigned(get(prefix, at), {HASH_BITS}) < {frequent - CROWDED_BITS}, 0L,
        coalesce(if(pairs IS NULL, get(prefix, pos - 1), get(pairs, pos).prev), 0L))"""
    rows = rows.select(*FILTERED, "open", F.expr("9 * (n - at)").alias("room"), F.expr(prev).alias("prev"), "k")
    # None is null; as columns that cannot be, they are tested faster.
    return rows.select(*(F.coalesce(c, F.lit(0).cast(kind)).alias(c) for c, kind in rows.dtypes))


def met(entry: DataFrame) -> DataFrame:
    """Pairs of lines that may be similar, earlier one first, as often as they meet."""
    a, b = sides(entry.repartition("k"), ["k"], [*FILTERED, "open", "room", "prev"])
    # The first is the shorter one, so from its first shared word on 8/9 of it are left: that leaves half of its entries.  They are
    # picked out behind the shuffle, by a test that is not moved before it (rand is under 1), so that one shuffle serves both sides.
    a = a.where("rand(0) < if(room_a >= 8 * n_a, 1, 0)")
    # What is cheap to test comes first.  Lines like their head are only the earlier of a pair.
    met = b.join(a, "k").where(F.expr(f"""room_a >= 4 * (n_a + n_b) AND n_a <= n_b AND room_b >= 4 * (n_a + n_b) AND {ALIKE}
        AND (n_a < n_b OR {BEFORE}) AND if({BEFORE}, open_b, open_a) = 1 AND (prev_a <> prev_b OR prev_a = 0)"""))
    return met.withColumn("ahead", F.expr(BEFORE)).select(*(F.expr(f"if(ahead, {c}_{x}, {c}_{y})").alias(f"{c}_{x}") for x, y in ("ab", "ba") for c in PLACE))


def placed(least: int | None, most: int | None, far: int | None) -> Column:
    """One number in the order of (id, line_no), long if ids leave room: its least value is found by hashing, that of a struct by sorting.

    Ids are from ``least`` to ``most``, line numbers up to ``far``.
    """
    shift = (far or 0).bit_length()
    if least is None or -1 << 62 - shift <= least <= most < 1 << 62 - shift:
        return F.expr(f"cast(id AS long) * {1 << shift}L + line_no")
    return F.expr("cast(id AS decimal(38, 0)) * 2147483648 + line_no")


def similar_lines(rows: DataFrame) -> DataFrame:
    """(id, line_no) of every line that is similar to one before it."""
    bits, frequent = rarity(rows)
    seen = Observation()
    lines = line_sets(rows, bits).observe(seen, F.min("id").alias("least"), F.max("id").alias("most"), F.max("line_no").alias("far"))
    lines = written(lines, "line-sets").where("n > 0")
    place = placed(*(seen.get.get(x) for x in ("least", "most", "far")))
    # A hash of the set and its least word hash tell sets apart.  One shuffle serves both sides; of it only a few numbers a row are kept:
    # hashing them saves sorting all lines.  (None is null; without that test the join's side would be another shuffle.)
    same = ["s", "near_1"]
    dealt = lines.select(*PLACE, *same).where("s IS NOT NULL AND near_1 IS NOT NULL").repartition(*same)
    repeated = dealt.groupBy(*same).agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    later = written(dealt.join(repeated.hint("shuffle_hash"), same).where(place > F.col("first")).select(*PLACE), "repeated-lines")

    # Most members of a large group of alike lines are similar to its first one: these need no other partner.
    keyed = lines.join(later.hint("shuffle_hash"), PLACE, "left_anti").select(*FILTERED, F.explode(F.array("near_1", "near_2")).alias("k"))
    heads = keyed.groupBy("k").agg(F.min(F.struct(*FILTERED)).alias("h"), F.count("*").alias("times")).where("times > 1")
    heads = heads.select("k", *(F.col(f"h.{c}").alias(f"{c}_a") for c in FILTERED))
    to_head = heads.join(sides(keyed, ["k"], FILTERED)[1], "k").where(CLOSE).select(*PAIR).distinct()
    like_head = written(verified(rows, written(to_head, "head-pairs")), "lines-like-heads")

    # All others are held against every line before them with which they share a prefix word.
    closed = like_head.select(F.col("id_b").alias("id"), F.col("line_no_b").alias("line_no"), F.lit(0).alias("open"))
    entry = lines.join(later.hint("shuffle_hash"), PLACE, "left_anti").join(closed, PLACE, "left").where("n > 3").select(*FILTERED, F.coalesce("open", F.lit(1)).alias("open"), "prefix")
    pairs = met(entries(entry, frequent)).distinct()
    near = verified(rows, written(pairs, "line-pairs")).unionByName(like_head)
    # No line is in two of the three: lines like heads are closed, and repeated ones take no part in pairs.
    return later.unionByName(near.withColumnsRenamed({"id_b": "id", "line_no_b": "line_no"}))


def sieve(places: DataFrame, of: list[str]) -> Column:
    """A test whether some columns may be those of a row among some: one bit for each of 2**22 hash values, a constant of 512 KB.

    It lets all of them pass, and of others as many as the share of bits that are set.
    """
    slot = F.xxhash64(*of).bitwiseAND(SIEVE - 1)
    words = places.select(F.shiftright(slot, 6).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int")).alias("bit"))
    bits = [0] * (SIEVE // 64)
    for row in words.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():  # 2**16 at most
        bits[row["at"]] = row["bits"]
    table = F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")
    return F.call_function("getbit", F.get(table, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(63).cast("int")) == 1


def verified(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_b, line_no_b) of the pairs whose word sets have a Jaccard similarity of 0.8 or more.

    The words of their lines are fetched once, by a join with the lines that
    pass the sieve; so as long as few lines are asked for, few texts are split
    and move.
    """
    asked = [pairs.select(*(F.col(f"{c}_{side}").alias(c) for c in PLACE)) for side in "ab"]
    asked = written(asked[0].unionByName(asked[1]).distinct(), "lines-to-verify")
    lines = split_lines(rows.where(sieve(asked, ["id"]))).where(sieve(asked, PLACE)).join(asked, PLACE, "left_semi")
    words = written(lines.select(*PLACE, F.array_distinct(F.array_remove(split_words(F.col("line"), F.col("odd_text")), "")).alias("words")), "words-to-verify")
    a, b = sides(words, [], [*PLACE, "words"])
    both = pairs.join(a, ["id_a", "line_no_a"]).join(b, ["id_b", "line_no_b"])
    shared = F.size(F.array_intersect("words_a", "words_b"))
    return both.where(9 * shared >= 4 * (F.size("words_a") + F.size("words_b"))).select("id_b", "line_no_b").distinct()


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, row): ``id`` tells every row apart and keeps the order of ids; ``row`` holds the other columns.

    Where no id is repeated that is the id itself.  Else rows are numbered in
    the order of id and a hash of the text, in ranges of one written table.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("row"))
    repeated = docs.select(F.col(id_col).alias("id")).where("id IS NOT NULL").groupBy("id").count().where("count > 1")
    if repeated.isEmpty():
        return rows
    rows = rows.withColumns({"tie": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
    rows = written(rows.repartitionByRange("id", "tie", "at").withColumn("part", F.spark_partition_id()), "keyed-rows")
    numbers = scanned(rows.where("id IS NOT NULL").select("part", "id", "tie", "at"), [], ["id", "tie", "at"], F.col("part"), stored=True, number=total())
    rows = rows.join(numbers.select("part", "at", "number"), ["part", "at"], "left")
    return written(rows.select(F.when(F.col("id").isNotNull(), F.col("number")).alias("id"), "text", "row"), "numbered-rows")


def removed_lines(rows: DataFrame) -> DataFrame:
    """(id, removed): by row the ascending numbers (from 0) of its removed lines."""
    rows = rows.select("id", "text").where("id IS NOT NULL AND text IS NOT NULL")
    return similar_lines(rows).groupBy("id").agg(F.sort_array(F.collect_list("line_no")).alias("removed"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: lines, removed lines, and the removed numbers joined by commas ('' if none).

    Words are runs of anything but the space and characters 9-13, compared
    exactly; lines without a word stay.  Ids are integers.  Null texts have no lines; rows without
    an id take no part and lose nothing; rows that share an id are documents
    of their own, one after another; other columns are not looked at.
    """
    docs = docs.select(F.col(id_col), F.col(text_col))
    rows = keyed_rows(docs, id_col, text_col)
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1)
    rows = rows.select("id", F.col(f"row.`{id_col}`").alias("own"), lines.alias("n_lines")).join(removed_lines(rows), "id", "left")
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.select(F.col("own").alias(id_col), F.col("n_lines").cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"), F.array_join(gone.cast("array<string>"), ",").alias("removed_lines"))


def without_similar_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with all their columns, whatever their names, and texts without their removed lines."""
    rows = keyed_rows(docs, id_col, text_col)
    rows = rows.join(removed_lines(rows), "id", "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept)
    return rows.select(*(text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
