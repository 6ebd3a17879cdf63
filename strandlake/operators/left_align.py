"""Left alignment of reads: their own CIGARs are rewritten, so that every indel stands as far to the left as it goes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.reads import BOTH, READ_ONLY, REF_ONLY
from strandlake.operators.variants import reference_slice

_OPS = "array<struct<op:int,len:int>>"
#: Steps that are tried first; only an indel that passes all of them is tried further.
FIRST = 64


def _moved(a: str, x: str) -> str:
    """Offsets into the reference text and the read after an operation."""
    return f"'r', {a}.r + if({x}.op IN {BOTH} OR {x}.op IN {REF_ONLY}, {x}.len, 0), 'q', {a}.q + if({x}.op IN {BOTH} OR {x}.op IN {READ_ONLY}, {x}.len, 0)"


def _pushed(ops: str, op: str, n: str) -> str:
    """Operations with one more, put together with the last if it is of the same kind."""
    last = f"element_at({ops}, -1)"
    return f"""CASE WHEN {n} = 0 THEN {ops} WHEN size({ops}) > 0 AND get({ops}, size({ops}) - 1).op = {op} THEN concat(slice({ops}, 1, size({ops}) - 1), array(named_struct('op', {op}, 'len', {last}.len + {n})))
        ELSE concat({ops}, array(named_struct('op', {op}, 'len', {n}))) END"""


def left_align(reads: DataFrame, reference: DataFrame, clip: bool = True) -> DataFrame:
    """The reads with rewritten ``cigar`` and ``start``; all other columns stay.

    An indel moves one base to the left while the base before it is an actual
    match and stays one on its other side; so the number of mismatches and the
    length of the read never change.  Indels that meet are put together, an
    insertion and a deletion of one length that match each other become
    aligned bases, leading deletions are taken off, and with ``clip`` a leading
    insertion becomes a soft clip.

    Both steps are folds over the operations of a read inside its row; the
    reference text under the read is fetched once.
    """
    text = reference_slice(reads, reference, "start", "end", "__text", any_length=True)
    rows = text.withColumns({"__ref": F.col("__text").cast("binary"), "__seq": F.col("seq").cast("binary")})
    base = lambda column, at: f"substring({column}, {at} + 1, 1)"
    stays = f"""(l.op = 7 OR {base('__seq', 'a.q - t')} = {base('__ref', 'a.r - t')})
        AND if(x.op = 2, {base('__ref', 'a.r - t')} = {base('__ref', 'a.r - t + x.len')}, {base('__seq', 'a.q - t')} = {base('__seq', 'a.q - t + x.len')})"""
    stop = lambda lo, hi: f"array_min(filter(sequence({lo}, {hi}), t -> NOT ({stays})))"
    steps = f"coalesce({stop('1', f'least(l.len, {FIRST})')}, if(l.len > {FIRST}, {stop(f'{FIRST} + 1', f'greatest(l.len, {FIRST} + 1)')}, NULL), l.len + 1) - 1"
    some = lambda op, n: f"if({n} > 0, array(named_struct('op', {op}, 'len', {n})), cast(array() AS {_OPS}))"
    shifted = f"concat(slice(a.o, 1, size(a.o) - 1), {some('l.op', 'l.len - s')}, array(named_struct('op', x.op, 'len', x.len)), {some('l.op', 's')})"
    shift = f"get(transform(array(element_at(a.o, -1)), l -> get(transform(array({steps}), s -> {shifted}), 0)), 0)"
    can = "x.op IN (1, 2) AND x.len > 0 AND size(a.o) > 0 AND get(a.o, size(a.o) - 1).op IN (0, 7)"
    empty = f"named_struct('o', cast(array() AS {_OPS}), 'r', 0, 'q', 0)"
    moved = f"aggregate(cigar, {empty}, (a, x) -> named_struct('o', CASE WHEN {can} THEN {shift} ELSE {_pushed('a.o', 'x.op', 'x.len')} END, {_moved('a', 'x')}), a -> a.o)"
    rows = rows.withColumn("__ops", F.expr(moved))
    # A pair of one length that matches: its read bases against its reference bases.
    pair = """size(a.o) > 0 AND x.op IN (1, 2) AND get(a.o, size(a.o) - 1).op = 3 - x.op AND get(a.o, size(a.o) - 1).len = x.len
        AND if(x.op = 2, substring(__seq, a.q - x.len + 1, x.len) = substring(__ref, a.r + 1, x.len), substring(__seq, a.q + 1, x.len) = substring(__ref, a.r - x.len + 1, x.len))"""
    without = "slice(a.o, 1, size(a.o) - 1)"
    joined = f"aggregate(__ops, {empty}, (a, x) -> named_struct('o', CASE WHEN {pair} THEN get(transform(array({without}), b -> {_pushed('b', '0', 'x.len')}), 0) ELSE {_pushed('a.o', 'x.op', 'x.len')} END, {_moved('a', 'x')}), a -> a.o)"
    rows = rows.withColumn("__ops", F.expr(joined))
    # Leading deletions: those with nothing but deletions before them.
    rows = rows.withColumn("__skip", F.expr("aggregate(__ops, named_struct('n', 0, 'len', 0, 'open', true), (a, x) -> if(a.open AND x.op = 2, named_struct('n', a.n + 1, 'len', a.len + x.len, 'open', true), named_struct('n', a.n, 'len', a.len, 'open', false)))"))
    rows = rows.withColumn("__ops", F.expr("slice(__ops, __skip.n + 1, size(__ops))"))
    if clip:
        rows = rows.withColumn("__ops", F.expr("transform(__ops, (x, i) -> named_struct('op', if(i = 0 AND x.op = 1, 4, x.op), 'len', x.len))"))
    kind = reads.schema["start"].dataType.simpleString()
    known = F.col("cigar").isNotNull() & F.col("__text").isNotNull()
    rows = rows.withColumn("start", F.when(known, F.expr(f"cast(start + __skip.len AS {kind})")).otherwise(F.col("start"))).withColumn("cigar", F.when(known, F.col("__ops")).otherwise(F.col("cigar")))
    return rows.select(*reads.columns)
