"""Running sums, maxima and last values in the order of a key, without a task that holds all rows of the key.

A scan has two levels.  The rows of a key are cut into cells by an expression
that never falls in the order of the rows (a range of positions, or the number
of a range partition).  Windows run inside a cell; a small table with one row
a cell holds what each cell adds up to, is scanned by key, and is joined back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.shared import written

#: Positions in a cell, where cells are ranges of a chromosome.
CELL = 1 << 20
_P = "__scan_"


@dataclass(frozen=True)
class Scan:
    """One running value: ``kind`` is sum, max or last (nulls don't count); ``own``: with the row itself."""

    kind: str
    value: Column
    own: bool = True


def total(value: Column | int = 1, own: bool = True) -> Scan:
    return Scan("sum", F.lit(value) if isinstance(value, int) else value, own)


def highest(value: Column, own: bool = True) -> Scan:
    return Scan("max", value, own)


def latest(value: Column, own: bool = True) -> Scan:
    return Scan("last", value, own)


def range_cell(pos: Column, width: int = CELL) -> Column:
    return F.floor(pos / width)


def scanned(rows: DataFrame, by: list[str], order: list[str | Column], cell: Column, stored: bool = False, **scans: Scan) -> DataFrame:
    """Adds a column for each scan.  ``cell`` must not fall in ``order`` inside a key.

    A sum of nothing is 0; a maximum or a last value of nothing is null.  Null
    keys are a key of their own.  Columns that begin with ``__scan_`` are used
    inside.

    Rows are looked at twice, so they are written to the shared folder first,
    and a chain of scans does its work once; ``stored`` says that they come
    from a written table already.
    """
    rows = rows.withColumns({_P + "cell": cell} | {f"{_P}v_{k}": s.value for k, s in scans.items()})
    rows = rows if stored else written(rows, "scan")
    inner = W.partitionBy(*by, _P + "cell").orderBy(*order)
    step = F.struct(*(F.col(c) if isinstance(c, str) else c for c in order))
    whole, seen = {}, {}
    for k, s in scans.items():
        c, over = F.col(f"{_P}v_{k}"), inner.rowsBetween(W.unboundedPreceding, 0 if s.own else -1)
        if s.kind == "sum":
            whole[k], seen[k] = F.sum(c), F.sum(c).over(over)
        elif s.kind == "max":
            whole[k], seen[k] = F.max(c), F.max(c).over(over)
        else:
            whole[k], seen[k] = F.max_by(c, F.when(c.isNotNull(), step)), F.last(c, ignorenulls=True).over(over)
    cells = rows.groupBy(*by, _P + "cell").agg(*(whole[k].alias(k) for k in scans))
    before = W.partitionBy(*by).orderBy(_P + "cell").rowsBetween(W.unboundedPreceding, -1)
    carried = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    cells = cells.select(*(F.col(c).alias(f"{_P}by_{c}") for c in by), F.col(_P + "cell").alias(_P + "at"), *(carried[s.kind](k).over(before).alias(f"{_P}c_{k}") for k, s in scans.items()))
    rows = rows.withColumns({f"{_P}i_{k}": seen[k] for k in scans})
    on = F.col(_P + "cell").eqNullSafe(F.col(_P + "at"))
    for c in by:
        on = F.col(c).eqNullSafe(F.col(f"{_P}by_{c}")) & on
    out = {}
    for k, s in scans.items():
        own, carry = F.col(f"{_P}i_{k}"), F.col(f"{_P}c_{k}")
        out[k] = {"sum": F.coalesce(own, F.lit(0)) + F.coalesce(carry, F.lit(0)), "max": F.greatest(own, carry), "last": F.coalesce(own, carry)}[s.kind]
    joined = rows.join(cells, on).withColumns(out)
    return joined.drop(*(c for c in joined.columns if c.startswith(_P)))


def in_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """Rows written in range partitions of ``order``; ``__part`` numbers these, and is a cell for scans in that order."""
    return written(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")


def numbered(rows: DataFrame, *order: str, by: tuple[str, ...] = (), out: str = "ordinal") -> DataFrame:
    """Rows with their number (from 0) in the order of ``by`` and ``order``, counted anew for each value of ``by``; in ranges, at any size."""
    ranged = in_ranges(rows, *by, *order)
    return scanned(ranged, [*by], [*order], F.col("__part"), stored=True, **{out: total(own=False)}).drop("__part")
