"""Read tensors filled batch by batch against a slow loop; short reads and reads of one operation at sites as others are."""

import pyarrow as pa
from pyspark.sql import functions as F

from strandlake.operators import cells, sites
from strandlake.operators import reads as R
from test_whole_runs import CIGAR, SCHEMA, random_reads

LIST = pa.list_(pa.struct([("op", pa.int32()), ("len", pa.int32())]))


def slow(row, width):
    """What the operations of a read write into its window, one after another; nothing: None."""
    level = lambda x, top: 254 * min(x, top) // top if x is not None else 254
    out, seen, at, off = {c: [0] * width for c in cells.CHANNELS}, set(), row["start"], 0

    def common(pos):
        k = pos - row["lo"]
        seen.add(k)
        ref = row["ref"][k] if k < len(row["ref"]) else ""
        for c, x in zip("ref m s p h".split(), (R.SHADES.get(ref, 0), level(row["mapq"], 60), 240 if row["is_reverse"] else 70, 240 if row["site_start"] <= pos < row["site_stop"] else 70, [0, 120, 240][row["hp"]]), strict=True):
            out[c][k] = x
        return k

    inside = lambda pos: 0 <= pos - row["lo"] < width
    late = []
    for x in row["cigar"]:
        op, size = x["op"], x["len"]
        for i in range(size if op in (0, 2, 7, 8) else 0):
            if inside(at + i):
                k = common(at + i)
                out["base"][k] = 0 if op == 2 else R.SHADES.get(row["seq"][off + i], 0)
                out["q"][k] = level(60 if op == 2 else row["qual"][off + i], 40)
        if op == 1 and size and inside(at - 1):
            late.append((at - 1, min(row["qual"][off : off + size])))
        at, off = at + (size if op in (0, 2, 3, 7, 8) else 0), off + (size if op in (0, 1, 4, 7, 8) else 0)
    for pos, q in late:
        out["q"][pos - row["lo"] if pos - row["lo"] in seen else common(pos)] = level(q, 40)
    return out if seen else None


def test_cells_of_random_reads():
    made, text = random_reads(400, seed=8)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = []
    for k, read in enumerate(made):
        r = dict(zip(names, read, strict=True))
        lo = r["start"] + (k % 60) - 20
        ref = text[lo : lo + 50 - k % 4]  # the reference may end inside a window
        rows.append(r | {"cigar": [{"op": o, "len": n} for o, n in r["cigar"]], "hp": r["tags"].get("HP", 0), "lo": lo, "ref": ref, "site_start": lo + 20, "site_stop": lo + 23 + k % 9})
    kinds = {"seq": pa.string(), "ref": pa.string(), "qual": pa.list_(pa.int16()), "cigar": LIST, "is_reverse": pa.bool_()}
    batch = pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], kinds.get(c, pa.int64())) for c in cells.TAKEN} | {"n": pa.array(range(len(rows)))})
    want = {n: s for n, r in enumerate(rows) if (s := slow(r, 50))}
    for part in (batch, batch.slice(7, 200)):
        found = [r for b in cells.writer(["n"], 50, R.SHADES, sites.DELETED_Q, False)(iter([part])) for r in b.to_pylist()]
        first, last = part.column("n")[0].as_py(), part.column("n")[-1].as_py()
        assert {r["n"]: {c: r[c] for c in cells.CHANNELS} for r in found} == {n: s for n, s in want.items() if first <= n <= last}
        sums = [r for b in cells.writer(["n"], 50, R.SHADES, sites.DELETED_Q, True)(iter([part])) for r in b.to_pylist()]
        assert [{c: sum(r[c]) for c in cells.CHANNELS} for r in found] == [{c: r[c] for c in cells.CHANNELS} for r in sums]


def test_short_and_plain_reads_at_sites(spark, monkeypatch):
    """Lists of sites and of operations, taken for long reads and CIGARs, give what short ones get at once."""
    rows, _ = random_reads(150, seed=3, ops_most=4)
    reads = spark.createDataFrame(rows, SCHEMA).cache()
    places = spark.createDataFrame([("c1", a, a + n) for a, n in [(100, 1), (301, 4), (420, 2), (423, 1), (700, 9), (9_990, 20), (10_050, 3)]], "chrom string, start long, stop long")
    found = sites.site_slices(reads, places)
    padded = reads.withColumn("cigar", F.expr(f"if(element_at(cigar, -1).op = 1, cigar, concat(cigar, cast(array(named_struct('op', 5, 'len', 0)) AS {CIGAR})))"))  # a last insertion has to stay the last
    monkeypatch.setattr(sites, "SHORT", -1)
    want = sites.site_slices(padded, places).collect()
    monkeypatch.undo()
    assert len(want) > 50 and sorted(map(str, found.collect())) == sorted(map(str, want))


def test_features_without_a_row_a_cell(spark, sf):
    from strandlake.plans.registry import QUERIES

    plan = QUERIES["read_features"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "read_offset" not in plan and "map_from_entries" not in plan
