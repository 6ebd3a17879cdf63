"""SQL twins of the derived tables, for any engine that reads the driver's tables."""

from __future__ import annotations

CODE = "((({p}) * 7 + (({p}) * ({p})) % 101 + cn * 13) % 4)"


def code(pos: str) -> str:
    return CODE.format(p=pos)


def letter(expr: str) -> str:
    return f"substr('ACGT', CAST({expr} AS INT) + 1, 1)"


_CTES = {
    "g": "SELECT count(*) // 3 AS g FROM lineitem",
    "r0": """SELECT 1 + l_orderkey % 5 AS cn, l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, l_orderkey || '-' || l_linenumber AS read_name,
        (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % ((SELECT g FROM g) - 80) + 20 AS start,
        CASE WHEN l_linestatus = 'F' THEN 'P' ELSE 'I' END AS tech, l_returnflag = 'R' AS is_reverse,
        CAST(round(l_discount * 100) AS BIGINT) * 6 AS mapq, CAST(l_quantity AS BIGINT) AS q0 FROM lineitem""",
    "r1": "SELECT *, start + 5 + (((200 - (start + 5)) % 389) + 389) % 389 AS d FROM r0",
    "reads": """SELECT 'c' || cn AS chrom, *, CASE WHEN ok % 3 = 0 AND d <= start + 34 THEN d - start END AS m,
        start + 40 + CASE WHEN ok % 3 = 0 AND d <= start + 34 THEN 2 ELSE 0 END AS "end",
        CAST(1 + CASE WHEN sk % 10 <> 0 THEN 2 ELSE 0 END + CASE WHEN is_reverse THEN 16 ELSE 0 END + CASE WHEN sk % 29 = 0 THEN 256 ELSE 0 END + CASE WHEN pk % 37 = 0 THEN 1024 ELSE 0 END AS BIGINT) AS flag,
        CASE WHEN pk % 4 = 0 THEN 1 + pk % 2 ELSE 0 END AS hp FROM r1""",
    "usable": "SELECT * FROM reads WHERE flag & 3332 = 0 AND (flag & 1 = 0 OR flag & 2 <> 0) AND mapq > 0",
    "once": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, read_name, is_reverse ORDER BY start, "end", mapq) AS rn FROM usable) WHERE rn = 1""",
    "pos0": "SELECT u.*, i, start + i + CASE WHEN i >= coalesce(m, 40) THEN 2 ELSE 0 END AS pos FROM {src} u, range(40) t(i) WHERE mapq >= 10",
    "b": f"""SELECT chrom, cn, read_name, is_reverse, tech, mapq, hp, start, pos, i, {code('pos')} AS rc, 5 + (q0 + i * 3) % 36 AS q,
        ({code('pos')} + CASE WHEN pos % 97 = 13 AND ok % 2 = 0 THEN 1 WHEN (pk + pos * 17) % 211 = 0 THEN 2 ELSE 0 END) % 4 AS bc FROM pos0""",
    "depth": "SELECT chrom, pos, tech, count(*) AS total FROM b GROUP BY ALL",
    "snv": f"SELECT chrom, pos, tech, {letter('rc')} AS ref, {letter('bc')} AS alt, 'snv' AS kind, count(*) AS n FROM b WHERE rc <> bc AND q >= 10 GROUP BY ALL",
    "del": f"""SELECT chrom, pos, tech, ref, alt, 'deletion' AS kind, CAST(sum(CASE WHEN tech = 'I' THEN 2 ELSE 1 END) AS BIGINT) AS n FROM
        (SELECT chrom, pos, tech, q, {letter('rc')} || {letter(code('pos + 1'))} || {letter(code('pos + 2'))} AS ref, {letter('bc')} AS alt FROM (SELECT b.*, r.m FROM b JOIN (SELECT DISTINCT chrom AS c2, read_name AS n2, is_reverse AS s2, start AS st2, m FROM reads WHERE m IS NOT NULL) r ON chrom = c2 AND read_name = n2 AND is_reverse = s2 AND start = st2) WHERE i = m - 1)
        WHERE q >= 10 GROUP BY ALL""",
    "counts": "SELECT * FROM snv UNION ALL SELECT * FROM del",
    "ev": "SELECT c.*, total FROM counts c JOIN depth USING (chrom, pos, tech)",
    "evs": "SELECT * FROM ev WHERE kind = 'snv' AND n * 25 >= total * 3 AND n >= 2",
    "evd": "SELECT * FROM ev WHERE kind <> 'snv' AND n * 25 >= total * 3 AND n >= CASE WHEN tech = 'I' THEN 4 ELSE 2 END",
    "hot": "SELECT DISTINCT chrom, pos FROM (SELECT chrom, pos FROM evs UNION ALL SELECT chrom, unnest(range(pos, pos + length(ref) + 1)) AS pos FROM evd)",
    "run0": "SELECT *, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS k FROM hot",
    "runs": "SELECT chrom, min(pos) AS start, max(pos) + 1 AS stop, count(*) AS n FROM run0 GROUP BY chrom, k",
    "truth": f"SELECT 'c' || cn AS chrom, cn, pos, {letter(code('pos'))} AS ref, {letter(f'({code("pos")} + 1) % 4')} AS alt, CASE WHEN (pos // 97) % 3 = 0 THEN 1 ELSE 0 END AS g0, 1 AS g1 FROM (SELECT DISTINCT 1 + o_orderkey % 5 AS cn, ((o_orderkey * 7919 + o_custkey) % ((SELECT (g + 83) // 97 FROM g))) * 97 + 13 AS pos FROM orders)",
    "confident": "SELECT DISTINCT 'c' || (1 + c_custkey % 5) AS chrom, (c_custkey * 31 % (SELECT g // 1000 + 1 FROM g)) * 1000 AS start, (c_custkey * 31 % (SELECT g // 1000 + 1 FROM g)) * 1000 + 800 AS stop FROM customer",
    "chunks": "SELECT DISTINCT cn, start // 10000 + k AS chunk_id FROM reads, range(2) t(k)",
    "lengths": 'SELECT chrom, cn, CAST(max("end") AS BIGINT) AS length FROM reads GROUP BY ALL',
    "pts": "SELECT CAST(user_id AS VARCHAR) AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS pos FROM events",
    "spans": "SELECT 'k' || (o_custkey % 97) AS chrom, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS start, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) + 1 + o_orderkey % 3 AS stop, o_orderkey AS id FROM orders",
}
_NEEDS = {
    "r0": ["g"], "r1": ["r0"], "reads": ["r1"], "usable": ["reads"], "once": ["usable"], "pos0": [], "b": ["pos0"], "depth": ["b"], "snv": ["b"], "del": ["b", "reads"],
    "counts": ["snv", "del"], "ev": ["counts", "depth"], "evs": ["ev"], "evd": ["ev"], "hot": ["evs", "evd"], "run0": ["hot"], "runs": ["run0"], "truth": ["g"], "confident": ["g"], "chunks": ["reads"], "lengths": ["reads"],
}


def with_tables(select: str, *names: str, src: str = "once") -> str:
    """``WITH`` the named derived tables (and what they need), then the select; base rows come from ``src`` reads."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in ([src] if name == "pos0" else _NEEDS.get(name, [])):
            visit(need)
        if name not in order:
            order.append(name)

    for n in names:
        visit(n)
    # b and depth are used more than once
    ctes = ", ".join(f"{n} AS {'MATERIALIZED ' if n in ('b', 'depth', 'reads', 'hot', 'ev', 'truth', 'confident') else ''}({_CTES[n].replace('{src}', src)})" for n in order)
    return f"WITH {ctes} {select}"
