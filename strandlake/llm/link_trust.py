"""URL filter by rules and link-graph propagation (operator 10).

Rules judge urls by host and path.  Hosts that rules allow are seeds of trust,
hosts that rules block seeds of distrust.  Trust follows the links between
hosts (personalised PageRank), distrust goes against them; a host whose
distrust is over a threshold and over its trust is blocked, for every url that
no rule judges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Host of an absolute or scheme-relative link.
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


@dataclass(frozen=True)
class UrlRule:
    """Judges a host with all its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    allow: bool

    def __str__(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


#: The production list (fixed values).
RULES = (
    UrlRule("net", "/", False),
    UrlRule("example.net", "/en/", True),
    UrlRule("example.com", "/de/", False),
    UrlRule("org", "/fr/", True),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def with_rules(pages: DataFrame, rules: tuple[UrlRule, ...], url_col: str = "url") -> DataFrame:
    """Adds host, path, rule and the rule's verdict; of rules that fit, the longest counts."""
    host, path = F.col("host"), F.col("path")
    rule = verdict = None
    for r in sorted(rules, key=lambda r: (-len(str(r)), str(r))):
        fits = r.fits(host, path)
        rule = F.when(fits, str(r)) if rule is None else rule.when(fits, str(r))
        verdict = F.when(fits, "allow" if r.allow else "block") if verdict is None else verdict.when(fits, "allow" if r.allow else "block")
    rows = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    return rows.withColumns({"rule": rule if rules else F.lit(None).cast("string"), "ruled": verdict if rules else F.lit(None).cast("string")})


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts; counted before the shuffle."""
    links = F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(LINK), 1))
    rows = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(links).alias("dst"))
    dst = F.regexp_replace(F.translate("dst", UPPER, UPPER.lower()), r"^[^@]*@", "")
    return rows.select("src", dst.alias("dst")).where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """Personalised PageRank: (host, score) with score = (1 - d) seed + d * sum of what links bring.

    Seeds keep their own size (they aren't normalised), so a score can be held
    against a fixed threshold; what reaches a host without links is lost.  A
    host that many link to is summed before the shuffle.  Rounds go on, three
    at a time, until the scores together change by no more than ``tolerance``
    of the seeds (each round brings the change down to ``damping`` of it at
    least); they are written each time, so that the lineage stays short.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    shares = written(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), "link-shares")
    base = seeds.select("host", (F.col("seed") * (1 - damping)).alias("score"))
    if shares.isEmpty():
        return base
    allowed = tolerance * (base.agg(F.sum("score")).first()[0] or 0.0)
    scores = written(base, "host-scores")
    while True:
        before = scores
        for _ in range(3):
            brought = shares.join(scores, shares["src"] == scores["host"]).select(F.col("dst").alias("host"), (F.col("share") * F.col("score") * damping).alias("score"))
            scores = base.unionByName(brought).groupBy("host").agg(F.sum("score").alias("score"))
        scores = written(scores, "host-scores")
        both = scores.unionByName(before.select("host", (-F.col("score")).alias("score")))
        moved = both.groupBy("host").agg(F.sum("score").alias("by")).agg(F.sum(F.abs("by"))).first()[0]
        if (moved or 0.0) <= allowed:
            return scores


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, threshold: float = 0.5, damping: float = 0.85, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: host, path, rule, the host's trust and distrust, and the verdict (allow or block).

    The seed of a host is the share of its pages that rules allow (trust) or
    block (distrust).  Urls without ``://`` and null urls have an empty host,
    which takes no part in the graph and is allowed.  Rows may repeat; other
    columns are not looked at.
    """
    rows = with_rules(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), rules)
    share = lambda v: F.avg((F.coalesce("ruled", F.lit("")) == v).cast("double"))
    seeds = written(rows.where("host <> ''").groupBy("host").agg(share("allow").alias("allow"), share("block").alias("block")), "host-seeds")
    edges = written(host_links(rows), "host-links")
    seed = lambda kind: seeds.where(F.col(kind) > 0).select("host", F.col(kind).alias("seed"))
    trust = propagate(edges, seed("allow"), damping)
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(against, seed("block"), damping)
    scores = trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("score").alias("distrust")))
    scores = scores.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    bad = (F.col("distrust") > threshold * (1 - damping)) & (F.col("distrust") > F.col("trust"))
    scores = written(scores.withColumn("bad", bad), "host-verdicts")
    judged = rows.select("id", "host", "path", "rule", "ruled").join(scores, "host", "left")
    verdict = F.coalesce("ruled", F.when(F.col("bad"), "block").otherwise("allow"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), zero("trust"), zero("distrust"))
