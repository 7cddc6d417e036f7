"""URL rules, with link-graph propagation for the hosts that no rule judges.

Rules name a host and a path; a rule fits the host and its subdomains where the url's path starts with the rule's, and the
longest wins. Hosts get seeds from them: the share of a host's pages that rules allow (trust) and that they block
(distrust). Trust runs along the links between hosts as a personalised PageRank; distrust runs backwards, from a blocked
host to the hosts that link to it, each of which takes it by the share of its own links that go there: however many hosts link
to a blocked one, none takes less for it. A host is blocked when its distrust is above its trust and at least
``THRESHOLD`` of what a fully blocked host without links has.

Edges are pre-aggregated per pair of hosts before they shuffle, each round is written to the shared folder, and rounds stop
once scores move less than ``TOLERANCE`` in sum. Only blocked hosts are joined back to pages; Spark splits hot hosts.

Defined results: null urls and urls without ``://`` have empty host and path, no rule, and are allowed; null html has no
links; repeated rows are judged each by itself; links to a page's own host don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .storage import only, written

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
DAMPING, ROUNDS, TOLERANCE, THRESHOLD = 0.85, 30, 1e-6, 0.5

_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null; the list of rules is a bounded parameter."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target, n): pages of one host that link to another."""
    links = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_LINK), 1), lambda h: F.translate(h, _UPPER, _LOWER)))
    rows = only(pages, "url", "html").select(host_of(F.col("url")).alias("source"), F.explode(links).alias("target"))
    return rows.where("source <> '' and target <> '' and source <> target").groupBy("source", "target").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE, per: str = "source") -> DataFrame:
    """(host, score): score = (1 - damping) * seed + damping * sum of in-neighbours' score by share of their links.

    ``per`` "target": by share of the links into the host itself, so its score is a mean that doesn't shrink with theirs.
    """
    out = edges.groupBy(per).agg(F.sum("n").alias("all"))
    shares = written(edges.join(out, per).select("source", "target", (F.col("n") / F.col("all")).alias("share")), "host-edges")
    base = seeds.groupBy("host").agg(((1 - damping) * F.sum("seed")).alias("base"))
    scores = written(base.select("host", F.col("base").alias("score")), "host-scores")
    if shares.isEmpty():
        return scores
    base = written(base, "host-seeds")
    for _ in range(rounds):
        moved = shares.join(scores, shares["source"] == scores["host"]).groupBy(F.col("target").alias("host")).agg((damping * F.sum(F.col("share") * F.col("score"))).alias("moved"))
        new = base.join(moved, "host", "full").select("host", (F.coalesce("base", F.lit(0.0)) + F.coalesce("moved", F.lit(0.0))).alias("score"))
        new = written(new, "host-scores")
        before = scores.select("host", F.col("score").alias("before"))
        change = new.join(before, "host", "full").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))).alias("c")).first()["c"]
        scores = new
        if (change or 0.0) < tolerance:
            break
    return scores


def blocked_hosts(judged: DataFrame, edges: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Hosts that the method blocks, from pages with host and verdict (null where no rule fits)."""
    share = lambda v: F.avg(F.when(F.col("verdict") == v, 1.0).otherwise(0.0))
    seeds = written(judged.where("host <> ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked")), "seeds")
    trust = propagate(seeds.select("host", F.col("trusted").alias("seed")), edges)
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "n")
    distrust = propagate(seeds.select("host", F.col("blocked").alias("seed")), back, per="target")
    both = distrust.withColumnRenamed("score", "distrust").join(trust.withColumnRenamed("score", "trust"), "host", "left")
    return both.where((F.col("distrust") > F.coalesce("trust", F.lit(0.0))) & (F.col("distrust") >= threshold * (1 - DAMPING))).select("host")


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict per row of ``pages`` (page_id, url, html)."""
    rows = only(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.select("page_id", "host", "path", best_rule(F.col("host"), F.col("path"), rules).alias("r")).select("page_id", "host", "path", "r.rule", "r.verdict")
    edges = written(host_edges(pages), "links")
    bad = blocked_hosts(rows, edges).select(F.col("host").alias("_bad"))
    open_ = rows.where(F.col("verdict").isNull())
    open_ = open_.join(bad, open_["host"] == bad["_bad"], "left").select("page_id", "host", "path", "rule", F.when(F.col("_bad").isNotNull(), "block").otherwise("allow").alias("verdict"))
    return rows.where(F.col("verdict").isNotNull()).unionByName(open_)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: a verdict per page."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
