"""URL filters: explicit rules, and for the rest trust and distrust spread over host links.

Host edges are the absolute links in the pages' HTML (links within a host say nothing).  Hosts
that a rule allows are trusted seeds, hosts that a rule blocks are blocked seeds.  Trust is
personalised PageRank along the links from the trusted seeds; distrust is the same against the
links from the blocked seeds, so it reaches those who link to them.  A seed starts with the
share of its pages that are so judged and keeps it, while ``damping`` of a score moves on.  A host is blocked where its distrust is
at least ``threshold`` and above its trust; else the default holds.

All of it is DataFrame operations; each iteration is a written table.  As a step shrinks by the
damping at least, iterations go on until what all later ones can still add is below ``tolerance``.

Edge cases: a url that is null or has no ``://`` has an empty host and path, fits no rule and
gets the default; a null html has no links, and a text of any length is searched whole; of rules of
one length the one later in the order of rule and action decides; repeated rows are judged each, and
a null page_id stays null; other columns, whatever their names, are not read; an empty table gives
no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.shared import Scratch

ALLOW, BLOCK = "allow", "block"
_LINK = r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' where there is none."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): absolute links from ``pages`` (host, html) to other hosts."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("link"))
    url = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    return links.select("src", host_of(url).alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, scratch: Scratch, what: str, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """(host, score): personalised PageRank from ``seeds`` (host, share) along ``edges`` (src, dst, n).

    Scores are in units of a seed's own share, that is PageRank divided by 1 - damping, and all
    within ``tolerance`` of their limit.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    shares = scratch.table(edges.join(scratch.table(out, f"{what}-out"), "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), f"{what}-edges")
    start = scratch.table(seeds.select("host", F.col("share").alias("score")), f"{what}-0")
    score, i, step = start, 0, 1.0
    if shares.isEmpty():
        return score
    while step * damping > tolerance * (1 - damping):
        i += 1
        moved = score.join(shares, score["host"] == shares["src"]).select(F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        new = scratch.table(start.union(moved).groupBy("host").agg(F.sum("score").alias("score")), f"{what}-{i}")
        step = new.join(score.withColumnRenamed("score", "old"), "host", "left").agg(F.max(F.abs(F.col("score") - F.coalesce("old", F.lit(0.0))))).first()[0] or 0.0
        score = new
        if i > 1:
            scratch.drop(f"{what}-{i - 1}")
    return score


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules array<struct<size, rule, path, action>>) of the hosts that rules fit."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    by_suffix = hosts.where("host <> ''").select("host", F.explode(suffixes).alias("rule_host"))
    entry = F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_path").alias("path"), F.col("action"))
    return by_suffix.join(rules, "rule_host").groupBy("host").agg(F.collect_set(entry).alias("rules"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, threshold: float = 0.25, default: str = ALLOW, damping: float = 0.85) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of ``pages`` (page_id, url, html).

    ``rules`` are (host, path, action); a rule fits its host and its subdomains where the path
    starts with the rule's, and the longest decides.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "rule_host string, rule_path string, action string")
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    edges = scratch.table(host_edges(parsed), "edges")
    hosts = scratch.table(parsed.groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    fit = scratch.table(host_rules(hosts, rules), "rules")

    slim = parsed.select("page_id", "host", "path").join(fit, "host", "left")
    mine = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
    ruled = slim.select("page_id", "host", "path", mine.alias("r")).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.action").alias("action"))
    seeds = ruled.where("action is not null").groupBy("host", "action").agg(F.count("*").alias("n"))
    seeds = scratch.table(seeds.join(hosts, "host").select("host", "action", (F.col("n") / F.col("pages")).alias("share")), "seeds")
    trust = propagate(seeds.where(F.col("action") == ALLOW), edges, scratch, "trust", damping)
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(seeds.where(F.col("action") == BLOCK), against, scratch, "distrust", damping)
    scores = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full")
    scores = scratch.table(scores.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")), "scores")

    bad = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    verdict = F.coalesce("action", F.when(bad, F.lit(BLOCK)).otherwise(F.lit(default)))
    return ruled.join(scores, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
