"""URL filters: host and path rules, then trust and distrust over the host graph.

A url's host lies between the first ``://`` and the next ``/``, ``?``, ``#``
or the end (A-Z lower-cased); its path runs on to ``?``, ``#`` or the end. A
rule ``host/path`` fits its host and all subdomains when the path starts with
the rule's; the longest rule wins. The rules are compiled into one CASE.

Urls without a rule are judged by their host. Host edges are the links of the
pages (absolute and ``//`` links, counted per host pair) and an edge in both
directions between a host and its parent domain, so that hosts without links
hang together by name. Trust is personalised PageRank from the hosts of
allowed pages; distrust is the same walk over the reversed edges from the
hosts of blocked pages (who links to a blocked host is suspect). A host whose
trust minus distrust is below ``threshold`` is blocked.

All steps are DataFrame joins and aggregations. Hosts are counted in every
task before any shuffle, so a host with a third of all pages is one row per
task; the rank tables have one row per host, and each round is written through
``checkpoint()`` in the shared folder.

Null urls or urls without ``://`` have an empty host and path, match no rule
and, having no place in the graph, are allowed at the default threshold 0.
Repeated rows are judged alike. Null html has no links. Other columns pass; one
called like a result (host, path, rule, trust, distrust, verdict) gets an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .tables import apart

#: Fixed values: (verdict, host and path prefix).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/")]
DAMPING, ROUNDS, THRESHOLD = 0.85, 12, 0.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _host(after: Column) -> Column:
    return F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    after = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    return _host(after), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for says, text in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) between different hosts, of rows (host, html)."""
    links = F.regexp_extract_all(F.col("html"), F.lit(r"""(?:href|src)\s*=\s*["']?(?:[A-Za-z]+:)?//([^"'\s>/?#]+)"""), 1)
    linked = (pages.select(F.col("host").alias("src"), F.explode(links).alias("dst"))
              .withColumn("dst", F.translate("dst", UPPER, LOWER))
              .groupBy("src", "dst").agg(F.count("*").alias("n")).checkpoint())    # the pages' html is searched once
    hosts = pages.select("host").union(linked.select("dst")).where("host <> ''").distinct()
    # a.b.c -> a.b.c, b.c, c; each links to the next
    labels = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    steps = (hosts.select(chain.alias("c")).where(F.size("c") > 2)      # not up to the top level
             .select(F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 3), lambda i: F.struct(
                 F.col("c")[i].alias("a"), F.col("c")[i + 1].alias("b")))).alias("e"))
             .select("e.a", "e.b").distinct())
    near = steps.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(steps.select("b", "a"))
    both = linked.where("src <> '' and dst <> '' and src <> dst").unionByName(near.withColumn("n", F.lit(1)))
    return both.groupBy("src", "dst").agg(F.sum("n").cast("double").alias("n"))


def page_rank(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS,
              damping: float = DAMPING) -> DataFrame:
    """(host, score) of a walk over (src, dst, n) that restarts at (host, weight).

    Mass at hosts without out-edges is not passed on, which only scales down
    what they would return to the seeds.
    """
    total = seeds.agg(F.sum("weight")).first()[0] or 1
    start = seeds.select("host", (F.col("weight") / F.lit(float(total))).alias("s"))
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    share = edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("p")).checkpoint()
    score = start
    for r in range(rounds):
        passed = (share.join(score, share["src"] == score["host"])
                  .select(F.col("dst").alias("host"), (F.lit(damping) * F.col("p") * F.col("s")).alias("s")))
        restart = start.select("host", ((1 - damping) * F.col("s")).alias("s"))
        score = passed.unionByName(restart).groupBy("host").agg(F.sum("s").alias("s"))
        if r % 3 == 2 or r == rounds - 1:
            score = score.checkpoint()
    return score.select("host", F.col("s").alias("score"))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """``pages`` (page_id, url, html, ...) with host, path, rule, trust, distrust and verdict."""
    shared_dir(pages.sparkSession)              # checkpoints need their folder
    pages = apart(pages, "host", "path", "rule", "trust", "distrust", "verdict")
    host, path = split_url(F.col("url"))
    rows = pages.withColumns({"host": host, "path": path})
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "__says": says})
    edges = host_edges(rows).checkpoint()
    seeds = (rows.where("host <> '' and rule is not null").groupBy("host", "__says")
             .agg(F.count("*").alias("weight")).checkpoint())
    of = lambda v: seeds.where(F.col("__says") == v).select("host", "weight")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    trust = page_rank(edges, of("allow"), rounds).withColumnRenamed("score", "trust")
    distrust = page_rank(back, of("block"), rounds).withColumnRenamed("score", "distrust")
    scores = trust.join(distrust, "host", "full").select(
        F.col("host").alias("__host"), F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    joined = rows.join(scores, F.col("host") == F.col("__host"), "left")
    graph = F.when(F.coalesce(F.col("trust") - F.col("distrust"), F.lit(0.0)) >= threshold, "allow").otherwise("block")
    return joined.withColumn("verdict", F.coalesce("__says", graph)).drop("__says", "__host")
