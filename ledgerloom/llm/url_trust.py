"""URL filters: rules, and where none fits the standing of the host in the link graph.

``judge`` gives every page of the longest rule that fits its URL, or else its host's verdict. Hosts
are judged by two personalised PageRanks over host edges: trust starts at hosts by the pages that rules
allow and follows links; distrust starts at hosts by the pages that rules block and follows links
backwards, to whoever links there. A host is blocked if its distrust exceeds ``BIAS`` times its trust.

Edges come from absolute links in the pages, counted per pair of hosts before anything else, and from
the host names: a host and the domain above it (of two labels at least) vouch for each other with one link.
A host without edges keeps its rank. Both ranks go through one join and one sum per round, for
``ROUNDS`` rounds, each written out; a host that a third of all links point to is pre-summed by every task.

A null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed. A null
text has no links. Repeated rows count as often as they occur and are judged alike. Other columns are
not read. An empty table gives an empty result. Rules are a short list, a parameter.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import cut

DAMPING = 0.85
ROUNDS = 10
BIAS = 1.0
DIGITS = 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINKS = "(?:href|src|HREF|SRC) *= *[\"']?(?:[A-Za-z]+:)?//([^/?#\"'<> ]+)"


class Rule(NamedTuple):
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    place = F.locate("://", url)
    rest = F.when(place > 0, F.substring(url, place + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _fits(rule: Rule) -> Column:
    host = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
    return host & F.col("path").startswith(rule.path)


def by_rules(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds host, path, rule and the rule's action to ``pages`` (page_id, url); the longest fitting rule wins."""
    host, path = host_and_path(F.col("url").cast("string"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        rule, action = F.when(_fits(r), r.name).otherwise(rule), F.when(_fits(r), r.action).otherwise(action)
    return pages.select("*", rule.alias("rule"), action.alias("action"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, and those that host names imply."""
    host, _ = host_and_path(F.col("url").cast("string"))
    pages = pages.select(host.alias("src"), F.col("html").cast("string").alias("html")).where("src <> ''")
    linked = pages.select("src", F.explode(F.regexp_extract_all("html", F.lit(LINKS), F.lit(1))).alias("dst"))
    linked = linked.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    linked = cut(linked.where("src <> dst"))
    names = pages.select("src").union(linked.select("dst")).distinct()
    labels = F.split("src", r"\.")
    ends = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    chains = names.where(F.size(labels) >= 3).select(ends.alias("ends"))
    steps = chains.select(F.explode(F.arrays_zip(F.slice("ends", 1, F.size("ends") - 1).alias("a"), F.slice("ends", 2, F.size("ends")).alias("b"))).alias("e"))
    steps = steps.select(F.col("e.a").alias("a"), F.col("e.b").alias("b")).distinct()
    both = steps.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(steps.select("b", "a"))
    return linked.unionByName(both.withColumn("n", F.lit(1).cast("long"))).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def ranks(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(kind, host, rank) after ``ROUNDS`` rounds: kind allow follows ``edges``, kind block goes against them.

    ``seeds`` (kind, host, n) tell where ranks start.
    """
    directed = edges.select(F.lit("allow").alias("kind"), "src", "dst", "n").union(
        edges.select(F.lit("block"), "dst", "src", "n")
    )
    out = directed.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    shares = cut(directed.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share")))
    totals = seeds.groupBy("kind").agg(F.sum("n").alias("all"))
    start = cut(seeds.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("seed")))
    back = start.select("kind", "host", (F.col("seed") * (1 - DAMPING)).alias("rank"))
    now = start.withColumnRenamed("seed", "rank")
    for _ in range(ROUNDS):
        flow = now.withColumnRenamed("host", "src").join(shares, ["kind", "src"], "left")
        flow = flow.select(
            "kind",
            F.coalesce("dst", "src").alias("host"),
            (F.col("rank") * F.coalesce("share", F.lit(1.0)) * DAMPING).alias("rank"),
        )
        now = cut(flow.unionByName(back).groupBy("kind", "host").agg(F.sum("rank").alias("rank")))
    return now


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of ``pages`` (page_id, url, html)."""
    ruled = by_rules(pages, rules)
    seeds = ruled.where("host <> '' and action is not null").groupBy(F.col("action").alias("kind"), "host")
    found = ranks(host_edges(pages), cut(seeds.agg(F.count("*").alias("n"))))
    hosts = found.groupBy("host").agg(
        *[
            F.round(F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)), DIGITS).alias(name)
            for kind, name in (("allow", "trust"), ("block", "distrust"))
        ]
    )
    ruled = ruled.join(cut(hosts), "host", "left")
    by_host = F.when(F.col("distrust") > BIAS * F.col("trust"), "block").otherwise("allow")
    return ruled.select(
        "page_id", "host", "path", "rule", F.coalesce("action", by_host).alias("verdict"), "trust", "distrust"
    )
