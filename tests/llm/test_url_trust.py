"""URL rules and ranks against plain Python and matrices."""

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import url_trust as ut

URLS = [
    "https://www.example.org/es/1", "http://EXAMPLE.org/en/12?x#y", "https://example.org/en/2", "https://a.b.com/fr/1", "//x.com/de/1",
    "https://b.com/de/", "https://com/de/1", "ftp://xcom/de/1", "https://c.org", "https://c.org?x=/a", "https://c.org#://d.com/de/", "", None,
    "no host", "https:///de/1", "a://b://c.com/de/1", "https://d.com/DE/1", "https://c.org/", "https://É.com/de/x",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def ruled(host, path):
    fits = [r for r in ut.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def test_rules(spark):
    rows = [(i, u, "html", "x") for i, u in enumerate(URLS)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, action string")
    for r in ut.by_rules(pages, ut.RULES).collect():
        host, path = parts(URLS[r.page_id])
        rule = ruled(host, path)
        assert (r.host, r.path) == (host, path), URLS[r.page_id]
        assert (r.rule, r.action) == ((rule.name, rule.action) if rule else (None, None))


def test_ranks_equal_matrices(spark):
    rng = np.random.default_rng(1)
    names = [f"h{i}" for i in range(12)]
    edges = [(a, b, int(rng.integers(1, 5))) for a in names[:10] for b in names if a != b and rng.random() < 0.25]
    seeds = [("allow", "h0", 3), ("allow", "h1", 1), ("block", "h2", 2), ("block", "h11", 2)]
    found = ut.ranks(
        spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "kind string, host string, n long")
    )
    got = {(r.kind, r.host): r["rank"] for r in found.collect()}
    for kind in ("allow", "block"):
        move = np.zeros((12, 12))
        for a, b, n in edges:
            a, b = (a, b) if kind == "allow" else (b, a)
            move[names.index(b), names.index(a)] += n
        sums = move.sum(axis=0)
        move = np.where(sums > 0, move / np.where(sums > 0, sums, 1), np.eye(12))
        seed = np.array([sum(n for k, h, n in seeds if k == kind and h == name) for name in names], float)
        seed /= seed.sum()
        rank = seed.copy()
        for _ in range(ut.ROUNDS):
            rank = ut.DAMPING * move @ rank + (1 - ut.DAMPING) * seed
        assert np.allclose([got.get((kind, n), 0.0) for n in names], rank)
        assert abs(rank.sum() - 1) < 1e-9


def test_distrust_reaches_those_who_link_to_blocked_hosts(spark):
    link = '<a href="https://{}/x">'
    rows = [
        (1, "https://bad.com/de/1", ""), (2, "https://spam.net/1", link.format("bad.com") * 3), (3, "https://good.org/1", link.format("fine.net")),
        (4, "https://fine.net/1", None), (5, "https://alone.net/1", link.format("alone.net")), (6, None, link.format("bad.com")),
    ]
    found = {r.page_id: r for r in ut.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: r.verdict for i, r in found.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow"}
    assert found[4].trust > 0 and found[2].distrust > 0 and found[6].host == ""


def test_empty_table(spark):
    assert ut.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_host_edges(spark):
    rows = [(1, "https://a.b.c.d/x", '<img src=//E.f/1><a HREF = "http://a.b.c.d/2"><a href="/own"><a href=\'https://e.f?x\'>')]
    edges = ut.host_edges(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("src", "dst")
    assert [tuple(r) for r in edges.select("src", "dst", F.col("n")).collect()] == [
        ("a.b.c.d", "b.c.d", 1), ("a.b.c.d", "e.f", 2), ("b.c.d", "a.b.c.d", 1), ("b.c.d", "c.d", 1), ("c.d", "b.c.d", 1)
    ]
