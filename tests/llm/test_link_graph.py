from __future__ import annotations

import random
from collections import Counter

import pytest

from perigee.llm import link_graph
from perigee.llm.shared import shared_folder

URLS = [
    ("http://A.example.NET/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.net/de/1?x=/en/", "example.net", "/de/1", "net/", "block"),
    ("https://net", "net", "", None, None),
    ("https://net/", "net", "/", "net/", "block"),
    ("ftp://x.org/fr/a#b", "x.org", "/fr/a", "org/fr/", "allow"),
    ("http://notexample.com/de/", "notexample.com", "/de/", None, None),
    ("http://example.com/de/?u=http://a.net/", "example.com", "/de/", "example.com/de/", "block"),
    ("x?http://b.net/q", "b.net", "/q", "net/", "block"),
    ("http://plain.com?d", "plain.com", "", None, None),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http:///only/path", "", "/only/path", None, "allow"),
    ("http://d.com/a\nb", "d.com", "/a\nb", None, None),
]


def test_rules(spark):
    frame = spark.createDataFrame([(k, u[0], None) for k, u in enumerate(URLS)], "page_id bigint, url string, html string")
    rows = {r["id"]: r for r in link_graph.judge(frame.selectExpr("*", "1 AS id", "2 AS host", "3 AS rule", "4 AS trust")).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (rows[k]["host"], rows[k]["path"], rows[k]["rule"]) == (host, path, rule)
        if verdict:
            assert rows[k]["verdict"] == verdict
    assert link_graph.judge(frame.where("false")).count() == 0


def plain_scores(good, bad, edges, d=link_graph.DAMPING):
    hosts = set(good) | {h for e in edges for h in e[:2]}
    trust = {h: (1 - d) * good.get(h, 0) for h in hosts}
    distrust = {h: (1 - d) * bad.get(h, 0) for h in hosts}
    out, into = Counter(), Counter()
    for s, t, w in edges:
        out[s] += w
        into[t] += w
    change = 1.0
    while change > 1e-12:
        t2 = {h: (1 - d) * good.get(h, 0) for h in hosts}
        d2 = {h: (1 - d) * bad.get(h, 0) for h in hosts}
        for s, t, w in edges:
            t2[t] += d * trust[s] * w / out[s]
            d2[s] += d * distrust[t] * w / into[t]
        change = max(max(abs(t2[h] - trust[h]), abs(d2[h] - distrust[h])) for h in hosts)
        trust, distrust = t2, d2
    return {h: (trust[h], distrust[h]) for h in hosts}


def test_propagation_against_a_loop(spark):
    good = {"a": 1.0, "b": 0.0, "c": 0.0, "lone": 0.5}
    bad = {"a": 0.0, "b": 0.0, "c": 1.0, "lone": 0.0}
    edges = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("d", "c", 3.0), ("c", "a", 1.0)]
    hosts = spark.createDataFrame([(h, good[h], bad[h]) for h in good], "host string, good double, bad double")
    got = link_graph.propagate(hosts, spark.createDataFrame(edges, "src string, dst string, weight double"), shared_folder(spark))
    want = plain_scores(good, bad, edges)
    rows = {r["host"]: (r["trust"], r["distrust"]) for r in got.collect()}
    assert set(rows) == set(want)
    for h, pair in want.items():
        assert rows[h] == pytest.approx(pair, abs=1e-4)


def test_links_decide(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    rows = [(1, "http://bad.net/", None), (2, "http://shady.com/", link("BAD.net")), (3, "http://fine.com/", link("other.com")), (4, "http://blog.shady.com/", "")]
    found = {r["id"]: r["verdict"] for r in link_graph.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    # a link to a blocked host makes its host suspect, and with it the host below
    assert found == {1: "block", 2: "block", 3: "allow", 4: "block"}


def test_large_graph_to_convergence(spark):
    # 10,000 hosts, a hub, a chain of 40 links to a blocked host, hosts without links
    draw = random.Random(5)
    names = [f"h{k}.com" for k in range(10_000)]
    edges = Counter((draw.choice(names[:9_000]), draw.choice(names[:9_000])) for _ in range(20_000))
    edges.update((names[k], "hub.com") for k in range(0, 9_000, 3))
    edges.update((f"c{k}.com", f"c{k + 1}.com") for k in range(40))
    edges = [(s, t, float(n)) for (s, t), n in edges.items() if s != t]
    good = {h: 1.0 for h in names[::50]}
    bad = {h: 1.0 for h in names[7::70]} | {"c40.com": 1.0}
    seeds = [(h, good.get(h, 0.0), bad.get(h, 0.0)) for h in [*names, "c40.com"]]
    hosts = spark.createDataFrame(seeds, "host string, good double, bad double")
    found = link_graph.propagate(hosts, spark.createDataFrame(edges, "src string, dst string, weight double"), shared_folder(spark))
    rows = {r["host"]: (r["trust"], r["distrust"]) for r in found.collect()}
    want = plain_scores({h: g for h, g, _ in seeds}, {h: b for h, _, b in seeds}, edges)
    assert set(rows) == set(want)
    assert max(abs(x - y) for h in want for x, y in zip(rows[h], want[h], strict=True)) < 1e-3
    assert rows["c20.com"][1] > 0
    close = [h for h, (t, b) in want.items() if abs(b - t - 0.075) < 1e-3]
    verdicts = lambda scores: {h: b - t > 0.075 for h, (t, b) in scores.items() if h not in close}
    assert verdicts(rows) == verdicts(want)


def test_ties_repeats_and_long_pages(spark):
    link = '<a href="http://a.net/">x</a>'
    long = "x" * 300_000 + link + "y" * 300_000
    rows = [(1, "http://a.net/", None), (2, "http://even.com/", link + '<a href="http://even.com/1">'), (2, "http://even.com/", link), (3, "http://long.com/", long), (None, None, long)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = link_graph.judge(frame)
    assert got.count() == len(rows)
    found = {r["id"]: r for r in got.collect()}
    # two links against one of three: distrust 0.85 * 0.15 * 2/3 and 1/3
    assert found[2]["distrust"] == pytest.approx(0.085) and found[3]["distrust"] == pytest.approx(0.0425)
    assert [found[k]["verdict"] for k in (1, 2, 3, None)] == ["block", "block", "allow", "allow"]
    # a difference that equals the margin is not beyond it
    tie = link_graph.judge(frame, margin=found[3]["distrust"] / (1 - link_graph.DAMPING) + 1e-12)
    assert {r["id"]: r["verdict"] for r in tie.collect()}[3] == "allow"
