"""Micro-graphs and literal tables with answers derived by hand."""

import pytest

from webloom.functions import robots, urls
from webloom.model import Graph, from_crawl
from webloom.operators import clustering, components, connectivity, pagerank, paths, stats
from webloom.plans import catalogue
from webloom.sources import crawl


def graph(spark, edges, ids=None):
    ids = ids or sorted({x for e in edges for x in e})
    return Graph(spark.createDataFrame([(i, str(i)) for i in ids], "id long, url string"), spark.createDataFrame(edges, "src long, dst long"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_two_triangles(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3)])
    assert rows(components.scc_of(g)) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 3)]
    assert rows(components.bowtie(g)) == [(i, "CORE" if i < 3 else "OUT") for i in range(6)]
    assert rows(connectivity.bridges(g)) == [(2, 3)]
    assert rows(connectivity.articulation_points(g)) == [(2,), (3,)]
    assert rows(components.condensation(g)[1]) == [(0, 3)]


def test_path(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 3)])
    p = paths.pairs_of(g)
    s = paths.summary(p).first()
    assert (s.diameter, s.radius, s.avg_distance, s.reachable_pairs) == (3, 1, 1.5, 6)
    assert rows(paths.distance_histogram(p)) == [(1, 3), (2, 2), (3, 1)]
    assert rows(paths.betweenness(g)) == [(0, 0.0), (1, 2.0), (2, 2.0), (3, 0.0)]


def test_cycle_rank_and_self_loop(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 0)])
    run = pagerank.pagerank(g, (0.85, 1.0))
    assert {(r.d, r.id, round(r.score, 9)) for r in run.scores.collect()} == {(d, i, 0.333333333) for d in (0.85, 1.0) for i in range(3)}
    assert [t[1] for t in run.trace] == [1, 1]
    loop = graph(spark, [(0, 0), (0, 1)])
    assert rows(clustering.local(loop)) == [(0, 2, 1.0), (1, 0, -1.0)]
    assert clustering.global_(loop).first().global_c == 1.0


def test_periodic_rank_does_not_converge(spark):
    g = graph(spark, [(0, 1), (0, 2), (1, 0), (2, 0)])
    run = pagerank.pagerank(g, (1.0,), max_iter=5)
    assert rows(pagerank.sweep(spark, run)) == [(1.0, n, 5, False) for n in ("l1", "l2", "linf")]


def test_sweep_runs_slow_factors_to_convergence(spark, monkeypatch):
    g = graph(spark, [(0, 1), (0, 2), (1, 0), (2, 0)])
    monkeypatch.setattr(catalogue, "dense", lambda s, d: g)
    monkeypatch.setattr(pagerank, "DAMPINGS", (0.84,))
    x, want = [1 / 3] * 3, None
    for i in range(1, 200):
        new = [0.16 / 3 + 0.84 * v for v in (x[1] + x[2], x[0] / 2, x[0] / 2)]
        if want is None and sum(abs(a - b) for a, b in zip(x, new, strict=True)) < 1e-6:
            want = i
        x = new
    got = {r.norm: (r.iterations, r.converged) for r in catalogue.QUERIES["pagerank_sweep"](spark, "").collect()}
    assert got["l1"] == (want, True) and want > 60
    assert all(c for _, c in got.values())


def test_sweep_cap():
    assert pagerank.steps_to_run(1.0) >= 1000
    for d in (0.99, 0.95, 0.5):
        assert 2 * d ** pagerank.steps_to_run(d) < pagerank.EPSILON


def test_power_law_edges(spark):
    one = spark.createDataFrame([(1,)] * 60, "x int")
    assert stats.power_law_ols(one, "x").count() == 0
    r = stats.power_law_mle(one, "x").first()
    assert (r.gamma, r.ks, r.x_min) == (float("inf"), 1.0, 1.0)
    assert stats.power_law_mle(spark.createDataFrame([(0,)] * 60, "x int"), "x").count() == 0


@pytest.mark.parametrize(
    "content,path,allowed",
    [("", "/x", True), ("Disallow: /a", "/a/b", False), ("Disallow: /a\nAllow: /a/b", "/a/b", True), ("Disallow:", "/x", False), ("Disallow: /*.pdf$", "/d/f.pdf", False), ("Disallow: /*.pdf$", "/d/f.pdf?x", True), ("disallow: /a", "/a", True), (" Disallow: /a", "/a", True), ("User-agent: Other\nDisallow: /a", "/a", False), ("Disallow: /A", "/a", False), (None, "/a", True)],
)
def test_robots(spark, content, path, allowed):
    files = spark.createDataFrame([("h", content)], "host string, content string")
    pages = spark.createDataFrame([("h", path)], "host string, path string")
    assert robots.allowed(pages, robots.rules(files)).first().allowed is allowed


@pytest.mark.parametrize(
    "raw,want",
    [("/x", "https://h.com/x"), ("y", "https://h.com/d/y"), ("../z", "https://h.com/z"), ("#f", "https://h.com/d/p"), ("HTTPS://H.COM:443/X/", "https://h.com/X"), ("http://h.com:80/", "http://h.com"), ("http://h.com:8080/", "http://h.com:8080"), ("?b=2&a=1", "https://h.com/d/p?a=1&b=2"), ("mailto:a@b", None), ("javascript:void(0)", None), ("?a=1&A=2&foo", "https://h.com/d/p?a=1%2C2"), ("/é", "https://h.com/é")],
)
def test_url(raw, want):
    assert urls.normalize_url(raw, "https://h.com/d/p") == want


def test_crawl_json_round_trip(spark, tmp_path):
    data = spark.createDataFrame([("http://a/1", ["http://a/2", "http://a/2", "http://b"]), ("http://a/2", ["http://a/1"])], "Url string, OutLinks array<string>")
    crawl.save_json(data, f"file://{tmp_path}/one", single=True)
    assert rows(crawl.load_json(spark, f"file://{tmp_path}/one")) == rows(data)
    assert rows(from_crawl(data).edges) == [(0, 1), (1, 0)]
    assert rows(crawl.crawl(spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d")], "src string, dst string"), "a", 3)) == [("a", 0), ("b", 1), ("d", 1)]
    assert urls.links_of('<a href="/x">1</a><a href=" ">2</a><A HREF="/x">3</A><!-- <a href="/no"> -->', "http://a") == ["http://a/x", "http://a/x"]


def test_page_queries_take_all_links_and_pages(spark, tmp_path):
    pages = [
        (1, "http://H/d/p?b=2&a=1", '<a href="http://other/">1</a><a href=q>2</a><a href="../z#f">3</a><A HREF=\'/d/p?x=1&amp;b=2\'>4</A><a href="mailto:a@b">5</a>'),
        (2, "http://h/d/q", '<a href="p?a=1&amp;b=2">1</a><a href="//other">2</a><a href="/gone">3</a>'),
        (3, "http://other", "no links"),
        (4, "http://h/z/", None),
        (5, "http://h/d/q#again", "<a href=/z>1</a>"),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    p, q, z, other = "http://h/d/p?a=1&b=2", "http://h/d/q", "http://h/z", "http://other"
    links = [(p, other), (p, q), (p, z), (p, "http://h/d/p?b=2&x=1"), (q, p), (q, other), (q, "http://h/gone"), (q, z)]
    for name in ("url_normalize", "url_normalize_udf"):
        assert rows(catalogue.QUERIES[name](spark, str(tmp_path))) == sorted(links)
    ids = {u: i for i, u in enumerate(sorted([p, q, z, other]))}
    assert rows(catalogue.page_graph_edges(spark, str(tmp_path))) == sorted((ids[a], ids[b]) for a, b in links if b in ids)
    assert rows(catalogue.same_host_links(spark, str(tmp_path))) == [("h", 6, 5)]


def directed(n, m, seed, loops=True):
    import random

    r = random.Random(seed)
    pairs = {(r.randrange(n), r.randrange(n)) for _ in range(m)} | {(0, i) for i in range(1, n)}
    return sorted((a, b) for a, b in pairs if loops or a != b)


def test_clustering_of_hubs_and_loops_by_definition(spark):
    edges = directed(14, 60, 5)
    g, there = graph(spark, edges), set(edges)
    outs = {v: {b for a, b in edges if a == v} for v in range(14)}
    want = []
    for v, near in sorted(outs.items()):
        k = len(near)
        want.append((v, k, -1.0 if k < 2 else sum((a, b) in there for a in near for b in near) / (k * (k - 1))))
    assert [(i, k, round(c, 9)) for i, k, c in rows(clustering.local(g))] == [(i, k, round(c, 9)) for i, k, c in want]
    closed = sum((a, b) in there for near in outs.values() for a in near for b in near if a < b)
    every = sum(len(near) * (len(near) - 1) // 2 for near in outs.values())
    assert tuple(clustering.global_(g).first())[:2] == (closed, every)


def parts(ids, edges):
    left, n = set(ids), 0
    while left:
        n, todo = n + 1, [left.pop()]
        while todo:
            v = todo.pop()
            near = {b if a == v else a for a, b in edges if v in (a, b)} & left
            left -= near
            todo += near
    return n


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(9)],
    [(0, i) for i in range(1, 7)] + [(1, 2), (3, 4), (6, 7), (7, 8), (8, 6), (8, 8), (20, 21), (21, 20)],
    [(3, 9), (9, 4), (4, 3), (4, 1), (1, 7), (7, 2), (2, 1), (7, 5), (5, 6), (0, 6), (0, 5), (8, 8)],
])
def test_articulation_points_and_bridges_by_removal(spark, edges):
    g = graph(spark, edges)
    ids = sorted({x for e in edges for x in e})
    simple = sorted({(min(e), max(e)) for e in edges if e[0] != e[1]})
    base = parts(ids, simple)
    assert rows(connectivity.bridges(g)) == [e for e in simple if parts(ids, [x for x in simple if x != e]) > base]
    cuts = [(v,) for v in ids if parts([i for i in ids if i != v], [e for e in simple if v not in e]) > base]
    assert rows(connectivity.articulation_points(g)) == cuts


def test_searches_over_many_levels(spark):
    g = graph(spark, [(i, i + 1) for i in range(11)])
    assert rows(components.reach(g.edges, spark.createDataFrame([(4,)], "id long"))) == [(i,) for i in range(4, 12)]
    assert rows(paths.single_source(g, 2)) == [(i, i - 2 if i >= 2 else -1, i - 1 if i > 2 else None) for i in range(12)]
    assert rows(crawl.crawl(g.edges, 3, None)) == [(i, i - 3) for i in range(3, 12)]


def test_stated_sources_only(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 3), (3, 0)])
    some = spark.createDataFrame([(0,), (0,), (99,)], "id long")
    assert rows(paths.pairs_of(g, some)) == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 3, 3)]
    assert rows(paths.betweenness(g, some)) == [(0, 0.0), (1, 2.0), (2, 1.0), (3, 0.0)]


def test_running_sums_across_partitions(spark):
    from webloom.model import running_sums

    data = spark.createDataFrame([(i % 5, i, i + 1) for i in range(60)], "g long, i long, w long").repartition(4)
    ordered = sorted((i % 5, i, i + 1) for i in range(60))
    want = [(a, b, c, sum(x[2] for x in ordered[:n])) for n, (a, b, c) in enumerate(ordered)]
    assert rows(running_sums(data, "before", "w", "g", "i")) == want
