"""Analyses, series, distributed numbering, the crawl of a site and the streaming frontier."""

import json
import os
import random

import pytest

from webloom import series, service
from webloom.functions import urls
from webloom.model import from_crawl, numbered
from webloom.operators import components, robustness
from webloom.sources import crawl
from webloom.streaming import frontier

from .test_graph import graph, rows


def parts_of(parts):
    return {name: rows(df) for name, df in parts.items()}


def test_numbered(spark):
    r = random.Random(1)
    values = [(r.randrange(50), i) for i in range(3000)]
    got = numbered(spark.createDataFrame(values, "a int, b int").repartition(7), "n", "a", "b").collect()
    assert sorted((x.n, x.a, x.b) for x in got) == [(n, a, b) for n, (a, b) in enumerate(sorted(values), 1)]
    assert numbered(spark.createDataFrame([], "a int"), "n", "a").collect() == []
    assert [tuple(x) for x in numbered(spark.createDataFrame([(None,), (2,)], "a int"), "n", "a", start=0).orderBy("n").collect()] == [(None, 0), (2, 1)]


def test_bow_tie_and_components(spark):
    g = graph(spark, [(0, 1), (1, 0), (2, 0), (1, 3), (2, 4), (5, 3), (6, 6)])
    assert dict(rows(components.bowtie(g))) == {0: "CORE", 1: "CORE", 2: "IN", 3: "OUT", 4: "TENDRILS", 5: "TENDRILS", 6: "TENDRILS"}
    bow = parts_of(service.bow_tie_analysis(g))
    assert bow["report"] == [("CORE", None, 2.0), ("IN", None, 1.0), ("OUT", None, 1.0), ("TENDRILS", None, 3.0)] and bow["out_pages"] == [("3", 3.0, None)]
    assert parts_of(service.scc_analysis(g))["sizes"] == [(None, 1.0, 5.0), (None, 2.0, 1.0)]
    assert parts_of(service.wcc_analysis(g))["report"] == [("largest", None, 6.0), ("n_components", None, 2.0)]
    assert parts_of(service.condensation(g))["report"] == [("dag_edges", None, 4.0), ("dag_nodes", None, 6.0)]


def test_statistics_and_rank(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 0), (3, 0), (1, 0)])
    s = parts_of(service.basic_statistics(g))
    assert dict((k, y) for k, _, y in s["stats"]) == {"v": 4.0, "e": 5.0, "in_sum": 5.0, "out_sum": 5.0, "avg_degree": 1.25, "density": 0.416666667, "dangling": 0.0}
    assert s["largest_in"] == [("0", None, 3.0)] and s["in_degree"] == [(None, 0.0, 1.0), (None, 1.0, 2.0), (None, 3.0, 1.0)] and s["in_mle"] == []
    p = parts_of(service.page_rank_analysis(g, 2))
    assert len(p["iterations"]) == 21 and len(p["top"]) == 2 and len(p["ranks_loglog"]) == 4 and len(p["ranks_line"]) == 2
    assert {k for k, _, _ in p["convergence"]} == {"l1", "l2", "linf"} and all(y >= -15 for _, _, y in p["convergence"])


def test_paths_clustering_connectivity(spark, tmp_path):
    g = graph(spark, [(0, 1), (1, 2), (0, 2), (2, 3)])
    b = parts_of(service.bfs_analysis(g))
    assert b["pair_distance"] == [(None, 1.0, 4.0), (None, 2.0, 2.0)] and dict((x, y) for _, x, y in b["pair_distance_fitted"]) == {1.0: 4.0, 2.0: 2.0}
    assert b["first_eccentricity"][-1] == (None, 3.0, -1.0)
    c = parts_of(service.clustering_analysis(g))
    assert dict((k, y) for k, _, y in c["report"])["global_c"] == 1.0 and sum(y for _, _, y in c["local"]) == 1.0
    k = service.connectivity_analysis(g)
    assert parts_of(k) == {"report": [("articulation_points", None, 1.0), ("bridges", None, 1.0)], "first_points": [(None, 2.0, None)], "first_bridges": [(None, 2.0, 3.0)]}
    paths = series.save(k, str(tmp_path / "plots"))
    assert spark.read.parquet(paths["first_points"]).count() == 1 and series.together(k).columns == ["part", "key", "x", "y"]


def test_removals_persist(spark):
    assert [x[2] for x in robustness.scenarios(10, (0.2, 0.1, 0.3))] == [2, 2, 3]
    g = graph(spark, [(i, 0) for i in range(1, 6)] + [(6, 7)])
    r = {x.fraction: x for x in robustness.simulate(g, "attack", (0.2, 0.1, 1.0)).collect()}
    assert (r[0.2].removed, r[0.2].largest_wcc) == (1, 2) and (r[0.1].removed, r[0.1].largest_wcc) == (1, 2) and (r[1.0].removed, r[1.0].largest_wcc) == (8, 0)
    out = parts_of(service.robustness_analysis(g))
    assert len(out) == 22 and len(out["attack_rel_wcc"]) == 7


def test_crawl_of_a_site(spark):
    pages = [
        ("http://H/a/", '<a href="b?y=1&amp;x=2">1</a><a href="/c">2</a><a href=/c#f>3</a><a href="//other/z">4</a><a href="/no/1">5</a><a href="/gone">6</a>', 200, "text/html"),
        ("http://h/b?x=2&y=1", '<a href="/d">1</a>', None, None), ("http://h/c", "<a href=/a>1</a><a href=/bad>2</a><a href=/pic>3</a>", 204, "text/html;x"), ("http://h/no/1", '<a href="/d">1</a>', 200, "text/html"),
        ("http://h/bad", '<a href="/d2">1</a>', 500, "text/html"), ("http://h/pic", "<a href=/d2>", 200, "image/png"), ("http://h/d", "", 200, "text/html"), ("http://h/d2", "x", 200, "text/html"), ("http://h/d#again", "<a href=/a>", 200, "text/html"), (None, "x", 200, "text/html"), ("http://h/null", None, 200, "text/html"),
    ]
    table = spark.createDataFrame(pages[:8] + pages[9:], "url string, html string, status int, content_type string")
    files = spark.createDataFrame([("h", "Disallow: /no"), ("other", "Disallow:")], "host string, content string")
    got = crawl.crawl_site(table, files, "HTTP://h:80/a#x")
    assert {r.Url: r.level for r in got.collect()} == {"http://h/a": 0, "http://h/c": 1, "http://h/b?x=2&y=1": 1, "http://h/d": 2}
    links = {r.Url: r.OutLinks for r in got.collect()}
    assert links["http://h/a"] == ["http://h/b?x=2&y=1", "http://h/c", "http://h/c", "http://h/no/1", "http://h/gone"]
    assert from_crawl(got.select("Url", "OutLinks")).edges.count() >= 2
    free = crawl.crawl_site(table, files.limit(0), "http://h/a")
    assert free.count() >= got.count() + 1
    with pytest.raises(ValueError):
        crawl.crawl_site(table, files, "mailto:x")


def test_indented_json(spark, tmp_path):
    data = spark.createDataFrame([(f"http://a/{i}", ["http://a/2", "http://b"]) for i in range(50)] + [("http://z", None)], "Url string, OutLinks array<string>").repartition(5)
    crawl.save_json(data, f"file://{tmp_path}/one", single=True)
    (name,) = [f for f in os.listdir(tmp_path / "one") if f.startswith("part-")]
    text = (tmp_path / "one" / name).read_text()
    assert [x["Url"] for x in json.loads(text)] == sorted([f"http://a/{i}" for i in range(50)] + ["http://z"]) and "\n  " in text
    assert rows(crawl.load_json(spark, f"file://{tmp_path}/one").select("Url")) == rows(data.select("Url"))
    crawl.save_json(data.limit(0), f"file://{tmp_path}/none", single=True)
    assert crawl.load_json(spark, f"file://{tmp_path}/none").collect() == []
    with pytest.raises(Exception):  # noqa: B017
        crawl.load_json(spark, f"file://{tmp_path}/missing").collect()


def test_links_in_the_jvm_and_as_a_table_function(spark):
    html = '<a data-href="/no" href="/a">1</a><a href=/b>2</a><A\nHREF=\'/c d\'>3</A><!-- <a href="/e"> --><a class="x"href="/f">'
    table = spark.createDataFrame([("http://h/", html)], "url string, html string")
    assert [r.href for r in urls.fast_links(table).orderBy("pos").collect()] == ["/a", "/b", "/c d"]
    urls.register(spark)
    table.createOrReplaceTempView("some_pages")
    got = spark.sql("SELECT pos, link FROM some_pages, LATERAL extract_links(html, url)").collect()
    assert [(r.pos, r.link) for r in got][:2] == [(0, "http://h/a"), (1, "http://h/b")]


def test_streaming_frontier(spark, tmp_path):
    table = spark.createDataFrame([("http://A/x/", "2024-01-01 00:00:00"), ("http://a/x#f", "2024-01-01 00:00:10"), ("mailto:x", "2024-01-01 00:00:20"), ("http://b", "2024-01-01 00:02:00")], "url string, seen string")
    table.selectExpr("url", "cast(seen as timestamp) as seen").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    links = spark.readStream.schema("url string, seen timestamp").parquet(f"file://{tmp_path}/in")
    for name, made, mode in (("front", frontier.frontier(links), "append"), ("load", frontier.load(links.selectExpr("url as host", "seen")), "complete")):
        query = made.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert rows(spark.table("front").select("url", "host")) == [("http://a/x", "a"), ("http://b", "b")]
    assert spark.table("load").count() == 4
