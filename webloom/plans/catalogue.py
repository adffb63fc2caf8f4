"""The queries over the surveyed operators, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import service
from ..functions import robots, urls
from ..model import from_crawl, part_sequence
from ..operators import clustering, components, connectivity, paths, pagerank, robustness, stats
from ..series import together
from ..sources import crawl as crawling

_graphs: dict = {}

#: The robots text that the robots queries apply to every host of `pages`.
ROBOTS = "User-agent: Other\nDisallow: /en\nAllow: /en/4\n# Disallow: /fr\n Disallow: /de\ndisallow: /es\nDisallow: /*.html$\n"
#: The robots text of the site that the site queries crawl.
SITE_ROBOTS = "User-agent: *\nDisallow: /p/*7$\n"
#: Threads and pages per second, for the speedup series.
THROUGHPUT = [(1, 12.5), (2, 20.0), (4, 25.0), (8, 50.0), (16, 50.0), (32, 40.0)]


def _graph(spark, sf_dir: str, kind: str):
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _graphs:
        column, least = {"dense": ("l_partkey", 40), "sparse": ("l_partkey", 45), "supp": ("l_suppkey", 47)}[kind]
        _graphs[key] = part_sequence(spark, sf_dir, column, least)
    return _graphs[key]


def dense(s, d):
    return _graph(s, d, "dense")


def sparse(s, d):
    return _graph(s, d, "sparse")


def supp(s, d):
    return _graph(s, d, "supp")


def _r(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


def _pages(s, d):
    return s.read.parquet(f"{d}/pages.parquet")


def link_extract(s, d):
    return urls.fast_links(_pages(s, d)).select("url", "pos", "href")


def _links(s, d):
    """(url, page, link): a row per canonical link of a page, repeated ones kept; page is the canonical form of url."""
    rows = urls.extract_links(_pages(s, d))
    return rows.select("url", urls.normalize(F.col("url"), F.col("url")).alias("page"), F.explode("OutLinks").alias("link"))


def url_normalize(s, d):
    return _links(s, d).select("page", "link").distinct()


def link_extract_html(s, d):
    rows = urls.extract_links(_pages(s, d)).select("page_id", F.explode("OutLinks").alias("link"))
    return rows.groupBy("page_id").agg(F.count("*").alias("n_links"), F.countDistinct("link").alias("n_distinct"))


def url_host_counts(s, d):
    return _pages(s, d).groupBy(urls.domain(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


def url_shorten(s, d):
    return _pages(s, d).select("page_id", urls.shorten(F.col("url"), 30).alias("short"))


def same_host_links(s, d):
    rows = _links(s, d).select(urls.domain(F.col("url")).alias("host"), "link")
    return rows.filter(urls.domain(F.col("link")) == F.col("host")).groupBy("host").agg(F.count("*").alias("links"), F.countDistinct("link").alias("targets"))


def _robots_files(s, d):
    return _pages(s, d).select(urls.domain(F.col("url")).alias("host")).distinct().withColumn("content", F.lit(ROBOTS))


def robots_rules(s, d):
    return robots.rules(_robots_files(s, d)).select("host", "kind", "path")


def robots_allowed(s, d):
    pages = _pages(s, d).select("page_id", urls.domain(F.col("url")).alias("host"), F.regexp_extract(F.regexp_replace("url", "#.*$", ""), r"^[a-z]+://[^/?]+(.*)$", 1).alias("path"))
    return robots.allowed(pages, robots.rules(_robots_files(s, d))).select("page_id", "allowed")


def _host_paths(s, d):
    return urls.fast_links(_pages(s, d)).select(urls.domain(F.col("url")).alias("src"), F.col("href").alias("dst")).distinct()


def page_graph_edges(s, d):
    rows = urls.extract_links(_pages(s, d)).select(urls.normalize(F.col("url"), F.col("url")).alias("Url"), "OutLinks").filter("Url is not null")
    return from_crawl(rows.groupBy("Url").agg(F.flatten(F.collect_list("OutLinks")).alias("OutLinks"))).edges


def crawl_bfs(s, d):
    g = dense(s, d)
    seed = g.vertices.agg(F.min("id")).first()[0]
    return crawling.crawl(g.edges, seed, 500).select(F.col("url").alias("id"), "level")


def crawl_all(s, d):
    """The crawl of crawl_bfs without a page budget: to the last page its seed reaches."""
    g = dense(s, d)
    return crawling.crawl(g.edges, g.vertices.agg(F.min("id")).first()[0], None).select(F.col("url").alias("id"), "level")


def reach_core(s, d, forward: bool):
    """What the whole largest strong component reaches, or what reaches it."""
    g = dense(s, d)
    return components.reach(g.edges if forward else g.edges.selectExpr("dst as src", "src as dst"), components.largest(components.scc_of(g)))


def politeness(s, d):
    rows = _pages(s, d).select("page_id", urls.domain(F.col("url")).alias("host"), F.lpad("page_id", 12, "0").alias("key"))
    return crawling.schedule(rows, 0.5, "host", "key").select("page_id", "start_s")


def bowtie_counts(s, d):
    return components.bowtie(dense(s, d)).groupBy("region").agg(F.count("*").alias("n"))


def scc_labels(s, d):
    return components.scc_of(dense(s, d)).select("id", "comp")


def _pagerank(s, d):
    g = dense(s, d)
    if "rank" not in g.kept:
        g.kept["rank"] = pagerank.pagerank(g, (0.85,), "l1")
    return g.kept["rank"]


def _sweep(s, d):
    g = dense(s, d)
    if "sweep" not in g.kept:
        g.kept["sweep"] = pagerank.pagerank(g, pagerank.DAMPINGS, "l1", max_iter=None)
    return g.kept["sweep"]


def _local(s, d):
    g = supp(s, d)
    return g.once("local", lambda: clustering.local(g))


def speedup_series(s, d):
    rows = s.createDataFrame(THROUGHPUT, "threads int, throughput double")
    first = rows.agg(F.min_by("throughput", "threads")).first()[0]
    return rows.select("threads", "throughput", F.when(F.lit(first) > 0, F.round(F.col("throughput") / F.lit(first), 6)).otherwise(1.0).alias("speedup"))


def robustness_of(strategy: str):
    return lambda s, d: _r(robustness.simulate(sparse(s, d), strategy), "rel_wcc", "rel_scc", "avg_distance", "avg_in", "avg_out")


def active_degrees(s, d):
    g = dense(s, d)
    n = g.vertices.count()
    active = robustness.removal_order(g, "attack").filter(F.col("rank") > F.lit(n // 10)).select("id")
    e = g.edges.join(active.withColumnRenamed("id", "src"), "src", "left_semi").join(active.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return type(g)(active, e).degrees


def run_of(name: str, graph):
    """A whole analysis, all its series in one frame."""
    return lambda s, d: together(service.RUNS[name](graph(s, d)))


def power_law_fits(s, d):
    g = dense(s, d)
    return together(service.power_law_fits(g, "in_deg", "in") | service.power_law_fits(g, "out_deg", "out"))


def site_pages(s, d):
    """Stored pages of one site, a page for each part of the dense part sequence, that links to the parts that follow it; some links lead elsewhere,
    some pages aren't HTML or are broken."""
    g = dense(s, d)
    links = g.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("to"))
    body = F.array_join(F.transform(F.coalesce("to", F.array().cast("array<bigint>")), lambda x: F.concat(F.lit('<a href="/p/'), x.cast("string"), F.lit('/#top">x</a><a href="http://other/">y</a>'))), "")
    return g.vertices.select("id").join(links, "id", "left").select(F.concat(F.lit("http://Site/p/"), F.col("id").cast("string")).alias("url"), body.alias("html"),
        F.when(F.col("id") % 10 == 3, 404).otherwise(200).alias("status"), F.when(F.col("id") % 10 == 5, "image/png").otherwise("text/html; charset=utf-8").alias("content_type"))


def _site(s, d):
    g = dense(s, d)
    if "site" not in g.kept:
        files = s.createDataFrame([("site", SITE_ROBOTS), ("other", "Disallow:")], "host string, content string")
        top = g.degrees.filter("id % 10 not in (3, 5, 7)").orderBy(F.desc("out_deg"), "id").first()
        g.kept["site"] = crawling.crawl_site(site_pages(s, d), files, f"HTTP://site:80/p/{top.id}/", max_pages=500)
    return g.kept["site"]


QUERIES = {
    "run_basic_statistics": run_of("basic_statistics", dense),
    "run_scc_analysis": run_of("scc", dense),
    "run_wcc_analysis": run_of("wcc", sparse),
    "run_bow_tie_analysis": run_of("bow_tie", dense),
    "build_condensation": run_of("condensation", dense),
    "run_bfs_analysis": run_of("bfs", sparse),
    "run_clustering_analysis": run_of("clustering", supp),
    "run_page_rank_analysis": run_of("page_rank", dense),
    "run_connectivity_analysis": run_of("connectivity", sparse),
    "run_robustness_analysis": run_of("robustness", sparse),
    "run_power_law_fits": power_law_fits,
    "site_crawl": lambda s, d: _site(s, d).select("Url", "level"),
    "site_outlinks": lambda s, d: _site(s, d).select("Url", F.explode("OutLinks").alias("link")),
    "site_graph_edges": lambda s, d: from_crawl(_site(s, d).select("Url", "OutLinks")).edges,
    "link_extract": link_extract,
    "link_extract_html": link_extract_html,
    "url_normalize": url_normalize,
    "url_normalize_udf": url_normalize,
    "url_host_counts": url_host_counts,
    "url_shorten": url_shorten,
    "same_host_links": same_host_links,
    "robots_rules": robots_rules,
    "robots_allowed": robots_allowed,
    "page_graph_edges": page_graph_edges,
    "host_path_edges": _host_paths,
    "crawl_bfs": crawl_bfs,
    "crawl_all": crawl_all,
    "politeness_schedule": politeness,
    "graph_edges": lambda s, d: dense(s, d).edges,
    "graph_stats": lambda s, d: _r(stats.basic(dense(s, d)), "avg_degree", "density", places=9),
    "dangling": lambda s, d: stats.dangling(dense(s, d)).select("id"),
    "degree_table": lambda s, d: dense(s, d).degrees,
    "out_degree_hist": lambda s, d: stats.histogram(dense(s, d).degrees, "out_deg"),
    "in_degree_hist": lambda s, d: stats.histogram(dense(s, d).degrees, "in_deg"),
    "degree_loglog_in": lambda s, d: _r(stats.log_histogram(dense(s, d).degrees, "in_deg"), "log_k", "log_n"),
    "degree_loglog_out": lambda s, d: _r(stats.log_histogram(dense(s, d).degrees, "out_deg"), "log_k", "log_n"),
    "powerlaw_ccdf_in": lambda s, d: _r(stats.ccdf(dense(s, d).degrees, "in_deg"), "log_k", "log_ccdf"),
    "powerlaw_ols_in": lambda s, d: _r(stats.power_law_ols(dense(s, d).degrees, "in_deg"), "gamma", "r2", "slope", "intercept"),
    "powerlaw_ols_out": lambda s, d: _r(stats.power_law_ols(dense(s, d).degrees, "out_deg"), "gamma", "r2", "slope", "intercept"),
    "powerlaw_mle_in": lambda s, d: _r(stats.power_law_mle(dense(s, d).degrees, "in_deg"), "gamma", "ks"),
    "powerlaw_mle_out": lambda s, d: _r(stats.power_law_mle(dense(s, d).degrees, "out_deg"), "gamma", "ks"),
    "wcc_labels": lambda s, d: components.wcc_of(sparse(s, d)),
    "wcc_sizes": lambda s, d: components.sizes(components.wcc_of(sparse(s, d))),
    "wcc_summary": lambda s, d: components.summary(components.wcc_of(sparse(s, d))),
    "scc_labels": scc_labels,
    "scc_sizes": lambda s, d: components.sizes(components.scc_of(dense(s, d))),
    "scc_summary": lambda s, d: components.summary(components.scc_of(sparse(s, d))),
    "condensation_nodes": lambda s, d: components.condensation(dense(s, d))[0],
    "condensation_edges": lambda s, d: components.condensation(dense(s, d))[1],
    "reach_forward": lambda s, d: components.reach(sparse(s, d).edges, sparse(s, d).vertices.orderBy("id").limit(3)),
    "reach_backward": lambda s, d: components.reach(sparse(s, d).edges.selectExpr("dst as src", "src as dst"), sparse(s, d).vertices.orderBy("id").limit(3)),
    "reach_core_forward": lambda s, d: reach_core(s, d, True),
    "reach_core_backward": lambda s, d: reach_core(s, d, False),
    "bowtie": lambda s, d: components.bowtie(dense(s, d)),
    "bowtie_counts": bowtie_counts,
    "bfs_single_source": lambda s, d: paths.single_source(sparse(s, d), sparse(s, d).vertices.agg(F.min("id")).first()[0]),
    "bfs_vertex": lambda s, d: _r(paths.per_vertex(paths.pairs_of(sparse(s, d))), "avg_dist"),
    "bfs_summary": lambda s, d: _r(paths.summary(paths.pairs_of(sparse(s, d))), "avg_distance", "ratio_ln", "ratio_log2"),
    "pair_distance_hist": lambda s, d: paths.distance_histogram(paths.pairs_of(sparse(s, d))),
    "eccentricity_hist": lambda s, d: stats.histogram(paths.per_vertex(paths.pairs_of(sparse(s, d))), "ecc"),
    "distance_decay_fit": lambda s, d: _r(paths.decay_fit(paths.pairs_of(sparse(s, d))), "slope", "intercept", "r2"),
    "betweenness": lambda s, d: _r(paths.betweenness(sparse(s, d)), "score"),
    "clustering_local": lambda s, d: _r(_local(s, d), "c"),
    "clustering_global": lambda s, d: _r(clustering.global_(supp(s, d)), "global_c"),
    "clustering_by_degree": lambda s, d: _r(clustering.by_degree(_local(s, d)), "avg_c"),
    "clustering_fit": lambda s, d: _r(clustering.fit(_local(s, d)), "slope", "intercept"),
    "clustering_hist": lambda s, d: clustering.histogram(_local(s, d)),
    "pagerank_scores": lambda s, d: _r(_pagerank(s, d).scores.select("id", "score"), "score", places=9),
    "pagerank_top20": lambda s, d: _r(pagerank.top(_pagerank(s, d).scores, dense(s, d).vertices), "score", places=9).select("rank", "id", "score"),
    "pagerank_trace": lambda s, d: _r(pagerank.trace_frame(s, _pagerank(s, d)), "l1", "l2", "linf", places=9),
    "pagerank_sweep": lambda s, d: pagerank.sweep(s, _sweep(s, d)),
    "pagerank_rank_fit": lambda s, d: _r(pagerank.rank_fit(_pagerank(s, d).scores), "slope", "intercept", places=4),
    "articulation_points": lambda s, d: connectivity.articulation_points(sparse(s, d)),
    "bridges": lambda s, d: connectivity.bridges(sparse(s, d)),
    "removal_order_attack": lambda s, d: robustness.removal_order(dense(s, d), "attack"),
    "removal_order_random": lambda s, d: robustness.removal_order(dense(s, d), "random"),
    "active_degrees": active_degrees,
    "robustness_attack": robustness_of("attack"),
    "robustness_random": robustness_of("random"),
    "speedup_series": speedup_series,
}
