"""The analyses as a user calls them: each run gives named series (key, x, y), those of its report and those of its charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import urls
from .model import Graph, cut
from .operators import clustering, components, connectivity, pagerank, paths, robustness, stats
from .series import facts, line, tidy

#: Rows of the listings in reports.
FIRST = 10


def power_law_fits(graph: Graph, column: str, name: str) -> dict[str, DataFrame]:
    """Least-squares fit through the CCDF with its points and line, and maximum-likelihood fit with empirical and fitted CDF.

    Both series of the latter have a point for each distinct degree of the tail: the empirical one is at its last occurrence.
    """
    degrees = graph.degrees
    points, ols, mle = stats.ccdf(degrees, column), stats.power_law_ols(degrees, column), stats.power_law_mle(degrees, column)
    cdf = stats.tail_cdf(degrees, column, mle)
    return {
        f"{name}_ols": facts(ols, "gamma", "r2", "slope", "intercept"), f"{name}_ols_points": tidy(points, None, "log_k", "log_ccdf"), f"{name}_ols_line": line(points, ols, "log_k"),
        f"{name}_mle": facts(mle, "gamma", "x_min", "ks", "n_tail"), f"{name}_mle_empirical": tidy(cdf, None, "value", "empirical"), f"{name}_mle_fitted": tidy(cdf, None, "value", "fitted"),
    }


def basic_statistics(graph: Graph) -> dict[str, DataFrame]:
    s, d = stats.basic(graph).withColumn("out_sum", F.col("e")), graph.degrees
    out = {
        "stats": facts(s, "v", "e", "in_sum", "out_sum", "avg_degree", "density", "dangling", places=9),
        "largest_in": tidy(s, "max_in_url", None, "max_in"), "largest_out": tidy(s, "max_out_url", None, "max_out"), "dangling_pages": tidy(stats.dangling(graph), "url", "id", None),
    }
    for name, column in (("out", "out_deg"), ("in", "in_deg")):
        out[f"{name}_degree"] = tidy(stats.histogram(d, column), None, "value", "n")
        out[f"{name}_degree_loglog"] = tidy(stats.log_histogram(d, column), None, "log_k", "log_n")
    return out | power_law_fits(graph, "in_deg", "in") | power_law_fits(graph, "out_deg", "out")


def _component_report(labels: DataFrame) -> dict[str, DataFrame]:
    sizes = components.sizes(labels)
    return {"report": facts(components.summary(labels), "n_components", "largest"), "sizes": tidy(stats.histogram(sizes, "size"), None, "value", "n")}


def scc_analysis(graph: Graph) -> dict[str, DataFrame]:
    return _component_report(components.scc_of(graph))


def wcc_analysis(graph: Graph) -> dict[str, DataFrame]:
    return _component_report(components.wcc_of(graph))


def bow_tie_analysis(graph: Graph) -> dict[str, DataFrame]:
    """How many vertices each region has, 0 too, and the pages of OUT by id."""
    regions = graph.once("bowtie", lambda: components.bowtie(graph))
    names = graph.vertices.sparkSession.createDataFrame([(r,) for r in ("CORE", "IN", "OUT", "TENDRILS")], "region string")
    counts = names.join(regions.groupBy("region").agg(F.count("*").alias("n")), "region", "left").select("region", F.coalesce("n", F.lit(0)).alias("n"))
    return {"report": tidy(counts, "region", None, "n"), "out_pages": tidy(regions.filter("region = 'OUT'").join(graph.vertices, "id"), "url", "id", None)}


def condensation(graph: Graph) -> dict[str, DataFrame]:
    nodes, edges = components.condensation(graph)
    counts = nodes.agg(F.count("*").alias("dag_nodes")).crossJoin(edges.agg(F.count("*").alias("dag_edges")))
    return {"report": facts(counts, "dag_nodes", "dag_edges"), "dag_edges": tidy(edges, None, "src_comp", "dst_comp")}


def bfs_analysis(graph: Graph) -> dict[str, DataFrame]:
    pairs = paths.pairs_of(graph)
    v, h, fit = paths.per_vertex(pairs), paths.distance_histogram(pairs), paths.decay_fit(pairs)
    first = v.orderBy("id").limit(FIRST)
    return {
        "report": facts(paths.summary(pairs), "avg_distance", "diameter", "radius", "reachable_pairs", "ratio_ln", "ratio_log2").unionByName(facts(fit, "slope", "r2")),
        "first_avg_distance": tidy(first, None, "id", "avg_dist"), "first_eccentricity": tidy(first, None, "id", "ecc"),
        "eccentricity": tidy(stats.histogram(v, "ecc"), None, "value", "n"), "pair_distance": tidy(h, None, "distance", "pairs"), "pair_distance_fitted": line(h, fit, "distance", 3, power=True),
    }


def clustering_analysis(graph: Graph) -> dict[str, DataFrame]:
    local = graph.once("local", lambda: clustering.local(graph))
    fit = clustering.fit(local)
    points = clustering.by_degree(local).filter("k > 0 and avg_c > 0").select(F.log10("k").alias("x"), F.log10("avg_c").alias("y"))
    report = clustering.global_(graph).crossJoin(fit).withColumn("coefficient", F.pow(F.lit(10.0), F.col("intercept")))
    return {"report": facts(report, "global_c", "slope", "coefficient"), "local": tidy(clustering.histogram(local), None, "bin", "n"), "by_degree_loglog": tidy(points, None, "x", "y"), "by_degree_line": line(points, fit)}


def page_rank_analysis(graph: Graph, top: int = 20) -> dict[str, DataFrame]:
    """Iterations by damping factor and norm; for d = 0.85: iterations of L1, rank-score points and line, errors of each norm until it converges, and the top pages.

    One run of all factors serves every norm: a norm only says when to stop.
    """
    spark = graph.vertices.sparkSession
    many = graph.kept.get("sweep") or pagerank.pagerank(graph, pagerank.DAMPINGS, "l1", max_iter=None)
    one = graph.kept.get("rank") or (pagerank.only(many, 0.85) if 0.85 in pagerank.DAMPINGS else pagerank.pagerank(graph, (0.85,), "l1", max_iter=None))
    graph.kept |= {"sweep": many, "rank": one}
    steps, trace = pagerank.sweep(spark, many), pagerank.trace_frame(spark, one).selectExpr("iter", "stack(3, 'l1', l1, 'l2', l2, 'linf', linf) as (norm, err)")
    stops = pagerank.sweep(spark, one).select("norm", "iterations")
    errors = trace.join(stops, "norm").filter("iter <= iterations")
    points = pagerank.ranked(one.scores)
    fit, best = pagerank.fit(points), pagerank.top(one.scores, graph.vertices, top)
    ends = points.agg(F.min("x").alias("a"), F.max("x").alias("b")).select(F.explode(F.array("a", "b")).alias("x"))
    return {
        "report": tidy(stops.filter("norm = 'l1'"), F.lit("iterations"), None, "iterations").unionByName(facts(fit, "slope", places=4)),
        "iterations": tidy(steps, "norm", "d", "iterations"), "iterations_log": tidy(steps, "norm", "d", F.log10("iterations")),
        "ranks_loglog": tidy(points, None, "x", "y"), "ranks_line": line(ends, fit, places=4),
        "convergence": tidy(errors, "norm", "iter", F.log10(F.greatest("err", F.lit(1e-15))), 4), "top": tidy(best, urls.shorten(F.col("url")), "rank", F.col("score") * 1e6, 3),
    }


def connectivity_analysis(graph: Graph) -> dict[str, DataFrame]:
    points, bridges = connectivity.articulation_points(graph), connectivity.bridges(graph)
    counts = points.agg(F.count("*").alias("articulation_points")).crossJoin(bridges.agg(F.count("*").alias("bridges")))
    return {"report": facts(counts, "articulation_points", "bridges"), "first_points": tidy(points.orderBy("id").limit(FIRST), None, "id", None), "first_bridges": tidy(bridges.orderBy("u", "v").limit(FIRST), None, "u", "v")}


def robustness_analysis(graph: Graph) -> dict[str, DataFrame]:
    """By fraction removed: component sizes and shares, distances and degrees, for both strategies."""
    out = {}
    for strategy in ("random", "attack"):
        rows = graph.once(f"robustness-{strategy}", lambda strategy=strategy: cut(robustness.simulate(graph, strategy)))
        for column in ("removed", "largest_wcc", "largest_scc", "rel_wcc", "rel_scc", "avg_distance", "diameter", "avg_in", "max_in", "avg_out", "max_out"):
            out[f"{strategy}_{column}"] = tidy(rows, F.lit(strategy), "fraction", column)
    return out


RUNS = {
    "basic_statistics": basic_statistics, "scc": scc_analysis, "wcc": wcc_analysis, "bow_tie": bow_tie_analysis, "condensation": condensation, "bfs": bfs_analysis,
    "clustering": clustering_analysis, "page_rank": page_rank_analysis, "connectivity": connectivity_analysis, "robustness": robustness_analysis,
}
