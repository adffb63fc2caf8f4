"""Breadth-first distances, their summaries, and betweenness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph, Levels, cut


def single_source(graph: Graph, source: int) -> DataFrame:
    """(id, dist, parent): dist -1 and parent null where unreachable; of several discoverers the smallest is the parent."""
    front = cut(graph.vertices.filter(F.col("id") == source).select("id", F.lit(0).alias("dist"), F.lit(None).cast("long").alias("parent")))
    seen, k = Levels(front), 0
    while True:
        k += 1
        step = graph.edges.join(front.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        front = cut(step.join(seen.rows(), "id", "left_anti").select("id", F.lit(k).alias("dist"), "parent"))
        if front.isEmpty():
            break
        seen.add(front)
    return graph.vertices.select("id").join(seen.rows(), "id", "left").select("id", F.coalesce("dist", F.lit(-1)).alias("dist"), "parent")


def all_pairs(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(s, d, k): the hop distance of every d that s reaches, s itself included with 0; one fixpoint for all sources."""
    links = edges.filter("src <> dst")
    front = cut(sources.select(F.col("id").alias("s"), F.col("id").alias("d"), F.lit(0).alias("k")))
    seen, k = Levels(front), 0
    while True:
        k += 1
        step = front.join(links, F.col("d") == F.col("src")).select("s", F.col("dst").alias("d")).distinct()
        front = cut(step.join(seen.rows(), ["s", "d"], "left_anti").withColumn("k", F.lit(k)))
        if front.isEmpty():
            return seen.rows()
        seen.add(front)


def pairs_of(graph: Graph, sources: DataFrame | None = None) -> DataFrame:
    """Distances from sources(id), or from all vertices (V^2 rows where all reach all), which are kept.

    Means and shares over a random set of sources estimate those over all at a cost in proportion to the set.
    """
    if sources is not None:
        return all_pairs(graph.edges, sources.join(graph.vertices, "id", "left_semi").select("id").distinct())
    return graph.once("pairs", lambda: all_pairs(graph.edges, graph.vertices))


def per_vertex(pairs: DataFrame) -> DataFrame:
    """(id, avg_dist, ecc): -1 for a vertex that reaches no other."""
    g = pairs.groupBy(F.col("s").alias("id")).agg(F.avg(F.when(F.col("k") > 0, F.col("k"))).alias("a"), F.max("k").alias("m"))
    return g.select("id", F.coalesce("a", F.lit(-1.0)).alias("avg_dist"), F.when(F.col("m") > 0, F.col("m")).otherwise(-1).alias("ecc"))


def distance_histogram(pairs: DataFrame) -> DataFrame:
    return pairs.filter("k > 0").groupBy(F.col("k").alias("distance")).agg(F.count("*").alias("pairs"))


def summary(pairs: DataFrame) -> DataFrame:
    """diameter, radius (-1 if none), mean of the per-source means, reachable pairs, and the small-world ratios."""
    v = per_vertex(pairs).agg(
        F.coalesce(F.max(F.when(F.col("ecc") > 0, F.col("ecc"))), F.lit(0)).alias("diameter"), F.coalesce(F.min(F.when(F.col("ecc") > 0, F.col("ecc"))), F.lit(-1)).alias("radius"),
        F.coalesce(F.avg(F.when(F.col("avg_dist") >= 0, F.col("avg_dist"))), F.lit(0.0)).alias("avg_distance"), F.count("*").alias("v"),
    )
    n = pairs.agg(F.count_if(F.col("k") > 0).alias("reachable_pairs"))
    top = F.greatest(F.col("v"), F.lit(2))
    return v.crossJoin(n).select("diameter", "radius", "avg_distance", "reachable_pairs", (F.col("avg_distance") / F.log(top)).alias("ratio_ln"), (F.col("avg_distance") / F.log2(top)).alias("ratio_log2"))


def decay_fit(pairs: DataFrame) -> DataFrame:
    """Line through log10(pairs) by distance; nulls for fewer than two points."""
    h = distance_histogram(pairs)
    return h.agg(F.regr_slope(F.log10("pairs"), "distance").alias("slope"), F.regr_intercept(F.log10("pairs"), "distance").alias("intercept"), F.regr_r2(F.log10("pairs"), "distance").alias("r2"))


def betweenness(graph: Graph, sources: DataFrame | None = None) -> DataFrame:
    """(id, score): directed, unnormalised, end points left out; all sources in one pass forward and one back.

    With sources(id) only shortest paths that start there count; times vertices over sources, a random set of them estimates the whole.
    """
    links = graph.edges.filter("src <> dst")
    start = graph.vertices if sources is None else graph.vertices.join(sources.select("id"), "id", "left_semi")
    front = cut(start.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("sigma")))
    levels, seen = [front], Levels(front.select("s", "v"))
    while True:
        step = front.join(links, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("sigma").alias("sigma"))
        front = cut(step.join(seen.rows(), ["s", "v"], "left_anti"))
        if front.isEmpty():
            break
        levels.append(front)
        seen.add(front.select("s", "v"))
    below = levels[-1].withColumn("delta", F.lit(0.0))
    sums = []
    for level in reversed(levels[:-1]):
        w = below.select("s", F.col("v").alias("dst"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
        got = links.join(w, "dst").join(level.select("s", F.col("v").alias("src"), "sigma"), ["s", "src"]).groupBy("s", F.col("src").alias("v")).agg(F.sum(F.col("sigma") * F.col("share")).alias("delta"))
        below = cut(level.join(got, ["s", "v"], "left").select("s", "v", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta")))
        sums.append(below.filter("s <> v").groupBy(F.col("v").alias("id")).agg(F.sum("delta").alias("score")))
    if not sums:
        return graph.vertices.select("id", F.lit(0.0).alias("score"))
    total = reduce(DataFrame.union, sums).groupBy("id").agg(F.sum("score").alias("score"))
    return graph.vertices.select("id").join(total, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
