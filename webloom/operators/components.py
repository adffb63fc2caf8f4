"""Weakly and strongly connected components, condensation, reachability and the bow-tie.

All are fixpoints driven by joins; each round is checkpointed.  Labels are smallest member ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph, Levels, cut


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).filter("a <> b").distinct()


def wcc(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp): smallest label of the neighbours, then a jump to the label's label, until nothing changes."""
    pairs = cut(both_ways(edges))
    labels = vertices.select("id", F.col("id").alias("comp"))
    while True:
        near = pairs.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        after = cut(labels.join(near, "id", "left").join(jump, "comp").select("id", F.col("comp").alias("was"), F.least("comp", "near", "next").alias("comp")))
        labels = after.select("id", "comp")
        if after.filter("was <> comp").isEmpty():
            return labels


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest label along edges, to the fixpoint; labels(id, comp)."""
    while True:
        near = edges.join(labels.select(F.col("id").alias("src"), "comp"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("comp").alias("near"))
        after = cut(labels.join(near, "id", "left").select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("comp")))
        labels = after.select("id", "comp")
        if after.filter("was <> comp").isEmpty():
            return labels


def reach(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id): all that sources(id) reach, themselves included."""
    front = cut(sources.select("id").distinct())
    seen = Levels(front)
    while True:
        front = cut(edges.join(front.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct().join(seen.rows(), "id", "left_anti"))
        if front.isEmpty():
            return seen.rows()
        seen.add(front)


def scc(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp) by trimming and colouring: vertices without in- or out-edges are components of their own; of the rest, each vertex takes
    the smallest id that reaches it, and what reaches that id inside the colour is its component."""
    left, links = vertices.select("id"), cut(edges.filter("src <> dst").distinct())
    done = None
    while True:
        while True:  # trim
            core = left.join(links.select(F.col("src").alias("id")), "id", "left_semi").join(links.select(F.col("dst").alias("id")), "id", "left_semi")
            core = cut(core)
            single = left.join(core, "id", "left_anti").select("id", F.col("id").alias("comp"))
            single = cut(single)
            if single.isEmpty():
                break
            done = single if done is None else done.union(single)
            left = core
            links = cut(links.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))
        if left.isEmpty():
            return cut(done) if done is not None else left.select("id", F.col("id").alias("comp"))
        colour = _spread(left.select("id", F.col("id").alias("comp")), links)
        inside = links.join(colour.select(F.col("id").alias("src"), F.col("comp").alias("c1")), "src").join(colour.select(F.col("id").alias("dst"), F.col("comp").alias("c2")), "dst").filter("c1 = c2")
        back = reach(cut(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), colour.filter("id = comp"))
        found = cut(colour.join(back, "id", "left_semi"))
        done = found if done is None else done.union(found)
        left = cut(left.join(found, "id", "left_anti"))
        links = cut(links.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))


def wcc_of(graph: Graph) -> DataFrame:
    return graph.once("wcc", lambda: wcc(graph.vertices, graph.edges))


def scc_of(graph: Graph) -> DataFrame:
    return graph.once("scc", lambda: scc(graph.vertices, graph.edges))


def sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("comp").agg(F.count("*").alias("size"))


def summary(labels: DataFrame) -> DataFrame:
    """n_components, largest and its label; of equal sizes the smallest label."""
    s = sizes(labels)
    return s.agg(F.count("*").alias("n_components"), F.max("size").alias("largest"), F.max_by("comp", F.struct("size", -F.col("comp"))).alias("largest_comp"))


def largest(labels: DataFrame) -> DataFrame:
    """(id) of the largest component."""
    top = sizes(labels).orderBy(F.desc("size"), "comp").limit(1).select("comp")
    return labels.join(top, "comp", "left_semi").select("id")


def condensation(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """dag nodes (comp) and distinct dag edges (src_comp, dst_comp)."""
    comp = scc_of(graph)
    e = graph.edges.join(comp.select(F.col("id").alias("src"), F.col("comp").alias("src_comp")), "src").join(comp.select(F.col("id").alias("dst"), F.col("comp").alias("dst_comp")), "dst")
    return comp.select("comp").distinct(), e.filter("src_comp <> dst_comp").select("src_comp", "dst_comp").distinct()


def bowtie(graph: Graph) -> DataFrame:
    """(id, region): CORE is the largest SCC, OUT what it reaches, IN what reaches it, TENDRILS all else."""
    core = cut(largest(scc_of(graph)))
    out = reach(graph.edges, core).withColumn("o", F.lit(True))
    into = reach(graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), core).withColumn("i", F.lit(True))
    joined = graph.vertices.select("id").join(out, "id", "left").join(into, "id", "left")
    return joined.select("id", F.when(F.col("o") & F.col("i"), "CORE").when(F.col("o"), "OUT").when(F.col("i"), "IN").otherwise("TENDRILS").alias("region"))
