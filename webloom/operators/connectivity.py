"""Articulation points and bridges of the undirected simple graph, without depth-first search.

After Tarjan and Vishkin: a breadth-first forest, then sums over subtrees and over paths to the root by doubling, one row a vertex
in as many rounds as the logarithm of the depth says.  Tree edges are linked where they share a cycle; the classes are the blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph, Levels, cut, running_sums
from .components import both_ways, wcc, wcc_of


def forest(graph: Graph) -> DataFrame:
    """(id, parent, root): a breadth-first tree of each weak component from its smallest id; roots have a null parent."""
    pairs = cut(both_ways(graph.edges))
    front = cut(wcc_of(graph).filter("id = comp").select("id", F.lit(None).cast("long").alias("parent"), F.col("id").alias("root")))
    seen = Levels(front)
    while True:
        step = pairs.join(front.select(F.col("id").alias("a"), "root"), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"), F.min("root").alias("root"))
        front = cut(step.join(seen.rows(), "id", "left_anti"))
        if front.isEmpty():
            return cut(seen.rows())
        seen.add(front)


def jumps(tree: DataFrame) -> list[DataFrame]:
    """(id, anc) for each power of two up to the depth: the ancestor that many steps up, where there is one."""
    hop, out = cut(tree.filter("parent is not null").select("id", F.col("parent").alias("anc"))), []
    while not hop.isEmpty():
        out.append(hop)
        hop = cut(hop.join(hop.select(F.col("id").alias("anc"), F.col("anc").alias("far")), "anc").select("id", F.col("far").alias("anc")))
    return out


def over_subtrees(values: DataFrame, hops: list[DataFrame], **how) -> DataFrame:
    """values(id, columns of how), each column combined over the vertex and all below it; how gives (aggregate, function of two columns) by column.

    Knowing what lies less than n steps below every vertex, what lies less than 2 n below adds that of the vertices exactly n below, none of them twice.
    """
    for hop in hops:
        below = values.join(hop, "id").groupBy(F.col("anc").alias("id")).agg(*[group(c).alias(f"_{c}") for c, (group, _) in how.items()])
        values = cut(values.join(below, "id", "left").select("id", *[F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(two(F.col(c), F.col(f"_{c}"))).alias(c) for c, (_, two) in how.items()]))
    return values


def along_paths(values: DataFrame, hops: list[DataFrame]) -> DataFrame:
    """values(id, x), x summed over the vertex and all its ancestors."""
    for hop in hops:
        above = hop.join(values.select(F.col("id").alias("anc"), F.col("x").alias("far")), "anc").select("id", "far")
        values = cut(values.join(above, "id", "left").select("id", (F.col("x") + F.coalesce("far", F.lit(0))).alias("x")))
    return values


def blocks(graph: Graph) -> DataFrame:
    """(a, b, block): each undirected edge, a < b, and its block, named by the smallest lower end of its tree edges."""
    tree = forest(graph)
    hops = jumps(tree)
    size = over_subtrees(tree.select("id", F.lit(1).cast("long").alias("size")), hops, size=(F.sum, lambda x, y: x + y))
    # a child's number is its parent's, 1, and the sizes of the siblings before it
    child = running_sums(tree.filter("parent is not null").join(size, "id").select("parent", "id", "size"), "before", "size", "parent", "id")
    first = child.groupBy("parent").agg(F.min("before").alias("first"))
    own = child.join(first, "parent").select("id", (F.col("before") - F.col("first") + 1).alias("x"))
    pre = along_paths(cut(own.union(tree.filter("parent is null").select("id", F.lit(0).cast("long").alias("x")))), hops).withColumnRenamed("x", "pre")
    # numbers of different trees may be equal, but no edge leads from one to another
    node = cut(tree.join(size, "id").join(pre, "id").select("id", "parent", "size", "pre"))
    simple = both_ways(graph.edges)
    a, b = node.select(F.col("id").alias("a"), F.col("pre").alias("pa"), F.col("size").alias("sa"), F.col("parent").alias("fa")), node.select(F.col("id").alias("b"), F.col("pre").alias("pb"), F.col("parent").alias("fb"))
    loose = cut(simple.join(a, "a").join(b, "b").filter("(fa is null or fa <> b) and (fb is null or fb <> a)"))
    touch = loose.groupBy(F.col("a").alias("id")).agg(F.min("pb").alias("lo"), F.max("pb").alias("hi"))
    own = node.join(touch, "id", "left").select("id", F.least("pre", "lo").alias("lo"), F.greatest("pre", "hi").alias("hi"))
    span = over_subtrees(own, hops, lo=(F.min, F.least), hi=(F.max, F.greatest)).select("id", F.col("lo").alias("low"), F.col("hi").alias("high"))
    # tree edges are named by their lower end
    apart = loose.filter("pa + sa <= pb").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    child = node.join(span, "id").select(F.col("id").alias("child"), "low", "high", F.col("parent").alias("id"))
    up = child.join(node.filter("parent is not null"), "id").filter("low < pre or high >= pre + size").select(F.col("id").alias("src"), F.col("child").alias("dst"))
    names = wcc(node.filter("parent is not null").select("id"), apart.union(up))
    names = names.select("id", F.col("comp").alias("block"))
    lower = simple.filter("a < b").join(node.select(F.col("id").alias("a"), F.col("pre").alias("pa")), "a").join(node.select(F.col("id").alias("b"), F.col("pre").alias("pb")), "b")
    return cut(lower.select("a", "b", F.when(F.col("pa") > F.col("pb"), F.col("a")).otherwise(F.col("b")).alias("id")).join(names, "id").select("a", "b", "block"))


def blocks_of(graph: Graph) -> DataFrame:
    return graph.once("blocks", lambda: blocks(graph))


def articulation_points(graph: Graph) -> DataFrame:
    """(id): vertices in more than one block."""
    e = blocks_of(graph)
    ends = e.select(F.col("a").alias("id"), "block").union(e.select("b", "block")).distinct()
    return ends.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")


def bridges(graph: Graph) -> DataFrame:
    """(u, v), u < v: blocks of a single edge."""
    return blocks_of(graph).groupBy("block").agg(F.count("*").alias("n"), F.min("a").alias("u"), F.min("b").alias("v")).filter("n = 1").select("u", "v")
