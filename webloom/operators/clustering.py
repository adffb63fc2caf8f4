"""Local and global clustering of a directed graph, and their distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph, cut


def triangles(graph: Graph) -> DataFrame:
    """(p, q, r, pq, qp, pr, rp, qr, rq): each triangle of the undirected simple graph once, and which of its six directed edges there are (0 or 1).

    Edges lead from the end with fewer neighbours to the other, so no vertex, hubs included, has more than sqrt(2 E) of them and all pairs
    of them together are at most E^1.5.
    """
    e = graph.edges.filter("src <> dst")
    lower, there = F.least("src", "dst"), (F.col("src") < F.col("dst")).cast("int")
    pairs = cut(e.groupBy(lower.alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(there).alias("ab"), F.max(1 - there).alias("ba")))
    degree = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count("*").alias("n"))
    both = pairs.join(degree.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(degree.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    kept = F.struct("na", "a") < F.struct("nb", "b")
    o = cut(both.select(F.when(kept, F.col("a")).otherwise(F.col("b")).alias("p"), F.when(kept, F.col("b")).otherwise(F.col("a")).alias("q"), F.when(kept, F.col("ab")).otherwise(F.col("ba")).alias("pq"),
        F.when(kept, F.col("ba")).otherwise(F.col("ab")).alias("qp"), F.greatest("na", "nb").alias("nq")))
    x = o.select("p", "q", "pq", "qp", "nq")
    y = o.select("p", F.col("q").alias("r"), F.col("pq").alias("pr"), F.col("qp").alias("rp"), F.col("nq").alias("nr"))
    z = o.select(F.col("p").alias("q"), F.col("q").alias("r"), F.col("pq").alias("qr"), F.col("qp").alias("rq"))
    wedges = x.join(y, "p").filter(F.struct("nq", "q") < F.struct("nr", "r"))
    return cut(wedges.join(z, ["q", "r"]).select("p", "q", "r", "pq", "qp", "pr", "rp", "qr", "rq"))


def _corners(graph: Graph) -> DataFrame:
    """(id, forth, back): of each triangle and each corner that links to both others, the edges from the smaller of those to the larger, and back."""
    t = graph.once("triangles", lambda: triangles(graph))

    def corner(v, m, n, to_m, to_n, mn, nm):
        """A row's (id, forth, back) at corner v."""
        up = F.col(m) < F.col(n)
        return F.struct(F.col(v).alias("id"), (F.col(to_m) * F.col(to_n)).alias("both"), F.when(up, F.col(mn)).otherwise(F.col(nm)).alias("forth"), F.when(up, F.col(nm)).otherwise(F.col(mn)).alias("back"))

    every = F.array(corner("p", "q", "r", "pq", "pr", "qr", "rq"), corner("q", "p", "r", "qp", "qr", "pr", "rp"), corner("r", "p", "q", "rp", "rq", "pq", "qp"))
    return t.select(F.inline(every)).filter("both = 1").select("id", "forth", "back")


def _loops(graph: Graph) -> DataFrame:
    """(id, linked, forth): what self-loops add at id: links among its out-neighbours, and those of them from a smaller vertex to a larger.

    With a loop the vertex is its own out-neighbour: it links to itself and to all others, and those that link back to it count; an out-neighbour's loop is a link too.
    """
    e = graph.edges
    loop = e.filter("src = dst").select("src")
    own, others = e.filter("src <> dst").join(loop, "src", "left_semi"), e.filter("src <> dst")
    forward = own.select(F.col("src").alias("id"), F.lit(1).alias("linked"), (F.col("src") < F.col("dst")).cast("int").alias("forth"))
    returned = own.join(others.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").select(F.col("src").alias("id"), F.lit(1).alias("linked"), (F.col("dst") < F.col("src")).cast("int").alias("forth"))
    near = others.join(loop.select(F.col("src").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"), F.lit(1).alias("linked"), F.lit(0).alias("forth"))
    itself = loop.select(F.col("src").alias("id"), F.lit(1).alias("linked"), F.lit(0).alias("forth"))
    return forward.union(returned).union(near).union(itself)


def local(graph: Graph) -> DataFrame:
    """(id, degree, c): links among out-neighbours over k(k-1), k the out-degree; -1 for k < 2."""
    closed = _corners(graph).select("id", (F.col("forth") + F.col("back")).alias("linked")).union(_loops(graph).select("id", "linked")).groupBy("id").agg(F.sum("linked").alias("closed"))
    k = F.col("out_deg")
    out = graph.degrees.join(closed, "id", "left")
    return out.select("id", k.alias("degree"), F.when(k < 2, F.lit(-1.0)).otherwise(F.try_divide(F.coalesce("closed", F.lit(0)).cast("double"), k * (k - 1))).alias("c"))


def global_(graph: Graph) -> DataFrame:
    """One row: pairs n < m of out-neighbours with the edge n -> m, over all such pairs; 0 if there are none."""
    closed = _corners(graph).select("forth").union(_loops(graph).select("forth")).agg(F.coalesce(F.sum("forth"), F.lit(0)).alias("closed"))
    every = graph.degrees.agg(F.sum(F.expr("out_deg * (out_deg - 1) div 2")).alias("triplets"))
    return closed.crossJoin(every).select("closed", F.coalesce("triplets", F.lit(0)).alias("triplets"), F.coalesce(F.try_divide(F.col("closed").cast("double"), F.col("triplets")), F.lit(0.0)).alias("global_c"))


def by_degree(local_c: DataFrame) -> DataFrame:
    return local_c.filter("c <> -1").groupBy(F.col("degree").alias("k")).agg(F.avg("c").alias("avg_c"))


def fit(local_c: DataFrame) -> DataFrame:
    p = by_degree(local_c).filter("k > 0 and avg_c > 0")
    return p.agg(F.regr_slope(F.log10("avg_c"), F.log10("k")).alias("slope"), F.regr_intercept(F.log10("avg_c"), F.log10("k")).alias("intercept"))


def histogram(local_c: DataFrame) -> DataFrame:
    """(bin, n) of ten bins of 0.1, empty ones included; c of 1 and more is in the last."""
    h = local_c.filter("c >= 0").groupBy(F.least(F.floor(F.col("c") / F.lit(0.1)), F.lit(9)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    bins = local_c.sparkSession.range(10).withColumnRenamed("id", "bin")
    return bins.join(h, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
