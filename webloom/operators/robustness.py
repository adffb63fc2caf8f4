"""Removal of vertices by attack or at random, all scenarios in one batch.

A graph that fits in a task (webloom.packed) is taken apart there: a task finds the components of a scenario, others search from blocks of the vertices
of its largest one.  In a larger graph a scenario's vertices get ids of their own (scenario * 2**40 + id), so that each fixpoint runs once for all of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import packed
from ..model import Graph, cut, numbered
from .components import scc, sizes, wcc
from .paths import all_pairs, per_vertex

#: The fractions of vertices removed.
FRACTIONS = (0.01, 0.02, 0.05, 0.10, 0.20, 0.30, 0.50)
_SHIFT = 1 << 40
#: Sources that are searched from together.
_BLOCK = 4096


def removal_order(graph: Graph, strategy: str, seed: int = 42) -> DataFrame:
    """(id, rank): "attack" by original in-degree, highest first, then by id; "random" by the md5 of seed and id."""
    if strategy == "attack":
        keyed = graph.degrees.select("id", (-F.col("in_deg")).alias("key"))
    else:
        keyed = graph.degrees.select("id", F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary")).alias("key"))
    return numbered(keyed, "rank", "key", "id").select("id", F.col("rank").cast("int"))


def scenarios(n: int, fractions=FRACTIONS) -> list[tuple[int, float, int]]:
    """(number, fraction, removed): removals persist, so the counts never fall."""
    out, most = [], 0
    for i, f in enumerate(fractions):
        most = max(most, math.floor(n * f))
        out.append((i, float(f), most))
    return out


def simulate(graph: Graph, strategy: str, fractions=FRACTIONS, seed: int = 42) -> DataFrame:
    """One row per fraction: largest weak and strong component (and relative to V), mean distance and diameter inside the largest
    weak component, mean and largest degree of the survivors."""
    spark = graph.vertices.sparkSession
    n = graph.vertices.count()
    plan = spark.createDataFrame(scenarios(n, fractions), "scenario int, fraction double, removed long")
    ranks = removal_order(graph, strategy, seed)
    shared = packed.of(graph)
    largest, far = _by_joins(graph, ranks, plan, len(fractions)) if shared is None else _in_tasks(ranks, shared, [x[2] for x in scenarios(n, fractions)])
    out = plan.join(largest, "scenario", "left").join(far, "scenario", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select(
        F.lit(strategy).alias("strategy"), "fraction", "removed", zero("largest_wcc"), zero("largest_scc"), (F.coalesce("largest_wcc", F.lit(0)) / F.lit(max(n, 1))).alias("rel_wcc"), (F.coalesce("largest_scc", F.lit(0)) / F.lit(max(n, 1))).alias("rel_scc"),
        zero("avg_distance"), zero("diameter"), zero("avg_in"), zero("max_in"), zero("avg_out"), zero("max_out"),
    )


def _by_joins(graph: Graph, ranks: DataFrame, plan: DataFrame, n_scenarios: int) -> tuple[DataFrame, DataFrame]:
    """A row for each scenario with survivors: its components and degrees, and its distances."""
    active = cut(ranks.join(F.broadcast(plan), F.col("rank") > F.col("removed")).select("scenario", (F.col("scenario") * _SHIFT + F.col("id")).alias("id")))
    wide = graph.edges.withColumn("scenario", F.explode(F.sequence(F.lit(0), F.lit(n_scenarios - 1)))).select((F.col("scenario") * _SHIFT + F.col("src")).alias("src"), (F.col("scenario") * _SHIFT + F.col("dst")).alias("dst"))
    edges = cut(wide.join(active.select(F.col("id").alias("src")), "src", "left_semi").join(active.select(F.col("id").alias("dst")), "dst", "left_semi"))
    number = lambda c: F.floor(F.col(c) / _SHIFT).cast("int")
    weak, strong = wcc(active, edges), scc(active, edges)
    weak_sizes = sizes(weak).withColumn("scenario", number("comp"))
    largest = weak_sizes.groupBy("scenario").agg(F.max("size").alias("largest_wcc"), F.max_by("comp", F.struct("size", -F.col("comp"))).alias("comp"))
    largest_scc = sizes(strong).groupBy(number("comp").alias("scenario")).agg(F.max("size").alias("largest_scc"))
    inside = cut(weak.join(largest.select("comp"), "comp", "left_semi").select("id"))
    own = edges.join(inside.withColumnRenamed("id", "src"), "src", "left_semi")
    v = per_vertex(all_pairs(own, inside)).withColumn("scenario", number("id"))
    far = v.groupBy("scenario").agg(F.coalesce(F.avg(F.when(F.col("avg_dist") >= 0, F.col("avg_dist"))), F.lit(0.0)).alias("avg_distance"), F.greatest(F.max("ecc"), F.lit(0)).alias("diameter"))
    degrees = Graph(active, edges).degrees.groupBy(number("id").alias("scenario")).agg(F.avg("in_deg").alias("avg_in"), F.max("in_deg").alias("max_in"), F.avg("out_deg").alias("avg_out"), F.max("out_deg").alias("max_out"))
    return largest.drop("comp").join(largest_scc, "scenario", "left").join(degrees, "scenario", "left"), far


_MEASURED = "scenario int, largest_wcc long, largest_scc long, avg_in double, max_in long, avg_out double, max_out long, sources binary"


def _in_tasks(ranks: DataFrame, shared: Broadcast, removed: list[int]) -> tuple[DataFrame, DataFrame]:
    """What _by_joins() gives, with the graph in every task."""
    spark = ranks.sparkSession
    rank = np.zeros(len(shared.value.ids), np.int32)
    table = ranks.select("id", "rank").toArrow()
    rank[packed.places(shared.value.ids, table.column("id").to_numpy())[0]] = table.column("rank").to_numpy()
    order = spark.sparkContext.broadcast(rank)
    measured = cut(spark.range(0, len(removed), 1, max(len(removed), 1)).mapInArrow(_measure(shared, order, removed), _MEASURED))
    blocks = measured.filter("sources is not null").select("scenario", "sources").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = blocks.mapInArrow(_search(shared, order, removed), "scenario int, total double, n long, far int")
    far = cut(found.groupBy("scenario").agg((F.sum("total") / F.greatest(F.sum("n"), F.lit(1))).alias("avg_distance"), F.max("far").alias("diameter")))
    order.destroy()
    return measured.filter("sources is null").drop("sources"), far


def _measure(shared: Broadcast, order: Broadcast, removed: list[int]):
    """Of each scenario a row of its components and degrees, and one for each block of its largest weak component's vertices."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[kind]) for n, kind in (x.split() for x in _MEASURED.split(", "))])

    def run(batches):
        g = shared.value
        n = len(g.ids)
        for scenario in (i for b in batches for i in b.column(0).to_pylist()):
            here = order.value > removed[scenario]
            if not here.any():
                continue
            on = here[g.src] & here[g.dst]
            src, dst, row = g.src[on], g.dst[on], {"scenario": scenario}
            for name, ends in (("in", dst), ("out", src)):
                degrees = np.bincount(ends, minlength=n)[here]
                row |= {f"avg_{name}": float(degrees.mean()), f"max_{name}": int(degrees.max())}
            comp = packed.weak(n, src, dst)
            sizes = np.bincount(comp[here], minlength=n)
            row |= {"largest_wcc": int(sizes.max()), "largest_scc": int(np.bincount(packed.strong(n, src, dst)[here]).max())}
            yield pa.RecordBatch.from_pylist([row], schema)
            inside = np.flatnonzero(here & (comp == sizes.argmax())).astype(np.int32)
            for at in range(0, len(inside), _BLOCK):
                yield pa.RecordBatch.from_pylist([{"scenario": scenario, "sources": inside[at : at + _BLOCK].tobytes()}], schema)

    return run


def _search(shared: Broadcast, order: Broadcast, removed: list[int]):
    def run(batches):
        g = shared.value
        for batch in batches:
            for r in batch.to_pylist():
                total, n, far = packed.distances(g.first, g.dst, order.value > removed[r["scenario"]], np.frombuffer(r["sources"], np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([r["scenario"]], pa.int32()), pa.array([total]), pa.array([n]), pa.array([far], pa.int32())], names=["scenario", "total", "n", "far"])

    return run
