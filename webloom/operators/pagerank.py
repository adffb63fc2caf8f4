"""PageRank for several damping factors in one iteration, with all three norms of each step.

The norm only says when to stop, so one run per damping factor serves every norm.  Without max_iter a factor d < 1 runs to convergence, which
takes log(epsilon / 2) / log(d) steps at most; d = 1.0 need not converge (periodic graphs) and ends after ENDLESS steps.

A graph that fits in a task (webloom.packed) is stepped there, a task for each factor; a larger one by a join and an aggregate a step.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import packed
from ..model import Graph, cut, numbered

#: Damping factors of the sweep, and the tolerance.
DAMPINGS = (1.0, 0.99, 0.95, 0.90, 0.85, 0.70, 0.50)
EPSILON = 1e-6
#: Steps after which d = 1.0 counts as not converging.
ENDLESS = 1000


def l1(new: Column, old: Column) -> Column:
    return F.sum(F.abs(new - old))


def l2(new: Column, old: Column) -> Column:
    return F.sqrt(F.sum((new - old) * (new - old)))


def linf(new: Column, old: Column) -> Column:
    return F.max(F.abs(new - old))


NORMS = {"l1": l1, "l2": l2, "linf": linf}


@dataclass
class Run:
    scores: DataFrame  # (d, id, score) when the last norm asked for was met
    trace: list[tuple]  # (d, iter, l1, l2, linf)


def steps_to_run(d: float, epsilon: float = EPSILON) -> int:
    """Steps after which every norm of d < 1 is below epsilon: the L1 change of step k is at most 2 d^k.  ENDLESS for d = 1."""
    return ENDLESS if d >= 1 else 1 if d <= 0 else 2 + math.ceil(math.log(epsilon / 2) / math.log(d))


def pagerank(graph: Graph, dampings=(0.85,), norm: str = "l1", epsilon: float = EPSILON, max_iter: int | None = 100) -> Run:
    """Jacobi steps from 1/V; dangling mass is spread evenly.  A factor stops when its norm falls below epsilon, or after max_iter
    (None: steps_to_run of the factor).

    A vertex has one row with a score for each factor, so a step is one join and one aggregate for all of them.  Links stay dealt by their source and
    kept by the executors (lost ones are read again); only scores move.  Each step's scores are written to the shared folder, as a plan that
    names the last scores twice would double with each step.
    """
    spark = graph.vertices.sparkSession
    n = graph.vertices.count()
    if not n:
        return Run(spark.createDataFrame([], "d double, id long, score double"), [])
    limits = [steps_to_run(float(d), epsilon) if max_iter is None else max_iter for d in dampings]
    shared = packed.of(graph)
    if shared is not None:
        return _in_tasks(spark, shared, [float(d) for d in dampings], limits, norm, epsilon)
    degree = graph.degrees.select("id", "out_deg")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = cut(graph.edges.join(degree.withColumnRenamed("id", "src"), "src").select("src", "dst", (1.0 / F.col("out_deg")).alias("w")))
    links = links.repartition(parts, "src").persist(StorageLevel.MEMORY_AND_DISK)
    base = cut(degree.select("id", (F.col("out_deg") == 0).alias("dangling")))
    running = {f"s{i}": float(d) for i, d in enumerate(dampings)}
    x = base.select("id", "dangling", *[F.lit(1.0 / n).alias(c) for c in running])
    loose = dict.fromkeys(running, base.filter("dangling").count() / n)
    done, trace, i = [], [], 0
    last = dict(zip(running, limits, strict=True))
    while running and i < max(last[c] for c in running):
        i += 1
        got = links.join(x.select(F.col("id").alias("src"), *running), "src").groupBy(F.col("dst").alias("id")).agg(*[F.sum(F.col(c) * F.col("w")).alias(f"got_{c}") for c in running])
        given = lambda c, d: F.lit((1 - d) / n + d * loose[c] / n) + d * F.coalesce(F.col(f"got_{c}"), F.lit(0.0))
        new = x.join(got, "id", "left").select("id", "dangling", *[F.col(c).alias(f"old_{c}") for c in running], *[given(c, d).alias(c) for c, d in running.items()])
        new = cut(new)
        sums = [f(F.col(c), F.col(f"old_{c}")).alias(f"{c}_{k}") for c in running for k, f in NORMS.items()]
        row = new.agg(*sums, *[F.sum(F.when(F.col("dangling"), F.col(c)).otherwise(0.0)).alias(f"{c}_loose") for c in running]).first()
        trace += [(d, i, *[row[f"{c}_{k}"] for k in NORMS]) for c, d in running.items()]
        ended = [c for c in running if row[f"{c}_{norm}"] < epsilon or i >= last[c]]
        done += [cut(new.select(F.lit(running[c]).alias("d"), "id", F.col(c).alias("score"))) for c in ended]
        running = {c: d for c, d in running.items() if c not in ended}
        loose = {c: row[f"{c}_loose"] for c in running}
        x = new.select("id", "dangling", *running)
    links.unpersist()
    done += [cut(x.select(F.lit(d).alias("d"), "id", F.col(c).alias("score"))) for c, d in running.items()]
    return Run(reduce(DataFrame.union, done), trace)


#: Rows of a batch of scores.
_ROWS = 1 << 16
_RANKS = "factor int, d double, iter int, l1 double, l2 double, linf double, id long, score double"


def _in_tasks(spark, shared: Broadcast, dampings: list[float], limits: list[int], norm: str, epsilon: float) -> Run:
    """pagerank() with the graph in every task: a factor's trace and last scores come from one task."""
    if not dampings:
        return Run(spark.createDataFrame([], "d double, id long, score double"), [])
    table = cut(spark.range(0, len(dampings), 1, len(dampings)).mapInArrow(_steps(shared, dampings, limits, norm, epsilon), _RANKS))
    trace = table.filter("iter is not null").select("iter", "factor", "d", "l1", "l2", "linf").collect()
    return Run(table.filter("iter is null").select("d", "id", "score"), [(r.d, r.iter, r.l1, r.l2, r.linf) for r in sorted(trace)])


def _steps(shared: Broadcast, dampings: list[float], limits: list[int], norm: str, epsilon: float):
    schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[kind]) for n, kind in (x.split() for x in _RANKS.split(", "))])

    def run(batches):
        g = shared.value
        n, src, dst = len(g.ids), g.src.astype(np.int64), g.dst.astype(np.int64)
        weight, loose = 1.0 / np.maximum(g.out, 1), g.out == 0
        for factor in (i for b in batches for i in b.column(0).to_pylist()):
            d, x, trace = dampings[factor], np.full(n, 1.0 / n), []
            while len(trace) < limits[factor]:
                new = (1 - d) / n + d * x[loose].sum() / n + d * np.bincount(dst, (x * weight)[src], n)
                step = np.abs(new - x)
                x = new
                trace.append((step.sum(), np.sqrt((step * step).sum()), step.max()))
                if trace[-1][list(NORMS).index(norm)] < epsilon:
                    break
            rows = [{"factor": factor, "d": d, "iter": i, "l1": float(a), "l2": float(b), "linf": float(c)} for i, (a, b, c) in enumerate(trace, 1)]
            yield pa.RecordBatch.from_pylist(rows, schema)
            for at in range(0, n, _ROWS):
                ids = g.ids[at : at + _ROWS]
                fixed = [pa.repeat(pa.scalar(v, kind), len(ids)) for v, kind in ((factor, pa.int32()), (d, pa.float64()))]
                empty = [pa.nulls(len(ids), schema.field(c).type) for c in ("iter", "l1", "l2", "linf")]
                yield pa.RecordBatch.from_arrays([*fixed, *empty, pa.array(ids), pa.array(x[at : at + _ROWS])], schema=schema)

    return run


def only(run: Run, d: float) -> Run:
    """One factor of a run of several."""
    return Run(run.scores.filter(F.col("d") == d), [t for t in run.trace if t[0] == d])


def trace_frame(spark, run: Run) -> DataFrame:
    return spark.createDataFrame(run.trace, "d double, iter int, l1 double, l2 double, linf double")


def sweep(spark, run: Run, epsilon: float = EPSILON) -> DataFrame:
    """(d, norm, iterations, converged): the first step at which each norm is below epsilon, else the last step."""
    t = trace_frame(spark, run).selectExpr("d", "iter", "stack(3, 'l1', l1, 'l2', l2, 'linf', linf) as (norm, err)")
    met = F.min(F.when(F.col("err") < epsilon, F.col("iter")))
    return t.groupBy("d", "norm").agg(F.coalesce(met, F.max("iter")).alias("iterations"), met.isNotNull().alias("converged"))


def top(scores: DataFrame, vertices: DataFrame, n: int = 20) -> DataFrame:
    """(rank, id, url, score): by score, of equal ones the lowest id; then ranked within the n rows."""
    best = scores.orderBy(F.round("score", 12).desc(), "id").limit(n)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 12).desc(), "id")))
    return ranked.join(vertices, "id").select("rank", "id", "url", "score")


def ranked(scores: DataFrame) -> DataFrame:
    """(x, y): log10(rank) and log10(score) of positive scores, highest first."""
    positive = scores.filter("score > 0").select("id", "score")
    return numbered(positive, "rank", F.desc("score"), "id").select(F.log10(F.col("rank").cast("double")).alias("x"), F.log10("score").alias("y"))


def rank_fit(scores: DataFrame) -> DataFrame:
    """Line through log10(score) by log10(rank) of positive scores."""
    return fit(ranked(scores))


def fit(points: DataFrame) -> DataFrame:
    return points.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
