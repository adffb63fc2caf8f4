"""Degree statistics, histograms and least-squares and maximum-likelihood fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import Graph, cut


def basic(graph: Graph) -> DataFrame:
    """One row: vertices, edges, mean degree, density, degree sums, and the pages of largest degree (lowest id among ties)."""
    d = graph.degrees.join(graph.vertices, "id")
    v = F.count("*")
    out = d.agg(v.alias("v"), F.sum("out_deg").alias("e"), F.sum("in_deg").alias("in_sum"), F.max("in_deg").alias("max_in"), F.max("out_deg").alias("max_out"),
                F.max_by("url", F.struct("in_deg", -F.col("id"))).alias("max_in_url"), F.max_by("url", F.struct("out_deg", -F.col("id"))).alias("max_out_url"), F.count_if(F.col("out_deg") == 0).alias("dangling"))
    return out.withColumns({"avg_degree": F.try_divide(F.col("e"), F.col("v")), "density": F.try_divide(F.col("e").cast("double"), F.col("v") * (F.col("v") - 1))})


def dangling(graph: Graph) -> DataFrame:
    return graph.vertices.join(graph.edges, F.col("id") == F.col("src"), "left_anti").select("id", "url")


def histogram(values: DataFrame, column: str) -> DataFrame:
    return values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def log_histogram(values: DataFrame, column: str) -> DataFrame:
    """Points of the log-log histogram; none if fewer than two positive values differ."""
    h = histogram(values.filter(F.col(column) > 0), column)
    groups = F.count("*").over(Window.partitionBy(F.lit(1)))
    return h.withColumn("groups", groups).filter("groups >= 2").select(F.log10("value").alias("log_k"), F.log10("n").alias("log_n"))


def line(points: DataFrame, x: Column, y: Column) -> DataFrame:
    """One row: slope, intercept, r2 of the least-squares line; nulls for fewer than two points or equal x."""
    return points.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def ccdf(values: DataFrame, column: str) -> DataFrame:
    """(k, log_k, log_ccdf): P(K >= k) among all values, zeros included, for positive k."""
    h = histogram(values, column)
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    above = F.sum("n").over(Window.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0))
    return h.select("value", (above / total).alias("p")).filter("value > 0").select(F.col("value").alias("k"), F.log("value").alias("log_k"), F.log("p").alias("log_ccdf"))


def power_law_ols(values: DataFrame, column: str) -> DataFrame:
    """gamma, r2, slope, intercept of a line through the log CCDF; no row where either side is constant."""
    fit = ccdf(values, column).agg(F.regr_slope("log_ccdf", "log_k").alias("slope"), F.regr_intercept("log_ccdf", "log_k").alias("intercept"), F.regr_r2("log_ccdf", "log_k").alias("r2"), F.regr_syy("log_ccdf", "log_k").alias("syy"))
    return fit.filter("slope is not null and syy > 0").select((1 - F.col("slope")).alias("gamma"), "r2", "slope", "intercept")


def power_law_mle(values: DataFrame, column: str, least_tail: int = 50) -> DataFrame:
    """gamma, ks, x_min, n_tail of the x_min with the smallest Kolmogorov-Smirnov distance; works on the histogram alone.

    Inside a run of equal values the empirical CDF is furthest from the model at the run's first or last value.
    """
    h = cut(histogram(values.filter(F.col(column) > 0), column))  # a row for each distinct value
    # suffix sums give every tail's size and sum of logs in one pass
    behind = Window.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    tails = h.select(F.col("value").alias("x_min"), F.sum("n").over(behind).alias("n_tail"), F.sum(F.col("n") * F.log("value")).over(behind).alias("logs")).filter(F.col("n_tail") >= least_tail)
    # the largest value alone has no spread, whatever rounding leaves of it
    largest = h.agg(F.max("value")).first()[0]
    tails = tails.withColumn("logs", F.when(F.col("x_min") < F.lit(largest), F.col("logs") - F.col("n_tail") * F.log("x_min")).otherwise(0.0))
    tails = tails.withColumn("gamma", F.when(F.col("logs") > 0, 1 + F.try_divide(F.col("n_tail"), F.col("logs"))).otherwise(F.lit(float("inf"))))
    pairs = tails.select("x_min").join(h, F.col("value") >= F.col("x_min"))
    runs = pairs.join(tails, "x_min")
    upto = F.sum("n").over(Window.partitionBy("x_min").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    model = F.when(F.col("logs") > 0, 1 - F.pow(F.col("value") / F.col("x_min"), 1 - F.col("gamma"))).otherwise(F.lit(0.0))
    runs = runs.select("x_min", "n_tail", "gamma", upto.alias("upto"), "n", model.alias("f"))
    gap = F.greatest(F.abs((F.col("upto") - F.col("n") + 1) / F.col("n_tail") - F.col("f")), F.abs(F.col("upto") / F.col("n_tail") - F.col("f")))
    ks = runs.groupBy("x_min", "n_tail", "gamma").agg(F.max(gap).alias("ks"))
    return ks.orderBy(F.round("ks", 12), "x_min").limit(1).select("gamma", "ks", F.col("x_min").cast("double").alias("x_min"), "n_tail")


def tail_cdf(values: DataFrame, column: str, mle: DataFrame) -> DataFrame:
    """(value, empirical, fitted) of the tail that power_law_mle found: the share of the tail up to each value, and the model's."""
    h = histogram(values.filter(F.col(column) > 0), column).crossJoin(mle.select("gamma", "x_min", "n_tail")).filter("value >= x_min")
    upto = F.sum("n").over(Window.partitionBy("x_min").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    model = F.when(F.col("gamma") < float("inf"), 1 - F.pow(F.col("value") / F.col("x_min"), 1 - F.col("gamma"))).otherwise(F.lit(0.0))
    return h.select("value", (upto / F.col("n_tail")).alias("empirical"), model.alias("fitted"))
