"""Tidy series: what the charts draw and the reports print, as rows (key, x, y)."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _as(value, kind: str) -> Column:
    return (F.col(value) if isinstance(value, str) else F.lit(None) if value is None else value).cast(kind)


def tidy(df: DataFrame, key=None, x=None, y=None, places: int = 6) -> DataFrame:
    """(key, x, y); names of columns or columns, None for null."""
    return df.select(_as(key, "string").alias("key"), F.round(_as(x, "double"), places).alias("x"), F.round(_as(y, "double"), places).alias("y"))


def facts(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """A row for each named column of a one-row result: its name and value."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("y")) for c in columns])).alias("r"))
    return tidy(rows, F.col("r.key"), None, F.col("r.y"), places)


def line(points: DataFrame, fit: DataFrame, x: str = "x", places: int = 6, power: bool = False) -> DataFrame:
    """The fitted line at the points' x; power: 10 to it.  fit is one row (slope, intercept)."""
    y = F.col("slope") * F.col(x) + F.col("intercept")
    return tidy(points.select(x).crossJoin(fit.select("slope", "intercept")).filter("slope is not null"), None, x, F.pow(F.lit(10.0), y) if power else y, places)


def together(parts: dict[str, DataFrame]) -> DataFrame:
    """All series of an analysis in one frame: (part, key, x, y)."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("part"), "key", "x", "y") for name, df in parts.items()])


def path_of(name: str, folder: str = "plots") -> str:
    """Where a series is kept; a folder on this machine is made if it isn't there."""
    if "://" not in folder:
        os.makedirs(folder, exist_ok=True)
    return f"{folder.rstrip('/')}/{name}"


def save(parts: dict[str, DataFrame], folder: str = "plots") -> dict[str, str]:
    """Write each series as Parquet; returns their paths."""
    paths = {name: path_of(name, folder) for name in parts}
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(paths[name])
    return paths
