"""The graph: vertices(id, url) and edges(src, dst), and how to get one from crawl rows or from a relation."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

CRAWL_SCHEMA = T.StructType([T.StructField("Url", T.StringType(), False), T.StructField("OutLinks", T.ArrayType(T.StringType()))])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temp folder of our own where all run on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("webloom.shared.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir isn't set: executors of a cluster need a folder that all of them share")
        root = "file://" + tempfile.mkdtemp(prefix="webloom-")
        spark.conf.set("webloom.shared.dir", root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Run df and cut its lineage: a table in the shared folder, removed when the application ends.

    A table and not checkpoint(), which keeps plan properties that grow with each round of a fixpoint.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webloom-graph-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already; the folder is the cluster's to clear then
        pass


def numbered(df: DataFrame, name: str, *order, start: int = 1) -> DataFrame:
    """df with the row's number in this (total) order, by no task that sees all rows: rows are dealt by range and sorted inside each
    partition, and each partition begins where the earlier ones, of which only the sizes are collected, end."""
    at = F.monotonically_increasing_id().alias("_at")
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", at))
    part, nth = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    begin, offsets = start, []
    for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        offsets.append((r.part, begin))
        begin += r.n
    if not offsets:
        return placed.select(*df.columns, F.col("_at").alias(name))
    known = df.sparkSession.createDataFrame(offsets, "_part long, _begin long")
    return placed.join(F.broadcast(known), part == F.col("_part")).select(*df.columns, (F.col("_begin") + nth).alias(name))


def running_sums(df: DataFrame, name: str, value: str, *order) -> DataFrame:
    """df with the sum of `value` over all earlier rows in this (total) order, dealt by range as numbered() is, so that no task sees a whole group."""
    at = F.monotonically_increasing_id().alias("_at")
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", at).withColumn("_part", F.shiftright("_at", 33)))
    begin, offsets = 0, []
    for r in placed.groupBy("_part").agg(F.sum(value).alias("total")).orderBy("_part").collect():
        offsets.append((r["_part"], begin))
        begin += r.total
    earlier = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = df.sparkSession.createDataFrame(offsets, "_part long, _begin long")
    return placed.withColumn("_earlier", earlier).join(F.broadcast(known), "_part").select(*df.columns, (F.col("_begin") + F.col("_earlier")).alias(name))


class Levels:
    """The rows that a search has seen, level by level.  Tables of like age are merged as a binary counter carries: a row is rewritten as often
    as the logarithm of the number of levels says, and a plan over all rows has no more scans than that."""

    def __init__(self, first: DataFrame):
        self.tables = [(0, first)]

    def add(self, level: DataFrame) -> None:
        age = 0
        while self.tables and self.tables[-1][0] == age:
            level = cut(self.tables.pop()[1].unionByName(level))
            age += 1
        self.tables.append((age, level))

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [t for _, t in self.tables])


@dataclass
class Graph:
    """edges are distinct; self-loops stay.  Degrees and distances are computed once and kept."""

    vertices: DataFrame
    edges: DataFrame
    kept: dict = field(default_factory=dict)

    @cached_property
    def degrees(self) -> DataFrame:
        """(id, in_deg, out_deg) of every vertex."""
        outs = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_deg"))
        ins = self.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_deg"))
        joined = self.vertices.select("id").join(ins, "id", "left").join(outs, "id", "left")
        return joined.select("id", F.coalesce("in_deg", F.lit(0)).alias("in_deg"), F.coalesce("out_deg", F.lit(0)).alias("out_deg"))

    def once(self, name: str, make) -> DataFrame:
        if name not in self.kept:
            self.kept[name] = make()
        return self.kept[name]


def from_crawl(rows: DataFrame) -> Graph:
    """Vertices are the crawled urls, numbered from 0 by url; links to other urls are dropped, repeated ones merge."""
    pages = rows.dropDuplicates(["Url"])
    vertices = cut(numbered(pages.select(F.col("Url").alias("url")), "id", "url", start=0).select("id", "url"))
    links = pages.select("Url", F.explode("OutLinks").alias("link")).distinct()
    src, dst = vertices.select(F.col("id").alias("src"), F.col("url").alias("Url")), vertices.select(F.col("id").alias("dst"), F.col("url").alias("link"))
    return Graph(vertices, cut(links.join(src, "Url").join(dst, "link").select("src", "dst")))


def from_edges(edges: DataFrame) -> Graph:
    """A graph of the endpoints of edges(src, dst), which keep their keys as ids."""
    edges = cut(edges.distinct())
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return Graph(cut(ids.select("id", F.col("id").cast("string").alias("url"))), edges)


def part_sequence(spark: SparkSession, sf_dir: str, key: str = "l_partkey", least: float = 40) -> Graph:
    """Consecutive keys inside an order, of lines with at least that quantity."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter(F.col("l_quantity") >= least)
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", key)
    pairs = lines.select(F.col(key).alias("src"), F.lead(key).over(w).alias("dst"))
    return from_edges(pairs.filter("dst is not null"))
