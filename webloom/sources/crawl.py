"""Crawl rows: JSON source and sink, and the crawl of stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import robots, urls
from ..model import CRAWL_SCHEMA, Levels, cut, numbered


def save_json(rows: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines in a folder; single: one indented JSON array in one file of that folder, in the order of Url, streamed through one task row by row."""
    if not single:
        rows.write.mode("overwrite").json(path)
        return
    text = F.to_json(F.struct("Url", "OutLinks"), {"pretty": "true"})
    placed = cut(numbered(rows.select("Url", text.alias("text")), "n", "Url", "text"))
    lines = placed.select("n", F.concat(F.when(F.col("n") > 1, ",").otherwise(F.lit("")), F.col("text")).alias("value"))
    ends = rows.sparkSession.createDataFrame([(0, "["), (2**62, "]")], "n long, value string")
    lines.union(ends).orderBy("n").select("value").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Rows of a JSON array or of JSON lines; a missing path or a broken file is an error."""
    return spark.read.schema(CRAWL_SCHEMA).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)


def crawl(links: DataFrame, seed, max_pages: int | None = 1000, pages: DataFrame | None = None) -> DataFrame:
    """(url, level) of a breadth-first crawl over stored links(src, dst) from `seed`.

    A url enters the frontier once; pages(url), if given, are the ones that can be fetched.  Exactly the first max_pages by (level, url) are
    kept, so the crawl stops at the level at which that many are known; with None it goes on to the last reachable page.
    """
    spark = links.sparkSession
    kind = links.schema["src"].dataType
    front = spark.createDataFrame([(seed,)], "url " + kind.simpleString())
    front = cut(front if pages is None else front.join(pages.select("url"), "url", "left_semi"))
    seen, n, level = Levels(front.withColumn("level", F.lit(0))), front.count(), 0
    while max_pages is None or n < max_pages:
        level += 1
        reached = links.join(front.withColumnRenamed("url", "src"), "src").select(F.col("dst").alias("url")).distinct().join(seen.rows(), "url", "left_anti")
        front = cut(reached if pages is None else reached.join(pages.select("url"), "url", "left_semi"))
        found = front.count()
        if not found:
            break
        n += found
        seen.add(front.withColumn("level", F.lit(level)))
    return seen.rows() if max_pages is None else seen.rows().orderBy("level", "url").limit(max_pages)


def robots_of(hosts: DataFrame, files: DataFrame) -> DataFrame:
    """(host, content) of the hosts; content is null, and everything allowed, where files(host, content) has none."""
    return hosts.select("host").distinct().join(files.select("host", "content"), "host", "left")


def crawl_site(pages: DataFrame, files: DataFrame, seed: str, max_pages: int | None = 1000) -> DataFrame:
    """Crawl rows (Url, OutLinks, level) of one host over stored pages(url, html, and if known status, content_type) and robots files(host, content).

    A page counts if its status is 2xx (or unknown), its content type has text/html (or is unknown) and it has content; a url is fetched if the robots
    rules allow it; links to the seed's host go on, in the page's order, repeated ones kept.  A disallowed url may still be an out-link.
    """
    spark = pages.sparkSession
    start = urls.normalize_url(seed, None)
    if start is None:
        raise ValueError(f"not a url that can be crawled: {seed}")
    host = urls.host_of(start)
    own = pages.filter(F.col("html").isNotNull())
    if "status" in pages.columns:
        own = own.filter(F.col("status").isNull() | F.col("status").between(200, 299))
    if "content_type" in pages.columns:
        own = own.filter(F.col("content_type").isNull() | F.col("content_type").contains("text/html"))
    own = own.filter(urls.domain(F.trim("url")) == host).select(urls.normalize(F.col("url"), F.lit(None).cast("string")).alias("Url"), "html").filter("Url is not null")
    found = urls.extract_links(own.select("Url", "html"), "Url").select("Url", F.filter("OutLinks", lambda x: urls.domain(x) == host).alias("OutLinks"))
    rules = robots.rules(robots_of(spark.createDataFrame([(host,)], "host string"), files))
    path = F.coalesce(F.nullif(F.regexp_extract("Url", r"^[a-z]+://[^/?]+(.*)$", 1), F.lit("")), F.lit("/"))
    allowed = robots.allowed(found.select("*", F.lit(host).alias("host"), path.alias("path")), rules).filter("allowed")
    stored = cut(allowed.dropDuplicates(["Url"]).select("Url", "OutLinks"))
    links = stored.select(F.col("Url").alias("src"), F.explode("OutLinks").alias("dst")).distinct()
    order = crawl(links, start, max_pages, stored.select(F.col("Url").alias("url")))
    return cut(stored.join(order.withColumnRenamed("url", "Url"), "Url"))


def schedule(frontier: DataFrame, delay_seconds: float = 1.0, host_col: str = "host", url_col: str = "url") -> DataFrame:
    """When each url may be requested: starts of one host are delay_seconds apart, hosts don't wait for each other."""
    turn = F.row_number().over(Window.partitionBy(host_col).orderBy(url_col)) - 1
    return frontier.withColumn("start_s", turn * F.lit(float(delay_seconds)))
