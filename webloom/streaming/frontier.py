"""The frontier of a live crawl as a stream: each url goes out once, and requests to one host keep their distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def frontier(links: DataFrame, horizon: str = "1 day") -> DataFrame:
    """(url, host, seen) from a stream of links(url, seen): canonical urls, each once.  State is kept for `horizon`; a url that comes
    again later than that goes out again, as a page that is due."""
    canonical = links.select(urls.normalize(F.col("url"), F.lit(None).cast("string")).alias("url"), "seen").filter("url is not null")
    return canonical.withWatermark("seen", horizon).dropDuplicatesWithinWatermark(["url"]).select("url", urls.domain(F.col("url")).alias("host"), "seen")


def load(requests: DataFrame, window: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """(host, start, n): requests by host and window of time, for a stream of (host, seen); rows later than `late` are left out."""
    counted = requests.withWatermark("seen", late).groupBy("host", F.window("seen", window)).agg(F.count("*").alias("n"))
    return counted.select("host", F.col("window.start").alias("start"), "n")
