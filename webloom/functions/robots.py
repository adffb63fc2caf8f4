"""Robots rules, as the reference semantics have them: user-agent groups are ignored, any Allow wins, an empty Disallow blocks all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pattern_of(path: Column) -> Column:
    """A rule's path as a regular expression: * is anything, $ the end, a prefix unless it ends in $; case doesn't count."""
    escaped = F.regexp_replace(path, r"([\\^.|?+()\[\]{}#&~\s-])", r"\\$1")
    body = F.regexp_replace(escaped, r"\*", ".*")
    return F.concat(F.lit("(?i)^"), body, F.when(path.endswith("$"), F.lit("")).otherwise(F.lit(".*")))


def rules(files: DataFrame) -> DataFrame:
    """(host, kind, path, pattern) from (host, content): a line starts with Allow or Disallow, in that case, in its first column."""
    lines = files.select("host", F.explode(F.split("content", "\n")).alias("line"))
    kind = F.when(F.col("line").startswith("Disallow"), "disallow").when(F.col("line").startswith("Allow"), "allow")
    rest = F.when(kind == "allow", F.expr("substring(line, 7)")).otherwise(F.expr("substring(line, 10)"))
    found = lines.select("host", kind.alias("kind"), F.trim(F.regexp_replace(rest, r"[\r\t]", "")).alias("path")).filter("kind is not null")
    return found.withColumn("pattern", pattern_of(F.col("path")))


def allowed(pages: DataFrame, rule_table: DataFrame, host_col: str = "host", path_col: str = "path") -> DataFrame:
    """pages with a column allowed: no Disallow fits, or an Allow fits; true for hosts without rules."""
    by_host = rule_table.groupBy(F.col("host").alias("_host")).agg(
        F.collect_set(F.when(F.col("kind") == "allow", F.col("pattern"))).alias("_allow"), F.collect_set(F.when(F.col("kind") == "disallow", F.col("pattern"))).alias("_deny")
    )
    joined = pages.join(by_host, F.col(host_col) == F.col("_host"), "left")
    fits = lambda patterns: F.exists(F.coalesce(F.col(patterns), F.array().cast("array<string>")), lambda p: F.regexp_like(F.col(path_col), p))
    return joined.withColumn("allowed", ~fits("_deny") | fits("_allow")).drop("_host", "_allow", "_deny")
