"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

A document's expected copies are its source's target over its source's size.  Within a source, documents are put in
an order (by size class, then by the md5 of the id), expected copies are summed along it, one random offset
is added, and a document is emitted once for each integer boundary its stretch crosses.

The prefix sum is a rank times a constant.  The rank is built from two levels, so that no task sorts a whole
source: each (source, size class) of n documents is cut into ceil(sqrt(n)) ranges of the md5, documents are
ranked inside their range, and ranges are counted and added up.  The largest group is of the order of sqrt(n).

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share `share` of all sizes; no
target exceeds twice its source's size, and the excess is reshared by weight (water-filling, solved in one pass over
the per-source totals, which hold one row per source).

Nulls, ties and odd rows: null or empty text has size 0 and is never taken; a null source is a source of its own, the last;
rows that share an id are told apart by size, then by a hash of the text, and otherwise interchangeable; a null id sorts first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

WEIGHTS = (5, 2, 1)
SEED = "mix-1"
_WORD = r"[^\x20\x09-\x0D]+"


def _md5_of(what: Column) -> Column:
    """The first 32 bits of an md5, as a number."""
    return F.conv(F.substring(F.md5(what.cast("binary")), 1, 8), 16, 10).cast("long")


def size_class(size: Column) -> Column:
    """Eight classes to an octave, in the order of sizes."""
    bits = F.length(F.bin(size))
    return F.when(size < 8, size).otherwise(bits * 8 + F.expr("shiftright(size, length(bin(size)) - 4)") % 8)


def targets(sized: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weight = reduce(lambda c, i: c.when(turn == i, F.lit(float(WEIGHTS[i]))), range(1, len(WEIGHTS)), F.when(turn == 0, F.lit(float(WEIGHTS[0]))))
    w = sized.select("source", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("cap"))
    w = w.withColumn("fill", F.col("cap") / F.col("w"))
    below = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    w = w.select(
        "source", "source_size", "w", "cap", "fill",
        ((F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(below), F.lit(0.0)))).alias("level"),
    )
    # sources fill up in the order of `fill`; the water stands where the first stays below its cap
    w = w.withColumn("water", F.min(F.when(F.col("fill") > F.col("level"), F.struct("fill", "level"))).over(every)["level"])
    return w.select("source", "source_size", F.when(F.col("water").isNull() | (F.col("fill") <= F.col("water")), F.col("cap")).otherwise(F.col("water") * F.col("w")).alias("target"))


def _mixed(docs: DataFrame, row: Column, id_col: str, text_col: str, source_col: str, share: float, seed: str) -> DataFrame:
    """One row per row of docs: row, id, size, source_size, target, taken, copies."""
    key = _md5_of(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    sized = docs.select(row.alias("row"), F.xxhash64(F.col(text_col)).alias("text"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD)), F.lit(0)).cast("long").alias("size"))
    sized = materialise(sized.select("row", "text", "id", "source", "size", size_class(F.col("size")).cast("int").alias("class"), key.alias("key")), "sizes")

    classes = materialise(sized.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "size-classes")
    goal = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), share)
    offset = _md5_of(F.concat(F.lit(f"{seed}:offset:"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))) / F.lit(4294967296.0)
    goal = materialise(goal.select("source", "source_size", "target", offset.alias("offset")), "targets")
    ways = classes.select(F.col("source").alias("s2"), F.col("class").alias("c2"), F.ceil(F.sqrt("n")).cast("long").alias("ways"))

    placed = sized.join(ways, F.col("source").eqNullSafe(F.col("s2")) & (F.col("class") == F.col("c2")))
    placed = placed.select("row", "text", "id", "source", "size", "class", "key", F.floor(F.col("key") * F.col("ways") / F.lit(4294967296.0)).alias("range"))
    groups = placed.groupBy("source", "class", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("class", "range").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.select("source", "class", "range", F.coalesce(before, F.lit(0)).alias("before"))
    groups = groups.join(goal.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    own = F.row_number().over(Window.partitionBy("source", "class", "range").orderBy("key", "id", "size", "text"))
    ranked = placed.withColumn("own", own).alias("p").join(groups.alias("g"), F.expr("p.source <=> g.source AND p.class = g.class AND p.range = g.range"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("before") + F.col("own")
    copies = F.least(F.floor(rank * rate + F.col("offset")) - F.floor((rank - 1) * rate + F.col("offset")), F.lit(2))
    return ranked.select("row", F.col("p.id").alias("id"), "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("int").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, seed: str = SEED) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken, copies."""
    return _mixed(docs, F.lit(None).cast("long"), id_col, text_col, source_col, share, seed).drop("row").withColumnRenamed("id", id_col)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, seed: str = SEED) -> DataFrame:
    """The mix itself: docs' columns, each row as often as it is taken, with the copy's number in mix_copy (with underscores behind it where docs has
    such a column).  Each row is taken by itself, whatever its id: docs are written once more with a key for each."""
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own = materialise(flat.withColumn("row", F.monotonically_increasing_id()), "keyed-docs")
    named = own.select("row", *[F.col(f"c{docs.columns.index(c)}").alias(n) for n, c in (("doc", id_col), ("body", text_col), ("origin", source_col))])
    taken = _mixed(named, F.col("row"), "doc", "body", "origin", share, seed).filter("copies > 0 and size > 0").select("row", F.expr("sequence(1, copies)").alias("numbers"))
    copy = "mix_copy"
    while copy in (c.lower() for c in docs.columns):
        copy += "_"
    return own.join(taken, "row").select(*flat.columns, F.explode("numbers").alias("number")).toDF(*docs.columns, copy)


#: DuckDB SQL of mix() over a relation `docs(doc_id, text, source)`; ranks by one sort instead of two levels.
MIX_SQL = r"""
sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS key
  FROM docs),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM totals),
filled AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS fill FROM weighed),
water AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM totals)::DOUBLE
             - coalesce((SELECT sum(b.cap) FROM filled b WHERE (b.fill, coalesce(b.source, chr(1114111))) < (a.fill, coalesce(a.source, chr(1114111)))), 0))
            / (SELECT sum(w) FROM filled b WHERE (b.fill, coalesce(b.source, chr(1114111))) >= (a.fill, coalesce(a.source, chr(1114111)))) AS level
  FROM filled a),
stand AS (SELECT min_by(level, fill) AS stand FROM water WHERE fill > level),
goals AS (
  SELECT source, source_size, CASE WHEN stand IS NULL OR fill <= stand THEN cap ELSE stand * w END AS target,
         ('0x' || substr(md5('mix-1:offset:' || coalesce('=' || source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM water, stand),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY
    CASE WHEN size < 8 THEN size ELSE length(bin(size)) * 8 + (size >> (length(bin(size)) - 4)::BIGINT) % 8 END, key, doc_id NULLS FIRST, size) AS r
  FROM sized),
mixed AS (
  SELECT doc_id, size, source_size, target,
         least(CASE WHEN source_size > 0 THEN floor(r * (target / source_size) + u) - floor((r - 1) * (target / source_size) + u) ELSE 0 END, 2)::INTEGER AS copies
  FROM ranked JOIN goals ON ranked.source IS NOT DISTINCT FROM goals.source)
"""
ORACLE = f"WITH docs AS (SELECT * FROM documents), {MIX_SQL} SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM mixed"


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return mix(read(spark, sf_dir, "documents"))
