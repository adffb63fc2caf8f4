"""MinHash near-dedup by min-max hashing.

Each permutation is evaluated once per shingle and gives two signature values, its minimum
and its maximum, so 48 evaluations give 96 values.  They are cut into 24 bands of four
values (two minima and two maxima of different permutations); documents that agree in a
band share a bucket.  At a Jaccard similarity of 0.8 a pair shares no bucket with a
probability of (1 - 0.8**4)**24 = 3e-6.

Equal shingle sets are first collapsed into a class with one representative.  Within a
bucket no pairs are listed: members are compared with the bucket's leader, the member whose buckets are the
largest (of a group of near copies, one near its middle).  Members of buckets that hold several components
after that are joined on the rare shingles that a similar enough pair must share (prefix and position
filters, which lose no link), and only across components.
Links are confirmed on whole shingle sets (64-bit shingle hashes).

Nulls, ties and odd rows: null text, empty text and text without words have an empty set
and are linked with nothing.  Rows sharing a doc_id count as one document.  Rows with a null
doc_id are linked with nothing (component null, kept).  Extra columns are ignored by near_duplicates() and pass through keep_one() untouched.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLOCK_BYTES, U64, Words, blocks, buffers, materialise, mix, per_text, text_array

N_PERMUTATIONS = 48
N_BANDS = 24
PER_BAND = 4

_rng = np.random.default_rng(97)
_MUL = _rng.integers(1, 2**64, N_PERMUTATIONS, dtype=U64) | U64(1)
_ADD = _rng.integers(0, 2**64, N_PERMUTATIONS, dtype=U64)
_COMBINE = _rng.integers(1, 2**64, (N_BANDS, PER_BAND), dtype=U64) | U64(1)
#: Rows 2p and 2p + 1 of a signature are minimum and maximum of permutation p; a band takes four permutations' values.
_TAKE = np.array([[2 * ((2 * b + i) % N_PERMUTATIONS if i < 2 else (2 * b + i + 22) % N_PERMUTATIONS) + (i >= 2) for i in range(PER_BAND)] for b in range(N_BANDS)])


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, one after the other, and each text's first (n + 1).

    A text of fewer words than `width`, but not none, has its whole word sequence as one shingle.
    """
    data, offsets = buffers(texts)
    words = Words(data, offsets, fold=True)
    h, n = words.hashes(), words.counts
    out_n = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(out_n)]).astype(np.int64)
    out = np.empty(first[-1], U64)
    # positions of full shingles: all word positions but the last width - 1 of each text
    full = np.flatnonzero(n >= width)
    if len(full):
        total = np.zeros(len(h) - width + 1, U64)
        for i in range(width):
            total = total * U64(0xD6E8FEB86659FD93) + h[i : i + len(total)]
        doc = np.repeat(full, out_n[full])
        within = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(out_n[full])[:-1]]), out_n[full])
        out[first[doc] + within] = mix(total[words.first[doc] + within])
    for d in np.flatnonzero((n > 0) & (n < width)):
        value = U64(0x51ED270B * int(n[d]))
        for x in h[words.first[d] : words.first[d + 1]]:
            value = U64((int(value) * 0xD6E8FEB86659FD93 + int(x)) % 2**64)
        out[first[d]] = mix(np.array([value], U64))[0]
    return out, first


def band_keys(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The band keys of each text: n x N_BANDS; rows of texts without shingles mean nothing."""
    n = len(first) - 1
    signature = np.empty((2 * N_PERMUTATIONS, n), U64)
    for p in range(N_PERMUTATIONS):
        x = shingles * _MUL[p]
        x += _ADD[p]
        x ^= x >> U64(32)
        signature[2 * p] = per_text(x, first, np.minimum, 0)
        signature[2 * p + 1] = per_text(x, first, np.maximum, 0)
    keys = np.empty((n, N_BANDS), U64)
    for b in range(N_BANDS):
        keys[:, b] = mix(sum((mix(signature[_TAKE[b, i]]) * _COMBINE[b, i] for i in range(PER_BAND)), U64(b)))
    return keys


def _signatures(width: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for whole in batches:
            for part in blocks(whole, "text", BLOCK_BYTES):
                shingles, first = shingle_sets(text_array(part, "text"), width)
                n = len(first) - 1
                size, k1, k2 = np.zeros(n, np.int64), np.zeros(n, U64), np.zeros(n, U64)
                for d in range(n):
                    if first[d] < first[d + 1]:
                        own = np.unique(shingles[first[d] : first[d + 1]])
                        size[d], k1[d], k2[d] = len(own), own.sum(), mix(own ^ U64(0xA5A5A5A5A5A5A5A5)).sum()
                keys = band_keys(shingles, first).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * N_BANDS + 1, N_BANDS, dtype=np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(size), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), lists], schema=schema)

    return run


def _sets(width: int):
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for whole in batches:
            for part in blocks(whole, "text", BLOCK_BYTES):
                shingles, first = shingle_sets(text_array(part, "text"), width)
                own = [np.unique(shingles[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
                at = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                values = pa.array(np.concatenate(own) if own else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(at), values)], schema=schema)

    return run


def components(links: DataFrame, tag: str = "cc") -> DataFrame:
    """(id, comp) for every id of links(a, b): comp is the smallest id that can be reached.

    Smallest label of the neighbours, then a jump to the label's own label, until nothing changes;
    all of it as joins and aggregates over tables in the shared folder.
    """
    edges = materialise(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), f"{tag}-edges")
    labels = materialise(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("comp")), f"{tag}-labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.min("comp").alias("near"))
        lower = labels.join(near.withColumnRenamed("u", "id"), "id", "left").select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        after = materialise(lower.join(jump, "comp", "left").select("id", "was", F.least("comp", "next").alias("comp")), f"{tag}-labels")
        labels = after.select("id", "comp")
        if after.filter(F.col("was") != F.col("comp")).isEmpty():
            return labels


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose whole sets have 100 * intersection >= percent * union."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = both.filter(100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb")))
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _prefix_pairs(unsettled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs(a, b) of unsettled(id, comp) in different components that may reach the similarity; none that does is left out.

    Shingles are put in one order, rarest first.  Sets that are similar enough share a shingle among the first (100 - percent)
    percent of each, and behind their first common one enough must be left in both.
    """
    # text and n are computed under the explode: once a set, not once a shingle
    rows = sets.join(unsettled, "id").withColumn("text", F.xxhash64("shingles")).withColumn("n", F.size("shingles"))
    rows = rows.select("id", "comp", "text", "n", F.explode("shingles").alias("shingle"))
    # aggregates that meet their own rows are tables of their own, so that the adaptive skew join can split a hot key
    frequency = materialise(rows.groupBy("shingle").agg(F.count("*").alias("df")), "frequency")
    # rows of one id and one text share their ranks
    ranked = rows.join(frequency, "shingle").withColumn("at", F.dense_rank().over(Window.partitionBy("id", "text").orderBy("df", "shingle")) - 1)
    prefix = ranked.filter((F.col("df") > 1) & (F.col("at") * 100 <= F.col("n") * (100 - percent))).select("shingle", "id", "comp", "n", "at")
    prefix = materialise(prefix, "prefix")
    # a pair of two components has a side outside the shingle's most frequent one, so copies already linked never meet
    usual = prefix.groupBy("shingle", "comp").agg(F.count("*").alias("m")).groupBy("shingle").agg(F.max(F.struct("m", "comp"))["comp"].alias("usual"), F.count("*").alias("comps"))
    usual = materialise(usual.filter(F.col("comps") > 1).drop("comps"), "usual")
    several = materialise(prefix.join(usual, "shingle"), "prefix")
    one = several.filter(F.col("comp") != F.col("usual")).select("shingle", *[F.col(c).alias(f"{c}_1") for c in ("id", "comp", "n", "at")])
    n, n_1 = F.col("n"), F.col("n_1")
    once = (F.col("comp") == F.col("usual")) | (F.col("id_1") < F.col("id"))
    near = 100 * F.least(n, n_1) >= percent * F.greatest(n, n_1)
    enough = (100 + percent) * F.least(n - F.col("at"), n_1 - F.col("at_1")) >= percent * (n + n_1)
    met = several.alias("s").join(one, (F.col("s.shingle") == one.shingle) & (F.col("comp") != F.col("comp_1")) & once & near & enough)
    return met.select(F.greatest("id", "id_1").alias("a"), F.least("id", "id_1").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: (doc_id, n_shingles, component_id, kept)."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = materialise(source.mapInArrow(_signatures(width), "id long, n long, k1 long, k2 long, bands array<long>"), "signatures")
    able = sig.filter((F.col("n") > 0) & F.col("id").isNotNull())
    classes = materialise(able.groupBy("k1", "k2").agg(F.min("id").alias("rep")), "classes")
    member = materialise(able.select("id", "n", "k1", "k2").join(classes, ["k1", "k2"]).select("id", "n", "rep"), "classes")
    # A document with several classes (rows sharing its id) ties them together.
    ties = member.filter(F.col("id") != F.col("rep")).select(F.col("id").alias("a"), F.col("rep").alias("b"))

    reps = able.join(classes, ["k1", "k2"]).filter(F.col("id") == F.col("rep")).select("id", "bands")
    buckets = reps.select("id", F.explode("bands").alias("bucket"))
    shared = materialise(buckets.groupBy("bucket").agg(F.count("*").alias("size")).filter(F.col("size") > 1), "shared")
    members = materialise(buckets.join(shared, "bucket"), "buckets")
    popular = members.groupBy("id").agg(F.sum("size").alias("weight"))
    lead = members.join(popular, "id").groupBy("bucket").agg((-F.max(F.struct("weight", (-F.col("id")).alias("minus")))["minus"]).alias("leader"))
    lead = materialise(lead, "leaders")
    pairs = members.join(lead, "bucket").filter(F.col("id") != F.col("leader")).select(F.greatest("id", "leader").alias("a"), F.least("id", "leader").alias("b"))
    pairs = materialise(pairs.distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = source.join(wanted.hint("shuffle_hash"), "id", "left_semi").mapInArrow(_sets(width), "id long, shingles array<long>")
    sets = materialise(sets, "sets")
    linked = [materialise(_verified(pairs, sets, percent), "links")]
    comp = components(linked[0])

    named = members.select("bucket", "id").join(comp, "id", "left").select("bucket", "id", F.coalesce("comp", "id").alias("comp"))
    mixed = named.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter(F.col("lo") < F.col("hi")).select("bucket")
    unsettled = materialise(named.join(mixed, "bucket").select("id", "comp").distinct(), "unsettled")
    found = materialise(_prefix_pairs(unsettled, sets, percent).join(pairs, ["a", "b"], "left_anti"), "pairs")
    links = materialise(_verified(found, sets, percent), "links")
    if not links.isEmpty():
        linked.append(links)
        comp = components(reduce(DataFrame.union, linked))
    tied = ties.join(member.select(F.col("id").alias("a"), F.col("rep").alias("other")), "a").filter(F.col("b") != F.col("other")).select("a", "b")
    if not tied.isEmpty():
        linked.append(tied)
        comp = components(reduce(DataFrame.union, linked))

    named = member.select("id", "rep").distinct().join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("comp", "rep").alias("comp"))
    named = materialise(named.groupBy("id").agg(F.min("comp").alias("comp")), "named")
    out = sig.select("id", "n").join(named, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("comp", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: of each component, the document with the smallest id."""
    gone = near_duplicates(docs, id_col, text_col, width, percent).filter(~F.col("kept")).select(id_col)
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return near_duplicates(read(spark, sf_dir, "documents"), width=4, percent=80)


_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_FOLD}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT r, md5_number(array_to_string(w[n : n + least(len(w), 4) - 1], ' ')) AS s FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS n FROM d WHERE len(w) > 0)),
size AS MATERIALIZED (SELECT r, count(*) AS n FROM sh GROUP BY r),
-- equal sets are one class, so that copies don't pair with each other
class AS MATERIALIZED (SELECT r, min(r) OVER (PARTITION BY n, total) AS c FROM (SELECT sh.r, any_value(size.n) AS n, sum(hash(s)) AS total FROM sh JOIN size USING (r) GROUP BY sh.r)),
rep AS MATERIALIZED (SELECT sh.r, s FROM sh JOIN class ON class.r = sh.r AND class.c = class.r),
pair AS MATERIALIZED (SELECT a.r AS a, b.r AS b, count(*) AS common FROM rep a JOIN rep b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
link AS MATERIALIZED (SELECT a, b FROM pair JOIN size x ON x.r = a JOIN size y ON y.r = b WHERE 100 * common >= 80 * (x.n + y.n - common)
  UNION SELECT r, c FROM class WHERE r <> c),
named AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM link JOIN d x ON x.r = a JOIN d y ON y.r = b WHERE x.doc_id IS NOT NULL AND y.doc_id IS NOT NULL),
e AS MATERIALIZED (SELECT a, b FROM named UNION SELECT b, a FROM named),
w(id, comp) USING KEY (id) AS (SELECT DISTINCT doc_id, doc_id FROM d WHERE doc_id IS NOT NULL UNION
  SELECT r.id, min(w.comp) FROM w JOIN e ON e.a = w.id JOIN recurring.w AS r ON r.id = e.b WHERE w.comp < r.comp GROUP BY r.id)
SELECT doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles, w.comp AS component_id, coalesce(w.comp = doc_id, true) AS kept
FROM d LEFT JOIN size USING (r) LEFT JOIN w ON w.id = doc_id
"""
