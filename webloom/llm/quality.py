"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and word pairs of folded text are hashed into N_BUCKETS buckets.  The raw model counts them over all documents, the target
model over a bounded sample of documents that are labelled good.  A document's log weight is the sum over its
n-grams of log p_target - log p_raw.  Adding Gumbel noise to the log weights and keeping the k largest samples k documents
without replacement in proportion to their weights.

The k-th largest key is found exactly and without a total sort: keys are counted in bins, then in bins within the bin
that holds the k-th, until the bin is small.

Nulls, ties and odd rows: null and empty texts have weight 0 (no n-grams) and take part; equal keys go to the smaller
id, and of one id's rows to any; a null id has a key of its own, noise drawn for "null"; labels of unknown documents don't count, of
contradictory ones the better counts; without any target the weights are all 0 and sampling is uniform.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, U64, Words, blocks, buffers, materialise, mix, per_text, text_array

N_BUCKETS = 10_000
MAX_TARGET = 20_000
FRACTION = 0.25
SEED = "dsir-1"
_N_BINS = 1024
_SMALL = 2_000


def _ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs, text by text, and each text's first (n + 1)."""
    data, offsets = buffers(texts)
    words = Words(data, offsets, SPACED, fold=True)
    h, n = words.hashes(), words.counts
    pairs = mix(h[:-1] * U64(0xD6E8FEB86659FD93) + h[1:]) if len(h) > 1 else np.zeros(0, U64)
    doc = words.texts_of()
    inside = doc[:-1] == doc[1:]
    grams = np.concatenate([h, pairs[inside]]) % U64(N_BUCKETS)
    of = np.concatenate([doc, doc[:-1][inside]])
    order = np.argsort(of, kind="stable")
    first = np.concatenate([[0], np.cumsum(n + np.maximum(n - 1, 0))])
    return grams[order].astype(np.int64), first


def _counts(target: frozenset):
    schema = pa.schema([("model", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        raw, good = np.zeros(N_BUCKETS, np.int64), np.zeros(N_BUCKETS, np.int64)
        for whole in batches:
            for part in blocks(whole, "text"):
                grams, first = _ngrams(text_array(part, "text"))
                raw += np.bincount(grams, minlength=N_BUCKETS)
                for i, doc in enumerate(part.column(0).to_pylist()):
                    if doc in target:
                        good += np.bincount(grams[first[i] : first[i + 1]], minlength=N_BUCKETS)
        for model, counts in ((0, raw), (1, good)):
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), model, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])], schema=schema)

    return run


def fit(docs: DataFrame, target_ids: list[int], id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log p_target - log p_raw of each bucket."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(frozenset(target_ids))

    def run(batches):
        yield from _counts(known.value)(batches)

    counts = source.mapInArrow(run, "model int, bucket int, n long").groupBy("model", "bucket").agg(F.sum("n").alias("n"))
    table = np.zeros((2, N_BUCKETS))
    for r in counts.collect():  # at most 2 * N_BUCKETS rows
        table[r.model, r.bucket] = r.n
    if not table[1].sum():
        return np.zeros(N_BUCKETS)
    p = (table + 1) / (table.sum(axis=1, keepdims=True) + N_BUCKETS)
    return np.log(p[1]) - np.log(p[0])


def weights(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, log_weight) per row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        for whole in batches:
            for part in blocks(whole, "text"):
                grams, first = _ngrams(text_array(part, "text"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(per_text(shared.value[grams], first, np.add, 0.0))], names=["id", "log_weight"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, log_weight double")


def _kth_largest(keys: DataFrame, k: int, column: str = "key") -> tuple | None:
    """The k-th largest value of a double or long column, and how many rows with exactly that value are among the k; by counting in ever finer bins."""
    whole = dict(keys.dtypes)[column] == "bigint"
    value = F.col(column).cast("decimal(20,0)") if whole else F.col(column)
    lo, hi, n = keys.agg(F.min(column), F.max(column), F.count("*")).first()
    if k <= 0 or not n:
        return None
    left = k = min(k, n)
    while lo < hi:
        width = (hi - lo) // _N_BINS + 1 if whole else (hi - lo) / _N_BINS
        if width <= 0 or lo + width == lo:
            break
        inside = keys.filter((F.col(column) >= lo) & (F.col(column) <= hi))
        bins = inside.groupBy(F.least(F.floor((value - lo) / width).cast("int"), F.lit(_N_BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        for r in sorted(bins.collect(), key=lambda r: -r.bin):
            if r.n >= left:
                lo, hi, n = r.lo, r.hi, r.n
                break
            left -= r.n
        if n <= _SMALL:
            rows = [r[0] for r in keys.filter((F.col(column) >= lo) & (F.col(column) <= hi)).select(column).collect()]
            rows.sort(reverse=True)
            cut = rows[left - 1]
            return cut, left - sum(x > cut for x in rows)
    return hi, left


def resample(weighted: DataFrame, k: int, seed: str = SEED) -> DataFrame:
    """weighted's (id, log_weight) with the Gumbel key and whether the row is among the k largest."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10).cast("double")
    uniform = (bits + 0.5) / F.lit(float(16**13))
    # in the order of: key, largest first; id, smallest first (~id falls as id grows, and never overflows), nulls last; place
    ranked = weighted.select("id", "log_weight", (F.col("log_weight") - F.log(-F.log(uniform))).alias("key"), F.bitwise_not(F.coalesce("id", F.lit(2**63 - 1))).alias("by_id"), F.bitwise_not(F.monotonically_increasing_id()).alias("by_place"))
    keys = materialise(ranked, "gumbel")
    inside, tied, left = F.lit(False), F.lit(True), k
    for column in ("key", "by_id", "by_place"):
        found = _kth_largest(keys.filter(tied), left, column)
        if found is None:
            break
        cut, left = found
        inside, tied = inside | (tied & (F.col(column) > cut)), tied & (F.col(column) == cut)
        if keys.filter(tied).count() == left:
            inside = inside | tied
            break
    return keys.withColumn("selected", inside).drop("by_id", "by_place")


def select_by_quality(docs: DataFrame, labels: DataFrame, fraction: float = FRACTION, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of docs: id, log_weight, key, selected; floor(fraction * rows) rows are selected."""
    good = labels.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("good")).filter("good = 1")
    target = [r[0] for r in good.select(id_col, F.xxhash64(id_col).alias("h")).orderBy("h", id_col).limit(MAX_TARGET).collect()]
    weighted = materialise(weights(docs, fit(docs, target, id_col, text_col), id_col, text_col), "weights")
    return resample(weighted, int(weighted.count() * fraction)).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return select_by_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
