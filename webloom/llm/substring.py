"""Substring dedup by super-k-mer partitioning.

A window is 50 consecutive words of one document.  Its minimiser is the smallest hash of the
4-word grams in it; consecutive windows with the same minimiser form a super-k-mer.  Equal windows have equal
minimisers, so super-k-mers that share a window meet where their minimiser sends them; there sorting
their windows finds, for each, the smallest document it starts in.

Flow, with no task that gathers an unbounded group:

1. documents are packed into chunks of a few megabytes, written to the shared folder; each chunk names its
   distinct super-k-mers by a 128-bit hash, with minimiser and smallest document;
2. equal super-k-mers of all chunks are added up to one, with the smallest document of all (partial aggregation of fixed-width rows, so a passage
   that a third of all documents share is one row a task); one chunk is its representative;
3. minimisers with several different super-k-mers are those whose windows need comparing.  Representatives send them, packed as strings, to the
   minimiser's bucket.  The super-k-mers of a heavy minimiser (HEAVY_BYTES of different strings around one common gram) are cut
   by a second minimiser, of LONG_GRAM-word grams, so that they spread over many buckets;
4. a bucket sorts its windows and answers, for super-k-mers, with runs of windows that start in a smaller document elsewhere;
5. answers go to the chunks that have the super-k-mer, and each chunk cuts the covered words from its documents.

The number of buckets follows from the measured bytes that travel, so a bucket's size stays the same at any scale.
Windows are compared by two independent 64-bit hashes of the word sequence (sorted by the first, checked by
the second; a bucket in which the two disagree is sorted again by its strings).

Nulls, ties and odd rows: null text has no words; text of fewer than 50 words is never cut; a null doc_id counts
as larger than all others; rows that share a doc_id count as the same document, so they don't cut each other.
All input columns pass through, whatever they are called.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACED, U64, Words, blocks, buffers, limit_arrow_batches, materialise, mix, run_hashes, span_hashes, text_array, tidy
from .letters import ranges

GRAM, LONG_GRAM = 4, 16
CHUNK_BYTES = 1 << 20
BUCKET_BYTES = 4 << 20
#: Bytes of different super-k-mers of one minimiser from which a second one cuts them.
HEAVY_BYTES = 1 << 18
NO_ID = np.iinfo(np.int64).max
_Q = {11: 0xD1B54A32D192ED03, 12: 0x94D049BB133111EB}


# ------------------------------------------------------------------------ chunks


def _pack(text_col: str):
    schema = pa.schema([("chunk", pa.int64()), ("blob", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for piece in blocks(whole, text_col, CHUNK_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in piece.columns], schema=piece.schema))
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=schema)
                number += 1

    return run


def _unpack(blob: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(blob).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)


def _ids(batch: pa.RecordBatch, id_col: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def minimisers(h: np.ndarray, at: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The smallest hash of the grams in the window that starts at each of `at`, from word hashes h."""
    gram = min(gram, window)
    span = window - gram + 1
    low, step = run_hashes(h, gram), 1
    n = len(low) - span + 1
    while 2 * step <= span:
        low = np.minimum(low[: len(low) - step], low[step:])
        step *= 2
    return np.minimum(low[:n], low[span - step : span - step + n])[at]


def stretches(*values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the stretches over which all of these stay the same."""
    new = np.ones(len(values[0]), bool)
    new[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in values])
    begin = np.flatnonzero(new)
    return begin, np.diff(np.concatenate([begin, [len(new)]]))


class Chunk:
    """The words of a chunk, their normalised text, its super-k-mers (first word, windows, document, minimiser) and the distinct ones among them."""

    def __init__(self, batch: pa.RecordBatch, id_col: str, text_col: str, window: int):
        self.ids = _ids(batch, id_col)
        data, offsets = buffers(text_array(batch, text_col))
        words = Words(data, offsets)
        self.first, self.window = words.first, window
        keep = SPACED[data]
        after = np.zeros(len(data), bool)
        after[words.ends[words.ends < len(data)]] = True
        # a word that ends where the next text starts has no white space behind it to stand for the separator
        text = np.where(keep, data, np.uint8(32))
        place = np.concatenate([[0], np.cumsum(keep | after)])
        self.data = text[keep | after]
        self.text = self.data.tobytes()
        self.starts, self.ends = place[words.starts], place[words.ends]
        self.hashes = words.hashes()
        n = np.maximum(np.diff(self.first) - window + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        at = ranges(self.first[:-1], n)
        value = minimisers(self.hashes, at, window, GRAM) if len(at) else np.zeros(0, U64)
        begin, self.length = stretches(value, doc) if len(at) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.at, self.doc, minimiser = at[begin], doc[begin], value[begin]
        self.end = self.at + self.length + window - 1
        # the distinct ones, by hashes of their bytes
        a, b = self.starts[self.at], self.ends[self.end - 1]
        k1, k2 = (span_hashes(lambda x, y, add=add: self.data[x:y] * U64(0x9E3779B97F4A7C15) + U64(add), a, b, base) for add, base in ((1, _Q[11]), (77, _Q[12])))
        order = np.lexsort((k2, k1))
        edge, many = stretches(k1[order], k2[order]) if len(order) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.repeat(np.arange(len(edge)), many)
        self.example = order[edge]
        self.k1, self.k2, self.minimiser = k1[self.example].view(np.int64), k2[self.example].view(np.int64), minimiser[self.example]
        self.least = np.minimum.reduceat(self.ids[self.doc[order]], edge) if len(edge) else np.zeros(0, np.int64)
        self.size = (b - a)[self.example]
        self.by_number, self.edge = order, np.concatenate([edge, [len(order)]])

    def place_of(self, k1: list[int], k2: list[int]) -> list[int]:
        known = {key: i for i, key in enumerate(zip(self.k1.tolist(), self.k2.tolist(), strict=True))}
        return [known[key] for key in zip(k1, k2, strict=True)]

    def string(self, first: int, end: int) -> bytes:
        """Words first to end, one space between two."""
        return self.text[self.starts[first] : self.ends[end - 1]]


_NAMED = pa.schema([("chunk", pa.int64()), ("m", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("least", pa.int64()), ("size", pa.int64())])


def _name(id_col: str, text_col: str, window: int):
    def run(batches):
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = Chunk(_unpack(blob.as_py()), id_col, text_col, window)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c.k1), number)), pa.array(c.minimiser.view(np.int64)), pa.array(c.k1), pa.array(c.k2), pa.array(c.least), pa.array(c.size)], schema=_NAMED)
            tidy()

    return run


def _send(id_col: str, text_col: str, window: int, n_buckets: int):
    """A packed row for each bucket: strings, and keys, offsets (the first window's place in its super-k-mer) and smallest documents."""
    schema = pa.schema([("bucket", pa.int64()), ("strings", pa.binary()), ("about", pa.binary())])

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for blob, asked in zip(*batch.columns, strict=True):
                c, asked = Chunk(_unpack(blob.as_py()), id_col, text_col, window), asked.as_py()
                k1, k2, least, heavy = (np.array([x[name] for x in asked]) for name in ("k1", "k2", "least", "heavy"))
                own = np.array(c.place_of(k1.tolist(), k2.tolist()))
                at, length = c.at[c.example[own]], c.length[c.example[own]]
                of, begin, n, value = np.arange(len(own)), np.zeros(len(own), np.int64), length, c.minimiser[own]
                cut = np.flatnonzero(heavy)
                if len(cut):
                    which = np.repeat(cut, length[cut])
                    place = ranges(at[cut], length[cut])
                    second = minimisers(c.hashes, place, window, LONG_GRAM)
                    edge, many = stretches(second, which)
                    light = np.flatnonzero(~heavy)
                    of = np.concatenate([of[light], which[edge]])
                    begin = np.concatenate([begin[light], place[edge] - at[which[edge]]])
                    n, value = np.concatenate([n[light], many]), np.concatenate([value[light], value[which[edge]] ^ mix(second[edge])])
                bucket = (mix(value ^ U64(0x1F83D9ABFB41BD6B)) % U64(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                about = np.stack([k1[of], k2[of], begin, least[of]], axis=1)[order]
                strings = [c.string(a, b) for a, b in zip((at[of] + begin)[order].tolist(), (at[of] + begin + n + window - 1)[order].tolist(), strict=True)]
                edge, many = stretches(bucket[order])
                rows = [(int(bucket[order[a]]), squeeze.compress(b"\n".join(strings[a : a + k])), about[a : a + k].tobytes()) for a, k in zip(edge.tolist(), many.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            tidy()

    return run


# ----------------------------------------------------------------------- buckets


def _window_hash(h: np.ndarray, at: np.ndarray, window: int, seed: int) -> np.ndarray:
    """Polynomial hash of the `window` word hashes from each of `at` on, put together from runs of doubling widths."""
    if not len(at):
        return np.zeros(0, U64)
    run, width, out, have = h, 1, None, 0
    while True:
        if window & width:
            out = run if out is None else run[: len(out) - width] * U64(pow(_Q[seed], have, 1 << 64)) + out[width:]
            have += width
        if 2 * width > window:
            return mix(out[at])
        run = run[: len(run) - width] * U64(pow(_Q[seed], width, 1 << 64)) + run[width:]
        width *= 2


def _smallest(words: Words, at: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """For each window (its first word `at`, an id of its own), the smallest id among equal windows."""
    one, two = _window_hash(words.hashes(11), at, window, 11), _window_hash(words.hashes(12), at, window, 12)
    order = np.argsort(one, kind="stable")
    sorted_one, sorted_two = one[order], two[order]
    edge = np.flatnonzero(np.concatenate([[True], sorted_one[1:] != sorted_one[:-1]])) if len(at) else np.zeros(0, int)
    same = np.repeat(np.arange(len(edge)), np.diff(np.concatenate([edge, [len(at)]])))
    out = np.empty(len(at), np.int64)
    if len(at) and (sorted_two != sorted_two[edge][same]).any():
        best: dict[bytes, int] = {}
        keys = [words.data[words.starts[a] : words.ends[a + window - 1]].tobytes() for a in at.tolist()]
        for key, i in zip(keys, ids.tolist(), strict=True):
            best[key] = min(best.get(key, NO_ID), i)
        return np.array([best[k] for k in keys], np.int64)
    if len(at):
        out[order] = np.minimum.reduceat(ids[order], edge)[same]
    return out


def _answer(window: int):
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("least", pa.int64()), ("runs", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        inflate = zstandard.ZstdDecompressor()
        packed = [inflate.decompress(x) for x in table.column("strings").to_pylist()]
        about = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 4) for x in table.column("about").to_pylist()])
        data = np.frombuffer(b"\n".join(packed), np.uint8)
        ends = np.concatenate([np.flatnonzero(data == 10) + 1, [len(data)]])
        words = Words(data, np.concatenate([[0], ends]))
        n = np.diff(words.first) - window + 1
        string = np.repeat(np.arange(len(n)), n)
        inside = ranges(np.zeros(len(n), np.int64), n)
        own = about[string, 3]
        low = _smallest(words, words.first[string] + inside, own, window)
        hit = np.flatnonzero(low < own)
        begin, length = stretches(low[hit], string[hit], hit - np.arange(len(hit))) if len(hit) else (hit, hit)
        at = hit[begin]
        runs = np.stack([inside[at] + about[string[at], 2], length, low[at]], axis=1).astype(np.int64)
        edge, many = stretches(string[at]) if len(at) else (at, at)
        which = string[at[edge]] if len(at) else at
        packed_runs = [runs[a : a + k].tobytes() for a, k in zip(edge.tolist(), many.tolist(), strict=True)]
        return pa.Table.from_arrays([pa.array(about[which, 0]), pa.array(about[which, 1]), pa.array(np.full(len(which), NO_ID)), pa.array(packed_runs, pa.binary())], schema=schema)

    return run


# ------------------------------------------------------------------------ cutting


def _cut(id_col: str, text_col: str, window: int, with_text: bool, names: list[str]):
    def run(batches):
        for batch in batches:
            for blob, answers in zip(batch.column(0), batch.column(1), strict=True):
                docs = _unpack(blob.as_py())
                chunk = Chunk(docs, id_col, text_col, window)
                ids, least, covered = chunk.ids, chunk.least.copy(), np.zeros(len(chunk.starts) + 1, np.int64)
                answers = answers.as_py() or []
                for k, answer in zip(chunk.place_of([x["k1"] for x in answers], [x["k2"] for x in answers]), answers, strict=True):
                    least[k] = min(least[k], answer["least"])
                    rows = chunk.by_number[chunk.edge[k] : chunk.edge[k + 1]]
                    for begin, n, low in np.frombuffer(answer["runs"] or b"", np.int64).reshape(-1, 3).tolist():
                        own = chunk.at[rows[low < ids[chunk.doc[rows]]]] + begin
                        np.add.at(covered, own, 1)
                        np.add.at(covered, own + n + window - 1, -1)
                # windows of a whole super-k-mer start in the smallest document that has it
                whole = least[chunk.number] < ids[chunk.doc]
                np.add.at(covered, chunk.at[whole], 1)
                np.add.at(covered, chunk.end[whole], -1)
                gone = np.cumsum(covered)[:-1] > 0
                first = chunk.first
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
                kept = []
                for d in range(len(ids)):
                    a, b = first[d], first[d + 1]
                    if a == b:
                        kept.append(b"")
                    elif not removed[d]:
                        kept.append(chunk.string(a, b))
                    else:
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], (~gone[a:b]).astype(np.int8), [0]])))
                        kept.append(b" ".join([chunk.string(a + s, a + e) for s, e in edges.reshape(-1, 2).tolist()]))
                if with_text:
                    tail = [pa.array([k.decode() if r else None for k, r in zip(kept, removed, strict=True)], pa.string())]
                else:
                    tail = [pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                cols = [*docs.columns, pa.array(np.diff(first).astype(np.int64)), pa.array(removed.astype(np.int64)), *tail]
                yield pa.RecordBatch.from_arrays(cols, names=names)
            tidy()

    return run


_TAIL = (("_n_words", T.LongType()), ("_n_removed", T.LongType()), ("_kept", T.StringType()))


def _answered(docs: DataFrame, id_col: str, text_col: str, window: int, with_text: bool) -> DataFrame:
    """docs' columns, named c0, c1, ... by position so that odd or repeated names do no harm, and those of _TAIL."""
    limit_arrow_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*names)
    i, t = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    chunks = materialise(flat.mapInArrow(_pack(t), "chunk long, blob binary"), "chunks")
    named = materialise(chunks.mapInArrow(_name(i, t, window), "chunk long, m long, k1 long, k2 long, least long, size long"), "super-k-mers")
    distinct = named.groupBy("k1", "k2").agg(F.min("m").alias("m"), F.min("least").alias("least"), F.min("chunk").alias("chunk"), F.max("size").alias("size"), F.count("*").alias("n"))
    distinct = materialise(distinct, "distinct-super-k-mers")
    several = materialise(distinct.groupBy("m").agg(F.count("*").alias("keys"), F.sum("size").alias("bytes")).filter("keys > 1").select("m", "bytes", (F.col("bytes") > HEAVY_BYTES).alias("heavy")), "minimisers")
    n_buckets = max(8, math.ceil((several.agg(F.sum("bytes")).first()[0] or 0) / BUCKET_BYTES))
    asked = distinct.join(several.drop("bytes"), "m").groupBy("chunk").agg(F.collect_list(F.struct("k1", "k2", "least", "heavy")).alias("asked"))
    sent = chunks.join(asked.hint("shuffle_hash"), "chunk").select("blob", "asked").mapInArrow(_send(i, t, window, n_buckets), "bucket long, strings binary, about binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer(window), "k1 long, k2 long, least long, runs binary")
    answers = answers.union(distinct.filter("n > 1").select("k1", "k2", "least", F.lit(None).cast("binary")))
    wanted = named.select("chunk", "k1", "k2", F.col("least").alias("own")).join(answers, ["k1", "k2"]).filter(F.col("runs").isNotNull() | (F.col("least") < F.col("own")))
    wanted = wanted.groupBy("chunk").agg(F.collect_list(F.struct("k1", "k2", "least", "runs")).alias("answers"))
    joined = chunks.join(wanted.hint("shuffle_hash"), "chunk", "left").select("blob", "answers")
    schema = T.StructType([*flat.schema.fields, *[T.StructField(n, k) for n, k in _TAIL]])
    return joined.mapInArrow(_cut(i, t, window, with_text, schema.names), schema)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, output: str = "text") -> DataFrame:
    """Columns of docs (all, or with output="digest" the id and the text), then three more: the number of words, the number of those removed, and
    the kept text (null where nothing was removed) or, with output="digest", the SHA-256 of the kept words joined by one space.

    The new columns are named _n_words, _n_removed, _kept, with further underscores where docs has such a name.
    """
    passed = docs if output == "text" else docs.select(id_col, text_col)
    out, taken, tail = _answered(passed, id_col, text_col, window, output == "text"), {c.lower() for c in passed.columns}, []
    for name, _ in _TAIL:
        while name.lower() in taken:
            name = f"_{name}"
        tail.append(name)
    return out.toDF(*passed.columns, *tail)


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """The rows and columns of docs with repeated windows cut from the text (and n_chars, if there is one, set anew); untouched texts stay as they are."""
    out, columns = _answered(docs, id_col, text_col, window, True), []
    for i, c in enumerate(docs.columns):
        old = F.col(f"c{i}")
        new = F.coalesce("_kept", old) if c == text_col else F.when(F.col("_n_removed") > 0, F.length("_kept")).otherwise(old).cast(docs.schema[i].dataType) if c == "n_chars" else old
        columns.append(new.alias(f"c{i}"))
    return out.select(*columns).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return cut_repeats(read(spark, sf_dir, "documents"), output="digest").toDF("doc_id", "text", "n_words", "n_removed", "kept_sha256").drop("text")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS id, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT r, id, n, md5(array_to_string(w[n : n + 49], ' ')) AS s FROM (SELECT r, id, w, unnest(range(1, len(w) - 48)) AS n FROM d WHERE len(w) >= 50)),
low AS (SELECT s, min(id) AS least FROM win GROUP BY s),
gone AS (SELECT DISTINCT r, unnest(range(n, n + 50)) AS p FROM win JOIN low USING (s) WHERE least < id),
cut AS (SELECT r, list(p) AS ps FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
