"""Benchmark decontamination with a distributed positional inverted index.

The index is split by document and holds the postings of every word of the training text, whatever is looked up later.  Each row of the index table
is one segment of about SEGMENT_BYTES: its documents' ids, keys and lengths, its distinct words by their 64-bit hashes, and the sorted
positions of each.  It is written to the shared folder once, nothing is shuffled, and every search uses the same table.

A search adds up the postings of the test items' terms over all segments, then orders each window's terms from the
rarest on.  In a segment, only windows all of whose terms are there are looked at.  Their candidates are the positions of the rarest term moved by its offset; each
further term's moved list is intersected with them, for all windows of the segment at once, so that what is left are exact phrase matches, and most
windows end at the first lookup.  `proximity` uses the same lists with a tolerance in place of equality.

The windows of the test items are handed to the executors in blocks of at most MAX_WINDOWS, whose size is thereby bounded; an item may
be in several blocks.  More windows mean more searches of the same index, put together by each row's key.

Nulls, ties and odd rows: null or empty text has no words and no hits; items without words are ignored;
repeated items with the same id count once; documents may repeat ids, each row is judged by itself; a null
doc_id stays null; a null item_id is written as "null".  Extra columns are ignored by judge() and kept by clean(), whatever they are called.
"""

from __future__ import annotations

import hashlib
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, U64, Words, blocks, buffers, limit_arrow_batches, materialise, text_array
from .letters import ranges

WINDOW = 10
MAX_WINDOWS = 200_000
SEGMENT_BYTES = 2 << 20
#: Candidates looked at together.
CANDIDATES = 1 << 20


def words_of(text: str | None) -> Words:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), ALNUM, fold=True)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of its own for each row, written to the shared folder so that it stays the same in every pass; and the key's name."""
    name = "row"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return materialise(docs.withColumn(name, F.monotonically_increasing_id()), "keyed-docs"), name


# ------------------------------------------------------------------------- the index

_SEGMENT = pa.schema([("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("hashes", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("steps", pa.binary())])


def _index():
    """Segments; a row without a key gets one from the task's number and its place in it."""

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for whole in batches:
            for part in blocks(whole, "text", SEGMENT_BYTES):
                data, offsets = buffers(text_array(part, "text"))
                w = Words(data, offsets, ALNUM, fold=True)
                hashes, example, distinct, counts = np.unique(w.hashes(), return_index=True, return_inverse=True, return_counts=True)
                place = np.argsort(distinct, kind="stable")
                raw = w.data.tobytes()
                names = b"\n".join([raw[a:b] for a, b in zip(w.starts[example].tolist(), w.ends[example].tolist(), strict=True)])
                # positions one term after the other, as steps from one to the next
                steps = np.diff(place, prepend=0).astype(np.int32 if len(place) < 2**31 else np.int64)
                own = np.arange(at, at + part.num_rows)
                at += part.num_rows
                rows = part.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0).to_pylist()], _SEGMENT[0].type), pa.array([np.where(rows < 0, own, rows)], _SEGMENT[1].type), pa.array([w.counts], _SEGMENT[2].type), *[pa.array([x], pa.binary()) for x in (hashes.tobytes(), names, counts.astype(np.int32).tobytes(), steps.tobytes())]],
                    schema=_SEGMENT,
                )

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """The segments of docs, written to the shared folder; rows are known by row_col, or else by keys of the index."""
    limit_arrow_batches(docs.sparkSession)
    row = F.lit(None) if row_col is None else F.col(row_col)
    source = docs.select(F.col(id_col).cast("long").alias("id"), row.cast("long").alias("row"), F.col(text_col).cast("string").alias("text"))
    return materialise(source.mapInArrow(_index(), "ids array<long>, rows array<long>, lengths array<long>, hashes binary, words binary, counts binary, steps binary"), "index")


class Block:
    """Windows of test items: distinct terms (hash and word), each window's terms in order (-1 behind the last), and its items."""

    def __init__(self, windows: dict[tuple[bytes, ...], dict]):
        names = {t: i for i, t in enumerate(dict.fromkeys(t for w in windows for t in w))}
        self.names = list(names)
        data = b" ".join(self.names)
        self.hashes = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ALNUM).hashes()
        self.sizes = np.array([len(w) for w in windows], np.int64)
        self.terms = np.full((len(windows), int(self.sizes.max()) if len(windows) else 1), -1, np.int64)
        for i, w in enumerate(windows):
            self.terms[i, : len(w)] = [names[t] for t in w]
        self.items = [sorted(x) for x in windows.values()]

    def ordered(self, counts: np.ndarray) -> None:
        """Put each window's terms from the rarest on; offsets say where each stands in the window."""
        many = np.where(self.terms < 0, np.iinfo(np.int64).max, counts[self.terms])
        self.offsets = np.argsort(many, axis=1, kind="stable")
        self.terms = np.take_along_axis(self.terms, self.offsets, axis=1)


def _blocks_of_windows(items: DataFrame, item_id: str, item_text: str, width: int):
    """Blocks of windows, each of at most MAX_WINDOWS, read from the item table piece by piece."""
    block: dict[tuple[bytes, ...], dict] = {}
    for row in items.select(item_id, item_text).distinct().toLocalIterator():
        w = words_of(row[1])
        raw, name = w.data.tobytes(), "null" if row[0] is None else str(row[0])
        words = [raw[a:b] for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]
        for i in range(max(1, len(words) - width + 1) if words else 0):
            window = tuple(words[i : i + width])
            if window not in block and len(block) == MAX_WINDOWS:
                yield Block(block)
                block = {}
            block.setdefault(window, {})[name] = None
    yield Block(block)


def _counted(block: Block):
    """Postings of each of the block's terms in a task's segments."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(len(block.hashes), np.int64)
        for batch in batches:
            for hashes, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                known, at = _found(np.frombuffer(hashes, U64), block.hashes)
                total[known] += np.frombuffer(counts, np.int32)[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], schema=schema)

    return run


def _found(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted are there, and where."""
    if not len(sorted_):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    known = np.flatnonzero(sorted_[at] == wanted)
    return known, at[known]


class Segment:
    def __init__(self, ids: list, rows: list, lengths: list, hashes: bytes, words: bytes, counts: bytes, steps: bytes):
        self.ids, self.rows, self.lengths = ids, rows, np.array(lengths, np.int64)
        self.hashes, self.words = np.frombuffer(hashes, U64), words
        self.counts = np.frombuffer(counts, np.int32).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.places = np.cumsum(np.frombuffer(steps, np.int32 if len(steps) == 4 * self.first[-1] else np.int64), dtype=np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.lengths)])
        # one sorted list of (term, position)
        self.span = int(self.base[-1]) + 1
        self.postings = np.repeat(np.arange(len(self.counts)), self.counts) * self.span + self.places

    def search(self, block: Block, slop: int | None):
        """(document, first word, window) of each match, an array each; with slop, the place of the window's rarest term."""
        known, at = _found(self.hashes, block.hashes)
        own = np.full(len(block.hashes) + 1, -1)
        if len(known):
            words = self.words.split(b"\n")
            same = np.array([words[a] == block.names[i] for i, a in zip(known.tolist(), at.tolist(), strict=True)])
            own[known[same]] = at[same]
        here = own[block.terms]  # -1 for absent terms and behind a window's end
        alive = np.flatnonzero((here >= 0).sum(axis=1) == block.sizes) if len(block.sizes) else np.zeros(0, np.int64)
        many = self.counts[here[alive, 0]]
        edge, parts = 0, []
        total = np.concatenate([[0], np.cumsum(many)])
        while edge < len(alive):
            to = max(edge + 1, int(np.searchsorted(total, total[edge] + CANDIDATES, side="right")) - 1)
            parts.append(self._match(alive[edge:to], here, block, slop))
            edge = to
        return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3

    def _match(self, windows: np.ndarray, here: np.ndarray, block: Block, slop: int | None):
        size = self.counts[here[windows, 0]]
        window = np.repeat(windows, size)
        anchor = self.places[ranges(self.first[here[windows, 0]], size)]
        doc = np.searchsorted(self.base, anchor, side="right") - 1
        start = anchor - block.offsets[window, 0]
        if slop is None:
            inside = (start >= self.base[doc]) & (start + block.sizes[window] <= self.base[doc + 1])
            window, anchor, doc, start = window[inside], anchor[inside], doc[inside], start[inside]
        for j in range(1, block.terms.shape[1]):
            term = here[window, j]
            asked = np.flatnonzero(term >= 0)
            if not len(asked):
                break
            want = start[asked] + block.offsets[window[asked], j]
            low = want if slop is None else np.maximum(want - slop, self.base[doc[asked]])
            high = want if slop is None else np.minimum(want + slop, self.base[doc[asked] + 1] - 1)
            at = np.searchsorted(self.postings, term[asked] * self.span + low)
            good = self.postings[np.minimum(at, len(self.postings) - 1)]
            hit = (good >= term[asked] * self.span + low) & (good <= term[asked] * self.span + high)
            keep = np.ones(len(window), bool)
            keep[asked[~hit]] = False
            window, anchor, doc, start = window[keep], anchor[keep], doc[keep], start[keep]
        return doc, (start if slop is None else anchor) - self.base[doc], window


def _search(block: Block, slop: int | None, every: bool):
    """Per document row (every: of all, else of those with matches): its spans [start, end) and the items found in it."""
    schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment(*[c[row].as_py() for c in batch.columns])
                doc, start, window = segment.search(block, slop)
                spans: dict[int, list[int]] = {}
                items: dict[int, set] = {}
                for d, s, w in zip(doc.tolist(), start.tolist(), window.tolist(), strict=True):
                    spans.setdefault(d, []).extend((s, s + (int(block.sizes[w]) if slop is None else 1)))
                    items.setdefault(d, set()).update(block.items[w])
                own = range(len(segment.ids)) if every else sorted(spans)
                yield pa.RecordBatch.from_arrays([pa.array([segment.ids[d] for d in own], pa.int64()), pa.array([segment.rows[d] for d in own], pa.int64()), pa.array(segment.lengths[list(own)], pa.int64()), pa.array([spans.get(d, []) for d in own], pa.list_(pa.int64())), pa.array([sorted(items.get(d, ())) for d in own], pa.list_(pa.string()))], schema=schema)

    return run


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, slop: int | None = None) -> list[DataFrame]:
    """For each block of windows: id, row (its key), n_words, spans (start, end, start, end, ...), items.  The first has a row for every
    document row, the others for those with matches.

    slop None: exact phrases.  A number: every word of the window within that many words of its place.
    """
    found, sc = [], index.sparkSession.sparkContext
    for i, block in enumerate(_blocks_of_windows(items, item_id, item_text, width)):
        if not len(block.sizes) and i:
            continue
        asked = sc.broadcast(block)

        def count(batches, asked=asked):
            yield from _counted(asked.value)(batches)

        counts = np.zeros(len(block.hashes) + 1, np.int64)
        # as many rows as the block has terms
        for r in index.select("hashes", "counts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect() if len(block.sizes) else ():
            counts[r.term] = r.n
        block.ordered(counts)
        plan = sc.broadcast(block)

        def run(batches, plan=plan, every=not i):
            yield from _search(plan.value, slop, every)(batches)

        found.append(index.mapInArrow(run, "id long, row long, n_words long, spans array<long>, items array<string>"))
    return found


def proximity(docs: DataFrame, items: DataFrame, slop: int, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """(doc id, item) for every document row that has a window of the item with each word within `slop` of its place."""
    parts = [x.select("id", F.explode("items").alias("item")) for x in search(build_index(docs, id_col, text_col), items, slop=slop, **names)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def _digest():
    schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            hit, n_items, sha = [], [], []
            for spans, items in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                total, end = 0, 0
                for s, e in sorted(zip(spans[::2], spans[1::2], strict=True)):
                    total += max(0, e - max(s, end))
                    end = max(end, e)
                hit.append(total)
                own = sorted(set(items))
                n_items.append(len(own))
                sha.append(hashlib.sha256(",".join(own).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha)], schema=schema)

    return run


def _judged(index: DataFrame, items: DataFrame, id_col: str, **names) -> DataFrame:
    """judge() with the rows' keys, as `row`."""
    found = search(index, items, **names)
    out = found[0]
    if len(found) > 1:
        for x in found[1:]:
            out = out.union(x)
        out = out.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    out = out.select("id", "row", "n_words", "spans", "items").mapInArrow(_digest(), "id long, row long, n_words long, n_hit long, n_items long, items_sha256 string")
    return out.withColumnRenamed("id", id_col).withColumn("contaminated", F.col("n_hit") > 0)


def judge(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return _judged(build_index(docs, id_col, text_col), items, id_col, **names).drop("row")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of docs that share no window with the items; each row goes or stays by itself, whatever its id."""
    own, row = keyed(docs)
    gone = _judged(build_index(own, id_col, text_col, row), items, id_col, **names).filter("contaminated").select(F.col("row").alias(row))
    return own.join(gone, row, "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_WORDS = f"coalesce(regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_SQL_WORDS} AS w, least(len(w), 10) AS k FROM benchmark),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[n : n + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS n FROM i WHERE k > 0)),
dw AS (SELECT r, k, n, array_to_string(w[n : n + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS n FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT r, n, dw.k, item_id FROM dw JOIN win ON win.k = dw.k AND win.s = dw.s),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(n, n + k)) AS p FROM hit) GROUP BY r),
own AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS names FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN own USING (r)
"""
