"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character 3- to 5-grams (with word borders) and itself, hashed into N_ROWS rows of one
embedding matrix; its vector is the mean of those rows, so an unseen misspelling has most of its grams
in common with known words.  A run of more than LONGEST letters (a sentence in scripts without spaces, or words glued
together) is taken in pieces of LONGEST + 2 characters, borders included, that overlap by 4 at least, so that
none of its grams is lost; each piece counts as a word of its own.

A text's vector is the average of all its words' vectors, weighted by exp(attention . vector): with a plain average one insult in
thousands of words would vanish, with learned weights the average stays near the words that matter;
so that it does in texts of any length, half of the training texts are lengthened with calm words.  It goes through a linear softmax.
Embeddings, attention and softmax are trained together with Adam, in STEPS batches of BATCH texts; STEPS, INIT, DIM,
RATE and DILUTION were chosen on a part
of the training rows (crc32 mod 4 = 3) with a model of the others; held-out rows had no part in it.

The model is fitted on a bounded sample of the labelled training rows: at most MAX_TRAIN rows of either label, in the order of a
hash of the id, of any length.  Scoring reads every whole text.

Nulls, ties and odd rows: null text, empty text and text without letters have the model's score for no evidence, the
softmax of the bias; of contradictory labels of one document the toxic one counts; null labels and null ids are never learned from; rows that share an
id share its label; without both labels to learn from every score is 0.  Extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, crc_bucket, mix, per_text, span_hashes, text_array, tidy
from .letters import Letters, blocks_of, gram_hashes, ranges

MAX_TRAIN = 2500
N_ROWS = 1 << 15
DIM = 4
STEPS = 160
INIT = 1.0
RATE = 0.03
DILUTION = 1000.0
BATCH = 128
THRESHOLD = 0.3
#: Letters of a word; a longer run is taken in pieces.
LONGEST = 40
#: Attention is kept within this, so that its exponential is.
STEEPEST = 30.0


def subwords(words: Letters, example: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of these words: the word of each piece, each piece's first row (n + 1), and rows.  A piece is a whole word, or a stretch of a long run."""
    points, first = words.padded(example, ord("<"), ord(">"))
    size, length = np.diff(first), LONGEST + 2
    step = length - 4
    many = np.where(size <= length, 1, 1 + -(-(size - length) // step))
    word = np.repeat(np.arange(len(size)), many)
    nth = ranges(np.zeros(len(many), np.int64), many)
    # the last piece of a long run ends where the run ends
    begin = first[word] + np.minimum(nth * step, np.maximum(size[word] - length, 0))
    end = np.minimum(begin + length, first[word + 1])
    rows, of = [span_hashes(lambda a, b: points[a:b].astype(U64) * U64(0x9E3779B97F4A7C15) + U64(1), begin, end, 0xC2B2AE3D27D4EB4F)], [np.arange(len(word))]
    for k in (3, 4, 5):
        n = np.maximum(end - begin - k + 1, 0)
        rows.append(gram_hashes(points, k)[ranges(begin, n)])
        of.append(np.repeat(np.arange(len(word)), n))
    rows, of = (np.concatenate(rows) % U64(N_ROWS)).astype(np.int64), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return word, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(word)))]), rows[order]


def _mean(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first[:-1], axis=0) / np.diff(first).reshape(-1, *[1] * (values.ndim - 1))


class Sample:
    """Training texts as counts of distinct pieces: doc, piece and n of each pair, and the rows of each piece."""

    def __init__(self, texts: list[str]):
        known, index = np.zeros(0, U64), np.zeros(0, np.int64)  # keys of the pieces so far, sorted, and their numbers
        bags, sizes, docs, ids, many = [], [], [], [], []
        for numbers, parts in blocks_of(texts):
            words = Letters(parts, numbers)
            for text, example, distinct in words.slices():
                # a word's pieces are named by the word's hash and their place in it
                word, first, rows = subwords(words, example)
                nth = np.arange(len(word)) - np.searchsorted(word, word)
                keys = mix(words.hashes[example][word] + nth.astype(U64) * U64(0xD6E8FEB86659FD93))
                new = np.flatnonzero(~np.isin(keys, known))
                bags.append(rows[ranges(first[new], np.diff(first)[new])].astype(np.int32))
                sizes.append(np.diff(first)[new])
                every, number = np.concatenate([known, keys[new]]), np.concatenate([index, len(known) + np.arange(len(new))])
                order = np.argsort(every)
                known, index = every[order], number[order]
                own = index[np.searchsorted(known, keys)]
                pair, n = np.unique(text * len(example) + distinct, return_counts=True)
                w = pair % len(example)
                begin, size = np.searchsorted(word, w), np.bincount(word, minlength=len(example))[w]
                docs.append(np.repeat(pair // len(example), size).astype(np.int32))
                ids.append(own[ranges(begin, size)].astype(np.int32))
                many.append(np.repeat(n, size).astype(np.float32))
        self.n_docs = len(texts)
        every = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.first = np.concatenate([[0], np.cumsum(every(sizes, np.int64))]).astype(np.int64)
        self.rows, doc, self.piece, self.n = every(bags, np.int32), every(docs, np.int32), every(ids, np.int32), every(many, np.float32)
        order = np.argsort(doc, kind="stable")
        self.piece, self.n = self.piece[order], self.n[order]
        self.begin = np.searchsorted(doc[order], np.arange(self.n_docs + 1))


def step(rows: np.ndarray, attention: np.ndarray, out: np.ndarray, bias: np.ndarray, piece_first: np.ndarray, piece_rows: np.ndarray, doc_first: np.ndarray, doc_piece: np.ndarray, doc_n: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Probabilities of a batch (every document has words) and the gradients of its weighted cross entropy by rows, attention, out, bias."""
    size = np.diff(piece_first)
    vector = np.add.reduceat(rows[piece_rows], piece_first[:-1], axis=0) / size[:, None]
    raw = vector @ attention
    steep = np.clip(raw, -STEEPEST, STEEPEST)
    doc = np.repeat(np.arange(len(doc_first) - 1), np.diff(doc_first))
    share = doc_n * np.exp(steep)[doc_piece]
    share /= np.add.reduceat(share, doc_first[:-1])[doc]
    own = vector[doc_piece]
    mean = np.add.reduceat(own * share[:, None], doc_first[:-1], axis=0)
    logits = mean @ out + bias
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    d_logits = (p - np.stack([1 - y, y], axis=1)) * weight[:, None]
    d_mean = d_logits @ out.T
    given = d_mean[doc]
    pull = share * ((own - mean[doc]) * given).sum(axis=1) * (np.abs(raw) < STEEPEST)[doc_piece]
    d_own = share[:, None] * given + pull[:, None] * attention
    d_vector = np.stack([np.bincount(doc_piece, d_own[:, j], len(size)) for j in range(rows.shape[1])], axis=1) / size[:, None]
    of = np.repeat(np.arange(len(size)), size)
    d_rows = np.stack([np.bincount(piece_rows, d_vector[of, j], len(rows)) for j in range(rows.shape[1])], axis=1)
    return p, (d_rows, own.T @ pull, mean.T @ d_logits, d_logits.sum(axis=0))


class Model:
    """What each embedding row gives in the softmax (`value`, the difference of its classes) and in the weights (`steep`)."""

    def __init__(self, value: np.ndarray | None, steep: np.ndarray | None, bias: float):
        self.value, self.steep, self.bias = value, steep, bias

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], steps: int = STEPS, rate: float = RATE, dim: int = DIM, seed: int = 5) -> Model:
        if len(set(labels)) < 2:
            return cls(None, None, 0.0)
        sample, rng = Sample(texts), np.random.default_rng(seed)
        y = np.array(labels, float)
        some = np.flatnonzero(np.diff(sample.begin) > 0)
        if len(set(y[some].tolist())) < 2:
            return cls(None, None, 0.0)
        params = [rng.normal(0, INIT, (N_ROWS, dim)), rng.normal(0, INIT, dim), rng.normal(0, INIT, (dim, 2)), np.zeros(2)]
        state, t = [[np.zeros_like(p), np.zeros_like(p)] for p in params], 0
        weight = np.where(y == 1, 0.5 / max(1, y[some].sum()), 0.5 / max(1, (1 - y[some]).sum())) * len(some)
        order, calm = np.zeros(0, np.int64), some[y[some] == 0]
        while t < steps:
            if not len(order):
                order = rng.permutation(some)
            docs, order, t = order[:BATCH], order[BATCH:], t + 1
            # every text with the words of a calm one, which stand for up to DILUTION times as many; for half of the texts they count next to nothing
            both = np.stack([docs, rng.choice(calm, len(docs))], axis=1).reshape(-1)
            often = np.stack([np.ones(len(docs)), np.where(rng.random(len(docs)) < 0.5, 1e-9, DILUTION ** rng.random(len(docs)))], axis=1).reshape(-1)
            n = np.diff(sample.begin)[both]
            at = ranges(sample.begin[both], n)
            used, place = np.unique(sample.piece[at], return_inverse=True)
            size = np.diff(sample.first)[used]
            rows, doc_first = sample.rows[ranges(sample.first[used], size)], np.concatenate([[0], np.cumsum(n)])[::2]
            _, grads = step(*params, np.concatenate([[0], np.cumsum(size)]), rows, doc_first, place, sample.n[at] * np.repeat(often, n), y[docs], weight[docs] / len(docs))
            for (m, v), param, grad in zip(state, params, grads, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                param -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        del sample, state
        tidy()
        rows, attention, out, bias = params
        model = cls(rows @ (out[:, 1] - out[:, 0]), rows @ attention, float(bias[1] - bias[0]))
        model._place(texts, y)
        return model

    def _place(self, texts: list[str], y: np.ndarray) -> None:
        """Move the bias so that THRESHOLD stands where the training rows' F1 is highest."""
        logits = self.logits(texts)
        order = np.argsort(-logits, kind="stable")
        hit = np.cumsum(y[order])
        f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
        best = int(np.argmax(f1))
        cut = logits[order][best] if best + 1 == len(y) else (logits[order][best] + logits[order][best + 1]) / 2
        self.bias += float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut)

    def parts(self) -> tuple:
        return self.value, self.steep, self.bias

    def logits(self, texts: list[str]) -> np.ndarray:
        """The softmax's logit of each whole text: of two classes, the difference of their linear scores."""
        top, total = np.zeros(len(texts)), np.zeros(len(texts))
        for numbers, parts in blocks_of(texts):
            words = Letters(parts, numbers)
            for text, example, distinct in words.slices():
                word, first, rows = subwords(words, example)
                share = np.exp(np.clip(_mean(self.steep[rows], first), -STEEPEST, STEEPEST))
                begin = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(example)))])
                # a word's pieces are added up first, so that each of its occurrences takes one step
                up = per_text(share * _mean(self.value[rows], first), begin, np.add, 0.0)
                down = per_text(share, begin, np.add, 0.0)
                top += np.bincount(text, up[distinct], len(texts))
                total += np.bincount(text, down[distinct], len(texts))
        return np.divide(top, total, out=np.zeros(len(texts)), where=total > 0) + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        return np.zeros(len(texts)) if self.value is None else 1 / (1 + np.exp(-np.clip(self.logits(texts), -700, 700)))

    def score(self, text: str) -> float:
        return float(self.scores([text])[0])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample of the labelled rows."""
    spark = docs.sparkSession
    named = labels.filter((crc_bucket(id_col) != 2) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    first = lambda rows, *more: rows.orderBy(F.xxhash64("id"), "id", *more).limit(MAX_TRAIN)
    picked = [(r[0], label) for label in (0, 1) for r in first(named.filter(F.col("label") == label).select("id")).collect()]
    if not picked:
        return Model(None, None, 0.0)
    small = F.broadcast(spark.createDataFrame(picked, "id long, label int"))
    rows = docs.filter(crc_bucket(id_col) != 2).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(small, "id")
    # once more, for the rows of ids that repeat
    found = [(r.text, label) for label in (0, 1) for r in first(rows.filter(F.col("label") == label), "text").select("text").collect()]
    return Model.fit([t for t, _ in found], [y for _, y in found])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            scores = own.scores(text_array(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["id", "held_out", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(crc_bucket(id_col) == 2, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    out = source.mapInArrow(run, "id long, held_out boolean, score double").withColumnRenamed("id", id_col)
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def accepted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted toxic, with docs' columns; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())
    at = docs.columns.index(text_col)

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            texts = batch.column(at).cast(pa.string()).fill_null("").to_pylist()
            yield batch.filter(pa.array(own.scores(texts) < THRESHOLD, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
