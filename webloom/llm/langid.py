"""Language ID by word-first backoff.

A known word is scored by its log frequency in each language, relative to that in all languages together.  The latter also
smooths each language's counts (PRIOR), so that what a language of few documents lacks is not held to be frequent in it.  An unknown word backs off to the
longest character n-grams that are known: 5-grams first, then 4, 3, 2 and single letters, each position
being covered by the longest known gram that starts there, over the whole word; it has the mean of their rows.  Each language keeps its own most
frequent words and grams, of those that occur twice at least: MAX_WORDS and MAX_GRAMS an order, shared out among the languages, but LEAST_WORDS and
LEAST_GRAMS at least.  Words and grams are named by 64-bit hashes.

The model is fitted on a bounded sample of the labelled training rows, of every language and every length: about MAX_TRAIN rows each (MAX_ROWS shared
out, but LEAST_TRAIN at least, where there are many languages), picked by a hash of the id.  Executors count the sample's words and grams; the driver
gets the counts of what is kept, at most a number for each language.  Prediction reads every whole text.

Nulls, ties and odd rows: null text and text without letters is "und" with score 0; a null id is never a
training row, and counts as not held out; rows that share an id are picked together; equal scores go to the language that sorts first; rows
with null lang aren't learned from; with nothing to learn from every text is "und".  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, crc_bucket, materialise, text_array
from .letters import Letters, blocks_of, gram_hashes, ranges

MAX_TRAIN = 1500
MAX_ROWS, LEAST_TRAIN = 300_000, 100
MAX_WORDS, LEAST_WORDS = 120_000, 500
MAX_GRAMS, LEAST_GRAMS = 48_000, 200
LONGEST = 5
#: Words, or grams of a length, that every language is taken to have in the proportions of all languages together.
PRIOR = 100
#: Numbers that scoring holds at a time: distinct words times languages.
CELLS = 4_000_000
#: Counts that a task holds before it adds them up.
HELD = 2_000_000


def most_of(kind: int, languages: int) -> int:
    """How many words (kind 0) or grams of `kind` letters a language keeps."""
    return max(LEAST_GRAMS, MAX_GRAMS // languages) if kind else max(LEAST_WORDS, MAX_WORDS // languages)


# --------------------------------------------------------------------------- counting


def _grams(words: Letters, which: np.ndarray):
    """(k, hash, number of the word) of all grams of these words with a space at either end."""
    points, first = words.padded(which, 32, 32)
    of = np.repeat(np.arange(len(which)), np.diff(first))
    for k in range(1, LONGEST + 1):
        at = np.flatnonzero(np.arange(len(points)) + k <= first[of + 1])
        yield k, gram_hashes(points, k)[at], of[at]


def _added(parts: list) -> list:
    """Counts (language, kind, key, n) with equal ones added up."""
    lang, kind, key, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((key, kind, lang))
    lang, kind, key, n = lang[order], kind[order], key[order], n[order]
    new = np.ones(len(key), bool)
    new[1:] = (lang[1:] != lang[:-1]) | (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return [(lang[at], kind[at], key[at], np.add.reduceat(n, at))] if len(at) else []


def count(rows) -> list:
    """Counts (language number, kind, key, n) of rows (language number, text), as arrays; in bounded memory but for what differs."""
    parts, held = [], 0
    for lang, text in rows:
        for numbers, texts in blocks_of([text]):
            words = Letters(texts, numbers)
            for _, example, distinct in words.slices():
                n = np.bincount(distinct)
                found = [(0, words.hashes[example], n), *((k, key, n[of]) for k, key, of in _grams(words, example))]
                for kind, key, many in found:
                    parts.append((np.full(len(key), lang, np.int32), np.full(len(key), kind, np.int8), key.view(np.int64), many.astype(np.int64)))
                    held += len(key)
                if held > HELD:
                    parts = _added(parts)
                    held = HELD // 2 if sum(len(p[2]) for p in parts) > HELD // 2 else sum(len(p[2]) for p in parts)
    return _added(parts) if parts else []


# ------------------------------------------------------------------------------ model


class Model:
    """Rows of relative log frequencies, named by `keys` (sorted, an array for words and one for each length of gram).

    Of a row only the languages that have the word or gram are stored (begin, langs, values); others have the floor of
    the row's kind.  All arrays are plain, so that a model can be broadcast.
    """

    def __init__(self, languages: list[str], keys: list | None = None, begin: list | None = None, langs: list | None = None, values: list | None = None, floors: np.ndarray | None = None):
        self.languages, self.keys, self.begin, self.langs, self.values, self.floors = languages, keys, begin, langs, values, floors

    @classmethod
    def build(cls, languages: list[str], own: np.ndarray, lang: np.ndarray, kind: np.ndarray, key: np.ndarray, n: np.ndarray, total: np.ndarray) -> Model:
        """From counts of what is kept, each with the total over all languages, and own[kind, language], the sums of all counts."""
        floors = np.log(PRIOR / (own + PRIOR))
        keys, begin, langs, values = [], [], [], []
        for k in range(LONGEST + 1):
            at = np.flatnonzero(kind == k)
            at = at[np.lexsort((lang[at], key[at].view(U64)))]
            known, first = np.unique(key[at].view(U64), return_index=True)
            keys.append(known)
            begin.append(np.concatenate([first, [len(at)]]).astype(np.int64))
            langs.append(lang[at].astype(np.int32))
            relative = np.log((n[at] * (own[k].sum() / total[at]) + PRIOR) / (own[k, lang[at]] + PRIOR))
            values.append(relative - floors[k, lang[at]])
        return cls(languages, keys, begin, langs, values, floors)

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> Model:
        """From rows (language, text), in this process."""
        languages = sorted({lang for lang, _ in rows})
        place = {lang: i for i, lang in enumerate(languages)}
        found = count((place[lang], text) for lang, text in rows)
        if not found:
            return cls([])
        (lang, kind, key, n) = found[0]
        own = np.zeros((LONGEST + 1, len(languages)))
        np.add.at(own, (kind, lang), n)
        _, same = np.unique(np.stack([kind.astype(np.int64), key], axis=1), axis=0, return_inverse=True)
        total = np.bincount(same.reshape(-1), n)[same.reshape(-1)]
        keep: set = set()
        for k in range(LONGEST + 1):
            for j in range(len(languages)):
                at = np.flatnonzero((kind == k) & (lang == j) & (total > 1))
                keep.update(same.reshape(-1)[at[np.lexsort((key[at], -n[at]))][: most_of(k, len(languages))]].tolist())
        at = np.flatnonzero(np.isin(same.reshape(-1), list(keep)))
        return cls.build(languages, own, lang[at], kind[at], key[at], n[at], total[at])

    def parts(self) -> tuple:
        return self.languages, self.keys, self.begin, self.langs, self.values, self.floors

    def row_of(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """Row of each key among those of its kind; -1 where it isn't known."""
        known = self.keys[kind]
        if not len(known):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, at, -1)

    def _weighed(self, words: Letters, example: np.ndarray):
        """(kind, row, number of the word, weight) of what each of these words is scored by."""
        row = self.row_of(0, words.hashes[example])
        known = np.flatnonzero(row >= 0)
        out = [(0, row[known], known, np.ones(len(known)))]
        unknown = np.flatnonzero(row < 0)
        if len(unknown):
            grams = list(_grams(words, example[unknown]))
            open_ = np.ones(len(grams[0][1]), bool)  # positions of all letters and borders, as in grams of one letter
            first = np.concatenate([[0], np.cumsum(np.bincount(grams[0][2], minlength=len(unknown)))])
            found = []
            for k, key, of in reversed(grams):
                # a word of n positions has n - k + 1 grams of k letters, from its first position on
                size = np.bincount(of, minlength=len(unknown))
                at = ranges(first[:-1], size)
                row = np.where(open_[at], self.row_of(k, key), -1)
                hit = np.flatnonzero(row >= 0)
                open_[at[hit]] = False
                found.append((k, row[hit], of[hit]))
            many = np.maximum(sum(np.bincount(of, minlength=len(unknown)) for _, _, of in found), 1)
            out += [(k, row, unknown[of], 1 / many[of]) for k, row, of in found]
        return out

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's sums over its words, by language, and its number of words."""
        many, out, n_words = len(self.languages), np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for numbers, parts in blocks_of(texts):
            words = Letters(parts, numbers)
            n_words += np.bincount(words.texts, minlength=len(texts))
            for text, example, distinct in words.slices(max(256, min(1 << 16, CELLS // max(1, many)))) if many else ():
                rows = np.zeros(len(example) * many)
                for kind, row, word, weight in self._weighed(words, example):
                    size = self.begin[kind][row + 1] - self.begin[kind][row]
                    at = ranges(self.begin[kind][row], size)
                    place = np.repeat(word * many, size) + self.langs[kind][at]
                    rows += np.bincount(place, self.values[kind][at] * np.repeat(weight, size), len(rows))
                    rows += (np.bincount(word, weight, len(example))[:, None] * self.floors[kind]).reshape(-1)
                edge = np.flatnonzero(np.diff(text, prepend=-1))
                rows = rows.reshape(-1, many)
                for j in range(0, many, 16):
                    out[text[edge], j : j + 16] += np.add.reduceat(rows[distinct, j : j + 16], edge, axis=0)
        return out, n_words

    def predict_all(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        total, n = self.totals(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = total.argmax(axis=1)
        # a mean over words, so that the score says how clear the text is and not how long
        odds = np.exp((total - total.max(axis=1, keepdims=True)) / np.maximum(n, 1)[:, None])
        return [self.languages[b] if k else "und" for b, k in zip(best.tolist(), n.tolist(), strict=True)], np.where(n > 0, 1 / odds.sum(axis=1), 0.0)

    def predict(self, text: str) -> tuple[str, float]:
        lang, score = self.predict_all([text])
        return lang[0], float(score[0])


# ------------------------------------------------------------------------------ Spark


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    spark = docs.sparkSession
    rows = docs.filter((crc_bucket(id_col) != 2) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.count("*")).collect()}
    if not counts:
        return Model([])
    languages = sorted(counts)
    most = max(LEAST_TRAIN, min(MAX_TRAIN, MAX_ROWS // len(counts)))
    # a row is picked where its id's hash is in its language's share, so no language is sorted
    shares = spark.createDataFrame([(lang, i, min(1.0, most / counts[lang])) for i, lang in enumerate(languages)], "lang string, number int, share double")
    place = (F.xxhash64("id").cast("double") / F.lit(2.0**64)) + 0.5
    sample = rows.join(F.broadcast(shares), "lang").filter(place <= F.col("share")).select("number", "text")
    schema = pa.schema([("lang", pa.int32()), ("kind", pa.int8()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches):
        every = ((lang, text) for b in batches for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for columns in count(every):
            for a in range(0, len(columns[0]), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 18)]) for c in columns], schema=schema)

    counted = materialise(sample.mapInArrow(run, "lang int, kind byte, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "language-counts")
    totals = counted.groupBy("kind", "key").agg(F.sum("n").alias("total")).filter("total > 1")
    by_rank = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key")
    ranked = counted.join(totals, ["kind", "key"]).withColumn("rank", F.row_number().over(by_rank))
    most_here = F.when(F.col("kind") == 0, most_of(0, len(languages))).otherwise(most_of(1, len(languages)))
    kept = ranked.filter(F.col("rank") <= most_here).select("kind", "key", "total").distinct()
    table = counted.join(kept, ["kind", "key"]).select("lang", "kind", "key", "n", "total").toArrow()
    own = np.zeros((LONGEST + 1, len(languages)))
    for r in counted.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect():
        own[r.kind, r.lang] = r.n
    return Model.build(languages, own, *[table.column(c).to_numpy() for c in ("lang", "kind", "key", "n", "total")])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            langs, scores = own.predict_all(text_array(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores)], names=["id", "held_out", "lang_pred", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(crc_bucket(id_col) == 2, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    docs = read(spark, sf_dir, "documents")
    return identify(docs, train(docs))
