"""Near-dedup, substring dedup and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from webloom.llm import decontaminate, minhash, substring

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("id", T.StringType()), T.StructField("chunk", T.IntegerType())])


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], DOCS).repartition(parts)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)] + ["é", "Zü", "A", "a"]
    passage = [r.choice(vocab) for _ in range(70)]
    out = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.choice([0, 1, 3, 9, 40, 120, 300]))]
        if i % 3 == 0:
            at = r.randint(0, len(words))
            words[at:at] = passage
        if i % 4 == 1 and out:
            words = re.findall(r"[^\x20\x09-\x0D]+", out[r.randrange(len(out))][1] or "")
            for _ in range(r.choice([0, 1, 2, 5])):
                if words:
                    words[r.randrange(len(words))] = "edit%d" % r.randrange(99)
        out.append((i, r.choice([" ", "\n", " \t "]).join(words)))
    out += [(1000, None), (1001, ""), (1002, "  \n"), (1003, "ha " * 5000), (1004, "ha " * 4000), (None, out[0][1]), (None, None), (5, out[5][1]), (7, "Same id other text"), (1005, "x" * 3000000)]
    return out


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_near(rows, width, percent):
    sets = []
    for i, t in rows:
        w = words_of(fold(t))
        sets.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = [(i, s) for i, s in sets if i is not None and s]
    for k, (i, a) in enumerate(own):
        for j, b in own[:k]:
            c = len(a & b)
            if 100 * c >= percent * (len(a) + len(b) - c):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None and (s or True) else None, i is None or find(i) == i) for i, s in sets), key=str)


@pytest.mark.parametrize("width,percent,seed", [(4, 80, 1), (5, 80, 2), (2, 60, 3)])
def test_near_duplicates(spark, width, percent, seed):
    rows = corpus(seed)
    got = minhash.near_duplicates(frame(spark, rows), width=width, percent=percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_near(rows, width, percent)


def test_near_duplicates_needs_later_rounds(spark):
    """A bucket whose smallest document is linked with none of the others."""
    r = random.Random(7)
    base = ["t%d" % i for i in range(400)]

    def edited(n, tag):
        w = list(base)
        for k in r.sample(range(400), n):
            w[k] = f"{tag}{k}"
        return " ".join(w)

    rows = [(0, edited(30, "a"))] + [(i, edited(14, f"b{i}_")) for i in range(1, 25)] + [(50, " ".join(base))]
    got = minhash.near_duplicates(frame(spark, rows), width=4, percent=80).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_near(rows, 4, 80)


def test_near_duplicates_empty(spark):
    assert minhash.near_duplicates(frame(spark, [])).collect() == []
    assert minhash.keep_one(frame(spark, [(1, None), (2, "a b"), (3, "a b")])).count() == 2


def brute_cut(rows, window):
    best = {}
    key = lambda i: float("inf") if i is None else i
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            best[s] = min(best.get(s, float("inf")), key(i))
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if best[tuple(w[k : k + window])] < key(i):
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,seed", [(50, 1), (50, 4), (8, 2)])
def test_substring(spark, window, seed, monkeypatch):
    rows = corpus(seed)
    got = substring.cut_repeats(frame(spark, rows), window=window, output="digest").select("doc_id", "_n_words", "_n_removed", "_kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_cut(rows, window)
    texts = substring.cut_repeats(frame(spark, rows), window=window)
    assert texts.columns == [*DOCS.names, "_n_words", "_n_removed", "_kept"]
    again = sorted(((r.doc_id, hashlib.sha256(" ".join(words_of(r._kept if r._n_removed else r.text)).encode()).hexdigest()) for r in texts.collect()), key=str)
    assert again == sorted(((a, d) for a, _, _, d in brute_cut(rows, window)), key=str)


def test_substring_splits_heavy_minimisers(spark, monkeypatch):
    """One gram in many contexts: its super-k-mers are cut by a second minimiser, and no bucket holds most of them."""
    from webloom.llm.common import Words, run_hashes

    r = random.Random(8)
    vocab = ["v%d" % i for i in range(4000)]
    grams = [[r.choice(vocab) for _ in range(4)] for _ in range(3000)]
    data = " ".join(" ".join(g) for g in grams).encode()
    h = run_hashes(Words(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hashes(), 4)[::4]
    common = grams[int(np.argmin(h))]
    rows = []
    for i in range(120):
        w = [r.choice(vocab) for _ in range(200)]
        for at in (30, 90, 150):
            w[at:at] = common
        rows.append((i, " ".join(w)))
    some = words_of(rows[3][1])
    rows += [(200 + i, " ".join(["x%d" % i] + some[10 : 80 + i])) for i in range(20)]
    want = brute_cut(rows, 50)
    for heavy in (1 << 40, 2000):
        monkeypatch.setattr(substring, "HEAVY_BYTES", heavy)
        monkeypatch.setattr(substring, "BUCKET_BYTES", 4000)
        got = substring.cut_repeats(frame(spark, rows), output="digest").select("doc_id", "_n_words", "_n_removed", "_kept").collect()
        assert sorted((tuple(x) for x in got), key=str) == want
    assert sum(x[2] for x in want) > 0
    c = substring.Chunk(pa.RecordBatch.from_pydict({"i": [x[0] for x in rows], "t": [x[1] for x in rows]}), "i", "t", 50)
    _, which = np.unique(c.minimiser, return_inverse=True)
    assert np.bincount(which, c.size).max() > 50_000


def test_substring_keeps_clashing_columns(spark):
    text = " ".join("w%d" % i for i in range(60))
    docs = spark.createDataFrame([(1, text, 1, "a", 5), (2, text, 2, "b", 6), (3, None, 3, "c", 7)], "doc_id long, text string, _n_removed int, _kept string, n_chars int")
    assert substring.cut_repeats(docs).columns == [*docs.columns, "_n_words", "__n_removed", "__kept"]
    assert sorted(tuple(r) for r in substring.cleaned(docs).collect()) == [(1, text, 1, "a", 5), (2, "", 2, "b", 0), (3, None, 3, "c", 7)]


def test_substring_empty(spark):
    assert substring.cut_repeats(frame(spark, [])).collect() == []
    assert substring.cleaned(frame(spark, [(1, None)])).collect()[0].text is None


def test_substring_hashes_disagree(spark, monkeypatch):
    """Where the two hashes disagree, strings decide."""
    from webloom.llm.common import SPACED, Words

    data = np.frombuffer(b"a b c a b d a b c", np.uint8)
    words = Words(data, np.array([0, len(data)]), SPACED)
    real = substring._window_hash
    monkeypatch.setattr(substring, "_window_hash", lambda h, at, w, seed: np.zeros(len(at), np.uint64) if seed == 11 else real(h, at, w, seed))
    low = substring._smallest(words, np.array([0, 3, 6]), np.array([9, 2, 5]), 3)
    assert low.tolist() == [5, 2, 5]


def brute_hits(rows, items, width):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    windows = {}
    for i, t in items:
        w = word(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    out = []
    for i, t in rows:
        w = word(t)
        hit, own = [False] * len(w), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit[k : k + len(win)] = [True] * len(win)
                    own |= ids
        out.append((i, len(w), sum(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


def test_decontaminate(spark, monkeypatch):
    rows = [(i, t) for i, t in corpus(5, 40) if i not in (1003, 1004, 1005)]
    some = words_of(rows[0][1])
    items = [(1, " ".join(some[2:30])), (2, "W5, w6"), (3, None), (4, ""), (5, "!!"), (6, "never seen words " * 9), (2, "W5, w6"), (10, " ".join(some[20:31]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(rows, items, 10)
    assert sorted((tuple(r) for r in decontaminate.judge(frame(spark, rows), table).collect()), key=str) == want
    assert any(x[-1] for x in want) and not all(x[-1] for x in want)
    monkeypatch.setattr(decontaminate, "MAX_WINDOWS", 5)
    assert sorted((tuple(r) for r in decontaminate.judge(frame(spark, rows), table).collect()), key=str) == want


def test_decontaminate_blocks_judge_each_row(spark, monkeypatch):
    hit = "a b c d e f g h i j"
    rows = [(5, hit), (5, "k l m n o p q r s t"), (5, "clean words of the same length as the others here"), (None, hit), (None, "ten clean words without any id stand in this row"), (None, hit), (8, None), (8, None)]
    items = [(1, hit), (2, "k l m n o p q r s t"), (3, "a b c d e f g h i j u v w x")]
    table = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "MAX_WINDOWS", 1)
    index = decontaminate.build_index(frame(spark, rows), "doc_id", "text")
    assert len(decontaminate.search(index, table)) > 2
    assert sorted((tuple(r) for r in decontaminate.judge(frame(spark, rows), table).collect()), key=str) == brute_hits(rows, items, 10)


@pytest.mark.parametrize("most", [200_000, 1])
def test_decontaminate_cleans_each_row(spark, monkeypatch, most):
    hit = "a b c d e f g h i j"
    rows = [(5, hit), (5, "clean"), (None, "x " + hit), (None, "clean too"), (None, None), (6, "k l")]
    table = spark.createDataFrame([(1, hit), (2, "k l")], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "MAX_WINDOWS", most)
    kept = decontaminate.clean(frame(spark, rows).withColumnRenamed("chunk", "row"), table)
    assert kept.columns == [*DOCS.names[:-1], "row"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, "clean"), (None, "clean too"), (None, None)], key=str)


def test_decontaminate_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontaminate.judge(frame(spark, [(1, "a b")]), none).collect()] == [(1, 2, 0, 0)]
    assert decontaminate.judge(frame(spark, []), none).collect() == []


def test_proximity(spark):
    items = spark.createDataFrame([(1, "one two three"), (2, "alpha beta")], "item_id long, text string")
    docs = frame(spark, [(1, "one very two three"), (2, "one two three"), (3, "one a b c d two three"), (4, "beta alpha"), (5, "two")])
    got = {(r.id, r.item) for r in decontaminate.proximity(docs, items, slop=1).collect()}
    assert got == {(1, "1"), (2, "1")}
    two = frame(spark, [(6, "one two"), (7, "three"), (8, "alpha"), (9, "beta")], 1)
    assert decontaminate.proximity(two, items, slop=3).collect() == []
    got = {(r.id, r.item) for r in decontaminate.proximity(docs, items, slop=2).collect()}
    assert got == {(1, "1"), (2, "1"), (4, "2")}


def test_segment_takes_candidates_in_parts(spark, monkeypatch):
    rows = corpus(5, 40)
    segments = [decontaminate.Segment(*r) for r in decontaminate.build_index(frame(spark, rows), "doc_id", "text").collect()]
    items = spark.createDataFrame([(1, " ".join(words_of(rows[0][1])[2:30])), (2, "w5"), (3, "w6 w7")], "item_id long, text string")
    (block,) = decontaminate._blocks_of_windows(items, "item_id", "text", 10)
    block.ordered(np.arange(len(block.hashes) + 1))
    for slop in (None, 2):
        want = [set(zip(*[x.tolist() for x in s.search(block, slop)], strict=True)) for s in segments]
        monkeypatch.setattr(decontaminate, "CANDIDATES", 3)
        assert want == [set(zip(*[x.tolist() for x in s.search(block, slop)], strict=True)) for s in segments] and any(want)
        monkeypatch.undo()


def test_index_holds_every_word(spark):
    """An index is searched again with other items."""
    rows = corpus(9, 20)
    index = decontaminate.build_index(frame(spark, rows), "doc_id", "text")
    for first in (0, 30):
        items = [(1, " ".join(words_of(rows[3][1])[first : first + 15])), (2, "w7")]
        found = decontaminate.search(index, spark.createDataFrame(items, "item_id long, text string"))
        assert len(found) == 1
        assert sorted(((r.id, r.n_words, len(r["items"])) for r in found[0].collect()), key=str) == sorted(((x[0], x[1], x[3]) for x in brute_hits(rows, items, 10)), key=str)
