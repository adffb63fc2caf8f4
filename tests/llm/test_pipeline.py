"""The whole pipeline against brute force, stage by stage, on rows with nulls, repeats and long texts."""

import random
import re

import pytest

import corpus_pipeline
from webloom.llm import toxicity

from .test_model_ops import sql_mix
from .test_text_ops import brute_hits, brute_near, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    r = random.Random(12)
    vocab = ["word%d" % i for i in range(400)]
    passage, known = [r.choice(vocab) for _ in range(65)], [r.choice(vocab) for _ in range(30)]
    texts = []
    for i in range(200):
        words = [r.choice(vocab) for _ in range(r.choice([1, 5, 20, 80, 160]))]
        if i % 9 == 2:
            words += passage
        if i % 17 == 3:
            words += known
        if i % 8 == 1:
            words.append(r.choice(["scumface", "idiotic", "moronic"]))
        if i % 7 == 5:
            words = texts[r.randrange(len(texts))].split()
            words[r.randrange(len(words))] = "edited"
        texts.append(r.choice([" ", "\n"]).join(words))
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (None, texts[3]), (None, " ".join(known)), (None, None), (4, texts[4]), (4, "another text of the same id"), (502, " ".join(r.choice(vocab) for _ in range(9000)))]
    return [(i, t, r.choice(["en", None]), r.choice(["a", "a", "b", None]), None if t is None else len(t)) for i, t in rows], passage, known


def folder(spark, path, rows, labels, items):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}"


def cut_texts(rows, window=50):
    least = {}
    key = lambda i: float("inf") if i is None else i
    for i, t, *_ in rows:
        w = words_of(t)
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            least[s] = min(least.get(s, float("inf")), key(i))
    out = []
    for i, t, lang, source, n in rows:
        w = words_of(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < key(i):
                gone.update(range(k, k + window))
        text = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t
        out.append((i, text, lang, source, len(text) if gone else n))
    return out


def test_pipeline(spark, tmp_path):
    rows, passage, known = documents()
    labels = [(i, None, int(bool(re.search("scumface|idiotic|moronic", t or "")))) for i, t, *_ in rows if i is not None and i % 3] + [(None, 1, 1)]
    items = [(1, " ".join(known)), (2, None), (3, "...")]
    path = folder(spark, tmp_path, rows, labels, items)
    got = corpus_pipeline.run(spark, path).collect()

    model = toxicity.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    keep = [r for r in rows if model.score(r[1] or "") < toxicity.THRESHOLD]
    assert 20 < len(rows) - len(keep) < 120
    gone = {x[0] for x in brute_near([r[:2] for r in keep], 5, 80) if not x[3]}
    keep = [r for r in keep if r[0] is None or r[0] not in gone]
    assert gone
    cut = cut_texts(keep)
    assert sorted(map(str, cut)) != sorted(map(str, keep))
    clean = [r for r in cut if not brute_hits([r[:2]], items, 10)[0][-1]]
    assert 0 < len(clean) < len(cut)
    want = []
    for (i, size, _, _, copies) in sql_mix([(r[0], r[1], r[3]) for r in clean]):
        want += [(i, size, n) for n in range(1, copies + 1)] if size else []
    assert sorted(((r.doc_id, len(words_of(r.text)), r.mix_copy) for r in got), key=str) == sorted(want, key=str)
    assert {(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in got} <= set(clean)
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "mix_copy"}
    again = corpus_pipeline.run(spark, path).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "a b", "en", "s", 3)]])
def test_pipeline_of_almost_nothing(spark, tmp_path, rows):
    path = folder(spark, tmp_path, rows, [], [])
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "mix_copy"]
    assert {r.doc_id for r in out.collect()} == {r[0] for r in rows if r[1]}


def test_stages_keep_clashing_columns(spark, tmp_path):
    """Columns named as the operators name theirs go through every stage."""
    extra = {"y": 1, "id": 2, "row": 3, "_n_removed": 4, "_kept": 5, "c0": 6, "k1": 7, "chunk": 8, "label": 9, "comp": 10, "score": 11, "mix_copy": 12, "number": 13, "size": 14}
    rows = [(i, "some text number %d here" % i, "en", "a", 24, *extra.values()) for i in range(8)] + [(9, None, None, None, None, *extra.values())]
    docs = spark.createDataFrame(rows, SCHEMA + ", " + ", ".join(f"{c} int" for c in extra))
    path = folder(spark, tmp_path, [r[:5] for r in rows], [(1, 0, 0)], [(1, "nothing of it")])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), *extra]
        assert docs.count() > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    assert out.columns == [*docs.columns, "mix_copy_"] and all(r[5:-1] == tuple(extra.values()) for r in out.collect())
