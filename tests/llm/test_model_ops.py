"""WARC, language ID, quality, mixing, URL filters, top-k search and toxicity against brute force or by round trip."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from webloom.llm import langid, letters, mixing, mtree, quality, toxicity, urlfilter, warc
from webloom.llm.common import new_path
from webloom.llm.letters import Letters


# ------------------------------------------------------------------------------- WARC


def test_warc_round_trip(spark):
    big, other = "<p>é" + "x" * 200, "y" * 99
    rows = [(4, "http://a/ b", big, "d"), (2, None, big, "d"), (9, "http://c", big, "d"), (3, "u", other, "d"), (1, "u", other, "d"), (7, "u", None, None), (8, "u", "", "d"), (None, "u", big, "d"), (5, "\r\n\x01", "z" * 300_000, "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    folder = new_path(spark, "test-warc")
    manifest = warc.write_archives(pages, folder)
    got = warc.read_archives(manifest, folder, with_payload=True).collect()
    assert len(got) == len(rows)
    want = {}
    for i, _, html, _ in rows:
        data = (html or "").encode()
        twin = html == big and i != 2
        want[i] = (len(data), hashlib.sha256(data).hexdigest(), "revisit" if twin else "response", 2 if twin else None, b"" if twin else data)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in got} == want


def test_warc_without_ids_and_many_archives(spark):
    pages = spark.createDataFrame([(None, "u", "x" * 200)] * 3 + [(5, "u", "y" * 200), (5, "u", "y" * 200)], "page_id long, url string, html string")
    folder = new_path(spark, "test-warc")
    got = warc.read_archives(warc.write_archives(pages, folder), folder).collect()
    assert [(r.page_id, r.record_type, r.refers_to) for r in sorted(got, key=str)] == [(5, "response", None)] * 2 + [(None, "response", None)] * 3
    manifest = warc.write_archives(pages, folder)
    for _ in range(4):
        manifest = manifest.union(warc.write_archives(pages, folder))
    read = warc.read_archives(manifest, folder)
    assert manifest.count() > 4 and read.rdd.getNumPartitions() == manifest.count() and read.count() == 25


def test_warc_empty(spark):
    folder = new_path(spark, "test-warc")
    manifest = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_archives(manifest, folder).collect() == []


# ------------------------------------------------------------------------- language ID


def test_language_backs_off_to_grams():
    rows = [("xx", "anzorel bektorel mirzorel"), ("yy", "shalipuma torpuma velipuma")] * 3
    model = langid.Model.fit(rows)
    assert model.predict("dunzorel")[0] == "xx" and model.predict("garpuma")[0] == "yy"
    assert model.predict("bektorel") == max([model.predict("bektorel")], key=lambda x: x[1])
    assert model.predict("12 !?") == ("und", 0.0) and langid.Model.fit([]).predict("word") == ("und", 0.0)


def test_language_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", 1), (2, "", None, 1), (None, "words here", None, 1), (4, "words here", "en", 1), (4, "words here", "en", 1)], "doc_id long, text string, lang string, score int")
    model = langid.Model.fit([("en", "some words here words")])
    got = sorted(((r.doc_id, r.lang_pred) for r in langid.identify(docs, model).collect()), key=str)
    assert got == [(1, "und"), (2, "und"), (4, "en"), (4, "en"), (None, "en")]
    none = docs.limit(0)
    assert langid.identify(none, langid.train(none)).collect() == []


def test_language_learns_every_language(spark):
    name = lambda i: "".join(chr(97 + int(c)) for c in str(1000 + i))
    rows = [(4 * i + k, f"{name(i)}zu {name(i)}zo " * 3, f"l{i}", 1) for i in range(230) for k in range(8)]
    rows += [(9000 + k, "qxqx vyvy " * 2500, "long", 1) for k in range(12)] + [(9100, None, "never", 1), (None, "no id", "never", 1), (9101, "no lang", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, number int")
    model = langid.train(docs)
    assert model.languages == sorted([f"l{i}" for i in range(230)] + ["long"])
    assert all(model.predict(f"{name(i)}zu")[0] == f"l{i}" for i in range(230)) and model.predict("qxqx vyvy")[0] == "long"
    local = langid.Model.fit([(r[2], r[1]) for r in rows if r[0] is not None and r[1] and r[2] and zlib.crc32(str(r[0]).encode()) % 4 != 2])
    texts = [f"{name(3)}zu {name(9)}zoq", "unseenword qxqv", "vyvy " * 9]
    assert np.allclose(model.totals(texts)[0], local.totals(texts)[0])


def test_language_keeps_small_vocabularies(monkeypatch):
    big = " ".join("".join(random.Random(i).choices("abcdefghij", k=6)) for i in range(400))
    rows = [("big", big)] * 9 + [("few", "klmno pqrst klmno pqrst")]
    monkeypatch.setattr(langid, "MAX_WORDS", 100)
    monkeypatch.setattr(langid, "LEAST_WORDS", 10)
    model = langid.Model.fit(rows)
    words = Letters(["klmno pqrst"])
    assert (model.row_of(0, words.hashes) >= 0).all() and len(model.keys[0]) <= 52
    held = [model.predict(t) for t in ("klmno", "klmnopq", big[:50], "a" * 70 + "klmnopqrst" * 30)]
    assert [x[0] for x in held] == ["few", "few", "big", "few"]
    monkeypatch.setattr(langid, "CELLS", 600)
    again = model.predict_all(["", "klmno " * 2000 + big, big])
    assert again[0][0] == "und" and again[0][1:] == langid.Model(*model.parts()).predict_all(["klmno " * 2000 + big, big])[0]


def spelled(text):
    return [w for w in "".join(c if c.isalpha() else " " for c in text.lower()).split(" ") if w]


def brute_language(rows):
    """Scores of a text by the definition: strings, dictionaries and one word at a time."""
    langs, counts = sorted({lang for lang, _ in rows}), [{} for _ in range(langid.LONGEST + 1)]
    for lang, text in rows:
        for w in spelled(text):
            padded = f" {w} "
            for kind, x in [(0, w)] + [(k, padded[i : i + k]) for k in range(1, langid.LONGEST + 1) for i in range(len(padded) - k + 1)]:
                counts[kind].setdefault(x, Counter())[lang] += 1
    own = [{lang: sum(c[lang] for c in table.values()) for lang in langs} for table in counts]
    known = lambda k, x: sum(counts[k].get(x, Counter()).values()) > 1

    def value(k, x, lang):
        share = sum(own[k].values()) / sum(counts[k][x].values())
        return math.log((counts[k][x][lang] * share + langid.PRIOR) / (own[k][lang] + langid.PRIOR))

    def scores(text):
        total = dict.fromkeys(langs, 0.0)
        for w in spelled(text):
            padded = f" {w} "
            found = [(0, w)] if known(0, w) else [next(((k, padded[i : i + k]) for k in range(min(langid.LONGEST, len(padded) - i), 0, -1) if known(k, padded[i : i + k])), None) for i in range(len(padded))]
            found = [x for x in found if x]
            for lang in langs:
                total[lang] += sum(value(k, x, lang) for k, x in found) / max(1, len(found))
        return [total[lang] for lang in langs], len(spelled(text))

    return scores


def test_language_scores_by_definition():
    r = random.Random(1)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(1, 9)))
    vocabulary = {lang: [word(letters) for _ in range(60)] for lang, letters in (("x", "abcdeé"), ("y", "cdefgÜ"), ("z", "日本語abc"))}
    rows = [(lang, " ".join(r.choice(v) for _ in range(40)) + " 12 _x") for lang, v in vocabulary.items() for _ in range(5)]
    model, brute = langid.Model.fit(rows), brute_language(rows)
    texts = [" ".join(r.choice(vocabulary[r.choice("xyz")]) if r.random() < 0.5 else word("abcdefgéÜ日本") for _ in range(r.choice([0, 1, 5, 50]))) for _ in range(60)] + ["q" * 500 + "abc", "a" * 62 + "b" * 3000, "²³ ", ""]
    total, n = model.totals(texts)
    for i, text in enumerate(texts):
        want, words = brute(text)
        assert words == n[i] and np.allclose(want, total[i], atol=1e-7)


def test_long_texts_come_in_pieces(monkeypatch):
    text = "abc defgh " * 50 + "x" * 90 + " ij"
    whole = Letters([text, "k"])
    monkeypatch.setattr(letters, "PIECE", 16)
    parts = [Letters(t, n) for n, t in letters.blocks_of([text, "k"], 16)]
    assert len(parts) > 20
    assert np.concatenate([p.hashes for p in parts]).tolist() == whole.hashes.tolist() and np.concatenate([p.texts for p in parts]).tolist() == whole.texts.tolist()


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found) > 0


# ----------------------------------------------------------------------------- quality


def test_quality_weights_and_sample(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["good", "fine", "bad", "worse", "Ü"]) for _ in range(r.choice([0, 1, 5, 40]))) for _ in range(80)] + [None, ""]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, key double").repartition(3)
    labels = spark.createDataFrame([(i, int("good" in t), 0) for i, t in enumerate(texts) if t] + [(None, 1, 0), (0, None, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.select_by_quality(docs, labels).collect()}
    grams = [quality._ngrams(pa.array([t or ""]))[0] for t in texts]
    raw, good = np.ones(quality.N_BUCKETS), np.ones(quality.N_BUCKETS)
    for t, g in zip(texts, grams, strict=True):
        for x in g:
            raw[x] += 1
            good[x] += "good" in (t or "")
    ratio = np.log(good / good.sum()) - np.log(raw / raw.sum())
    for i, g in enumerate(grams):
        assert got[i].log_weight == pytest.approx(ratio[g].sum(), abs=1e-9)
    best = sorted(got.values(), key=lambda x: (-x.key, x.doc_id))[: len(texts) // 4]
    assert {x.doc_id for x in got.values() if x.selected} == {x.doc_id for x in best}


@pytest.mark.parametrize("k", [0, 1, 7, 50, 5000, 6000])
def test_kth_largest(spark, k):
    values = [float(x % 97) for x in range(3000)] + [1e9, -1e9] + [5.0] * 2500
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    found = quality._kth_largest(keys, k)
    if k == 0:
        assert found is None
    else:
        cut = sorted(values, reverse=True)[min(k, len(values)) - 1]
        assert found == (cut, min(k, len(values)) - sum(v > cut for v in values))


@pytest.mark.parametrize("k", [1, 2, 700, 3000])
def test_kth_largest_of_longs(spark, k):
    r = random.Random(k)
    values = [r.choice([-(2**63), 2**63 - 1, 0, 2**53, 2**53 + 1, r.randrange(-(2**62), 2**62)]) for _ in range(3000)]
    keys = spark.createDataFrame([(v,) for v in values], "key long")
    cut = sorted(values, reverse=True)[k - 1]
    assert quality._kth_largest(keys, k) == (cut, k - sum(v > cut for v in values))


def test_quality_takes_as_many_as_it_says(spark):
    rows = [(7, "a a")] * 12 + [(None, "a a")] * 4 + [(2**53 + i, "a") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    for fraction in (0.05, 0.25, 0.5, 0.9, 1.0):
        assert quality.select_by_quality(docs, labels, fraction).filter("selected").count() == int(20 * fraction)


def test_quality_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.select_by_quality(docs, labels).collect() == []
    same = spark.createDataFrame([(i, "a a") for i in range(8)], "doc_id long, text string")
    assert quality.select_by_quality(same, labels).filter("selected").count() == 2


# ------------------------------------------------------------------------------ mixing


def sql_mix(rows):
    con = duckdb.connect()
    con.register("docs", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[2] for r in rows], pa.string())}))
    return con.sql(f"WITH {mixing.MIX_SQL} SELECT doc_id, size, source_size, target, copies FROM mixed").fetchall()


def test_mixing(spark):
    r = random.Random(5)
    rows = [(i, "w " * r.choice([0, 1, 3, 30, 900]), r.choice(["a", "a", "a", "b", "é", None])) for i in range(400)] + [(1000, None, "a"), (1001, "", "only empty"), (1002, "x " * 50_000, "b"), (None, "one two", "a")]
    docs = spark.createDataFrame([(*x, 1, "n") for x in rows], "doc_id long, text string, source string, size int, target string").repartition(3)
    got = mixing.mix(docs).collect()
    key = lambda x: (x[0] is None, x[0])
    for a, b in zip(sorted(((x.doc_id, x.size, x.source_size, x.target, x.copies) for x in got), key=key), sorted(sql_mix(rows), key=key), strict=True):
        assert a[:3] + a[4:] == b[:3] + b[4:] and a[3] == pytest.approx(b[3])
    assert all(0 <= x.taken <= 2 * x.size for x in got)
    source = dict((x[0], x[2]) for x in rows)
    for name in ("a", "b", "é", None):
        own = [x for x in got if source[x.doc_id] == name]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 2 * max(x.size for x in own)
    copies = mixing.mixed(docs).groupBy("doc_id").count().collect()
    assert {x.doc_id: x["count"] for x in copies} == {x.doc_id: x.copies for x in got if x.taken}


def test_mixed_takes_each_row_by_itself(spark):
    r = random.Random(6)
    rows = [(r.choice([1, 2, None, 4]), "w " * r.choice([0, 1, 3, 30]), r.choice(["a", "b", None]), i, 9, 3) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id int, mix_copy int, row int").repartition(3)
    copies = mixing.mixed(docs)
    assert copies.columns == [*docs.columns, "mix_copy_"]
    seen = Counter(x._id for x in copies.collect())
    want, got = Counter(), Counter()
    for x in mixing.mix(docs).collect():
        want[x.doc_id, x.size, x.copies if x.size else 0] += 1
    for doc, text, _, i, _, _ in rows:
        got[doc, text.count("w"), seen[i]] += 1
    assert got == want and max(seen.values()) == 2


def test_mixing_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).collect() == [] and mixing.mixed(docs).collect() == []


# ------------------------------------------------------------------------- URL filters


def brute_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(rule), rule, says) for rule, says in urlfilter.RULES for h, p in [rule.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def test_url_rules_and_propagation(spark):
    link = '<p><a class=x href="http://{}/p">x</a> <A HREF=\'https://{}\'>'
    rows = [
        (1, "http://Good.COM/a?b#c", link.format("mid.org", "mid.org")), (2, "https://bad.net/es/1", link.format("far.org", "bad.net")), (3, "http://near.org/x", link.format("bad.net", "bad.net")),
        (4, "http://mid.org", None), (5, "http://far.org/", ""), (6, None, "x"), (7, "no scheme", None), (8, "", None), (9, "http://example.com/en/a", None), (10, "http://www.example.com/en/", None), (11, "http://example.com/fr", None),
        (12, "http://notexample.com/en/", None), (13, "ftp://x.bad.net/fr/2?u=http://q", None), (13, "ftp://x.bad.net/fr/2?u=http://q", None), (None, "http://com/", None), (14, "http://com", None), (15, "http://a.net/es", None), (16, "://h/p", "x"),
    ]
    pages = spark.createDataFrame([(*x, "z", 0.5) for x in rows], "page_id long, url string, html string, host string, trust double").repartition(3)
    got = urlfilter.judge(pages).collect()
    want = [(i, *brute_rule(u)) for i, u, _ in rows]
    says = {"near.org": "block"}  # it links to a blocked seed; mid.org is trusted, far.org only linked from the blocked
    want = [(i, h, p, r, v or says.get(h, "allow")) for i, h, p, r, v in want]
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == sorted(want, key=str)
    trust = {r.host: (r.trust, r.distrust) for r in got}
    assert trust["mid.org"][0] > 0 == trust["mid.org"][1] and trust["near.org"][1] > 0 == trust["near.org"][0]


def test_propagation_equals_power_iteration(spark):
    r = random.Random(2)
    hosts = ["h%d" % i for i in range(12)]
    edges = sorted({(r.choice(hosts), r.choice(hosts)) for _ in range(40)} - {(h, h) for h in hosts})
    seeds = [("trust", "h0", 0.5), ("trust", "h1", 0.5), ("distrust", "h5", 1.0)]
    got = {(x.kind, x.host): x.score for x in urlfilter.propagate(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "kind string, host string, score double"), rounds=10).collect()}
    for kind in ("trust", "distrust"):
        way = edges if kind == "trust" else [(b, a) for a, b in edges]
        start = {h: s for k, h, s in seeds if k == kind}
        score = dict(start)
        for _ in range(10):
            after = {h: s * 0.15 for h, s in start.items()}
            for a, b in way:
                if a in score:
                    after[b] = after.get(b, 0) + 0.85 * score[a] / sum(x == a for x, _ in way)
            score = after
        assert {h: pytest.approx(s) for h, s in score.items()} == {h: s for (k, h), s in got.items() if k == kind}


def test_url_scores_converge_on_a_long_chain(spark):
    n = 26
    link = lambda i: f"http://h{i}/" if i % 2 else f"//h{i}/?u=http://x/"
    pages = [(i, f"http://h{i}/p", f'<p><a href="{link(i + 1)}">x</a><a href="/own">y</a>') for i in range(n - 1)] + [(n - 1, f"http://h{n - 1}/p", "")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in urlfilter.judge(table, rules=[(f"h{n - 1}/", "block")]).collect()}
    assert {r.verdict for r in got.values()} == {"block"} and len(got) == n
    assert {i: r.distrust for i, r in got.items()} == {i: pytest.approx(0.15 * 0.85 ** (n - 1 - i)) for i in range(n)}
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("trust", "a", 1.0)], "kind string, host string, score double")
    found = {x.host: x.score for x in urlfilter.propagate(ring, seeds).collect()}
    assert found == {"a": pytest.approx(0.15 / (1 - 0.85**2), abs=1e-5), "b": pytest.approx(0.85 * 0.15 / (1 - 0.85**2), abs=1e-5)}


def test_host_edges(spark):
    pages = [(1, "http://a/p", '<a data-href="http://no/">x</a><a class=k href=//b/x>y</a><!-- <a href="http://no2/"> --><A\nHREF = "https://C/">'), (2, "http://b/", "<script>'<a href=\"http://no3/\">'</script><a href='/own'><a href=\"http://b/2\">"), (3, None, '<a href="http://a/">'), (4, "http://c/", None)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert sorted(tuple(r) for r in urlfilter.host_edges(table).collect()) == [("a", "b"), ("a", "c")]


@pytest.mark.parametrize("links", [1 << 17, 2])
def test_url_sql_on_linked_hosts(spark, monkeypatch, links):
    """The whole query against its SQL where hosts are linked; with hubs dealt to parts too."""
    r = random.Random(4)
    hosts = ["good.com", "x.good.com", "bad.net", "spam.net", *[f"h{i}.org" for i in range(12)]]
    pages = [(i, f"http://{r.choice(hosts)}{r.choice(['/es/', '/fr/1', '/en/', ''])}", "".join(f'<a href="{r.choice(["http:", ""])}//{r.choice(hosts)}/p">x</a>' for _ in range(r.randrange(4)))) for i in range(60)] + [(99, None, None)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    monkeypatch.setattr(urlfilter, "HUB_LINKS", links)
    got = sorted(((x.page_id, x.host, x.path, x.rule, x.verdict) for x in urlfilter.judge(table).collect()), key=str)
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": [p[0] for p in pages], "url": [p[1] for p in pages], "html": [p[2] for p in pages]}))
    assert got == sorted(con.sql(urlfilter.ORACLE).fetchall(), key=str)
    assert {x[4] for x in got if x[3] is None} == {"allow", "block"}


def test_url_empty(spark):
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# ------------------------------------------------------------------------ top-k search


def brute_top(vectors, k):
    long_ = lambda x: max(-(2**63), min(2**63 - 1, x))
    good = [(i, [long_(math.floor(64 * c)) if abs(64 * c) < math.inf else (2**63 - 1 if c > 0 else -(2**63)) for c in v]) for i, v in vectors if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q, a in good:
        if q % 20 == 0:
            best = sorted((-long_(sum(x * y for x, y in zip(a, b))), i) for i, b in good if i != q)[:k]  # noqa: B905
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def searched_top(spark, rows, kind="array<double>"):
    table = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], f"vec_id long, embedding {kind}, score int, pivot int, id int").repartition(3)
    q = mtree.quantised(table)
    return sorted(tuple(x) for x in mtree.top_k(q, q.filter("id % 20 = 0"), 20).collect())


def test_top_k(spark, monkeypatch):
    r = random.Random(11)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(900)] + [(i, [0.5] * 6) for i in range(900, 1200)]
    rows += [(2000, None), (2020, [float("nan")] * 6), (2040, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2060, [float("inf")] + [0.0] * 5), (2080, [0.0] * 6), (None, [9.0] * 6), (40, [1.0] * 6), (900, [0.5] * 6)]
    monkeypatch.setattr(mtree, "SHARD_ROWS", 100)
    monkeypatch.setattr(mtree, "BLOCK_ROWS", 5)
    monkeypatch.setattr(mtree, "GROUP_BLOCKS", 2)
    monkeypatch.setattr(mtree, "MAX_PIVOTS", 7)
    assert searched_top(spark, rows) == brute_top(rows, 20)


def test_top_k_of_few_short_and_huge_vectors(spark):
    few = [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (20, [-1.0, 0.0])]
    assert searched_top(spark, few) == brute_top(few, 20)
    mixed = [(0, [1.0, 2.0, 3.0]), (1, []), (20, [2.0]), (2, [1.0, -1.0]), (40, [])]
    assert searched_top(spark, mixed) == brute_top(mixed, 20)
    assert searched_top(spark, [(0, []), (1, [])]) == [(0, 1, 1, 0)]
    huge = [(0, [1e9, -1.0]), (1, [3e15, 7.0]), (20, [1e300, 1.0]), (2, [-1e300, 5.0]), (3, [2.0**53, 1.0]), (4, [-3.0, 2.0])]
    assert searched_top(spark, huge) == brute_top(huge, 20)
    none = mtree.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert mtree.top_k(none, none).collect() == []
    one = mtree.quantised(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"))
    assert mtree.top_k(one, one.filter("id = 0")).collect() == [] and mtree.top_k(one, one).collect() == []


def test_tree_avoids_distances():
    """Clustered vectors of 64 dimensions: most distances are never computed."""
    r = np.random.default_rng(4)
    centres = r.integers(-4000, 4000, (60, 64))
    vectors = centres[r.integers(0, 60, 9000)] + r.integers(-20, 20, (9000, 64))
    top = float((vectors * vectors).sum(axis=1).max())
    tree = mtree.Tree.load(np.arange(9000), vectors, top)
    asked = np.arange(0, 9000, 60)
    score, who, computed = tree.search(vectors[asked], asked, 10)
    for row, i in enumerate(asked):
        scores = vectors @ vectors[i]
        want = [j for j in np.lexsort((np.arange(9000), -scores)) if j != i][:10]
        assert who[row].tolist() == want and score[row].tolist() == scores[want].tolist()
    assert computed < 0.5 * len(asked) * 9000
    one = sum(tree.search(vectors[[i]], np.array([i]), 10)[2] for i in asked[:20])
    assert one < 0.2 * 20 * 9000


# ---------------------------------------------------------------------------- toxicity


def test_toxicity_learns_subwords(spark):
    r = random.Random(1)
    calm = ["river", "stone", "garden", "window", "paper", "yellow", "autumn", "market"]
    harsh = ["scumbagger", "idiotface", "wretchhead"]
    texts = [" ".join(r.choice(calm) for _ in range(12)) for _ in range(120)]
    labels = [i % 3 == 0 for i in range(120)]
    texts = [t + " " + r.choice(harsh) if y else t for t, y in zip(texts, labels, strict=True)]
    model = toxicity.Model.fit(texts, [int(y) for y in labels])
    assert model.score("river stone scumbaggerr garden") >= toxicity.THRESHOLD > model.score("river stone garden paper")
    docs = spark.createDataFrame([(1, "a SCUMBAGGER", 1), (2, "river stone", 1), (3, None, 1), (4, "", 1), (None, "paper " * 5000 + "idiotface", 1), (2, "river stone", 1)], "doc_id long, text string, score int")
    got = sorted(((x.doc_id, x.predicted) for x in toxicity.score(docs, model).collect()), key=str)
    assert [x for x in got if x[0] in (1, 2, None)] == [(1, 1), (2, 0), (2, 0), (None, 1)]
    assert all(0 <= x.score <= 1 for x in toxicity.score(docs, model).collect())
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {2, *(i for i, p in got if i in (3, 4) and not p)}


def brute_pieces(word):
    whole, size = f"<{word}>", toxicity.LONGEST + 2
    if len(whole) <= size:
        return [whole]
    at, out = 0, []
    while at + size < len(whole):
        out.append(whole[at : at + size])
        at += size - 4
    return [*out, whole[-size:]]


def test_toxicity_reads_long_runs_whole():
    letters_ = [chr(0x4E00 + i) for i in range(1000)]
    for n in (1, 39, 40, 41, 42, 43, 78, 79, 80, 81, 82, 200, 1000):
        words = Letters(["".join(letters_[:n])])
        word, first, rows = toxicity.subwords(words, np.array([0]))
        want = brute_pieces("".join(letters_[:n]))
        assert len(word) == len(want) == len(first) - 1
        for piece, a, b in zip(want, first[:-1], first[1:], strict=True):
            grams = [piece[i : i + k] for k in (3, 4, 5) for i in range(len(piece) - k + 1)]
            points = [np.frombuffer(g.encode("utf-32-le"), np.uint32) for g in grams]
            assert Counter(rows[a + 1 : b].tolist()) == Counter(int(letters.gram_hashes(p, len(p))[0]) % toxicity.N_ROWS for p in points)
    bad, r = "".join(letters_[300:340]), random.Random(2)
    calm = lambda: "".join(r.choice(letters_[:200]) for _ in range(150))
    texts = [calm() for _ in range(120)]
    model = toxicity.Model.fit([t + bad if i % 3 == 0 else t for i, t in enumerate(texts)], [int(i % 3 == 0) for i in range(120)])
    clean = calm()
    assert model.score(clean + bad + calm()) >= toxicity.THRESHOLD > model.score(clean)


def test_toxicity_forward_and_gradients():
    """Scores by the definition, word by word; gradients by differences."""
    r = np.random.default_rng(3)
    rows, attention, out, bias = r.normal(0, 1, (toxicity.N_ROWS, 3)), r.normal(0, 1, 3), r.normal(0, 1, (3, 2)), r.normal(0, 1, 2)
    texts = ["one two two three", "Scum " + "x" * 100 + " one", "Ärger ärger", "one"]
    sample = toxicity.Sample(texts)
    y, weight = np.array([1.0, 0.0, 1.0, 0.0]), np.array([0.5, 0.2, 0.2, 0.1])

    def forward(text):
        vectors = []
        for w in spelled(text):
            word, first, own = toxicity.subwords(Letters([w]), np.array([0]))
            vectors += [rows[own[a:b]].mean(axis=0) for a, b in zip(first[:-1], first[1:], strict=True)]
        share = np.exp([v @ attention for v in vectors])
        logits = (np.array(vectors) * (share / share.sum())[:, None]).sum(axis=0) @ out + bias
        return np.exp(logits) / np.exp(logits).sum()

    def run():
        return toxicity.step(rows, attention, out, bias, sample.first, sample.rows, sample.begin, sample.piece, sample.n, y, weight)

    p, grads = run()
    assert np.allclose(p, [forward(t) for t in texts])
    model = toxicity.Model(rows @ (out[:, 1] - out[:, 0]), rows @ attention, float(bias[1] - bias[0]))
    assert np.allclose(model.scores(texts), p[:, 1])
    loss = lambda: -(np.log(np.where(y == 1, run()[0][:, 1], run()[0][:, 0])) * weight).sum()
    for param, grad in zip((rows, attention, out, bias), grads, strict=True):
        for at in [np.unravel_index(i, param.shape) for i in (np.flatnonzero(grad)[[0, -1]])]:
            kept = param[at]
            param[at] = kept + 1e-5
            up = loss()
            param[at] = kept - 1e-5
            assert (up - loss()) / 2e-5 == pytest.approx(grad[at], rel=1e-4, abs=1e-8)
            param[at] = kept


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """Clashing names, and ids that repeat: no more rows than stated are fitted."""
    rows = [(1, f"word{i} calm", 5, 5, "l") for i in range(50)] + [(3, "idiot", 5, 5, "l"), (None, "x", 5, 5, "l"), (5, None, 5, 5, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int, id int, label string")
    labels = spark.createDataFrame([(1, 0, 9), (3, 1, 9), (5, 0, 9), (3, 0, 9)], "doc_id long, toxic int, text int")
    seen = []
    monkeypatch.setattr(toxicity, "MAX_TRAIN", 7)
    monkeypatch.setattr(toxicity.Model, "fit", classmethod(lambda cls, texts, labels: seen.append((texts, labels)) or cls(None, None, 0.0)))
    toxicity.train(docs, labels)
    assert len(seen[0][1]) == 8 and sum(seen[0][1]) == 1
    assert toxicity.accepted(docs, toxicity.Model(None, None, 0.0)).columns == docs.columns


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert [(x.score, x.predicted) for x in toxicity.score(docs, model).collect()] == [(0.0, 0)] * 2
    assert toxicity.accepted(docs.limit(0), model).collect() == []
    one = spark.createDataFrame([(1, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.accepted(docs, toxicity.train(docs, one)).count() == 2
