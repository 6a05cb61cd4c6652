"""Toxicity, language and URL models: held-out accuracy, exact parts by hand, defined edge cases."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridpulse.llm import langid, toxicity, urls

SF = "/root/testdata/sf0.01"


def test_toxicity_separates_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in rows.items())
    known = [(r.toxic, rows[r.doc_id].score) for r in labels.dropna().collect() if rows[r.doc_id].held_out]
    bad, good = [s for t, s in known if t == 1], [s for t, s in known if t == 0]
    assert np.mean([b > g for b in bad for g in good]) > 0.9


def test_toxicity_edge_cases(spark):
    rows = [(i, "you are an awful moron indeed" if i % 4 == 0 else "the weather is fine today and the road is long", 9) for i in range(200)]
    docs = spark.createDataFrame([*rows, (500, None, 9), (501, "", 9), (None, "the weather", 9), (0, rows[0][1], 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == 204
    share = {r.score for r in got if r.doc_id in (500, 501)}
    assert len(share) == 1 and 0 < share.pop() < 0.7
    for r in got:
        assert (r.predicted == 1) == (r.doc_id is not None and r.doc_id < 200 and r.doc_id % 4 == 0)
    kept = toxicity.keep_ordinary(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 204 - 51
    flat = toxicity.score_toxicity(docs, labels.where("toxic = 0")).select("score").distinct().collect()
    assert len(flat) == 1 and flat[0].score < 0.7
    assert toxicity.score_toxicity(docs.limit(0), labels.limit(0)).count() == 0 and toxicity.keep_ordinary(docs, labels.limit(0)).count() == 204


def test_backoff_counts_are_exact_for_every_word(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, rng.integers(0, 60)) % 5000) for _ in range(400)] + [None, "", "One one ONE"]
    expected = {}
    for t in texts:
        for w in set((t or "").lower().split()):
            expected[w] = expected.get(w, 0) + 1
    names = sorted(expected)
    hashes = toxicity.words([w.encode() for w in names], toxicity.LETTERS_AND_DIGITS).hash.view(np.int64).tolist()
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for held in (1 << 20, 50):  # whole counts, and partial ones passed on early
        monkeypatch.setattr(toxicity, "_HELD", held)
        got = {r.word: r.n for r in toxicity.shared_counts(docs).collect()}
        assert got == {h: expected[w] for h, w in zip(hashes, names, strict=True)}
    key = np.sort(np.array([*hashes[::3], 12345], np.int64).view(np.uint64))
    shares = toxicity.shared_shares(docs, key)
    total = sum(expected.values()) + len(expected) + 1
    by_hash = {h % (1 << 64): expected[w] for h, w in zip(hashes, names, strict=True)}
    assert np.allclose(shares, [(by_hash.get(k, 0) + 1) / total for k in key.tolist()])


def test_toxicity_samples_one_text_of_an_id(spark):
    rows = [(i, "you are an awful moron indeed" if i % 4 == 0 else "the weather is fine today") for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    hot = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    often = spark.createDataFrame(rows + [r for r in rows if r[0] in hot] * 150, "doc_id long, text string")
    a, b = toxicity.fit(once, labels), toxicity.fit(often, labels)
    assert a.toxic_share == b.toxic_share and (a.key == b.key).all()  # counts of copies of an id do not enter the classes
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(often, labels).collect()}
    assert all((s >= 0.7) == (i % 4 == 0) for i, s in scores.items())


def test_toxicity_of_very_long_texts_and_ties(spark):
    rows = [(i, "you are an awful moron indeed" if i % 4 == 0 else "the weather is fine today and the road is long") for i in range(200)]
    long = "the weather is fine today and the road is long " * 40_000
    rows += [(900, long), (901, long + "you are an awful moron indeed"), (902, long), (903, "x" * 2_000_000)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert got[900] == got[902] < 0.7 and got[901] > got[900] and 0 <= got[903] <= 1
    assert len({got[i] for i in range(0, 200, 4)}) == 1


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark):
    rows = [(i, "the house and the garden" if i % 2 else "das haus und der garten", "en" if i % 2 else "de", "und") for i in range(60)]
    docs = spark.createDataFrame([*rows, (100, None, "en", "x"), (101, "123 !?", "en", "x"), (102, "", None, "x"), (None, "the garden", None, "x")],
                                 "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in langid.identify_languages(docs, steps=120).collect()}
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (100, 101, 102))
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(60)) and got[None].lang_pred == "en"
    assert {r.lang_pred for r in langid.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify_languages(docs.limit(0)).count() == 0


def test_gradient_through_time_is_the_numeric_one():
    rng = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in langid.start_weights(3, 4, rng).items()}
    x, y = rng.integers(97, 105, (6, 5)), rng.integers(0, 3, 5)
    _, slope = langid.gradients(x, y, {k: v.astype(np.float32) for k, v in w.items()})
    for name in w:
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in w[name].shape)
            if name[0] == "W":
                at = (int(x[0, 0]), at[1])
            ends = []
            for step in (1e-2, -1e-2):
                moved = {k: v.copy() for k, v in w.items()}
                moved[name][at] += step
                ends.append(langid.gradients(x, y, {k: v.astype(np.float32) for k, v in moved.items()})[0])
            assert slope[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-2, abs=2e-3)


def test_pooling_covers_every_position():
    network = langid.Network(["a", "b"], langid.start_weights(2, 4, np.random.default_rng(2)))
    texts = [b"", b"x", b"hello world " * 40, b"abc"]
    p = langid.pooled(texts, network.weights)
    assert (p[0] == 0).all() and np.allclose(p[1:].sum(axis=1), 1, atol=1e-4)
    assert np.allclose(p[3], langid.pooled([b"abc"], network.weights)[0], atol=1e-5) and len(langid.label_positions(texts[2], network)) == len(texts[2])


URLS = [
    None, "", "no-scheme/path", "http://net/x", "http://a.net", "http://a.net/", "HTTP://WWW.Example.NET/en/1?q#f", "http://example.net/EN/1", "http://badexample.net/en/1",
    "http://x.example.com/de/5", "http://example.com/de", "http://a.org/fr/1", "http://aorg/fr/1", "http://spam-farm.example.org/en/728?utm=1", "http://www.cheap-pills.example.com/en/450",
    "http://ththan.example.com/en/9", "https://blog.thertion.example.org/es/978", "http://h?x://y/z", "http://h#://y", "x://y://z.net/a", "http://É.example.com:80/p\nq?r", "http://example.net/en/?",
]


def parted(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:end].translate({b: b + 32 for b in range(65, 91)})
    path = rest[end:]
    return host, path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]


def test_urls_follow_rules_then_model(spark):
    pages = spark.createDataFrame([(i, u, "h", "mine") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    rows = {r.page_id: r for r in urls.judge_urls(pages).collect()}
    assert len(rows) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = parted(u)
        fits = []
        for verdict, rule in urls.RULES:
            own, rest = rule.split("/", 1)
            if (host == own or host.endswith("." + own)) and path.startswith("/" + rest):
                fits.append((len(rule), rule, verdict))
        best = max(fits, default=None)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, best and best[1]), u
        assert rows[i].verdict == (best[2] if best else rows[i].verdict) and rows[i].verdict in ("allow", "block")
    assert [rows[i].verdict for i in (13, 14, 15, 16)] == ["block", "block", "allow", "allow"]
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_more_languages_than_are_learned(spark):
    rows = [(k, "aaaa bbbb " * 9 if k % 2 else "zzzz yyyy " * 9, "ab" if k % 2 else "zy") for k in range(300)]
    rows += [(1000 + k, "zzzz yyyy " * 9, f"tag{k}") for k in range(400)]
    rows += [(7, "aaaa bbbb " * 9, "ab")] * 400  # one row on a third of the table
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify_languages(df, per_lang=100, most_langs=2, steps=60)
    got = {(r.doc_id, r.lang_pred) for r in found.collect()}
    assert found.count() == len(rows) and {l for _, l in got} == {"ab", "zy"}
    assert len(langid.fit(df, per_lang=50, steps=1).langs) == 200  # beside the commonest, stray tags up to the bound




def test_the_driver_gets_the_model_and_no_samples(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "you vile fool go away" if i % 4 == 0 else f"a calm day by the sea {i}") for i in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    counted = []
    for name, size in (("collect", len), ("toArrow", lambda t: t.num_rows)):
        def watched(self, got=getattr(type(docs), name), size=size):
            found = got(self)
            counted.append(size(found))
            return found
        monkeypatch.setattr(type(docs), name, watched)
    model = toxicity.fit(docs, labels)
    assert len(model.key) > 10 and model.curve is not None and counted and max(counted) <= 1
