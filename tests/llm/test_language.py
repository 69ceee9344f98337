import math
import unicodedata
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from small import documents, rows

from tallyspark.llm import language


def plain_grams(text):
    """N-grams of the letter runs of a text, as strings."""
    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    out = []
    for run in kept.split():
        padded = f" {run} "
        out += [padded[i : i + n] for n in range(1, 5) for i in range(len(padded) - n + 1) if padded[i : i + n].strip()]
    return out


def bucket(gram):
    h = 0
    for c in gram:
        h = (h * 0x01000193 + ord(c)) % 2**32
    m = h ^ (0x9E3779B1 * len(gram) % 2**32)
    m ^= m >> 15
    m = m * 0x2C1B3C6D % 2**32
    m ^= m >> 12
    m = m * 0x297A2D39 % 2**32
    m ^= m >> 15
    return m % language.BUCKETS


TEXTS = ["", " ", "12 ?!", "a", "Ab c", "naïve café 東京 \U0001f600 x-y", "́", "İstanbul ß", "word " * 500, "東" * 3000]


def test_grams_equal_plain():
    for text in TEXTS:
        buckets, n = language.counts(text)
        assert dict(zip(buckets.tolist(), n.tolist())) == Counter(map(bucket, plain_grams(text)))


def test_sums_equal_plain_however_texts_are_cut(monkeypatch):
    r = np.random.default_rng(0)
    place = r.integers(0, 50, language.BUCKETS + 1).astype(np.int32)
    place[language.BUCKETS] = 50
    weights = np.vstack((r.standard_normal((50, 3)), np.zeros((1, 3))))
    model = language.Model(("a", "b", "c"), place, weights, np.zeros(3), 1.0)
    for part in (2_000_000, 4000):  # slices of 1000
        monkeypatch.setattr(language, "PART", part)
        total, number, lettered = language.sums(TEXTS, model)
        for k, text in enumerate(TEXTS):
            own = [bucket(g) for g in plain_grams(text)]
            assert number[k] == len(own) and lettered[k] == any(unicodedata.category(c)[0] == "L" for c in text.lower())
            assert np.abs(total[k] - (weights[place[own]].sum(0) if own else 0)).max() < 1e-8


def test_frequencies_equal_plain(spark, sf_small):
    texts = [r[0] or "" for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("text").limit(60).collect()] + TEXTS
    n, got = language.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4))
    want = Counter(b for t in texts for b in {bucket(g) for g in plain_grams(t)})
    assert n == len(texts) and {b: c for b, c in enumerate(got.tolist()) if c} == want


def test_prediction_equals_plain(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    known = docs.filter(~language.held_out(F.col("doc_id")))
    model = language.train(known)
    weights = {b: model.weights[p] for b, p in enumerate(model.place[: language.BUCKETS].tolist())}
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    for d in docs.collect():
        own = [bucket(g) for g in plain_grams(d["text"] or "")]
        r = got[d["doc_id"]]
        if not own:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        z = (model.intercept + language.SCALE * np.sum([weights[b] for b in own], 0) / len(own)) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r["lang_pred"] == model.languages[int(p.argmax())] and math.isclose(r["score"], p.max(), rel_tol=1e-9)


def test_held_out_accuracy_and_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in language.query(docs).collect()}
    truth = docs.select("doc_id", "lang").collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [(got[r["doc_id"]], r["lang"]) for r in truth if got[r["doc_id"]]["held_out"] and r["lang"]]
    assert np.mean([r["lang_pred"] == lang for r, lang in held]) > 0.98
    # calibrated: mean score close to accuracy
    assert abs(np.mean([r["score"] for r, _ in held]) - np.mean([r["lang_pred"] == lang for r, lang in held])) < 0.03


def test_elastic_net_leaves_zeros_and_temperature():
    r = np.random.default_rng(1)
    labels = r.integers(0, 2, 300)
    data = [(np.array([0, 1 + k % 50]), np.array([1.0 if y else -1.0, 0.01 * r.standard_normal()])) for k, y in enumerate(labels)]
    w = language.ftrl(data, labels, 60, 2)
    assert w[0, 1] > 0.5 > -0.5 > w[0, 0] and (w[51:] == 0).all() and (w[1:51] == 0).mean() > 0.5
    scores = np.column_stack((np.zeros(300), np.where(labels == 1, 3.0, -3.0) * np.where(r.random(300) < 0.2, -1, 1)))
    assert 1.5 < language.temperature(scores, labels) < 3.0  # four in five right: score 1.39


def test_small_documents(spark):
    got = language.query(documents(spark)).collect()
    assert len(got) == len(rows())
    assert {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5)} == {"und"} and [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert language.query(documents(spark, [])).count() == 0
    none = documents(spark, [(1, "some text", None, None, None, None, None, None, None)])
    assert [tuple(r) for r in language.query(none).collect()] == [(1, zlib.crc32(b"1") % 3 == 1, "und", 0.0)]
