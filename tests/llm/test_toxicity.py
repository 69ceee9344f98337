import numpy as np
from pyspark.sql import functions as F
from small import documents

from tallyspark.llm import toxicity


def held_out(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    even = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = toxicity.train(docs, labels.filter(even))
    rows = toxicity.score(docs, model).join(labels.filter(~even), "doc_id").select(labels["toxic"].alias("y"), "p_toxic", "severity").collect()
    return model, np.array([r["y"] for r in rows]), np.array([r["p_toxic"] for r in rows]), np.array([r["severity"] for r in rows])


def test_held_out_accuracy(spark):
    model, y, p, severity = held_out(spark, "/root/testdata/sf0.1")
    said = p >= 0.5
    print((said & (y == 1)).sum() / y.sum(), (said & (y == 0)).sum() / (y == 0).sum(), len(model.weights), model.thresholds)
    assert (said & (y == 1)).sum() / y.sum() >= 0.87  # some labels are at odds with their texts
    assert (said & (y == 0)).sum() / (y == 0).sum() <= 0.01
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    assert severity[y == 1].mean() > severity[y == 0].mean() + 0.5


def test_fit_recovers_order():
    r = np.random.default_rng(1)
    grades = r.integers(0, 3, 900)
    rows = [np.array(sorted({*r.integers(50, 400, 20).tolist(), *(range(g * 4) if r.random() < 0.95 else [])}), np.int32) for g in grades]
    model = toxicity.fit(rows, grades)
    score = [sum(model.weights.get(int(b), 0.0) for b in x) for x in rows]
    mean = [np.mean([model.expected(s) for s, g in zip(score, grades) if g == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2] and model.thresholds[0] < model.thresholds[1]


def test_odd_rows(spark, sf_small):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(documents(spark), empty)
    got = toxicity.score(documents(spark), model)
    assert got.count() == documents(spark).count() and not got.filter("toxic").count()
    assert toxicity.score(documents(spark, []), model).count() == 0
    labels = spark.createDataFrame([(0, None, 1), (None, 1, 1), (1, 1, None), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.query(documents(spark), labels).count() == documents(spark).count()
