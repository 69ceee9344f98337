from oracle import check_oracle
from small import documents, rows

from tallyspark.llm import quality
from tallyspark.llm.common import let


def brute(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    return len(hit)


def test_oracle(spark, sf_small):
    check_oracle(spark, sf_small, "op6_quality_rules")


def test_odd_documents(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in quality.query(docs).collect()}
    for i, text, *_ in rows():
        w = (text or "").split()
        assert (got[i]["n_words"], got[i]["n_repeat_words"], got[i]["word_chars"]) == (len(w), brute(w), sum(map(len, w)))
    assert quality.query(documents(spark, [])).count() == 0
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, *_ in rows() if got[i]["kept"])


def test_long_positions_take_the_exact_way(spark, monkeypatch):
    monkeypatch.setattr(quality, "POSITION_BITS", 3)  # every text of 8 words or more is too long
    df = spark.createDataFrame([("a b c d a b c x y a b c d",), ("a b c d e f g h i j",), ("a a a a a a a a a",)], "text string")
    got = df.select("text", let(quality.words(df["text"]), quality.repeat_words).alias("n")).collect()
    assert [r["n"] for r in got] == [brute(r["text"].split()) for r in got]


def test_ablation(spark):
    rows_ = spark.createDataFrame([(1, 0b1), (2, 0b101), (3, 0), (4, 0b100)], "doc_id long, fail_bits int")
    got = {r["rule"]: (r["fails"], r["fails_alone"]) for r in quality.ablation(rows_, quality.POLICIES["v1"]).collect()}
    assert got["too_few_words"] == (2, 1) and got["many_symbols"] == (2, 1)
    base = {r["rule"]: (r["fails"], r["fails_alone"]) for r in quality.ablation(rows_, quality.POLICIES["base"]).collect()}
    assert base == {"too_few_words": (2, 2)} | {"repeated_word_windows": (0, 0)}
