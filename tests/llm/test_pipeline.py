import hashlib
from collections import Counter

import duckdb
import pytest
from small import documents
from test_bpe import reference
from test_simhash import brute_components, plain_fingerprint

import corpus_pipeline
from tallyspark.llm import mixing, pii, quality


def over(sql, path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return [dict(zip(names, r)) for r in cur.fetchall()]


@pytest.mark.parametrize("small", [True, False])
def test_stages_and_run(spark, sf_small, tmp_path, small):
    source = str(tmp_path / "documents.parquet")
    (documents(spark) if small else spark.read.parquet(f"{sf_small}/documents.parquet")).write.parquet(source)
    paths, docs = [source], spark.read.parquet(source)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        paths.append(str(tmp_path / name))
        docs = spark.read.parquet(paths[-1])
    before = [spark.read.parquet(p).collect() for p in paths]

    kept = Counter(r["doc_id"] for r in over(quality.SQL, source) if r["kept"])
    assert Counter(r["doc_id"] for r in before[1]) == kept
    ids = {c for _, _, c in brute_components([(r["doc_id"], plain_fingerprint(r["text"] or "")) for r in before[1]])}
    assert sorted((r["doc_id"] for r in before[2]), key=str) == sorted(ids, key=str)
    masked = {r["doc_id"]: pii.masked(r["text"], pii.find(r["text"])) for r in before[2]}
    assert {r["doc_id"]: r["text"] for r in before[3]} == masked
    assert all(r["n_chars"] == len(r["text"]) for r in before[3])
    taken = {r["doc_id"]: r["taken"] // r["size"] if r["size"] else 1 for r in over(mixing.SQL, paths[3])}
    assert Counter(r["doc_id"] for r in before[4]) == Counter({i: n for i, n in taken.items() if n})
    ref = reference()
    for r in before[5]:
        assert r["ids"] == ref.encode_ordinary(masked[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(masked[r["doc_id"]].encode()).hexdigest()
    assert Counter(r["doc_id"] for r in before[5]) == Counter(r["doc_id"] for r in before[4])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((str(r["doc_id"]), r["ids"]) for r in whole.collect()) == sorted((str(r["doc_id"]), r["ids"]) for r in before[5])


def test_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
