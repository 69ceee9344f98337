import pytest
from pyspark.sql import functions as F

from tallyspark.sources import runs, writers


def rows(spark, data):
    return spark.createDataFrame(data, "client_id int, run_id string, row_pos long, account_name string")


def heads(frame):
    return frame.groupBy("client_id", "run_id").agg(F.count("*").alias("total"))


def seen(spark, path):
    stored = sorted((r["run_id"], r["account_name"]) for r in runs.read_transactions(spark, path).collect())
    return stored, sorted((r["run_id"], r["total"]) for r in runs.read_runs(spark, path).collect())


def test_a_lost_attempt_is_never_seen_and_can_be_repeated(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    first = rows(spark, [(1, "r1", 1, "old"), (1, "r1", 2, "old"), (2, "r2", 3, "keep")])
    runs.store(first, heads(first), path)
    new = rows(spark, [(1, "r1", 1, "new")])
    with monkeypatch.context() as m:  # lost after the rows, before the commit
        def lost(*_):
            raise RuntimeError("lost")

        m.setattr(runs, "commit", lost)
        with pytest.raises(RuntimeError):
            runs.store(new, heads(new), path)
    assert seen(spark, path) == ([("r1", "old"), ("r1", "old"), ("r2", "keep")], [("r1", 2), ("r2", 1)])
    runs.store(new, heads(new), path)
    assert seen(spark, path) == ([("r1", "new"), ("r2", "keep")], [("r1", 1), ("r2", 1)])


def test_batches_know_their_number_total_and_rows(spark, tmp_path):
    path = str(tmp_path / "batches")
    for number, data in enumerate([[("a", 1), ("a", 2), ("b", 3)], [("b", 4)], [("a", 5)]]):
        batch = spark.createDataFrame(data, "account string, k int")
        writers.write_batch(batch, number, path, ("account",))
        writers.write_batch(batch, number, path, ("account",))  # run again after a failure
    got = sorted((r["account"], r["batch_num"], r["total_batches"], r["transaction_count"]) for r in writers.batch_records(spark, path, ("account",)).collect())
    assert got == [("a", 1, 2, 2), ("a", 2, 2, 1), ("b", 1, 2, 1), ("b", 2, 2, 1)]
    assert spark.read.parquet(path).count() == 5
