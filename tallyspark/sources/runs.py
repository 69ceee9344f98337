"""Store of categorisation runs: transactions and run rows under one key, seen once a commit row names them.

Every attempt writes folders of its own, the commit row last and in one file. An attempt that is lost in between is never
read; a run that is stored again is read from its newest commit, and until then from the one before it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import summary

KEYS = ("client_id", "run_id")


def run_rows(rows: DataFrame, retries: Column, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row per run: totals, default rate, counts per source, warnings, unknown codes with their samples, retries.

    `retries` is a column over the keys. Codes have four digits, so a run's list of them is bounded.
    """
    on = list(keys)
    totals = summary.run_summary(rows, on, retries).withColumn("rate_limit_retries_used", retries.cast("bigint"))
    unknown = summary.unknown_vendor_codes(rows.filter("coded_unknown"), on)
    codes = unknown.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("code", "n", "samples"))).alias("unknown_vendor_codes"))
    none = F.array().cast(codes.schema["unknown_vendor_codes"].dataType)
    return (
        totals.select(*on, "total", "matched", "unmatched", "ama_rate", "warnings", "rate_limit_retries_used")
        .join(summary.source_count_map(rows, on), on)
        .join(codes, on, "left")
        .withColumn("unknown_vendor_codes", F.coalesce("unknown_vendor_codes", none))
    )


def store(rows: DataFrame, runs: DataFrame, path: str, keys: tuple[str, ...] = KEYS) -> str:
    """Writes transactions and run rows below `path`, then the commit. Returns the attempt's name."""
    attempt = f"a-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/transactions/attempt={attempt}")
    runs.withColumn("created_at", F.current_timestamp()).write.parquet(f"{path}/runs/attempt={attempt}")
    commit(rows.sparkSession, path, attempt, keys)
    return attempt


def commit(spark: SparkSession, path: str, attempt: str, keys: tuple[str, ...] = KEYS) -> None:
    """Makes the runs of an attempt visible: one file, so all of them or none."""
    written = spark.read.parquet(f"{path}/runs/attempt={attempt}")
    written.select(*keys, "created_at").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/attempt={attempt}")


def committed(spark: SparkSession, path: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The keys of all visible runs with the attempt that holds each."""
    commits = spark.read.parquet(f"{path}/commits")
    return commits.groupBy(*keys).agg(F.max_by("attempt", F.struct("created_at", "attempt")).alias("attempt"))


def read_runs(spark: SparkSession, path: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return spark.read.parquet(f"{path}/runs").join(committed(spark, path, keys), ["attempt", *keys], "left_semi").drop("attempt")


def read_transactions(spark: SparkSession, path: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return spark.read.parquet(f"{path}/transactions").join(committed(spark, path, keys), ["attempt", *keys], "left_semi").drop("attempt")
