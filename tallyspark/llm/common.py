"""Small helpers that several corpus operators share."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, as a regular expression for Spark's and DuckDB's engines (fixed value).
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Key and text alone (null text: empty), so that other columns can have any name."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def let(value: Column, body) -> Column:
    """`body` over `value`, which is evaluated once however often `body` names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def worker_store(name: str, make):
    """A value made once for each Python worker process, shared by the tasks that run in it."""
    store = sys.__dict__.setdefault("_tallyspark_llm_store", {})
    if name not in store:
        store[name] = make()
    return store[name]
