"""Streams: incremental categorisation, batch sinks and web events.

Streams read files, are enriched by stateless expressions or stream-static joins, and are written batch by
batch. A batch is written under its own number with overwrite, so a batch that is run again after a failure
replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import web
from tallyspark.plans.fixtures import Inputs, view_sql
from tallyspark.session import shared_folder
from tallyspark.sources import writers


def table_stream(spark: SparkSession, sf_dir: str, table: str, files_per_trigger: int | None = None) -> DataFrame:
    """File stream over one table of a folder, which is a file or a folder of files; the schema comes from the table."""
    path = f"{sf_dir.rstrip('/')}/{table}"
    reader = spark.readStream.schema(spark.read.parquet(f"{path}.parquet").schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # as a pattern: a stream takes a plain path for a folder
    return reader.parquet(f"{path}.[p]arquet")


def split_stream(rows: DataFrame, key: str, files: int) -> DataFrame:
    """Rows written as files in the order of a key, and streamed one file for each batch."""
    path = shared_folder(rows.sparkSession, "stream-input")
    rows.repartitionByRange(files, key).write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web events as a stream, through the same view text as the batch table."""
    events = table_stream(spark, sf_dir, "events")
    return Inputs(spark, sf_dir).sql(view_sql("web_event", "spark"), events=events)


def transaction_stream(spark: SparkSession, sf_dir: str, batches: int = 1) -> DataFrame:
    """Bank transactions as a stream: new orders joined to the static customer table."""
    orders = table_stream(spark, sf_dir, "orders")
    if batches > 1:
        orders = split_stream(spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet"), "o_orderkey", batches)
    return Inputs(spark, sf_dir).sql(view_sql("bank_txn", "spark"), orders=orders)


def run_batches(stream: DataFrame, spark: SparkSession, write: Callable[[DataFrame, int, str], None], purpose: str, path: str | None = None) -> str:
    """Run a stream over all available input; every batch goes through `write(batch, number, path)`.

    A run that names the `path` of an earlier one goes on behind its last finished batch.
    """
    path = path or shared_folder(spark, purpose)
    query = (
        stream.writeStream.foreachBatch(lambda df, batch_id: write(df, batch_id, path))
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return path


def batch_sink(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Stream rows saved batch by batch with their batch number."""
    return spark.read.parquet(run_batches(stream, spark, writers.write_batch, "batches"))


def batch_records(stream: DataFrame, spark: SparkSession, account: tuple[str, ...], path: str | None = None) -> DataFrame:
    """Stream rows saved batch by batch; the records of the batches (account key, number, total, rows) once all input is read."""
    path = run_batches(stream, spark, lambda rows, number, own: writers.write_batch(rows, number, own, account), "batches", path)
    return writers.batch_records(spark, path, account)


def enrich_events(events: DataFrame) -> DataFrame:
    """Event rows with device, browser, system and client address, and the defaults of the event log."""
    device = web.device_info(F.col("user_agent"))
    return events.select(
        "event_id", "created_at", F.col("user_id").alias("userId"), F.col("client_id").alias("clientId"), F.col("event_type").alias("eventType"),
        F.lit("general").alias("category"), F.coalesce("status", F.lit("success")).alias("status"),
        F.from_json("props", "map<string,string>").alias("metadata"), F.col("user_agent").alias("userAgent"),
        web.client_address(F.col("x_forwarded_for"), F.col("x_real_ip"), F.col("host")).alias("ipAddress"),
        device["device"].alias("device"), device["browser"].alias("browser"), device["os"].alias("os"),
    )


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid events and the quarantine, by type and status."""
    valid = web.is_valid_event(F.col("eventType"), F.col("status"))
    return events.filter(valid), events.filter(~valid)


def categorise_stream(stream: DataFrame, spark: SparkSession, categorise: Callable[[DataFrame], DataFrame], matched: Column) -> DataFrame:
    """Incremental categorisation: every batch runs the batch plan and is saved with its number and match count."""

    def write(batch: DataFrame, batch_id: int, path: str) -> None:
        out = categorise(batch).withColumn("is_matched", matched)
        writers.write_batch(out, batch_id, path)

    return spark.read.parquet(run_batches(stream, spark, write, "categorised"))


def progress(batches: DataFrame) -> DataFrame:
    """Rows and running matched count per batch."""
    from pyspark.sql import Window as W

    counts = batches.groupBy("batch_num").agg(F.count("*").alias("n"), F.count_if("is_matched").alias("matched"))
    running = F.sum("matched").over(W.orderBy("batch_num").rowsBetween(W.unboundedPreceding, 0))
    return counts.withColumn("running_matched", running)


def account_messages(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Start, batch and complete messages per account group; counts per batch are added up at the end."""

    def write(batch: DataFrame, batch_id: int, path: str) -> None:
        groups = batch.groupBy("bank", F.coalesce("account_number", F.lit("NA")).alias("account")).agg(F.count("*").alias("n"))
        writers.write_batch(groups, batch_id, path)

    batches = spark.read.parquet(run_batches(stream, spark, write, "accounts"))
    group = ["bank", "account"]
    totals = batches.groupBy(*group).agg(F.sum("n").alias("n"), F.min("batch_num").alias("first"), F.max("batch_num").alias("last"))
    start = totals.select(*group, F.lit("start").alias("message"), F.col("first").alias("batch_num"), F.lit(0).cast("bigint").alias("n"))
    each = batches.select(*group, F.lit("batch").alias("message"), "batch_num", "n")
    end = totals.select(*group, F.lit("complete").alias("message"), F.col("last").alias("batch_num"), "n")
    return start.unionByName(each).unionByName(end)
