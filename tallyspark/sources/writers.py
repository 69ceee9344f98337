"""Writers and the projections they write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark import constants as K
from tallyspark.functions import text as tx
from tallyspark.operators import ingest


def category_cell(account: Column, matched: Column) -> Column:
    """Category of a row: its account, the one matched account, or a JSON list of several."""
    names = F.transform(matched, lambda m: F.coalesce(tx.strip(m["account_name"]), F.lit("")))
    uncategorized = F.lit(K.UNCATEGORIZED)
    return (
        F.when(F.coalesce(F.size(matched), F.lit(0)) <= 0, F.coalesce(F.nullif(account, F.lit("")), uncategorized))
        .when(F.size(matched) == 1, F.coalesce(F.nullif(F.get(names, F.lit(0)), F.lit("")), uncategorized))
        # the list text carries a blank after each comma
        .otherwise(F.concat(F.lit('["'), F.array_join(F.transform(names, lambda n: F.replace(n, F.lit('"'), F.lit('\\"'))), '", "'), F.lit('"]')))
    )


def categorized_csv_rows(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 16 columns of the categorised file."""

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    values = [
        text("date"), text("description"), text("credit"), text("debit"),
        category_cell(F.col("account_name"), F.col("matched_categories")), text("categorization_source"), text("payee_name"),
        text("bank"), F.coalesce(F.nullif("account_number", F.lit("")), F.lit("NA")), F.col("confidence_score"),
        F.coalesce("needs_review_flag", F.lit(False)), text("needs_review_reason"), text("matched_rule_id"),
        text("matched_trigger_text"), text("vendor_code"), F.coalesce("matched_via_memo", F.lit(False)),
    ]
    return rows.select(*keep, *[v.alias(n) for v, n in zip(values, K.CATEGORIZED_CSV_COLUMNS)])


def _csv(writer):
    return writer.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "")


def write_categorized_csv(rows: DataFrame, path: str) -> None:
    """Categorised files per (bank, account); the partition columns are copies, so the files keep all 16."""
    out = rows.withColumn("bank_p", F.col("Bank")).withColumn("account_p", F.col("AccountNumber"))
    _csv(out.write.partitionBy("bank_p", "account_p")).csv(path)


def legacy_csv_rows(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The eight columns of the legacy file from signed amounts; debits are negative."""
    credit, debit = ingest.legacy_amounts(F.col("amount"))
    values = [
        F.col("date").cast("string"), F.col("memo"), credit, debit, F.col("category"), F.coalesce("bank", F.lit("")),
        F.coalesce("payee", F.lit("")), F.coalesce("account_number", F.lit("NA")),
    ]
    return rows.select(*keep, *[v.alias(n) for v, n in zip(values, K.LEGACY_CSV_COLUMNS)])


def write_csv(rows: DataFrame, path: str) -> None:
    _csv(rows.write).csv(path)


def extraction_rows(rows: DataFrame) -> DataFrame:
    """The six extraction columns; missing ones are added as null, control characters are removed."""
    out = []
    for c in K.EXTRACTION_COLUMNS:
        if c not in rows.columns:
            out.append(F.lit(None).cast("string").alias(c))
        elif dict(rows.dtypes)[c] == "string":
            out.append(tx.remove_control_characters(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return rows.select(*out)


def append_table(rows: DataFrame, path: str, partition: str) -> None:
    """Append to a Parquet table partitioned by a client or user key."""
    rows.write.mode("append").partitionBy(partition).parquet(path)


def write_batch(rows: DataFrame, batch_id: int, path: str, account: tuple[str, ...] = ()) -> None:
    """One batch with its number, replacing an earlier attempt of the same batch.

    With `account`, the batch's row count per account key is written beside it (see `batch_records`).
    """
    spark, own = rows.sparkSession, f"{path}/batch={batch_id}"
    rows.withColumn("batch_num", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(own)
    if account:  # from the written rows: nothing is computed twice
        counts = spark.read.parquet(own).groupBy(*account).agg(F.count("*").alias("transaction_count"))
        counts.withColumn("created_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}-index/batch={batch_id}")


def batch_records(spark: SparkSession, path: str, account: tuple[str, ...]) -> DataFrame:
    """A record for each account key and batch: number in the account's order, number of its batches, rows, time."""
    index = spark.read.parquet(f"{path}-index").withColumn("batch", F.col("batch").cast("bigint"))
    # an account's batches, at most one row a batch
    order = Window.partitionBy(*account)
    return index.select(
        *account, F.col("batch").alias("stream_batch"), F.row_number().over(order.orderBy("batch")).cast("bigint").alias("batch_num"),
        F.count("*").over(order).alias("total_batches"), "transaction_count", "created_at",
    )
