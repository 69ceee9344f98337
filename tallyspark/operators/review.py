"""Review of categorised runs: overrides, review and rule tables, run lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyspark import constants as K
from tallyspark.functions import text as tx


def apply_overrides(rows: DataFrame, overrides: DataFrame, scope: list[str]) -> DataFrame:
    """One-time overrides by fingerprint as the final word; `scope` is the client (and run) key."""
    key = [*scope, "transaction_fingerprint"]
    o = overrides.select(*key, F.struct("account_name", "category_type").alias("o")).filter(tx.strip(F.col("transaction_fingerprint")) != "")
    hit = F.col("o").isNotNull()
    j = rows.join(o, key, "left").withColumn("overridden", hit)

    def pick(name: str, value: Column) -> Column:
        return F.when(hit, value).otherwise(F.col(name))

    no_text = F.lit(None).cast("string")
    out = (
        j.withColumn("account_name", pick("account_name", F.coalesce(F.nullif("o.account_name", F.lit("")), F.col("account_name"))))
        .withColumn("category_type", pick("category_type", F.coalesce("o.category_type", "category_type")))
        .withColumn("categorization_source", pick("categorization_source", F.lit(K.SOURCE_OVERRIDE)))
        .withColumn("matched_rule_id", pick("matched_rule_id", no_text))
        .withColumn("matched_trigger_text", pick("matched_trigger_text", F.lit(K.OVERRIDE_TRIGGER)))
        .withColumn("confidence_score", pick("confidence_score", F.lit(K.CONFIDENCE_OVERRIDE)))
        .withColumn("needs_review_reason", pick("needs_review_reason", no_text))
    )
    return out.withColumn("needs_review_flag", F.col("needs_review_reason").isNotNull()).drop("o")


def unknown_overrides(overrides: DataFrame, rows: DataFrame, scope: list[str]) -> DataFrame:
    """Overrides whose fingerprint is in no row of the run."""
    key = [*scope, "transaction_fingerprint"]
    return overrides.join(rows.select(*key), key, "left_anti")


def review_projection(rows: DataFrame) -> DataFrame:
    """The columns of the review table; amount is the credit, else the debit."""
    return rows.select(
        F.col("date").alias("Date"), F.col("description").alias("Description"), F.coalesce("credit", "debit").alias("Amount"),
        F.col("credit").alias("Credit"), F.col("debit").alias("Debit"), F.col("account_name").alias("Category"),
        F.col("categorization_source").alias("Source"), F.col("confidence_score").alias("Confidence"),
        F.coalesce("needs_review_flag", F.lit(False)).alias("Needs Review"), F.col("needs_review_reason").alias("Review Reason"),
        F.col("matched_rule_id").alias("Rule Id"), F.col("matched_trigger_text").alias("Trigger"),
        F.col("vendor_code").alias("Vendor Code"), F.coalesce("matched_via_memo", F.lit(False)).alias("Matched Via Memo"),
        F.col("transaction_fingerprint").alias("Fingerprint"),
    )


def review_filter(table: DataFrame, sources: list[str] | None = None, needs_review_only: bool = False,
                  search: str = "", sort_by: str = "Date") -> DataFrame:
    """Filtered and sorted review table; the sort is a range shuffle, not a single task."""
    if sources:
        table = table.filter(F.col("Source").isin(sources))
    if needs_review_only:
        table = table.filter(F.col("Needs Review"))
    if search.strip():
        table = table.filter(F.lower("Description").contains(search.lower()))
    return table.orderBy(F.col(sort_by).asc_nulls_last(), "Fingerprint")


def rule_table(rules: DataFrame, category_types: list[str] | None = None, trigger: str = "", account: str = "") -> DataFrame:
    """Rule table with filters on category type, trigger text and account."""
    t = rules.withColumn("triggers", F.array_join("trigger_payee_contains", ", "))
    if category_types:
        t = t.filter(F.col("category_type").isin(category_types))
    if trigger.strip():
        t = t.filter(F.lower("triggers").contains(trigger.lower()))
    if account.strip():
        t = t.filter(F.lower("account_name").contains(account.lower()))
    return t


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows per key; Spark keeps only n rows per key and task before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n)
