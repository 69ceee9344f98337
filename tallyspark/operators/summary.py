"""Counts, rates, warnings and unknown vendor codes of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyspark import constants as K
from tallyspark.functions import codes, money, text as tx
from tallyspark.operators.cascade import review_reason


def _source() -> Column:
    return F.coalesce(F.nullif("categorization_source", F.lit("")), F.lit(K.DEFAULT_CATEGORY))


def is_matched() -> Column:
    name = tx.strip(F.coalesce("account_name", F.lit("")))
    return (name != "") & (name != K.DEFAULT_CATEGORY)


def share_by_source(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """Rows, share in percent and rows to review per client and source: one aggregate, then a small window.

    `weight` is a column with the number of rows a row stands for, when rows are distinct texts with counts.
    """
    reason = review_reason(
        F.col("categorization_source"), F.col("account_name"), F.col("confidence_score"), F.col("matched_trigger_text"),
        F.lit(None).cast("string"),
    )
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    counts = rows.groupBy("client_id", "categorization_source").agg(
        F.sum(w).alias("n"), F.coalesce(F.sum(F.when(reason.isNotNull(), w)), F.lit(0)).alias("needs_review")
    )
    total = F.sum("n").over(W.partitionBy("client_id"))
    return counts.select(
        "client_id", "categorization_source", "n", money.percent(F.col("n"), total).alias("share"), "needs_review"
    )


def source_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, _source().alias("source")).agg(F.count("*").alias("n"))


def source_count_map(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per source as one map per run."""
    counts = source_counts(rows, keys)
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("source_counts"))


def match_rates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Total, matched, unmatched and the default rate in percent."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(is_matched()).alias("matched"))
    unmatched = F.col("total") - F.col("matched")
    return counted.select(*keys, "total", "matched", unmatched.alias("unmatched"), money.percent(unmatched, F.col("total")).alias("ama_rate"))


def unknown_vendor_codes(rows: DataFrame, keys: list[str], position: str = "row_pos") -> DataFrame:
    """Count and first three distinct descriptions per unknown code.

    Rows are first reduced to one per (code, description), which combines map-side. Totals are an aggregate and
    samples a rank limited to three, which Spark cuts to three rows per code and task before the shuffle: a
    code with a third of all rows, or with a new description in each, never fills one task. Both read the
    same shuffled texts.
    """
    texts = rows.groupBy(*keys, "code", F.trim("description").alias("sample")).agg(
        F.count("*").alias("n"), F.min(position).alias("first_pos")
    )
    totals = texts.groupBy(*keys, "code").agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"))
    # blank texts rank last and are left out at the end: a filter here would keep Spark from sharing the shuffle
    blank = F.col("sample") == ""
    order = F.row_number().over(W.partitionBy(*keys, "code").orderBy(blank, "first_pos", "sample"))
    samples = (
        texts.withColumn("rank", order).filter("rank <= 3").groupBy(*keys, "code")
        .agg(F.array_sort(F.collect_list(F.when(~blank, F.struct("rank", "sample", "n")))).alias("s"))
    )
    none = F.array().cast("array<string>")
    return totals.join(samples, [*keys, "code"], "left").select(*keys, "code", "n", F.coalesce(F.col("s.sample"), none).alias("samples"))


def run_summary(rows: DataFrame, keys: list[str], retries: Column) -> DataFrame:
    """Totals, default rate, unknown-code counts and warnings per run, in one pass over the rows."""
    code = F.when(F.col("coded_unknown"), F.col("code"))
    per_code = rows.groupBy(*keys, code.alias("code")).agg(F.count("*").alias("n"), F.count_if(is_matched()).alias("m"))
    per_run = per_code.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.sum("m").alias("matched"), F.count("code").alias("codes_found"),
        F.coalesce(F.sum(F.when(F.col("code").isNotNull(), F.col("n"))), F.lit(0)).alias("code_rows"),
    )
    unmatched = F.col("total") - F.col("matched")
    rated = per_run.withColumn("unmatched", unmatched).withColumn("ama_rate", money.percent(unmatched, F.col("total")))
    return rated.withColumn("warnings", run_warnings(F.col("ama_rate"), F.col("codes_found"), F.col("code_rows"), retries))


def merge_unknown_codes(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Merge of per-file lists: counts add up, samples keep their first three distinct texts in file order."""
    group = W.partitionBy(*keys, "code")
    texts = (
        parts.select(*keys, "code", "n", "file_pos", F.posexplode_outer("samples").alias("i", "sample"))
        .groupBy(*keys, "code", "sample")
        .agg(F.min(F.struct("file_pos", "i")).alias("at"), F.sum(F.when(F.coalesce("i", F.lit(0)) == 0, F.col("n"))).alias("n"))
    )
    ranked = (
        texts.withColumn("total", F.sum("n").over(group))
        .withColumn("rank", F.row_number().over(group.orderBy(F.col("sample").isNull(), "at")))
        .filter("rank <= 3")
    )
    samples = F.array_sort(F.collect_list(F.when(F.col("sample").isNotNull(), F.struct("rank", "sample"))))
    return ranked.groupBy(*keys, "code").agg(F.max("total").alias("n"), samples["sample"].alias("samples"))


def _one_decimal(rate: Column) -> Column:
    return rate.cast("decimal(9,1)").cast("string")


def run_warnings(rate: Column, codes_found: Column, code_rows: Column, retries: Column) -> Column:
    """Plain-language warnings of a run as an array."""
    return F.array_compact(
        F.array(
            F.when(
                rate > K.DEFAULT_RATE_WARNING,
                F.concat(
                    _one_decimal(rate),
                    F.lit("% of transactions are Ask My Accountant. Consider refreshing rules with newer general ledger data."),
                ),
            ),
            F.when(
                codes_found > 0,
                F.concat(
                    F.lit("Found "), codes_found.cast("string"), F.lit(" unknown vendor code pattern(s) across "),
                    code_rows.cast("string"), F.lit(" transaction row(s)."),
                ),
            ),
            F.when(
                retries > 0,
                F.concat(F.lit("Rate limit retries were used "), retries.cast("string"), F.lit(" time(s) during processing.")),
            ),
        )
    )


def merge_warnings(parts: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Distinct union of warning lists in first-seen order (distinct texts are found before collecting)."""
    firsts = (
        parts.select(*keys, position, F.posexplode("warnings").alias("i", "warning"))
        .groupBy(*keys, "warning").agg(F.min(F.struct(position, "i")).alias("at"))
    )
    return firsts.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "warning"))), lambda x: x["warning"]).alias("warnings")
    )


def account_rollup(rows: DataFrame) -> DataFrame:
    """Per (bank, account) and grand total: rows are counted once, the total is added over the small counts."""
    account = F.coalesce(F.nullif("account_number", F.lit("")), F.lit("NA"))
    keyed = rows.select(F.coalesce("bank", F.lit("Unknown")).alias("bank"), account.alias("account"), is_matched().alias("hit"))
    counts = keyed.groupBy("bank", "account").agg(F.count("*").alias("n"), F.count_if("hit").alias("m"))
    both = counts.groupingSets([["bank", "account"], []], "bank", "account").agg(
        F.sum("n").alias("total"), F.sum("m").alias("matched"), F.grouping("bank").cast("int").alias("is_total")
    )
    unmatched = F.col("total") - F.col("matched")
    return both.select(
        "bank", "account", "is_total", "total", "matched", unmatched.alias("unmatched"),
        money.percent(unmatched, F.col("total")).alias("ama_rate"),
    )
