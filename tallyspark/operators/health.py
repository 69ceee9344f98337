"""Health of rule bases and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import constants as K
from tallyspark.functions import dates, text as tx
from tallyspark.operators import rules as rule_ops


def ledger_duplicates(entries: DataFrame) -> DataFrame:
    """Groups of rows with the same memo and category, with the values of the first row and the count.

    One aggregate with map-side combine: a hot group is reduced before the shuffle.
    """
    memo, category = tx.strip(F.col("memo")), tx.strip(F.col("category"))
    rows = entries.filter((memo != "") & (category != ""))
    first = F.min_by(F.struct(memo.alias("memo"), category.alias("split"), "date", "credit", "debit"), "row_pos")
    grouped = rows.groupBy("client_id", F.lower(memo).alias("_m"), F.lower(category).alias("_c")).agg(
        F.count("*").alias("occurrence_count"), first.alias("f")
    )
    return grouped.filter("occurrence_count > 1").select("client_id", "f.*", "occurrence_count")


def trigger_conflicts(rules: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """Trigger phrases used by more than one account (account, else category type, else `unknown`)."""
    account = F.coalesce(
        F.nullif(tx.strip(F.coalesce("account_name", F.lit(""))), F.lit("")),
        F.nullif(tx.strip(F.coalesce("category_type", F.lit(""))), F.lit("")), F.lit(unknown),
    )
    rows = rules.select("client_id", account.alias("account"), F.explode("trigger_payee_contains").alias("t"))
    rows = rows.select("client_id", "account", tx.label_key(F.col("t")).alias("trigger")).filter(F.col("trigger") != "")
    return (
        rows.distinct().groupBy("client_id", "trigger").agg(F.array_sort(F.collect_list("account")).alias("accounts"))
        .filter(F.size("accounts") > 1)
    )


def _generic(t: Column) -> Column:
    return tx.squeeze(F.regexp_replace(F.upper(t), "[^A-Za-z0-9 ]", " ")).isin(K.GENERIC_PAYMENT_PHRASES)


def generic_trigger_rules(rules: DataFrame) -> DataFrame:
    """Rules with triggers that are nothing but generic wording."""
    hits = F.filter(F.transform("trigger_payee_contains", tx.strip), _generic)
    return rules.withColumn("generic_triggers", hits).filter(F.size("generic_triggers") > 0)


def rule_base_health(rules: DataFrame, coa: DataFrame) -> DataFrame:
    """Counts and warnings per client, from one row per finding and one aggregate."""

    def finding(df: DataFrame, name: str) -> DataFrame:
        return df.select("client_id", F.lit(name).alias("kind"))

    findings = (
        finding(rules, "rule")
        .unionByName(finding(rule_ops.rules_missing_in_coa(rules, coa), "missing"))
        .unionByName(finding(generic_trigger_rules(rules), "generic"))
        .unionByName(finding(trigger_conflicts(rules, "unknown"), "overlap"))
    )

    def count(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind).alias(f"{kind}_count")

    counted = findings.groupBy("client_id").agg(count("rule"), count("missing"), count("generic"), count("overlap"))
    low = F.col("rule_count") < K.LOW_RULE_COUNT

    def n(kind: str) -> Column:
        return F.col(f"{kind}_count").cast("string")

    warnings = F.array_compact(
        F.array(
            F.when(low, F.concat(F.lit("Only "), n("rule"), F.lit(" rules were generated. This may be too low for strong coverage."))),
            F.when(
                F.col("missing_count") > 0,
                F.concat(n("missing"), F.lit(" rule(s) reference account identifiers or names not found in chart of accounts.")),
            ),
            F.when(
                F.col("generic_count") > 0,
                F.concat(n("generic"), F.lit(" rule(s) include generic trigger wording that can cause mis-categorization.")),
            ),
            F.when(
                F.col("overlap_count") > 0,
                F.concat(n("overlap"), F.lit(" trigger phrase(s) appear in more than one account category.")),
            ),
        )
    )
    return counted.withColumn("low_rule_count", low).withColumn("warnings", warnings)


def ledger_date_range(entries: DataFrame, keys: list[str], date: Column) -> DataFrame:
    """First and last date as m/d/yy and the sorted years, over all rows."""
    rows = entries.select(*keys, date.alias("_d")).filter(F.col("_d").isNotNull())
    agg = rows.groupBy(*keys).agg(
        F.min("_d").alias("lo"), F.max("_d").alias("hi"), F.array_sort(F.collect_set(F.year("_d"))).alias("gl_years")
    )
    return agg.select(
        *keys, dates.short_date_text(F.col("lo")).alias("gl_start_date"), dates.short_date_text(F.col("hi")).alias("gl_end_date"), "gl_years"
    )


def record_count(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with any non-blank cell."""
    cells = [c for c in raw.columns if c not in keys]
    filled = F.coalesce(*[tx.blank_to_null(F.col(c).cast("string")) for c in cells]).isNotNull()
    return raw.groupBy(*keys).agg(F.count_if(filled).alias("records"))


def rule_counts(rules: DataFrame, headers: DataFrame) -> DataFrame:
    """Rules per client with the header fields; clients without rules count zero."""
    counts = rules.groupBy("client_id").agg(F.count("*").alias("rule_count"))
    return headers.join(counts, "client_id", "left").withColumn("rule_count", F.coalesce("rule_count", F.lit(0)))


def ledger_counts(entries: DataFrame, clients: DataFrame) -> DataFrame:
    """Ledger rows per client and whether there are any."""
    counts = entries.groupBy("client_id").agg(F.count("*").alias("n"))
    return clients.join(counts, "client_id", "left").select(
        "client_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("n") > 0, F.lit(False)).alias("has_data")
    )


def blank_name_share(entries: DataFrame, keys: list[str]) -> DataFrame:
    return entries.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(tx.strip(F.coalesce("name", F.lit(""))) == "").alias("blank_names")
    )
