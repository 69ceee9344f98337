"""The rule cascade: register category, vendor code, register payee or memo, rule, model proposal, default.

Everything that depends on the text alone is decided once per distinct (client, description, payee); the
decision is then joined back to the transactions. Each text carries up to three searches (own text, register
payee, register memo), so the trigger join and its aggregate run once for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import constants as K
from tallyspark.functions import codes, text as tx
from tallyspark.operators import loans as loan_ops
from tallyspark.operators import register as reg_ops
from tallyspark.operators import rules as rule_ops

TEXT_KEYS = ["client_id", "description", "payee_key"]


def review_reason(source: Column, account: Column, confidence: Column, trigger: Column, reason: Column) -> Column:
    trigger = tx.strip(F.coalesce(trigger, F.lit("")))
    return (
        F.when(
            tx.strip(F.coalesce(account, F.lit(""))) == K.DEFAULT_CATEGORY,
            F.coalesce(F.nullif(reason, F.lit("")), F.lit(K.REASON_NO_RULE)),
        )
        .when((source == K.SOURCE_MODEL) & (F.coalesce(confidence, F.lit(0.0)) < K.MODEL_REVIEW_CONFIDENCE), K.REASON_MODEL_LOW)
        .when(
            (source == K.SOURCE_RULE) & (trigger != "") & (F.length(trigger) <= K.SHORT_TRIGGER_LENGTH),
            K.REASON_SHORT_TRIGGER,
        )
        .otherwise(reason)
    )


def _joined(rules: Column, field: str) -> Column:
    return F.array_join(F.transform(rules, lambda r: F.coalesce(r[field], F.lit(""))), ", ")


def decide_texts(txns: DataFrame, rules: DataFrame, register: DataFrame | None, proposals: DataFrame | None) -> DataFrame:
    """One decision per distinct text."""
    texts = txns.select("client_id", "description", F.coalesce("payee_name", F.lit("")).alias("payee_key")).distinct()
    t = rule_ops.match_vendor_code(texts, rules)
    if register is not None:
        entries = reg_ops.register_by_check(register)
        owners = entries.select("client_id", F.lit(True).alias("has_register")).distinct()
        t = (
            t.withColumn("check_number", codes.check_number(F.col("description")))
            .withColumn("_number", rule_ops.spread_key(F.col("check_number"), F.col("description")))
            .join(entries.withColumnRenamed("check_number", "_number").withColumn("entry_found", F.lit(True)), ["client_id", "_number"], "left")
            .drop("_number")
            .join(owners, "client_id", "left")
            .withColumn("has_register", F.coalesce("has_register", F.lit(False)))
        )
    else:
        # re-categorisation: no register step and no check step
        t = t.select(
            "*", F.lit(None).cast("string").alias("check_number"), F.lit(None).cast("boolean").alias("entry_found"),
            F.lit(True).alias("has_register"), *[F.lit(None).cast("string").alias(c) for c in reg_ops.INFO],
        )
    has_category = F.coalesce(F.col("category"), F.lit("")) != ""
    t = (
        t.withColumn("reason", rule_ops.vendor_reason(F.col("ach_payment"), F.col("code"), F.col("vendor_rule")))
        .withColumn("by_register_category", has_category)
        .withColumn("check_without_register", ~F.col("has_register") & codes.is_check_like(F.col("description")))
        # a text that the register or the check step has ended is not looked up by its code any more
        .withColumn(
            "coded_unknown",
            F.col("code").isNotNull() & F.col("vendor_rule").isNull() & ~F.col("by_register_category") & ~F.col("check_without_register"),
        )
        .withColumn(
            "open", ~(F.col("by_register_category") | F.col("check_without_register") | F.col("vendor_rule").isNotNull())
        )
    )
    # searches: 0 own text, 1 register payee, 2 register memo
    payee, memo = F.coalesce("payee_name", F.lit("")), F.coalesce("memo", F.lit(""))
    variants = F.filter(
        F.array(
            F.struct(F.lit(0).alias("via"), F.col("description").alias("d"), F.col("payee_key").alias("p")),
            F.struct(F.lit(1).alias("via"), payee.alias("d"), payee.alias("p")),
            F.struct(F.lit(2).alias("via"), memo.alias("d"), payee.alias("p")),
        ),
        lambda v: (v["via"] == 0) | (F.col("open") & (v["d"] != "")),
    )
    searches = t.withColumn("v", F.explode(variants))
    parts = rule_ops.search_columns(F.col("v.d"), F.col("v.p"))
    # a decided text needs no search: an empty search text matches nothing
    parts["s_text"] = F.when(F.col("open"), parts["s_text"]).otherwise(F.lit(""))
    searches = searches.select("*", *[c.alias(n) for n, c in parts.items()])
    carried = F.struct(
        "payee_name", "category", "type", "split_amount", "check_number", "code", "vendor_rule", "reason", "coded_unknown",
        "by_register_category", "check_without_register", "open",
    )
    via = F.col("v.via")
    searched = searches.drop("vendor_code").select(
        *TEXT_KEYS, "coded_unknown", "s_text", "s_ach", via.alias("via"), carried.alias("c")
    )
    hits = rule_ops.join_triggers(searched, rules, "left").drop("coded_unknown")
    matched = F.col("rule_pos").isNotNull()
    decided = hits.groupBy(*TEXT_KEYS).agg(
        F.first("c").alias("c"),
        F.min_by(
            F.struct(*rule_ops.RULE_FIELDS, tx.strip(F.col("trigger")).alias("trigger")),
            F.when(matched & (F.col("via") == 0), F.struct("rule_pos", "trigger_pos")),
        ).alias("own_rule"),
        F.array_sort(F.collect_set(F.when(matched & (F.col("via") == 1), rule_ops.rule_struct()))).alias("payee_rules"),
        F.array_sort(F.collect_set(F.when(matched & (F.col("via") == 2), rule_ops.rule_struct()))).alias("memo_rules"),
    )
    decided = decided.select(*TEXT_KEYS, "c.*", "own_rule", "payee_rules", "memo_rules")
    if proposals is not None:
        decided = decided.join(rule_ops.proposal_rules(proposals, rules), ["client_id", "description"], "left")
        coded = F.col("coded_unknown")
        decided = decided.select(
            "*", F.when(coded, F.col("specific_rule")).otherwise(F.col("any_rule")).alias("model_rule"),
            F.when(coded, F.col("specific_rejection")).otherwise(F.col("any_rejection")).alias("rejection"),
        )
    else:
        decided = decided.select(
            "*", F.lit(None).cast(decided.schema["vendor_rule"].dataType).alias("model_rule"),
            F.lit(None).cast("string").alias("rejection"), F.lit(None).cast("double").alias("confidence"),
        )
    return decided.select(*TEXT_KEYS, "code", "coded_unknown", _decision().alias("d"))


def _decision() -> Column:
    """The winning tier as one struct."""
    check_rules = F.when(F.size("payee_rules") > 0, F.col("payee_rules")).when(F.size("memo_rules") > 0, F.col("memo_rules"))
    via_memo = (F.size("payee_rules") == 0) & (F.size("memo_rules") > 0)
    no_text = F.lit(None).cast("string")

    def decision(account, category_type, source, confidence, rule_id=no_text, trigger=no_text, account_id=no_text,
                 split=no_text, vendor=no_text, memo=F.lit(False), several=None, reason=no_text):
        several = several if several is not None else F.lit(None)
        return F.struct(
            account.alias("account_name"), category_type.alias("category_type"), account_id.alias("account_id"),
            source.alias("categorization_source"), rule_id.alias("matched_rule_id"), trigger.alias("matched_trigger_text"),
            F.lit(confidence).cast("double").alias("confidence_score") if not isinstance(confidence, Column)
            else confidence.alias("confidence_score"),
            vendor.alias("vendor_code"), memo.alias("matched_via_memo"),
            several.cast("array<struct<account_name:string,category_type:string>>").alias("matched_categories"),
            split.alias("split_amount"), reason.alias("needs_review_reason"),
            F.col("payee_name").alias("register_payee"),
        )

    default = F.lit(K.DEFAULT_CATEGORY)
    register_category = decision(
        F.col("category"), F.coalesce(F.nullif("type", F.lit("")), F.lit("Expense")), F.lit(K.SOURCE_REGISTER),
        K.CONFIDENCE_REGISTER_CATEGORY,
        trigger=F.concat(F.lit("Check "), F.col("check_number"), F.lit(" category from check register")),
        split=F.nullif("split_amount", F.lit("")),
    )
    no_register = decision(default, no_text, default, 0.0, reason=F.lit(K.REASON_NO_REGISTER))
    v = F.col("vendor_rule")
    vendor = decision(
        v["account_name"], v["category_type"], F.lit(K.SOURCE_VENDOR), K.CONFIDENCE_VENDOR, v["rule_id"],
        F.concat(F.lit("ACH vendor code "), F.col("code")), v["account_id"], vendor=F.col("code"),
    )
    through_register = decision(
        _joined(check_rules, "account_name"), _joined(check_rules, "category_type"), F.lit(K.SOURCE_REGISTER),
        K.CONFIDENCE_REGISTER_RULE, F.get(check_rules, F.lit(0))["rule_id"],
        F.concat(F.lit("Check "), F.col("check_number"), F.when(via_memo, " memo").otherwise(" payee"), F.lit(" from check register")),
        _joined(check_rules, "account_id"), memo=via_memo,
        several=F.transform(
            check_rules, lambda r: F.struct(r["account_name"].alias("account_name"), r["category_type"].alias("category_type"))
        ),
    )
    o = F.col("own_rule")
    rule = decision(
        o["account_name"], o["category_type"], F.lit(K.SOURCE_RULE), K.CONFIDENCE_RULE, o["rule_id"], o["trigger"], o["account_id"]
    )
    m = F.col("model_rule")
    triggers = F.array_join(F.slice(m["trigger_payee_contains"], 1, 3), ", ")
    model = decision(
        m["account_name"], m["category_type"], F.lit(K.SOURCE_MODEL),
        F.when(F.coalesce("confidence", F.lit(0.0)) == 0, F.lit(K.CONFIDENCE_MODEL_DEFAULT)).otherwise(F.col("confidence")),
        m["rule_id"], F.coalesce(F.nullif(triggers, F.lit("")), F.lit(K.MODEL_TRIGGER_FALLBACK)), m["account_id"],
    )
    unmatched = decision(default, no_text, default, 0.0, reason=F.coalesce("reason", "rejection"))
    return (
        F.when(F.col("by_register_category"), register_category)
        .when(F.col("check_without_register"), no_register)
        .when(v.isNotNull(), vendor)
        .when(check_rules.isNotNull(), through_register)
        .when(o.isNotNull(), rule)
        .when(m.isNotNull(), model)
        .otherwise(unmatched)
    )


def _finish(rows: DataFrame) -> DataFrame:
    reason = review_reason(
        F.col("categorization_source"), F.col("account_name"), F.col("confidence_score"), F.col("matched_trigger_text"),
        F.col("needs_review_reason"),
    )
    return rows.withColumn("needs_review_reason", reason).withColumn(
        "needs_review_flag", F.coalesce(F.col("needs_review_reason"), F.lit("")) != ""
    )


def categorise(txns: DataFrame, rules: DataFrame, register: DataFrame | None = None, loans: DataFrame | None = None,
               proposals: DataFrame | None = None, keys: tuple[str, ...] = ("row_pos",)) -> DataFrame:
    """Categorised transactions, loan payments split when loan terms are given.

    `register=None` leaves out the register and check steps, as for re-categorising stored rows. An existing
    `transaction_fingerprint` column is kept.
    """
    decided = decide_texts(txns, rules, register, proposals)
    rows = (
        txns.withColumn("payee_key", F.coalesce("payee_name", F.lit("")))
        .join(decided, TEXT_KEYS, "left")
        .drop("payee_key")
        .withColumnRenamed("payee_name", "given_payee")
    )
    rows = rows.select("*", "d.*").drop("d")
    rows = rows.withColumn("payee_name", F.coalesce(F.nullif("register_payee", F.lit("")), F.col("given_payee"))).drop(
        "register_payee", "given_payee"
    )
    print_of = codes.fingerprint(
        F.col("date"), F.col("description"), F.col("credit"), F.col("debit"), F.coalesce("bank", F.lit("Unknown")), F.col("account_number")
    )
    if "transaction_fingerprint" not in rows.columns:
        rows = rows.withColumn("transaction_fingerprint", print_of)
    if loans is not None:
        # register categories and unregistered checks end the cascade before the loan step
        rows = rows.withColumn(
            "loan_open",
            ~((F.col("categorization_source") == K.SOURCE_REGISTER) & (F.col("confidence_score") == K.CONFIDENCE_REGISTER_CATEGORY)),
        )
        split = loan_ops.split_loan_rows(
            rows.withColumn("kept_name", F.col("account_name")).withColumn(
                "account_name", F.when(F.col("loan_open"), F.col("account_name"))
            ),
            loans, list(keys),
        )
        rows = (
            split.withColumn("account_name", F.when(F.col("split_part") == 2, F.col("account_name")).otherwise(F.col("kept_name")))
            .withColumn("transaction_fingerprint", F.when(F.col("split_part") == 0, F.col("transaction_fingerprint")).otherwise(print_of))
            .drop("kept_name", "loan_open")
        )
    return _finish(rows)


def label_rules(labelled: DataFrame, confidence: float = K.CONFIDENCE_RULE) -> DataFrame:
    """Flat columns for rows of `first_rule`: default category where no rule matched."""
    hit = F.col("rule").isNotNull()
    return labelled.select(
        "*", F.coalesce(F.col("rule.account_name"), F.lit(K.DEFAULT_CATEGORY)).alias("account_name"),
        F.col("rule.category_type").alias("category_type"),
        F.when(hit, K.SOURCE_RULE).otherwise(K.DEFAULT_CATEGORY).alias("categorization_source"),
        F.when(hit, F.lit(confidence)).otherwise(F.lit(0.0)).alias("confidence_score"),
        F.col("rule.rule_id").alias("matched_rule_id"), F.col("rule.trigger").alias("matched_trigger_text"),
    )
