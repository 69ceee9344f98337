"""Review tables, run lookups, batches and recent events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.catalog.base import query
from tallyspark.catalog.cascades import FULL_CASCADE, full_cascade
from tallyspark.operators import health, ingest, review

C = F.col

RUNS = """SELECT o_custkey AS user_id, o_custkey % 25 AS client_id, concat('run-', CAST(o_custkey AS STRING), '-', o_orderpriority) AS run_id, o_orderkey, o_orderdate AS created_at FROM {orders}"""
RUNS_SQL = RUNS.replace("{orders}", "orders")


@query("t5_latest_run", f"SELECT client_id, run_id, o_orderkey FROM ({RUNS_SQL}) r QUALIFY row_number() OVER (PARTITION BY client_id, run_id ORDER BY created_at DESC, o_orderkey DESC) = 1")
def t5(i):
    return review.latest_per_key(i.sql(RUNS), ["client_id", "run_id"], [C("created_at").desc(), C("o_orderkey").desc()]).select("client_id", "run_id", "o_orderkey")


@query("t6_review_table", f"""WITH {FULL_CASCADE} SELECT transaction_fingerprint AS "Fingerprint", description AS "Description", categorization_source AS "Source", account_name AS "Category"
FROM cat WHERE categorization_source IN ('Rule', 'Ask My Accountant') AND needs_review_reason IS NOT NULL AND contains(lower(description), 'payment')""")
def t6(i):
    table = review.review_projection(full_cascade(i))
    return review.review_filter(table, ["Rule", "Ask My Accountant"], True, "PAYMENT", "Description").select("Fingerprint", "Description", "Source", "Category")


@query("t7_rule_table", "SELECT client_id, rule_id, account_name FROM rules WHERE category_type IN ('Expense', 'COGS') AND contains(lower(array_to_string(trigger_payee_contains, ', ')), 'p') AND contains(lower(account_name), 's')")
def t7(i):
    return review.rule_table(i.rules, ["Expense", "COGS"], "P", "S").select("client_id", "rule_id", "account_name")


@query("t8_runs_of_user", f"SELECT user_id, run_id, created_at, o_orderkey FROM ({RUNS_SQL}) r ORDER BY user_id, created_at, o_orderkey")
def t8(i):
    # a range sort over all users: no user is sorted in one task
    return i.sql(RUNS).select("user_id", "run_id", "created_at", "o_orderkey").orderBy("user_id", "created_at", "o_orderkey")


@query("t9_recent_extracts", f"SELECT user_id, run_id, o_orderkey FROM ({RUNS_SQL}) r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, o_orderkey DESC) <= 5")
def t9(i):
    return review.latest_per_key(i.sql(RUNS), ["user_id"], [C("created_at").desc(), C("o_orderkey").desc()], 5).select("user_id", "run_id", "o_orderkey")


@query("t10_ordered_batches", """SELECT row_pos, client_id, CAST(ceil(row_number() OVER (PARTITION BY client_id ORDER BY row_pos) / 10) AS BIGINT) AS batch_num,
  CAST(ceil(count(*) OVER (PARTITION BY client_id) / 10) AS BIGINT) AS batch_total FROM bank_txn""")
def t10(i):
    return ingest.batches(i.bank_txn, ["client_id"], "row_pos", 10).select("row_pos", "client_id", "batch_num", "batch_total")


@query("t12_recent_events", "SELECT user_id, event_type, event_id FROM web_event QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY created_at DESC, event_id DESC) <= 3")
def t12(i):
    return review.latest_per_key(i.web_event, ["user_id", "event_type"], [C("created_at").desc(), C("event_id").desc()], 3).select("user_id", "event_type", "event_id")


@query("t13_duplicates_report", """WITH g AS (SELECT *, lower(trim(memo)) AS m, lower(trim(category)) AS c FROM gl_entry WHERE trim(memo) <> '' AND trim(category) <> ''),
d AS (SELECT client_id, arg_min(trim(memo), row_pos) AS memo, arg_min(trim(category), row_pos) AS split, arg_min(date, row_pos) AS date, count(*) AS occurrence_count FROM g GROUP BY client_id, m, c HAVING count(*) > 1)
SELECT client_id, memo, split, date, occurrence_count FROM d ORDER BY client_id, date DESC""")
def t13(i):
    report = health.ledger_duplicates(i.gl_entry)
    return report.select("client_id", "memo", "split", "date", "occurrence_count").orderBy("client_id", C("date").desc(), "memo", "split")


@query("t14_review_projection", f"""WITH {FULL_CASCADE} SELECT date AS "Date", description AS "Description", coalesce(credit, debit) AS "Amount", credit AS "Credit", debit AS "Debit", account_name AS "Category",
  categorization_source AS "Source", confidence_score AS "Confidence", needs_review_reason IS NOT NULL AS "Needs Review", needs_review_reason AS "Review Reason", matched_rule_id AS "Rule Id",
  matched_trigger_text AS "Trigger", vendor_code_used AS "Vendor Code", matched_via_memo AS "Matched Via Memo", transaction_fingerprint AS "Fingerprint" FROM cat""")
def t14(i):
    return review.review_projection(full_cascade(i))
