"""Run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark import constants as K
from tallyspark.catalog import sqltext as q
from tallyspark.catalog.base import query
from tallyspark.catalog.cascades import FULL_CASCADE, REAPPLY_SQL, full_cascade, overrides
from tallyspark.operators import cascade, ingest, review, summary

AMA = K.DEFAULT_CATEGORY
MATCHED = f"(trim(coalesce(account_name, '')) <> '' AND trim(coalesce(account_name, '')) <> '{AMA}')"
RATES = f"count(*) AS total, count_if({MATCHED}) AS matched, count_if(NOT {MATCHED}) AS unmatched, {q.percent(f'count_if(NOT {MATCHED})', 'count(*)')} AS ama_rate"

UNKNOWN_SQL = """
unknown0 AS (SELECT client_id, code, trim(description) AS sample, count(*) AS n, min(row_pos) AS first_pos FROM cat WHERE coded_unknown GROUP BY ALL),
unknown1 AS (SELECT *, row_number() OVER (PARTITION BY client_id, code ORDER BY first_pos, sample) AS rk FROM unknown0),
unknown AS (SELECT client_id, code, CAST(sum(n) AS BIGINT) AS n, string_agg(sample, '|' ORDER BY rk) FILTER (rk <= 3) AS samples FROM unknown1 GROUP BY ALL)"""

WARN = "% of transactions are Ask My Accountant. Consider refreshing rules with newer general ledger data."


@query("a1_rows_per_source", f"""WITH {FULL_CASCADE}
SELECT client_id, coalesce(categorization_source, '{AMA}') AS source, count(*) AS n FROM cat GROUP BY ALL""")
def a1(i):
    return summary.source_counts(full_cascade(i), ["client_id"])


@query("a1_source_count_map", f"""WITH {FULL_CASCADE},
c AS (SELECT client_id, coalesce(categorization_source, '{AMA}') AS source, count(*) AS n FROM cat GROUP BY ALL)
SELECT client_id, string_agg(source || '=' || CAST(n AS VARCHAR), ';' ORDER BY source) AS source_counts FROM c GROUP BY client_id""")
def a1_map(i):
    m = summary.source_count_map(full_cascade(i), ["client_id"])
    text = F.transform(F.map_entries("source_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return m.select("client_id", F.array_join(F.array_sort(text), ";").alias("source_counts"))


@query("a2_match_rates", f"WITH {FULL_CASCADE} SELECT client_id, {RATES} FROM cat GROUP BY client_id")
def a2(i):
    return summary.match_rates(full_cascade(i), ["client_id"])


def unknown_codes(i, keys=("client_id",)):
    rows = full_cascade(i).filter("coded_unknown")
    return summary.unknown_vendor_codes(rows, list(keys))


@query("a3_unknown_vendor_codes", f"WITH {FULL_CASCADE},{UNKNOWN_SQL} SELECT * FROM unknown")
def a3(i):
    return unknown_codes(i).select("client_id", "code", "n", F.array_join("samples", "|").alias("samples"))


@query("a4_merge_unknown_codes", f"""WITH {FULL_CASCADE},
u0 AS (SELECT client_id, bank, code, trim(description) AS sample, count(*) AS n, min(row_pos) AS first_pos FROM cat WHERE coded_unknown GROUP BY ALL),
u1 AS (SELECT *, row_number() OVER (PARTITION BY client_id, bank, code ORDER BY first_pos, sample) AS rk FROM u0),
tot AS (SELECT client_id, code, CAST(sum(n) AS BIGINT) AS n FROM u0 GROUP BY ALL),
s AS (SELECT client_id, code, sample, arg_min(bank, bank || CAST(rk AS VARCHAR)) AS b, min(bank || CAST(rk AS VARCHAR)) AS o FROM u1 WHERE rk <= 3 GROUP BY ALL),
s2 AS (SELECT *, row_number() OVER (PARTITION BY client_id, code ORDER BY o) AS rk FROM s)
SELECT client_id, code, n, string_agg(sample, '|' ORDER BY rk) AS samples FROM tot JOIN s2 USING (client_id, code) WHERE rk <= 3 GROUP BY ALL""")
def a4(i):
    parts = unknown_codes(i, ("client_id", "bank")).withColumnRenamed("bank", "file_pos")
    return summary.merge_unknown_codes(parts, ["client_id"]).select("client_id", "code", "n", F.array_join("samples", "|").alias("samples"))


def run_summary(i):
    # retries of outside services are an input of the run
    retries = (F.col("client_id") % 3).cast("bigint")
    return summary.run_summary(full_cascade(i), ["client_id"], retries)


WARNING_SQL = f"""{FULL_CASCADE},{UNKNOWN_SQL},
r AS (SELECT client_id, {RATES} FROM cat GROUP BY client_id),
c AS (SELECT client_id, count(*) AS cf, sum(n) AS cr FROM unknown GROUP BY client_id),
w AS (SELECT r.*, coalesce(cf, 0) AS cf, coalesce(cr, 0) AS cr FROM r LEFT JOIN c USING (client_id)),
warn AS (SELECT client_id, list_filter([CASE WHEN ama_rate > 40 THEN CAST(CAST(ama_rate AS DECIMAL(9,1)) AS VARCHAR) || '{WARN}' END,
  CASE WHEN cf > 0 THEN 'Found ' || CAST(cf AS VARCHAR) || ' unknown vendor code pattern(s) across ' || CAST(CAST(cr AS BIGINT) AS VARCHAR) || ' transaction row(s).' END,
  CASE WHEN client_id % 3 > 0 THEN 'Rate limit retries were used ' || CAST(client_id % 3 AS VARCHAR) || ' time(s) during processing.' END], lambda x: x IS NOT NULL) AS warnings FROM w)"""


@query("a5_run_warnings", f"WITH {WARNING_SQL} SELECT client_id, array_to_string(warnings, '|') AS warnings FROM warn")
def a5(i):
    return run_summary(i).select("client_id", F.array_join("warnings", "|").alias("warnings"))


@query("a6_merge_warnings", f"""WITH {WARNING_SQL},
e AS (SELECT client_id, unnest(warnings) AS wg, generate_subscripts(warnings, 1) AS i FROM warn),
f AS (SELECT client_id % 5 AS run_group, wg, min(client_id * 10 + i) AS pos FROM e GROUP BY ALL)
SELECT run_group, string_agg(wg, '|' ORDER BY pos) AS warnings FROM f GROUP BY run_group""")
def a6(i):
    parts = run_summary(i).withColumn("run_group", F.col("client_id") % 5)
    return summary.merge_warnings(parts, ["run_group"], "client_id").select("run_group", F.array_join("warnings", "|").alias("warnings"))


ROLLUP = f"WITH {FULL_CASCADE}, k AS (SELECT coalesce(bank, 'Unknown') AS bank, coalesce(nullif(account_number, ''), 'NA') AS account, account_name FROM cat)"


@query("a7_account_rollup", f"{ROLLUP} SELECT bank, account, {RATES} FROM k GROUP BY bank, account")
def a7(i):
    return summary.account_rollup(full_cascade(i)).filter("is_total = 0").drop("is_total")


@query("a8_grand_total", f"{ROLLUP} SELECT {RATES} FROM k")
def a8(i):
    return summary.account_rollup(full_cascade(i)).filter("is_total = 1").drop("is_total", "bank", "account")


@query("c7_reapply_summary", f"WITH {REAPPLY_SQL} SELECT client_id, {RATES} FROM reapplied GROUP BY client_id")
def c7_summary(i):
    rows = cascade.categorise(i.bank_txn, i.rules, None, None, i.model_proposal)
    return summary.match_rates(review.apply_overrides(rows, overrides(i), ["client_id"]), ["client_id"])


@query("a22_drop_counts", """
SELECT client_id, count(*) AS total, count_if(d IS NULL) AS no_date, count_if(d IS NOT NULL AND m = '') AS no_memo,
  count_if(d IS NOT NULL AND m <> '' AND a IS NULL) AS no_amount, count_if(d IS NOT NULL AND m <> '' AND a IS NOT NULL) AS kept
FROM (SELECT client_id, coalesce(date, post_date) AS d, trim(description) AS m, coalesce(credit, debit) AS a FROM bank_txn_gaps) t GROUP BY client_id""")
def a22(i):
    return ingest.drop_counts(i.bank_txn_gaps, ["client_id"])


@query("a23_rows_and_statements_per_account", """
SELECT bank, coalesce(account_number, 'NA') AS account, count(*) AS transactions, count(DISTINCT floor(row_pos / 100)) AS statements FROM bank_txn GROUP BY ALL""")
def a23(i):
    return ingest.account_groups(i.bank_txn.withColumn("statement_id", F.floor(F.col("row_pos") / 100)))


@query("a24_nested_accounts", """
WITH k AS (SELECT bank, coalesce(account_number, 'NA') AS account, count(*) AS n FROM bank_txn GROUP BY ALL)
SELECT bank, string_agg(account || ':' || CAST(n AS VARCHAR), ',' ORDER BY account) AS accounts FROM k GROUP BY bank""")
def a24(i):
    nested = ingest.nested_accounts(i.bank_txn)
    text = F.transform("accounts", lambda a: F.concat_ws(":", a["account"], a["n"].cast("string")))
    return nested.select("bank", F.array_join(text, ",").alias("accounts"))
