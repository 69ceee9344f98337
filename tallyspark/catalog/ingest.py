"""Column resolution, sources and sinks. Files are written from derived tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark import constants as K
from tallyspark.catalog import sqltext as q
from tallyspark.catalog.base import query
from tallyspark.catalog.cascades import FULL_CASCADE, full_cascade
from tallyspark.catalog.extract import ADDRESS_SQL, DEVICE_SQL
from tallyspark.catalog.summaries import RATES, WARNING_SQL
from tallyspark.catalog.normalise import BANK_CSV_SQL, N5_SQL, N6_SQL, gl_sql
from tallyspark.functions import codes, dates, web
from tallyspark.operators import health, ingest
from tallyspark.session import materialise, shared_folder
from tallyspark.sources import readers, resolve, runs, writers
from tallyspark.streaming import jobs

C = F.col


def renamed(df, names: dict[str, str], keep=()):
    return df.select(*keep, *[C(old).alias(new) for old, new in names.items()])


LEDGER_NAMES = {
    "date": "Trans Date", "name": "Vendor Name", "memo": "Transaction Description", "split": "GL Account", "debit": "Debit Amount", "credit": "Credit Amount",
}
GL_BOTH = f"SELECT * FROM ({gl_sql('both')}) g WHERE memo <> '' AND (debit <> 0 OR credit <> 0)"


def resolved_ledger(df):
    return ingest.ledger_rows(resolve.select_resolved(df, resolve.resolve_ledger(df.drop("row_pos", "client_id")), ("row_pos", "client_id")))


@query("b1_ledger_columns", GL_BOTH)
def b1(i):
    return resolved_ledger(renamed(i.gl_raw, LEDGER_NAMES, ("row_pos", "client_id")))


BANK_NAMES = {"date_text": "Posting Date", "description": "Description", "type_text": "Type", "amount_text": "Amount", "credit_text": "Credit", "debit_text": "Debit"}


@query("b2_bank_csv_columns", BANK_CSV_SQL)
def b2(i):
    raw = renamed(i.bank_export, BANK_NAMES, ("row_pos",))
    return ingest.bank_csv_rows(resolve.select_resolved(raw, resolve.bank_columns(raw.columns), ("row_pos",)))


@query("b3_bank_sheet_columns", f"SELECT s.*, cheque_no AS check_number FROM ({N5_SQL}) s JOIN bank_export USING (row_pos)")
def b3(i):
    raw = renamed(i.bank_export, {"date_text": "Date", "description": "Description", "amount_text": "Amount (USD)", "cheque_no": "Cheque No"}, ("row_pos",))
    return ingest.bank_sheet_rows(resolve.select_resolved(raw, resolve.sheet_columns(raw.columns), ("row_pos",)))


TABULAR_NAMES = {
    "date_text": "Posted Date", "description": "Details of payee", "amount_text": "Amt", "credit_text": "Deposit", "debit_text": "Withdrawal",
    "bank": "Bank Name", "account_number": "Acct",
}


@query("b4_tabular_columns", N6_SQL)
def b4(i):
    raw = renamed(i.bank_export, TABULAR_NAMES, ("row_pos",))
    mapping = resolve.tabular_columns([c for c in raw.columns if c != "row_pos"])
    return ingest.tabular_rows(resolve.select_resolved(raw, mapping, ("row_pos",))).drop("payee_name")


REGISTER_NAMES = {"check_number": "Check #", "payee_name": "Pay To", "category": "Classification", "memo": "Notes", "type": "Txn Type", "split_amount": "Split Amt"}


@query("b5_register_columns", "SELECT row_pos, check_number, payee_name, category, memo, type, split_amount FROM check_register")
def b5(i):
    raw = renamed(i.check_register, REGISTER_NAMES, ("row_pos",))
    return resolve.select_resolved(raw, resolve.register_columns(raw.columns), ("row_pos",))


@query("b6_register_inspection", "SELECT 'check #' AS check_number, 'pay to' AS payee, 'notes' AS memo, '' AS missing, count(*) AS row_count, 15 AS preview_rows FROM check_register")
def b6(i):
    raw = renamed(i.check_register, REGISTER_NAMES)
    found, missing, preview = resolve.inspect_register(raw)
    return raw.agg(F.count("*").alias("row_count")).select(
        *[F.lit(c).alias(f) for f, c in found.items()], F.lit(",".join(missing)).alias("missing"), "row_count", F.lit(preview.count()).alias("preview_rows")
    )


@query("b7_memo_fallback", GL_BOTH)
def b7(i):
    odd = {**LEDGER_NAMES, "memo": "What happened"}
    raw = renamed(i.gl_raw.withColumn("num", C("row_pos").cast("string")), {"num": "Voucher", **odd}, ("row_pos", "client_id"))
    return resolved_ledger(raw)


@query("b8_category_column", GL_BOTH)
def b8(i):
    raw = renamed(i.gl_raw.withColumn("none", F.lit(None).cast("string")), {"none": "Account Code", **LEDGER_NAMES}, ("row_pos", "client_id"))
    return resolved_ledger(raw)


@query("b9_range_column", f"WITH d AS (SELECT {q.parse_date('date')} AS d FROM gl_raw) SELECT min(d) AS lo, max(d) AS hi, count(d) AS n FROM d")
def b9(i):
    raw = renamed(i.gl_raw, {"memo": "Memo", "date": "Doc Date", "name": "Updated"})
    d = dates.parse_date(C(f"`{resolve.range_column(raw.columns)}`"))
    return raw.agg(F.min(d).alias("lo"), F.max(d).alias("hi"), F.count(d).alias("n"))


def written_csv(i, df, purpose: str) -> str:
    path = shared_folder(i.spark, purpose)
    writers.write_csv(df, path)
    return path


def mixed_csv(i, df, purpose: str, part) -> str:
    """Files with three headers, chosen by `part` (0, 1, 2, in the order of their paths): as given, reversed, and with one more column in front."""
    path = shared_folder(i.spark, purpose)
    rows = df.withColumn("part", part)
    orders = [df.columns, df.columns[::-1], [*df.columns[1:], df.columns[0]]]
    for k, order in enumerate(orders):
        own = rows.filter(C("part") == k).select(*([F.lit("x, \"y\"").alias("Reviewer Remark")] if k == 2 else []), *[C(f"`{c}`") for c in order])
        writers.write_csv(own, f"{path}/{k}")
    return f"{path}/*"


def thirds(df):
    return F.pmod(F.xxhash64(*[C(f"`{c}`") for c in df.columns]), F.lit(3))


@query("io1_ledger_file", GL_BOTH.replace("SELECT *", "SELECT date, name, memo, category, debit, credit", 1))
def io1(i):
    raw = renamed(i.gl_raw, LEDGER_NAMES)
    path = mixed_csv(i, raw, "ledger-csv", thirds(raw))
    return readers.read_ledger(i.spark, path).drop("row_pos")


@query("io2_bank_csv_file", BANK_CSV_SQL.replace("SELECT row_pos, date, description, CASE", "SELECT date, description, 'Unknown' AS bank, CASE"))
def io2(i):
    raw = renamed(i.bank_export, BANK_NAMES)
    path = mixed_csv(i, raw, "bank-csv", thirds(raw))
    return readers.read_bank_csv(i.spark, path).drop("row_pos", "file_name")


@query("io3_tabular_file", N6_SQL.replace("SELECT row_pos, date, description, credit", "SELECT date, description, credit"))
def io3(i):
    raw = renamed(i.bank_export, TABULAR_NAMES)
    path = mixed_csv(i, raw, "tabular-csv", thirds(raw))
    return readers.read_tabular(i.spark, path).drop("row_pos", "payee_name")


@query("io4_coa_file", "SELECT CAST(client_id AS VARCHAR) AS client, replace(trim(account), '  ', chr(10)) AS account, trim(account_id) AS account_id, CASE WHEN coa_pos % 2 = 0 THEN CAST(coa_pos AS VARCHAR) ELSE '' END AS pos FROM coa")
def io4(i):
    # names with a line break inside the cell
    account = F.replace(F.trim("account"), F.lit("  "), F.lit("\n")).alias("account")
    coa = i.coa.select(C("client_id").alias("client"), account, "account_id", F.when(C("coa_pos") % 2 == 0, C("coa_pos")).alias("pos"))
    return readers.read_coa(i.spark, written_csv(i, coa, "coa-csv"))


LAST = f"""SELECT client_id, {q.check_key('check_number')} AS check_number, payee_name, category, memo, type, split_amount FROM check_register
  WHERE coalesce(payee_name, category, memo, type, split_amount) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY client_id, {q.check_key('check_number')} ORDER BY row_pos DESC) = 1"""


def register_file(i) -> str:
    # several files with three headers whose order by path is row order
    ordered = i.check_register.repartitionByRange(4, "row_pos").sortWithinPartitions("row_pos")
    last = i.check_register.agg(F.max("row_pos")).first()[0] or 0
    part = F.least(F.lit(2), F.floor(C("row_pos") * 3 / (last + 1))).cast("int")
    return mixed_csv(i, renamed(ordered, REGISTER_NAMES, ("client_id", "row_pos")), "register-csv", part)  # its own row_pos is no more than a column


@query("io5_check_register_file", LAST)
def io5(i):
    return readers.read_register(i.spark, register_file(i), "client_id")


@query("io6_check_payee_map", f"SELECT client_id, {q.check_key('check_number')} AS check_number, payee_name FROM check_register WHERE payee_name <> '' QUALIFY row_number() OVER (PARTITION BY client_id, {q.check_key('check_number')} ORDER BY row_pos DESC) = 1")
def io6(i):
    return readers.read_check_payees(i.spark, register_file(i), "client_id")


@query("io7_text_file", "SELECT md5(line) AS h, count(*) AS n FROM (SELECT unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line FROM documents) l GROUP BY 1")
def io7(i):
    path = shared_folder(i.spark, "text")
    i.documents.select(F.regexp_replace(F.replace("text", F.lit("\r"), F.lit("")), "\n", "\u0000\r\n").alias("value")).write.text(path)
    lines = readers.read_text(i.spark, path)
    return lines.groupBy(F.md5("value").alias("h")).agg(F.count("*").alias("n"))


@query("io8_rule_base_read", "SELECT client_id, rule_pos, rule_id, account_name FROM rules WHERE client_id = 7")
def io8(i):
    path = shared_folder(i.spark, "rules")
    writers.append_table(i.rules, path, "client_id")
    return readers.read_rules(i.spark, path, 7).select(C("client_id").cast("int").alias("client_id"), "rule_pos", "rule_id", "account_name")


CELL = """CASE WHEN n_categories = 0 THEN coalesce(nullif(account_name, ''), 'Uncategorized') WHEN n_categories = 1 THEN coalesce(nullif(trim(account_name), ''), 'Uncategorized')
  ELSE '["' || replace(account_name, ', ', '", "') || '"]' END"""


@query("io9_categorized_csv", f"""WITH {FULL_CASCADE}
SELECT CAST(date AS VARCHAR) AS "Date", description AS "Description", CAST(credit AS VARCHAR) AS "Credit", CAST(debit AS VARCHAR) AS "Debit", {CELL} AS "Category",
  categorization_source AS "Source", nullif(payee_out, '') AS "Payee", bank AS "Bank", coalesce(account_number, 'NA') AS "AccountNumber", CAST(confidence_score AS DOUBLE) AS "Confidence",
  needs_review_reason IS NOT NULL AS "NeedsReview", needs_review_reason AS "ReviewReason", matched_rule_id AS "RuleId", matched_trigger_text AS "Trigger", vendor_code_used AS "VendorCode", matched_via_memo AS "MatchedViaMemo" FROM cat""")
def io9(i):
    path = shared_folder(i.spark, "categorized-csv")
    writers.write_categorized_csv(writers.categorized_csv_rows(full_cascade(i)), path)
    back = readers.read_delimited(i.spark, path).select(*K.CATEGORIZED_CSV_COLUMNS)
    return back.withColumn("Confidence", C("Confidence").cast("double")).withColumn("NeedsReview", C("NeedsReview").cast("boolean")).withColumn(
        "MatchedViaMemo", C("MatchedViaMemo").cast("boolean")
    )


@query("io10_category_cell", f"WITH {FULL_CASCADE} SELECT row_pos, {CELL} AS cell FROM cat")
def io10(i):
    return full_cascade(i).select("row_pos", writers.category_cell(C("account_name"), C("matched_categories")).alias("cell"))


LEGACY = """SELECT CAST(date AS VARCHAR) AS "Date", description AS "Description", CASE WHEN credit IS NOT NULL THEN CAST(credit AS VARCHAR) END AS "Credit",
  CASE WHEN credit IS NULL THEN CAST(-debit AS VARCHAR) END AS "Debit", 'Uncategorized' AS "Category", bank AS "Bank", payee_name AS "Payee", coalesce(account_number, 'NA') AS "AccountNumber" FROM bank_txn"""


def legacy_rows(i):
    rows = i.bank_txn.select(
        "date", C("description").alias("memo"), F.coalesce("credit", -C("debit")).alias("amount"), F.lit(K.UNCATEGORIZED).alias("category"), "bank",
        C("payee_name").alias("payee"), "account_number",
    )
    return writers.legacy_csv_rows(rows)


@query("io11_legacy_csv", LEGACY)
def io11(i):
    rows = legacy_rows(i)
    return rows.select(*[F.nullif(C(c), F.lit("")).alias(c) for c in rows.columns])


@query("io12_legacy_csv_read", LEGACY)
def io12(i):
    return readers.read_legacy_csv(i.spark, written_csv(i, legacy_rows(i), "legacy-csv"))


@query("io13_statement_run", f"""WITH {FULL_CASCADE}, s AS (SELECT client_id, coalesce(categorization_source, '{K.DEFAULT_CATEGORY}') AS source, count(*) AS n FROM cat GROUP BY ALL)
SELECT client_id, 'run-' || CAST(client_id AS VARCHAR) AS run_id, {RATES}, count(*) AS stored, sum(row_pos) AS stored_positions,
  (SELECT string_agg(source || '=' || CAST(n AS VARCHAR), ',' ORDER BY source) FROM s WHERE s.client_id = cat.client_id) AS sources FROM cat GROUP BY client_id""")
def io13(i):
    from tallyspark.operators import summary

    # the run row and its transactions are two tables under one run key
    path, run_id = shared_folder(i.spark, "statement-run"), F.concat(F.lit("run-"), C("client_id").cast("string")).alias("run_id")
    writers.append_table(full_cascade(i).select("*", run_id), f"{path}/transactions", "client_id")
    rows = i.spark.read.parquet(f"{path}/transactions")
    run = summary.match_rates(rows, ["client_id", "run_id"]).join(summary.source_count_map(rows, ["client_id", "run_id"]), ["client_id", "run_id"])
    writers.append_table(run, f"{path}/runs", "client_id")
    stored = rows.groupBy("run_id").agg(F.count("*").alias("stored"), F.sum("row_pos").alias("stored_positions"))
    sources = F.array_join(F.transform(F.array_sort(F.map_entries("source_counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return i.spark.read.parquet(f"{path}/runs").join(stored, "run_id").select(
        C("client_id").cast("int").alias("client_id"), "run_id", "total", "matched", "unmatched", "ama_rate", "stored", "stored_positions", sources.alias("sources")
    )


@query("io13_run_store", f"""WITH {WARNING_SQL}
SELECT client_id, 'run-' || CAST(client_id AS VARCHAR) AS run_id, total, matched, unmatched, ama_rate, array_to_string(warnings, '|') AS warnings, CAST(client_id % 3 AS BIGINT) AS retries,
  coalesce((SELECT string_agg(code || 'x' || CAST(n AS VARCHAR) || ':' || coalesce(samples, ''), ',' ORDER BY code) FROM unknown u WHERE u.client_id = warn0.client_id), '') AS codes,
  total AS stored, true AS is_dated FROM (SELECT r.*, warnings FROM r JOIN warn USING (client_id)) warn0""")
def io13_store(i):
    path, retries = shared_folder(i.spark, "run-store"), (C("client_id") % 3).cast("bigint")
    rows = materialise(full_cascade(i).withColumn("run_id", F.concat(F.lit("run-"), C("client_id").cast("string"))), "run-rows")
    made = runs.run_rows(rows, retries)
    # stored twice: the second commit replaces the first, a third attempt without a commit is never seen
    runs.store(rows.limit(0), made.withColumn("total", F.lit(0).cast("bigint")), path)
    runs.store(rows, made, path)
    rows.limit(1).write.parquet(f"{path}/transactions/attempt=a-lost")
    stored = runs.read_transactions(i.spark, path).groupBy("run_id").agg(F.count("*").alias("stored"))
    codes_text = F.array_join(F.transform("unknown_vendor_codes", lambda u: F.concat(u["code"], F.lit("x"), u["n"].cast("string"), F.lit(":"), F.array_join(u["samples"], "|"))), ",")
    return runs.read_runs(i.spark, path).join(stored, "run_id").select(
        "client_id", "run_id", "total", "matched", "unmatched", "ama_rate", F.array_join("warnings", "|").alias("warnings"), C("rate_limit_retries_used").alias("retries"),
        codes_text.alias("codes"), "stored", C("created_at").isNotNull().alias("is_dated"),
    )


@query("io14_batch_records", "SELECT bank, account_number, count(*) AS n, true AS numbered FROM bank_txn GROUP BY ALL")
def io14_records(i):
    account = ("bank", "account_number")
    records = jobs.batch_records(jobs.transaction_stream(i.spark, i.sf_dir, 3), i.spark, account)
    whole = (F.max("total_batches") == F.count("*")) & (F.max("batch_num") == F.count("*")) & (F.min("batch_num") == 1)
    return records.groupBy(*account).agg(F.sum("transaction_count").alias("n"), whole.alias("numbered"))


@query("io14_batch_sink", "SELECT count(*) AS n, count(DISTINCT event_id) AS events FROM web_event")
def io14(i):
    out = jobs.batch_sink(jobs.event_stream(i.spark, i.sf_dir), i.spark)
    return out.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events"))


@query("io15_review_export", f"""WITH {FULL_CASCADE} SELECT CAST(date AS VARCHAR) AS "Date", description AS "Description", categorization_source AS "Source", transaction_fingerprint AS "Fingerprint"
FROM cat WHERE needs_review_reason IS NOT NULL""")
def io15(i):
    from tallyspark.operators import review

    table = review.review_filter(review.review_projection(full_cascade(i)), needs_review_only=True)
    return readers.read_delimited(i.spark, written_csv(i, table, "review-csv")).select("Date", "Description", "Source", "Fingerprint")


@query("io16_extraction_csv", "SELECT CAST(date AS VARCHAR) AS date, CAST(NULL AS VARCHAR) AS post_date, description, CAST(credit AS VARCHAR) AS credit, CAST(debit AS VARCHAR) AS debit, bank FROM bank_txn")
def io16(i):
    noisy = i.bank_txn.withColumn("description", F.concat(F.char(F.lit(1)), "description", F.char(F.lit(31))))
    path = written_csv(i, writers.extraction_rows(noisy), "extraction-csv")
    return readers.read_delimited(i.spark, path).select(*K.EXTRACTION_COLUMNS)


EVENT_SQL = f"""SELECT event_id, user_id AS "userId", client_id AS "clientId", event_type AS "eventType", 'general' AS category, status, {ADDRESS_SQL} AS ip_address, {DEVICE_SQL}
FROM (SELECT *, lower(user_agent) AS ua FROM web_event) e"""


@query("io17_append_events", EVENT_SQL)
def io17(i):
    path = shared_folder(i.spark, "events")
    jobs.enrich_events(i.web_event).write.mode("append").parquet(path)
    return i.spark.read.parquet(path).select(
        "event_id", "userId", "clientId", "eventType", "category", "status", C("ipAddress").alias("ip_address"), "device", "browser", "os"
    )


@query("io18_grouped_result", "SELECT CAST(client_id AS INT) AS user_id, bank, coalesce(account_number, 'NA') AS account, count(*) AS n, sum(row_pos) AS positions, sum(coalesce(credit, debit)) AS amount FROM bank_txn GROUP BY ALL")
def io18(i):
    path = shared_folder(i.spark, "extracts")
    # the rows themselves are stored under user, bank and account
    keyed = i.bank_txn.withColumn("user_id", C("client_id")).withColumn("account", F.coalesce("account_number", F.lit("NA")))
    writers.append_table(keyed, path, "user_id")
    return i.spark.read.parquet(path).groupBy("user_id", "bank", "account").agg(
        F.count("*").alias("n"), F.sum("row_pos").alias("positions"), F.sum(F.coalesce("credit", "debit")).alias("amount")
    )
