"""Row normalisation (amounts, dates, standard rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark import constants as K
from tallyspark.catalog import sqltext as q
from tallyspark.catalog.base import query
from tallyspark.functions import codes, dates, money, text as tx, web
from tallyspark.operators import ingest

GL_DATE = f"coalesce(strftime({q.parse_date('date')}, '%Y-%m-%d'), nullif({q.strip('date')}, ''), '')"


def gl_sql(kind: str) -> str:
    debit, credit = {
        "both": (q.ledger_amount("debit"), q.ledger_amount("credit")),
        "amount": (f"CASE WHEN amount IS NOT NULL THEN greatest(-{q.ledger_amount('amount')}, 0) ELSE 0 END",
                   f"CASE WHEN amount IS NOT NULL THEN greatest({q.ledger_amount('amount')}, 0) ELSE 0 END"),
    }[kind]
    return f"""SELECT row_pos, client_id, {GL_DATE} AS date, coalesce({q.strip('name')}, '') AS name, coalesce({q.strip('memo')}, '') AS memo,
  coalesce({q.strip('split')}, 'Uncategorized') AS category, {debit} AS debit, {credit} AS credit FROM gl_raw"""


@query("n1_gl_amounts", f"SELECT row_pos, debit, credit FROM ({gl_sql('amount')}) g WHERE memo <> '' AND (debit <> 0 OR credit <> 0)")
def n1(i):
    return ingest.ledger_rows(i.gl_raw.drop("debit", "credit")).select("row_pos", "debit", "credit")


@query("n1_gl_two_columns", f"SELECT row_pos, debit, credit FROM ({gl_sql('both')}) g WHERE memo <> '' AND (debit <> 0 OR credit <> 0)")
def n1_two(i):
    return ingest.ledger_rows(i.gl_raw.drop("amount")).select("row_pos", "debit", "credit")


@query("n2_gl_date", f"SELECT row_pos, {GL_DATE} AS date FROM gl_raw")
def n2(i):
    return i.gl_raw.select("row_pos", F.coalesce(dates.iso_or_text(F.col("date")), F.lit("")).alias("date"))


@query("n3_gl_row_filter", f"SELECT * FROM ({gl_sql('both')}) g WHERE memo <> '' AND (debit <> 0 OR credit <> 0)")
def n3(i):
    return ingest.ledger_rows(i.gl_raw)


TYPED = f"TRY_CAST(nullif(regexp_extract({q.strip('type_text')}, '^(-?\\d+(?:\\.\\d+)?)', 1), '') AS DECIMAL(18,2))"
BANK_CSV_SQL = f"""WITH p AS (SELECT row_pos, {q.strip('date_text')} AS date, {q.strip('description')} AS description, {TYPED} AS ty,
    {q.lenient('credit_text')} AS cr, {q.lenient('debit_text')} AS de, {q.lenient('amount_text')} AS am FROM bank_export),
c AS (SELECT *, CASE WHEN ty IS NOT NULL THEN CASE WHEN ty >= 0 THEN ty END WHEN cr IS NOT NULL OR de IS NOT NULL THEN cr WHEN am >= 0 THEN am END AS c,
  CASE WHEN ty IS NOT NULL THEN CASE WHEN ty < 0 THEN -ty END WHEN cr IS NOT NULL OR de IS NOT NULL THEN de WHEN am < 0 THEN -am END AS d FROM p)
SELECT row_pos, date, description, CASE WHEN c > 0 THEN c END AS credit, CASE WHEN NOT coalesce(c > 0, false) AND d > 0 THEN d END AS debit
FROM c WHERE date <> '' AND description <> '' AND (c IS NOT NULL OR d IS NOT NULL)"""


def bank_csv(i):
    return i.bank_export.select(
        "row_pos", F.col("date_text").alias("date"), "description", F.col("type_text").alias("type"), F.col("amount_text").alias("amount"),
        F.col("credit_text").alias("credit"), F.col("debit_text").alias("debit"),
    )


@query("n4_bank_csv_amount", BANK_CSV_SQL)
def n4(i):
    return ingest.bank_csv_rows(bank_csv(i)).select("row_pos", "date", "description", "credit", "debit")


N5_SQL = f"""WITH p AS (SELECT row_pos, strftime({q.parse_date('date_text')}, '%m/%d/%Y') AS date, {q.strip('description')} AS description,
  TRY_CAST(amount_text AS DECIMAL(18,2)) AS am FROM bank_export)
SELECT row_pos, date, description, CASE WHEN am > 0 THEN am END AS credit, CASE WHEN am < 0 THEN -am END AS debit
FROM p WHERE date IS NOT NULL AND description <> '' AND am <> 0"""


def bank_sheet(i):
    return i.bank_export.select("row_pos", F.col("date_text").alias("date"), "description", F.col("amount_text").alias("amount"))


@query("n5_bank_sheet_amount", N5_SQL)
def n5(i):
    return ingest.bank_sheet_rows(bank_sheet(i)).select("row_pos", "date", "description", "credit", "debit")


N6_SQL = f"""WITH p AS (SELECT row_pos, coalesce(strftime({q.parse_date('date_text')}, '%Y-%m-%d'), nullif({q.strip('date_text')}, '')) AS date,
  {q.strip('description')} AS description, {q.lenient('credit_text')} AS cr, {q.lenient('debit_text')} AS de, {q.lenient('amount_text')} AS am, bank, account_number FROM bank_export),
c AS (SELECT *, CASE WHEN cr IS NULL AND de IS NULL THEN CASE WHEN am >= 0 THEN am END ELSE cr END AS credit,
  CASE WHEN cr IS NULL AND de IS NULL THEN CASE WHEN am < 0 THEN -am END ELSE de END AS debit FROM p)
SELECT row_pos, date, description, credit, debit, coalesce(bank, 'Unknown') AS bank, account_number FROM c
WHERE description <> '' AND (coalesce(credit, 0) <> 0 OR coalesce(debit, 0) <> 0)"""


def tabular(i):
    return i.bank_export.select(
        "row_pos", F.col("date_text").alias("date"), "description", F.col("amount_text").alias("amount"),
        F.col("credit_text").alias("credit"), F.col("debit_text").alias("debit"), "bank", "account_number",
    )


@query("n6_tabular_amount", N6_SQL)
def n6(i):
    return ingest.tabular_rows(tabular(i)).drop("payee_name")


@query("n7_extracted_rows", """WITH p AS (SELECT row_pos, floor(row_pos / 100) AS statement_id, description,
  TRY_CAST(nullif(regexp_replace(credit_text, '[^\\d.]', '', 'g'), '') AS DECIMAL(18,2)) AS cr,
  TRY_CAST(nullif(regexp_replace(debit_text, '[^\\d.]', '', 'g'), '') AS DECIMAL(18,2)) AS de, account_number FROM bank_export),
s AS (SELECT floor(row_pos / 100) AS statement_id, min(bank) AS s_bank, max(account_number) AS s_account FROM bank_export GROUP BY 1)
SELECT row_pos, trim(coalesce(description, '')) AS description, cr AS credit, CASE WHEN coalesce(cr, 0) = 0 THEN de END AS debit, s_bank AS bank, coalesce(account_number, s_account) AS account_number
FROM p JOIN s USING (statement_id) WHERE coalesce(cr, 0) <> 0 OR coalesce(de, 0) <> 0""")
def n7(i):
    rows = i.bank_export.withColumn("statement_id", F.floor(F.col("row_pos") / 100))
    heads = rows.groupBy("statement_id").agg(F.min("bank").alias("bank"), F.max("account_number").alias("account_number"))
    extracted = rows.select(
        "row_pos", "statement_id", "description", F.col("credit_text").alias("credit"), F.col("debit_text").alias("debit"),
        F.lit(None).cast("string").alias("bank"), "account_number",
    )
    return ingest.extracted_rows(extracted, heads).select("row_pos", "description", "credit", "debit", "bank", "account_number")


@query("n8_card_polarity", f"""WITH p AS (SELECT row_pos, description, coalesce(credit, -debit) AS amount FROM bank_txn)
SELECT row_pos, CASE WHEN {q.any_of('lower(description)', K.CARD_CREDIT_WORDS)} THEN true WHEN {q.any_of('lower(description)', K.CARD_DEBIT_WORDS)} THEN false ELSE amount >= 0 END AS is_credit FROM p""")
def n8(i):
    return i.bank_txn.select("row_pos", money.card_is_credit(F.col("description"), F.coalesce("credit", -F.col("debit"))).alias("is_credit"))


DATE_TEXTS = """SELECT row_pos, CASE CAST(row_pos % 6 AS INT) WHEN 0 THEN {mdy} WHEN 1 THEN CAST(date AS STRING)
  WHEN 2 THEN concat(CAST(month(date) AS STRING), '/', CAST(day(date) AS STRING), '/', substr(CAST(year(date) AS STRING), 3, 2))
  WHEN 3 THEN concat(CAST(day(date) AS STRING), '/', CAST(month(date) AS STRING), '/', CAST(year(date) AS STRING))
  WHEN 4 THEN concat(' ', CAST(month(date) AS STRING), '/', CAST(day(date) AS STRING), '/69 ') ELSE 'n/a' END AS date_text FROM bank_txn""".replace(
    "{mdy}", "concat(lpad(CAST(month(date) AS STRING), 2, '0'), '/', lpad(CAST(day(date) AS STRING), 2, '0'), '/', CAST(year(date) AS STRING))"
)


def date_texts(i):
    return i.sql(DATE_TEXTS.replace("bank_txn", "{bank_txn}"))


@query("n9_date_parse", f"SELECT row_pos, date_text, {q.parse_date('date_text')} AS parsed FROM ({DATE_TEXTS}) t")
def n9(i):
    return date_texts(i).withColumn("parsed", dates.parse_date(F.col("date_text")))


@query("n10_date_iso_or_text", f"SELECT row_pos, coalesce(strftime({q.parse_date('date_text')}, '%Y-%m-%d'), nullif({q.strip('date_text')}, '')) AS date FROM ({DATE_TEXTS}) t")
def n10(i):
    return date_texts(i).select("row_pos", dates.iso_or_text(F.col("date_text")).alias("date"))


@query("n11_standard_rows", """SELECT row_pos, client_id, d AS Date, m AS Memo, CAST(coalesce(credit, -debit) AS DECIMAL(18,2)) AS Amount, bank AS Bank, coalesce(payee_name, '') AS Payee
FROM (SELECT *, coalesce(date, post_date) AS d, trim(description) AS m FROM bank_txn_gaps) t WHERE d IS NOT NULL AND m <> '' AND coalesce(credit, debit) IS NOT NULL""")
def n11(i):
    return ingest.standard_rows(i.bank_txn_gaps)


@query("n12_check_key", f"SELECT row_pos, check_number, {q.check_key('check_number')} AS k, {q.check_key('check_number || chr(46) || chr(48)')} AS from_float FROM check_register")
def n12(i):
    c = F.col("check_number")
    return i.check_register.select(
        "row_pos", "check_number", codes.check_key(c).alias("k"), codes.check_key(F.concat(c, F.lit(".0"))).alias("from_float")
    )


FILE_NAME = "concat('/in/', lower(replace(bank, ' ', CASE WHEN row_pos % 2 = 0 THEN '_' ELSE ' ' END)), CASE WHEN row_pos % 5 = 0 THEN '' ELSE '_export' END, '.csv')"


@query("n13_bank_from_file_name", f"""WITH f AS (SELECT row_pos, {FILE_NAME} AS file FROM bank_txn)
SELECT row_pos, CASE WHEN contains(file, 'wells') OR contains(file, 'wf') THEN 'Wells Fargo' WHEN contains(file, 'chase') THEN 'Chase Bank'
  WHEN contains(file, 'boa') OR contains(file, 'bofa') OR contains(file, 'bank of america') THEN 'Bank of America' ELSE 'Unknown' END AS bank FROM f""")
def n13(i):
    return i.bank_txn.select("row_pos", web.bank_from_file_name(F.expr(FILE_NAME)).alias("bank"))


@query("n14_lenient_number", f"SELECT row_pos, {q.lenient('credit_text')} AS credit, {q.lenient('debit_text')} AS debit, {q.lenient('type_text')} AS bad FROM bank_export")
def n14(i):
    return i.bank_export.select("row_pos", *[money.lenient_amount(F.col(f"{c}_text")).alias(n) for c, n in [("credit", "credit"), ("debit", "debit"), ("type", "bad")]])


@query("n15_accounting_number", """WITH s AS (SELECT row_pos, x, regexp_replace(replace(regexp_replace(x, '[$,]', '', 'g'), '−', '-'), '^\\s+|\\s+$', '', 'g') AS c
  FROM (SELECT row_pos, unnest([debit, credit, '−' || amount]) AS x FROM gl_raw) g)
SELECT row_pos, x, CASE WHEN starts_with(c, '(') AND ends_with(c, ')') THEN -abs(TRY_CAST(regexp_replace(c, '^\\((.*)\\)$', '\\1') AS DECIMAL(18,2))) ELSE TRY_CAST(c AS DECIMAL(18,2)) END AS v FROM s""")
def n15(i):
    x = F.explode(F.array("debit", "credit", F.concat(F.lit("−"), F.col("amount"))))
    return i.gl_raw.select("row_pos", x.alias("x")).withColumn("v", money.accounting_amount(F.col("x")))


@query("n16_account_id_core", f"SELECT client_id, rule_pos, account_id, {q.account_id_core('account_id')} AS core FROM rules")
def n16(i):
    return i.rules.select("client_id", "rule_pos", "account_id", tx.account_id_core(F.col("account_id")).alias("core"))


@query("n17_trigger_list", """SELECT client_id, rule_pos, array_to_string(list_sort(list_distinct(list_filter([upper(trim(x)) for x in list_concat(trigger_payee_contains, [' pilot', 'zz', '  '])], lambda y: y <> ''))), '|') AS triggers FROM rules""")
def n17(i):
    noisy = F.concat("trigger_payee_contains", F.array(F.lit(" pilot"), F.lit("zz"), F.lit("  ")))
    return i.rules.select("client_id", "rule_pos", F.array_join(tx.normalise_triggers(noisy), "|").alias("triggers"))


@query("n18_coa_categories", f"SELECT DISTINCT client_id, lower({q.squeeze('account')}) AS category FROM coa WHERE lower(trim(account)) NOT IN ('', 'nan', 'none', 'null')")
def n18(i):
    return ingest.coa_categories(i.coa, ["client_id"])


TAX_TEXT = "concat(description, CASE CAST(row_pos % 4 AS INT) WHEN 0 THEN ' ftb' WHEN 1 THEN ' IRS' WHEN 2 THEN ' Cdtfa' ELSE '' END)"


@query("n19_tax_subcategory", f"""SELECT row_pos, CASE WHEN contains(u, 'FTB') THEN 'FTB-Taxes' WHEN contains(u, 'IRS') THEN 'IRS-Taxes' WHEN contains(u, 'CDTFA') THEN 'CDTFA-Taxes' ELSE 'Other-Taxes' END AS sub
FROM (SELECT row_pos, upper({TAX_TEXT}) AS u FROM bank_txn) t""")
def n19(i):
    return i.bank_txn.select("row_pos", tx.tax_subcategory(F.expr(TAX_TEXT)).alias("sub"))


@query("n20_not_categorisable", """SELECT row_pos, d = '' OR NOT regexp_matches(d, '[a-zA-Z]') OR regexp_matches(d, '(?i)\\bloan\\b') OR regexp_matches(d, '(?i)\\bcheck\\b') AS skip
FROM (SELECT row_pos, trim(description) AS d FROM bank_txn_gaps) t""")
def n20(i):
    return i.bank_txn_gaps.select("row_pos", tx.not_categorisable(F.col("description")).alias("skip"))


@query("n21_legacy_polarity", "SELECT row_pos, CASE WHEN credit IS NOT NULL THEN CAST(credit AS VARCHAR) ELSE '' END AS credit, CASE WHEN credit IS NULL THEN CAST(-debit AS VARCHAR) ELSE '' END AS debit FROM bank_txn")
def n21(i):
    credit, debit = ingest.legacy_amounts(money.signed_amount(F.col("credit"), F.col("debit")))
    return i.bank_txn.select("row_pos", credit.alias("credit"), debit.alias("debit"))


def long_date(c: str) -> str:
    s = f"regexp_replace(regexp_replace({q.strip(c)}, '\\s*,\\s*', ' ', 'g'), '\\s+', ' ', 'g')"
    return f"""CAST(coalesce(CASE WHEN regexp_matches({s}, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') THEN try_strptime({s}, '%m/%d/%Y') END,
      CASE WHEN regexp_matches({s}, '^[A-Za-z]{{3}} \\d{{1,2}} \\d{{4}}$') THEN try_strptime({s}, '%b %d %Y') END,
      CASE WHEN regexp_matches({s}, '^[A-Za-z]+ \\d{{1,2}} \\d{{4}}$') THEN try_strptime({s}, '%B %d %Y') END) AS DATE)"""


DUE = "coalesce(" + ", ".join(
    f"CASE WHEN regexp_matches(regexp_extract(text, {q.lit('(?i)' + p)}, 1), {q.lit(K.MONTH_NAMES)}) THEN trim(regexp_extract(text, {q.lit('(?i)' + p)}, 1)) END"
    for p in K.LOAN_TEXT_PATTERNS["due_date"]
) + ")"


@query("n24_loan_start_from_due_date", f"""WITH d AS (SELECT doc_id, {DUE} AS due, trim({q.first_group('lower(text)', ['(?i)' + p for p in K.LOAN_TEXT_PATTERNS['start_date']])}) AS st FROM loan_text)
SELECT doc_id, due, CAST(CASE WHEN st IS NOT NULL THEN {q.parse_date('st')} ELSE {long_date('due')} + 45 END AS DATE) AS start_date FROM d""")
def n24(i):
    due = dates.loan_due_date(F.col("text"))
    start = dates.loan_text_field(F.col("text"), "start_date")
    rows = i.loan_text.select("doc_id", due.alias("due"), start.alias("st"))
    return rows.select(
        "doc_id", "due",
        F.when(F.col("st").isNotNull(), dates.parse_date(F.col("st")))
        .otherwise(F.date_add(dates.parse_long_date(F.col("due")), K.LOAN_START_DAYS)).alias("start_date"),
    )


ORGANISER = """SELECT p_partkey, p_size, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'Last year''s income tax return(s)' ELSE p_name END AS label,
  CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'Last  year''s income tax return copy' WHEN 1 THEN 'last years income tax' ELSE p_type END AS sub FROM {part}"""


@query("n26_organiser_filter", f"SELECT p_partkey, label, sub FROM ({ORGANISER.replace('{part}', 'part')}) t WHERE NOT contains(label, 'Last year''s income tax return(s)') AND NOT regexp_matches(sub, '(?i)last\\s+year[''\\s]*(?:s)?\\s*income\\s+tax\\s+return')")
def n26(i):
    return i.sql(ORGANISER).filter(~tx.is_last_year_return(F.col("label"), F.col("sub"))).select("p_partkey", "label", "sub")


@query("n27_organiser_shape", """SELECT p_partkey, p_name AS "documentLabel", CAST(p_size AS VARCHAR) AS "categoryId", p_type AS "categoryName", '' AS "subcategoryId",
  CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS "subcategoryName", '' AS priority FROM part""")
def n27(i):
    reply = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.col("p_name").alias("documentLabel"), F.col("p_size").alias("categoryId"), F.col("p_type").alias("categoryName"),
                    F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("subcategoryName"), F.lit("x").alias("extra"),
                )
            ).alias("mapped")
        )
    )
    return ingest.organiser_rows(i.part.select("p_partkey", reply.alias("reply")), "reply")


@query("n28_partition_name", """SELECT c_custkey, CASE WHEN ends_with(n, '-data') THEN n ELSE n || '-data' END AS name
FROM (SELECT c_custkey, replace(lower(trim(t)), ' ', '-') AS n FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN ' ' || c_mktsegment || ' Data' ELSE c_mktsegment || ' Group ' END AS t FROM customer) a) b""")
def n28(i):
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), "c_mktsegment", F.lit(" Data"))).otherwise(F.concat("c_mktsegment", F.lit(" Group ")))
    return i.customer.select("c_custkey", tx.partition_name(name).alias("name"))
