"""Loan matching, amortisation and loan splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark import constants as K
from tallyspark.catalog import sqltext as q
from tallyspark.catalog.base import query
from tallyspark.catalog.cascades import FULL_CASCADE, full_cascade
from tallyspark.functions import money
from tallyspark.operators import loans
from tallyspark.operators.ingest import legacy_amounts

TERMS_SQL = f"""
terms AS (SELECT client_id AS n_client, loan_pos, account_no, {q.lenient('payment')} AS pay, {q.lenient('funding_provided')} AS principal,
    TRY_CAST(replace(annual_percentage_rate, '%', '') AS DOUBLE) / 100 AS rate,
    coalesce(CASE WHEN {q.lenient('payment')} > 0 AND {q.lenient('total_payment_amount')} > 0
      THEN CAST(round_even(CAST({q.lenient('total_payment_amount')} AS DOUBLE) / CAST({q.lenient('payment')} AS DOUBLE), 0) AS INT) END, {K.LOAN_DEFAULT_MONTHS}) AS months,
    {q.parse_date('start_date')} AS start_date FROM client_loans)"""

IDS = (
    f"CASE WHEN len(regexp_extract_all(description, {q.lit(K.LOAN_ID_PATTERN)}, 1)) > 0 THEN regexp_extract_all(description, {q.lit(K.LOAN_ID_PATTERN)}, 1) "
    f"ELSE regexp_extract_all(description, {q.lit(K.LOAN_DIGITS_PATTERN)}, 1) END"
)

MATCH_SQL = f"""{TERMS_SQL},
loan_hit AS (SELECT row_pos, client_id, date, terms.*, CASE WHEN list_contains(ids, account_no) THEN 20
      WHEN len([x for x in ids if contains(account_no, x)]) > 0 THEN 15 ELSE 0 END + 20 AS score
  FROM (SELECT row_pos, client_id, date, abs(coalesce(debit, credit)) AS amt, {IDS} AS ids FROM bank_txn) b
    JOIN terms ON n_client = client_id AND pay = amt AND len([x for x in ids if contains(lower(account_no), lower(x))]) > 0),
loan_best AS (SELECT * FROM loan_hit QUALIFY row_number() OVER (PARTITION BY row_pos ORDER BY score DESC, loan_pos) = 1),
loan_month AS (SELECT *, (year(date) - year(start_date)) * 12 + month(date) - month(start_date) + 1 AS k FROM loan_best),
loan_in AS (SELECT * FROM loan_month WHERE k BETWEEN 1 AND months AND principal IS NOT NULL AND rate IS NOT NULL),
fold AS (SELECT row_pos, CAST(1 AS BIGINT) AS step, CAST(principal AS DOUBLE) AS bal, rate / 12.0 AS mr, CAST(pay AS DOUBLE) AS p, k, months FROM loan_in
  UNION ALL SELECT row_pos, step + 1, bal - (p - bal * mr), mr, p, k, months FROM fold WHERE step < k),
entry AS (SELECT row_pos, k AS month_no, round(CASE WHEN k = months THEN bal * mr + bal ELSE p END, 2) AS total_payment, round(bal * mr, 2) AS interest_expense,
    round(CASE WHEN k = months THEN bal ELSE p - bal * mr END, 2) AS principal_liability,
    round(greatest(bal - CASE WHEN k = months THEN bal ELSE p - bal * mr END, 0), 2) AS ending_balance FROM fold WHERE step = k)"""

SPLIT_SQL = f"""{FULL_CASCADE},{MATCH_SQL},
split0 AS (SELECT cat.*, interest_expense, principal_liability,
    coalesce(contains(lower(account_name), 'loan') AND NOT (categorization_source = 'Check Register' AND confidence_score = 1.0) AND interest_expense > 0 AND principal_liability > 0, false) AS splits
  FROM cat LEFT JOIN entry USING (row_pos)),
split1 AS (SELECT *, unnest(CASE WHEN splits THEN [1, 2] ELSE [0] END) AS split_part FROM split0),
split AS (SELECT row_pos, client_id, date, description, bank, account_number, split_part, CASE WHEN split_part = 2 THEN 'Interest' ELSE account_name END AS account_name,
    CASE WHEN split_part = 0 THEN credit WHEN coalesce(credit, 0) <> 0 THEN CAST(CASE split_part WHEN 1 THEN principal_liability ELSE interest_expense END AS DECIMAL(18,2)) END AS credit,
    CASE WHEN split_part = 0 THEN debit WHEN coalesce(credit, 0) = 0 THEN CAST(CASE split_part WHEN 1 THEN principal_liability ELSE interest_expense END AS DECIMAL(18,2)) END AS debit
  FROM split1)"""


def matched(i):
    return loans.match_loans(i.bank_txn, i.client_loans, ["row_pos"])


@query("j7_loan_match", f"""WITH {MATCH_SQL}
SELECT row_pos, loan_pos, account_no, CAST(score AS INT) AS score FROM loan_best""")
def j7(i):
    return matched(i).select("row_pos", "loan_pos", "account_no", "score")


@query("j8_loan_month", f"""WITH {MATCH_SQL}
SELECT row_pos, CAST(month_no AS INT) AS month_no, total_payment, interest_expense, principal_liability, ending_balance FROM entry""")
def j8(i):
    return loans.loan_months(matched(i)).select("row_pos", "month_no", "entry.*")


@query("g1_amortisation_schedule", f"""WITH {TERMS_SQL},
ok AS (SELECT * FROM terms WHERE principal IS NOT NULL AND rate IS NOT NULL AND start_date IS NOT NULL AND months > 0),
fold AS (SELECT n_client, loan_pos, 1 AS k, CAST(principal AS DOUBLE) AS bal, rate / 12.0 AS mr, CAST(pay AS DOUBLE) AS p, months, start_date FROM ok
  UNION ALL SELECT n_client, loan_pos, k + 1, bal - (p - bal * mr), mr, p, months, start_date FROM fold WHERE k < months)
SELECT n_client AS client_id, loan_pos, k AS month_no, CAST(start_date + to_months(CAST(k - 1 AS INT)) AS DATE) AS payment_date,
  round(CASE WHEN k = months THEN bal * mr + bal ELSE p END, 2) AS total_payment, round(bal * mr, 2) AS interest_expense,
  round(CASE WHEN k = months THEN bal ELSE p - bal * mr END, 2) AS principal_liability,
  round(greatest(bal - CASE WHEN k = months THEN bal ELSE p - bal * mr END, 0), 2) AS ending_balance FROM fold""")
def g1(i):
    return loans.schedules(loans.loan_terms(i.client_loans))


@query("g2_loan_split", f"""WITH {SPLIT_SQL}
SELECT row_pos, CAST(split_part AS INT) AS split_part, account_name, credit, debit,
  {q.fingerprint('date', 'description', 'credit', 'debit', 'bank', 'account_number')} AS transaction_fingerprint FROM split""")
def g2(i):
    return full_cascade(i, i.client_loans).select(
        "row_pos", "split_part", "account_name", "credit", "debit", "transaction_fingerprint"
    )


@query("g3_loan_split_legacy", f"""WITH {SPLIT_SQL}
SELECT row_pos, CAST(split_part AS INT) AS split_part, account_name AS category,
  CASE WHEN credit IS NOT NULL THEN CAST(credit AS VARCHAR) ELSE '' END AS credit, CASE WHEN credit IS NULL THEN CAST(-debit AS VARCHAR) ELSE '' END AS debit FROM split""")
def g3(i):
    rows = full_cascade(i, i.client_loans)
    credit, debit = legacy_amounts(money.signed_amount(F.col("credit"), F.col("debit")))
    return rows.select("row_pos", "split_part", F.col("account_name").alias("category"), credit.alias("credit"), debit.alias("debit"))


@query("n22_payment_text", """
SELECT doc_id, payment_text, nullif(CASE WHEN regexp_extract(c, '(\\d+\\.?\\d*)', 1) <> '' THEN regexp_extract(c, '(\\d+\\.?\\d*)', 1) ELSE c END, '') AS payment
FROM (SELECT *, regexp_replace(regexp_replace(payment_text, '[\\$,\\s]', '', 'g'), '(?i)/month|/mo|/monthly', '', 'g') AS c
  FROM (SELECT doc_id, split_part(text, chr(10), 4) AS payment_text FROM loan_text) t) u""")
def n22(i):
    line = F.split_part("text", F.lit("\n"), F.lit(4))
    return i.loan_text.select("doc_id", line.alias("payment_text"), money.payment_text(line).alias("payment"))


@query("n23_valid_loan", "SELECT client_id, loan_pos, legal_name FROM client_loans WHERE coalesce(payment, funding_provided) IS NOT NULL")
def n23(i):
    return loans.valid_loans(i.client_loans).select("client_id", "loan_pos", "legal_name")


@query("n25_loan_terms", f"WITH {TERMS_SQL} SELECT n_client AS client_id, loan_pos, months, rate, principal, start_date FROM terms")
def n25(i):
    return loans.loan_terms(i.client_loans).select("client_id", "loan_pos", "months", "rate", "principal", "start_date")
