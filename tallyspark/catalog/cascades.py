"""The rule cascade and its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark import constants as K
from tallyspark.catalog import sqltext as q
from tallyspark.catalog.base import query
from tallyspark.catalog.matching import (
    LABELLED_SQL, PROPOSAL_SQL, REASON_SQL, REGISTER_SQL, REJECTION, VENDOR_SQL, labelled,
)
from tallyspark.functions import codes
from tallyspark.operators import cascade, review, rules

AMA = K.DEFAULT_CATEGORY


def cascade_sql(register: bool, proposals: bool, txn: str = "bank_txn") -> str:
    """Common table expressions ending in `cat`: one row per transaction with its category."""
    reg = "t0 LEFT JOIN reg ON t0.client_id = r_client AND chk = r_check" if register else (
        "t0, (SELECT CAST(NULL AS VARCHAR) AS r_payee, CAST(NULL AS VARCHAR) AS r_category, CAST(NULL AS VARCHAR) AS r_memo, "
        "CAST(NULL AS VARCHAR) AS r_type, CAST(NULL AS VARCHAR) AS r_split) none"
    )
    has_register = "t0.client_id IN (SELECT r_client FROM reg)" if register else "true"
    offer = (
        """LEFT JOIN offer_rule ON d.client_id = o_client AND d.description = o_desc
      LEFT JOIN rules m ON m.client_id = d.client_id AND conf >= 0.70 AND m.rule_id = CASE WHEN coded_unknown THEN specific_rule ELSE any_rule END"""
        if proposals
        else "LEFT JOIN (SELECT 0 AS o_client, 0.0 AS conf, '' AS any_rule, '' AS specific_rule) z ON false LEFT JOIN rules m ON false"
    )
    reject = f"CASE WHEN conf < 0.70 AND CASE WHEN coded_unknown THEN specific_rule ELSE any_rule END IS NOT NULL THEN {REJECTION} END"
    return f"""{PROPOSAL_SQL},{VENDOR_SQL},{REGISTER_SQL},
t0 AS (SELECT client_id, description, coalesce(payee_name, '') AS pk, {q.is_ach('description')} AS ach, {q.ach_code('description')} AS code,
    {q.check_number('description') if register else 'CAST(NULL AS VARCHAR)'} AS chk, {q.is_check_like('description')} AS like_check
  FROM (SELECT DISTINCT client_id, description, payee_name FROM {txn}) d),
t1 AS (SELECT t0.*, r_payee, r_category, r_memo, r_type, r_split, {has_register} AS has_register FROM {reg}),
t2 AS (SELECT t1.*, v_rule, v_name, v_account, v_type, code IS NOT NULL AND v_rule IS NULL AND coalesce(r_category, '') = '' AND NOT (NOT has_register AND like_check) AS coded_unknown,
    coalesce(r_category, '') <> '' AS by_category, NOT has_register AND like_check AS no_register
  FROM t1 LEFT JOIN vendor_map ON client_id = v_client AND code = v_code),
s0 AS (SELECT client_id, description, pk, coded_unknown, 0 AS via, description AS d, pk AS p FROM t2 WHERE NOT by_category AND NOT no_register AND v_rule IS NULL
  UNION ALL SELECT client_id, description, pk, coded_unknown, 1, r_payee, r_payee FROM t2 WHERE NOT by_category AND NOT no_register AND v_rule IS NULL AND coalesce(r_payee, '') <> ''
  UNION ALL SELECT client_id, description, pk, coded_unknown, 2, r_memo, coalesce(r_payee, '') FROM t2 WHERE NOT by_category AND NOT no_register AND v_rule IS NULL AND coalesce(r_memo, '') <> ''),
s1 AS (SELECT *, {q.is_ach('d')} AS s_ach, {q.search_text('d', 'p')} AS s, replace({q.search_text('d', 'p')}, ' ', '') AS sn FROM s0),
h AS (SELECT * FROM s1 JOIN triggers ON client_id = t_client AND (NOT ach_only OR s_ach) AND NOT (coded_unknown AND dropped) AND {q.predicate()}),
own AS (SELECT client_id, description, pk, arg_min(rule_id, rule_pos * 1000 + trigger_pos) AS w_rule, arg_min(trim(trigger), rule_pos * 1000 + trigger_pos) AS w_trigger
  FROM h WHERE via = 0 GROUP BY ALL),
regr AS (SELECT client_id, description, pk, any_value(via) = 2 AS memo_hit, string_agg(coalesce(account_name, ''), ', ' ORDER BY rule_pos) AS names,
    string_agg(coalesce(category_type, ''), ', ' ORDER BY rule_pos) AS types, string_agg(coalesce(account_id, ''), ', ' ORDER BY rule_pos) AS accounts,
    arg_min(rule_id, rule_pos) AS g_rule, count(*) AS g_n
  FROM (SELECT *, min(via) OVER (PARTITION BY client_id, description, pk) AS best FROM (SELECT DISTINCT client_id, description, pk, via, rule_pos, rule_id, account_name, category_type, account_id FROM h WHERE via > 0) u) v
  WHERE via = best GROUP BY client_id, description, pk),
dec AS (SELECT d.client_id, d.description, d.pk, d.code, d.coded_unknown, r_payee,
    CASE WHEN by_category THEN 1 WHEN no_register THEN 2 WHEN v_rule IS NOT NULL THEN 3 WHEN g_rule IS NOT NULL THEN 4 WHEN w_rule IS NOT NULL THEN 5 WHEN m.rule_id IS NOT NULL THEN 6 ELSE 7 END AS tier,
    chk, r_category, r_type, r_split, v_rule, v_name, v_account, v_type, memo_hit, names, types, accounts, g_rule, coalesce(g_n, 0) AS g_n, w_trigger,
    o.rule_id AS w_rule, o.account_name AS w_name, o.category_type AS w_type, o.account_id AS w_account,
    m.rule_id AS m_rule, m.account_name AS m_name, m.category_type AS m_type, m.account_id AS m_account, conf,
    array_to_string(m.trigger_payee_contains[1:3], ', ') AS m_trigger, coalesce({REASON_SQL}, {reject}) AS unmatched_reason
  FROM t2 d LEFT JOIN own ON d.client_id = own.client_id AND d.description = own.description AND d.pk = own.pk
    LEFT JOIN regr ON d.client_id = regr.client_id AND d.description = regr.description AND d.pk = regr.pk
    LEFT JOIN rules o ON o.client_id = d.client_id AND o.rule_id = own.w_rule {offer}),
cat0 AS (SELECT b.*, dec.code, dec.coded_unknown, dec.tier, coalesce(nullif(r_payee, ''), b.payee_name) AS payee_out,
    CASE tier WHEN 1 THEN r_category WHEN 3 THEN v_name WHEN 4 THEN names WHEN 5 THEN w_name WHEN 6 THEN m_name ELSE '{AMA}' END AS account_name,
    CASE tier WHEN 1 THEN coalesce(nullif(r_type, ''), 'Expense') WHEN 3 THEN v_type WHEN 4 THEN types WHEN 5 THEN w_type WHEN 6 THEN m_type END AS category_type,
    CASE tier WHEN 3 THEN v_account WHEN 4 THEN accounts WHEN 5 THEN w_account WHEN 6 THEN m_account END AS account_id,
    CASE tier WHEN 1 THEN 'Check Register' WHEN 3 THEN 'Vendor Code' WHEN 4 THEN 'Check Register' WHEN 5 THEN 'Rule' WHEN 6 THEN 'AI' ELSE '{AMA}' END AS categorization_source,
    CASE tier WHEN 3 THEN v_rule WHEN 4 THEN g_rule WHEN 5 THEN w_rule WHEN 6 THEN m_rule END AS matched_rule_id,
    CASE tier WHEN 1 THEN 'Check ' || chk || ' category from check register' WHEN 3 THEN 'ACH vendor code ' || dec.code
      WHEN 4 THEN 'Check ' || chk || CASE WHEN memo_hit THEN ' memo' ELSE ' payee' END || ' from check register' WHEN 5 THEN w_trigger
      WHEN 6 THEN coalesce(nullif(m_trigger, ''), '{K.MODEL_TRIGGER_FALLBACK}') END AS matched_trigger_text,
    CASE tier WHEN 1 THEN 1.0 WHEN 3 THEN 0.98 WHEN 4 THEN 0.90 WHEN 5 THEN 0.95 WHEN 6 THEN CASE WHEN coalesce(conf, 0) = 0 THEN 0.74 ELSE conf END ELSE 0.0 END AS confidence_score,
    CASE tier WHEN 2 THEN '{K.REASON_NO_REGISTER}' WHEN 7 THEN unmatched_reason END AS reason0,
    CASE WHEN tier = 3 THEN dec.code END AS vendor_code_used, tier = 4 AND memo_hit AS matched_via_memo, CASE WHEN tier = 4 THEN g_n ELSE 0 END AS n_categories,
    CASE WHEN tier = 1 THEN nullif(r_split, '') END AS split_amount,
    {q.fingerprint('b.date', 'b.description', 'b.credit', 'b.debit', "coalesce(b.bank, 'Unknown')", 'b.account_number')} AS transaction_fingerprint
  FROM {txn} b JOIN dec ON b.client_id = dec.client_id AND b.description = dec.description AND coalesce(b.payee_name, '') = dec.pk),
cat AS (SELECT *, {q.review_reason('categorization_source', 'account_name', 'confidence_score', 'matched_trigger_text', 'reason0')} AS needs_review_reason FROM cat0)"""


FULL_CASCADE = cascade_sql(True, True)


def full_cascade(i, loans=None):
    return cascade.categorise(i.bank_txn, i.rules, i.check_register, loans, i.model_proposal)


OUT = [
    "row_pos", "client_id", "account_name", "category_type", "account_id", "categorization_source", "matched_rule_id",
    "matched_trigger_text", "confidence_score", "needs_review_reason", "transaction_fingerprint", "split_amount",
]


@query("c1_rule_cascade", f"""WITH {FULL_CASCADE}
SELECT {', '.join(OUT)}, payee_out AS payee_name, vendor_code_used AS vendor_code, matched_via_memo, n_categories,
  needs_review_reason IS NOT NULL AS needs_review_flag FROM cat""")
def c1(i):
    n = F.coalesce(F.size("matched_categories"), F.lit(0))
    return full_cascade(i).select(
        *OUT, "payee_name", "vendor_code", "matched_via_memo", F.greatest(n, F.lit(0)).cast("bigint").alias("n_categories"), "needs_review_flag"
    )


@query("c2_review_reason", f"""WITH {FULL_CASCADE}
SELECT needs_review_reason, categorization_source, count(*) AS n FROM cat GROUP BY ALL""")
def c2(i):
    return full_cascade(i).groupBy("needs_review_reason", "categorization_source").agg(F.count("*").alias("n"))


@query("g4_category_array", f"""WITH {FULL_CASCADE}
SELECT row_pos, account_name AS names, category_type AS types, n_categories AS n FROM cat WHERE n_categories > 0""")
def g4(i):
    rows = full_cascade(i).filter(F.size("matched_categories") > 0)
    return rows.select(
        "row_pos",
        F.array_join(F.transform("matched_categories", lambda m: F.coalesce(m["account_name"], F.lit(""))), ", ").alias("names"),
        F.array_join(F.transform("matched_categories", lambda m: F.coalesce(m["category_type"], F.lit(""))), ", ").alias("types"),
        F.size("matched_categories").cast("bigint").alias("n"),
    )


RECAT = cascade_sql(False, True)


@query("c6_recategorise_stored", f"""WITH {RECAT}
SELECT row_pos, account_name, categorization_source, matched_rule_id, matched_trigger_text, confidence_score, needs_review_reason, transaction_fingerprint FROM cat""")
def c6(i):
    stored = i.bank_txn.withColumn(
        "transaction_fingerprint",
        codes.fingerprint(F.col("date"), F.col("description"), F.col("credit"), F.col("debit"), F.col("bank"), F.col("account_number")),
    )
    return cascade.categorise(stored, i.rules, None, None, i.model_proposal).select(
        "row_pos", "account_name", "categorization_source", "matched_rule_id", "matched_trigger_text", "confidence_score",
        "needs_review_reason", "transaction_fingerprint",
    )


@query("c9_vendor_reason", f"""WITH {VENDOR_SQL},
t AS (SELECT row_pos, client_id, {q.is_ach('description')} AS ach, {q.ach_code('description')} AS code FROM bank_txn)
SELECT row_pos, {REASON_SQL} AS reason FROM t LEFT JOIN vendor_map ON client_id = v_client AND code = v_code WHERE {REASON_SQL} IS NOT NULL""")
def c9(i):
    t = rules.match_vendor_code(i.bank_txn.select("row_pos", "client_id", "description"), i.rules)
    reason = rules.vendor_reason(F.col("ach_payment"), F.col("code"), F.col("vendor_rule"))
    return t.select("row_pos", reason.alias("reason")).filter("reason IS NOT NULL")


@query("c10_single_description_lookup", f"""WITH {q.TRIGGERS},
t AS (SELECT DISTINCT client_id, description, {q.is_ach('description')} AS ach, {q.search_text('description', "''")} AS s, replace({q.search_text('description', "''")}, ' ', '') AS sn FROM bank_txn),
h AS (SELECT * FROM t JOIN triggers ON client_id = t_client AND (NOT ach_only OR ach) AND {q.predicate()}),
f AS (SELECT client_id, description, arg_min(rule_id, rule_pos * 1000 + trigger_pos) AS rule_id, arg_min(account_name, rule_pos * 1000 + trigger_pos) AS category FROM h GROUP BY ALL)
SELECT t.client_id, t.description, coalesce(category, '{AMA}') AS category, rule_id FROM t LEFT JOIN f ON t.client_id = f.client_id AND t.description = f.description""")
def c10(i):
    t = i.bank_txn.select("client_id", "description").distinct()
    return rules.first_rule(t, i.rules, ["client_id", "description"], payee=None).select(
        "client_id", "description", F.coalesce("rule.account_name", F.lit(AMA)).alias("category"), "rule.rule_id"
    )


OVERRIDE_SQL = """
overrides AS (SELECT client_id AS ov_client, transaction_fingerprint AS ov_print, min(account_name) AS ov_name, min(category_type) AS ov_type
  FROM (SELECT client_id, """ + q.fingerprint("date", "description", "credit", "debit", "bank", "account_number") + """ AS transaction_fingerprint,
    'Owner Draw' AS account_name, CASE WHEN row_pos % 2 = 0 THEN 'Equity' END AS category_type FROM bank_txn WHERE row_pos % 97 = 0) o
  GROUP BY client_id, transaction_fingerprint)"""


def overrides(i):
    """One-time overrides of some rows, keyed by fingerprint."""
    rows = i.bank_txn.filter("row_pos % 97 = 0").select(
        "client_id",
        codes.fingerprint(F.col("date"), F.col("description"), F.col("credit"), F.col("debit"), F.col("bank"), F.col("account_number")).alias("transaction_fingerprint"),
        F.lit("Owner Draw").alias("account_name"), F.when(F.col("row_pos") % 2 == 0, "Equity").alias("category_type"),
    )
    return rows.groupBy("client_id", "transaction_fingerprint").agg(
        F.min("account_name").alias("account_name"), F.min("category_type").alias("category_type")
    )


REAPPLY_SQL = f"""{RECAT},{OVERRIDE_SQL},
reapplied AS (SELECT row_pos, client_id, transaction_fingerprint, CASE WHEN ov_print IS NULL THEN account_name ELSE coalesce(nullif(ov_name, ''), account_name) END AS account_name,
  CASE WHEN ov_type IS NOT NULL THEN ov_type ELSE category_type END AS category_type,
  CASE WHEN ov_print IS NULL THEN categorization_source ELSE 'Override' END AS categorization_source,
  CASE WHEN ov_print IS NULL THEN matched_rule_id END AS matched_rule_id,
  CASE WHEN ov_print IS NULL THEN matched_trigger_text ELSE '{K.OVERRIDE_TRIGGER}' END AS matched_trigger_text,
  CASE WHEN ov_print IS NULL THEN confidence_score ELSE 1.0 END AS confidence_score,
  CASE WHEN ov_print IS NULL THEN needs_review_reason END AS needs_review_reason
  FROM cat LEFT JOIN overrides ON client_id = ov_client AND transaction_fingerprint = ov_print)"""


@query("j9_override_join", f"""WITH {LABELLED_SQL},{OVERRIDE_SQL},
p AS (SELECT *, {q.fingerprint('date', 'description', 'credit', 'debit', 'bank', 'account_number')} AS fp FROM labelled)
SELECT row_pos, fp AS transaction_fingerprint, coalesce(ov_name, account_name) AS account_name, coalesce(ov_type, category_type) AS category_type,
  CASE WHEN ov_print IS NULL THEN categorization_source ELSE 'Override' END AS categorization_source,
  CAST(CASE WHEN ov_print IS NULL THEN confidence_score ELSE 1.0 END AS DOUBLE) AS confidence_score, ov_print IS NOT NULL AS overridden
FROM p LEFT JOIN overrides ON client_id = ov_client AND fp = ov_print""")
def j9(i):
    rows = labelled(i).withColumn(
        "transaction_fingerprint",
        codes.fingerprint(F.col("date"), F.col("description"), F.col("credit"), F.col("debit"), F.col("bank"), F.col("account_number")),
    ).withColumn("needs_review_reason", F.lit(None).cast("string"))
    return review.apply_overrides(rows, overrides(i), ["client_id"]).select(
        "row_pos", "transaction_fingerprint", "account_name", "category_type", "categorization_source", "confidence_score", "overridden"
    )


@query("j10_unknown_override_keys", f"""WITH {OVERRIDE_SQL},
asked AS (SELECT ov_client, ov_print FROM overrides UNION ALL SELECT ov_client, reverse(ov_print) FROM overrides),
prints AS (SELECT DISTINCT client_id, {q.fingerprint('date', 'description', 'credit', 'debit', 'bank', 'account_number')} AS fp FROM bank_txn)
SELECT ov_client AS client_id, ov_print AS transaction_fingerprint FROM asked WHERE NOT EXISTS (SELECT 1 FROM prints WHERE client_id = ov_client AND fp = ov_print)""")
def j10(i):
    o = overrides(i).select("client_id", "transaction_fingerprint")
    asked = o.unionByName(o.withColumn("transaction_fingerprint", F.reverse("transaction_fingerprint")))
    rows = i.bank_txn.select(
        "client_id",
        codes.fingerprint(F.col("date"), F.col("description"), F.col("credit"), F.col("debit"), F.col("bank"), F.col("account_number")).alias("transaction_fingerprint"),
    )
    return review.unknown_overrides(asked, rows, ["client_id"])


@query("c7_reapply_run", f"""WITH {REAPPLY_SQL} SELECT * FROM reapplied""")
def c7(i):
    rows = cascade.categorise(i.bank_txn, i.rules, None, None, i.model_proposal)
    return review.apply_overrides(rows, overrides(i), ["client_id"]).select(
        "row_pos", "client_id", "transaction_fingerprint", "account_name", "category_type", "categorization_source", "matched_rule_id",
        "matched_trigger_text", "confidence_score", "needs_review_reason",
    )
