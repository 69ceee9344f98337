"""Rule, vendor, register and proposal matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark import constants as K
from tallyspark.catalog import sqltext as q
from tallyspark.catalog.base import query
from tallyspark.functions import codes, text as tx
from tallyspark.operators import cascade, register, rules, summary

TEXTS_SQL = f"""
texts AS (SELECT client_id, description, payee_name, {q.search_text('description', 'payee_name')} AS s,
    replace({q.search_text('description', 'payee_name')}, ' ', '') AS sn, {q.is_ach('description')} AS ach
  FROM (SELECT DISTINCT client_id, description, coalesce(payee_name, '') AS payee_name FROM bank_txn) d),
hits AS (SELECT * FROM texts JOIN triggers ON client_id = t_client AND (NOT ach_only OR ach) AND {q.predicate()})"""

FIRST_SQL = f"""{q.TRIGGERS},{TEXTS_SQL},
first_hit AS (SELECT client_id, description, payee_name, arg_min(rule_id, rule_pos * 1000 + trigger_pos) AS rule_id,
    arg_min(account_name, rule_pos * 1000 + trigger_pos) AS account_name, arg_min(category_type, rule_pos * 1000 + trigger_pos) AS category_type,
    arg_min(trim(trigger), rule_pos * 1000 + trigger_pos) AS trigger FROM hits GROUP BY ALL)"""

LABELLED_SQL = f"""{FIRST_SQL},
labelled AS (SELECT b.*, h.rule_id AS matched_rule_id, h.trigger AS matched_trigger_text, h.category_type AS category_type,
    CASE WHEN h.rule_id IS NULL THEN '{K.DEFAULT_CATEGORY}' ELSE h.account_name END AS account_name,
    CASE WHEN h.rule_id IS NULL THEN '{K.DEFAULT_CATEGORY}' ELSE 'Rule' END AS categorization_source,
    CASE WHEN h.rule_id IS NULL THEN 0.0 ELSE 0.95 END AS confidence_score
  FROM bank_txn b LEFT JOIN first_hit h ON b.client_id = h.client_id AND b.description = h.description
    AND coalesce(b.payee_name, '') = h.payee_name)"""


def distinct_texts(i):
    return i.bank_txn.select("client_id", "description", F.coalesce("payee_name", F.lit("")).alias("payee_name")).distinct()


TEXT_KEYS = ["client_id", "description", "payee_name"]


def labelled(i):
    """Transactions labelled by the first matching rule, decided once per distinct text."""
    best = rules.first_rule(distinct_texts(i), i.rules, TEXT_KEYS).withColumnRenamed("payee_name", "payee_key")
    rows = i.bank_txn.withColumn("payee_key", F.coalesce("payee_name", F.lit("")))
    return cascade.label_rules(rows.join(best, ["client_id", "description", "payee_key"], "left"))


@query(
    "rule_share_by_client",
    f"""WITH {LABELLED_SQL}
SELECT client_id, categorization_source, count(*) AS n, {q.percent('count(*)', 'any_value(total)')} AS share,
  count_if({q.review_reason('categorization_source', 'account_name', 'confidence_score', 'matched_trigger_text', 'NULL')} IS NOT NULL) AS needs_review
FROM (SELECT *, count(*) OVER (PARTITION BY client_id) AS total FROM labelled) x GROUP BY client_id, categorization_source""",
)
def rule_share(i):
    """Flagship: share of transactions per client that the rules categorise, by source.

    Transactions are counted per distinct text with map-side combine; the counts stand in for the rows, so the
    transactions are shuffled once, as counts, and never joined back.
    """
    texts = i.bank_txn.groupBy("client_id", "description", F.coalesce("payee_name", F.lit("")).alias("payee_name")).agg(
        F.count("*").alias("text_rows")
    )
    best = rules.first_rule(texts, i.rules, [*TEXT_KEYS, "text_rows"])
    return summary.share_by_source(cascade.label_rules(best), "text_rows")


@query("g5_flatten_triggers", """
SELECT client_id, rule_pos, rule_id, CAST(k - 1 AS INT) AS trigger_pos, trigger_payee_contains[k] AS trigger
FROM (SELECT *, unnest(range(1, len(trigger_payee_contains) + 1)) AS k FROM rules) r""")
def g5(i):
    return rules.explode_triggers(i.rules).select("client_id", "rule_pos", "rule_id", "trigger_pos", "trigger")


@query("j1_first_rule_match", f"""WITH {FIRST_SQL}
SELECT t.client_id, t.description, t.payee_name, rule_id, account_name, trigger
FROM texts t LEFT JOIN first_hit h ON t.client_id = h.client_id AND t.description = h.description AND t.payee_name = h.payee_name""")
def j1(i):
    return rules.first_rule(distinct_texts(i), i.rules, TEXT_KEYS).select(
        *TEXT_KEYS, "rule.rule_id", "rule.account_name", "rule.trigger"
    )


@query("j2_all_rule_matches", f"""WITH {q.TRIGGERS},{TEXTS_SQL}
SELECT client_id, description, payee_name, string_agg(rule_id, ',' ORDER BY rule_pos) AS rule_ids, count(*) AS n
FROM (SELECT DISTINCT client_id, description, payee_name, rule_pos, rule_id FROM hits) d GROUP BY ALL""")
def j2(i):
    return rules.all_rules(distinct_texts(i), i.rules, TEXT_KEYS).select(
        *TEXT_KEYS, F.array_join("rules.rule_id", ",").alias("rule_ids"), F.size("rules").cast("bigint").alias("n")
    )


PART_SQL = FIRST_SQL.replace("FROM rules)", "FROM part_rules)").replace("FROM bank_txn)", "FROM part_text)")


def part_texts(i):
    return i.part_text.select("client_id", "description", F.coalesce("payee_name", F.lit("")).alias("payee_name")).distinct()


@query("j1_first_match_indexed", f"""WITH {PART_SQL}
SELECT t.client_id, t.description, t.payee_name, rule_id, account_name, trigger
FROM texts t LEFT JOIN first_hit h ON t.client_id = h.client_id AND t.description = h.description AND t.payee_name = h.payee_name""")
def j1_indexed(i):
    """First match where a client has as many rules as goods, by the index of grams."""
    return rules.first_rule(part_texts(i), i.part_rules, TEXT_KEYS, indexed=True).select(
        *TEXT_KEYS, "rule.rule_id", "rule.account_name", "rule.trigger"
    )


@query("j2_all_matches_indexed", f"""WITH {PART_SQL}
SELECT client_id, description, payee_name, string_agg(rule_id, ',' ORDER BY rule_pos) AS rule_ids, count(*) AS n
FROM (SELECT DISTINCT client_id, description, payee_name, rule_pos, rule_id FROM hits) d GROUP BY ALL""")
def j2_indexed(i):
    return rules.all_rules(part_texts(i), i.part_rules, TEXT_KEYS, indexed=True).select(
        *TEXT_KEYS, F.array_join("rules.rule_id", ",").alias("rule_ids"), F.size("rules").cast("bigint").alias("n")
    )


VENDOR_SQL = f"""
vendor_codes AS (SELECT client_id AS v_client, trim(vendor_code) AS v_code, 1 AS via, rule_pos, rule_id, account_name, account_id, category_type FROM rules WHERE trim(coalesce(vendor_code, '')) <> ''
  UNION ALL SELECT client_id, unnest(regexp_extract_all(upper(tr), '\\b(\\d{{4}})\\b', 1)), 2, rule_pos, rule_id, account_name, account_id, category_type
    FROM (SELECT *, unnest(trigger_payee_contains) AS tr FROM rules) r),
vendor_map AS (SELECT v_client, v_code, arg_min(rule_id, via * 100000 + rule_pos) AS v_rule, arg_min(account_name, via * 100000 + rule_pos) AS v_name,
    arg_min(account_id, via * 100000 + rule_pos) AS v_account, arg_min(category_type, via * 100000 + rule_pos) AS v_type
  FROM vendor_codes GROUP BY v_client, v_code)"""

REASON_SQL = f"""CASE WHEN ach AND code IS NULL THEN '{K.REASON_NO_CODE}'
  WHEN ach AND v_rule IS NULL THEN 'No rule mapping found for ACH vendor code ' || code || '.' END"""


@query("j3_vendor_code_match", f"""WITH {VENDOR_SQL},
t AS (SELECT DISTINCT client_id, description, {q.is_ach('description')} AS ach, {q.ach_code('description')} AS code FROM bank_txn)
SELECT client_id, description, code, v_rule AS rule_id, v_name AS account_name, {REASON_SQL} AS reason
FROM t LEFT JOIN vendor_map ON client_id = v_client AND code = v_code WHERE ach""")
def j3(i):
    t = rules.match_vendor_code(i.bank_txn.select("client_id", "description").distinct(), i.rules)
    return t.filter("ach_payment").select(
        "client_id", "description", "code", "vendor_rule.rule_id", "vendor_rule.account_name",
        rules.vendor_reason(F.col("ach_payment"), F.col("code"), F.col("vendor_rule")).alias("reason"),
    )


REGISTER_SQL = f"""
reg AS (SELECT client_id AS r_client, {q.check_key('check_number')} AS r_check, payee_name AS r_payee, category AS r_category, memo AS r_memo, type AS r_type, split_amount AS r_split
  FROM check_register WHERE check_number IS NOT NULL AND coalesce(payee_name, category, memo, type, split_amount) IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY client_id, {q.check_key('check_number')} ORDER BY row_pos DESC) = 1)"""


@query("j4_check_to_register", f"""WITH {REGISTER_SQL}
SELECT row_pos, client_id, {q.check_number('description')} AS check_number, r_payee AS payee, r_category AS category, r_memo AS memo
FROM bank_txn LEFT JOIN reg ON client_id = r_client AND {q.check_number('description')} = r_check""")
def j4(i):
    return register.match_register(i.bank_txn, i.check_register).select(
        "row_pos", "client_id", "check_number", F.col("entry.payee_name").alias("payee"), "entry.category", "entry.memo"
    )


@query("j5_register_payee_then_memo", f"""WITH {q.TRIGGERS},{REGISTER_SQL},
s AS (SELECT r_client, r_check, 1 AS via, coalesce(r_payee, '') AS d, coalesce(r_payee, '') AS p FROM reg WHERE coalesce(r_payee, '') <> ''
  UNION ALL SELECT r_client, r_check, 2, r_memo, coalesce(r_payee, '') FROM reg WHERE coalesce(r_memo, '') <> ''),
st AS (SELECT r_client, r_check, via, {q.is_ach('d')} AS ach, {q.search_text('d', 'p')} AS s, replace({q.search_text('d', 'p')}, ' ', '') AS sn FROM s),
h AS (SELECT DISTINCT r_client, r_check, via, rule_pos, rule_id FROM st JOIN triggers ON r_client = t_client AND (NOT ach_only OR ach) AND {q.predicate()}),
w AS (SELECT *, min(via) OVER (PARTITION BY r_client, r_check) AS best FROM h)
SELECT r_client AS client_id, r_check AS check_number, best = 2 AS via_memo, string_agg(rule_id, ',' ORDER BY rule_pos) AS rule_ids
FROM w WHERE via = best GROUP BY r_client, r_check, best""")
def j5(i):
    entries = register.register_by_check(i.check_register)
    payee, memo = F.coalesce("payee_name", F.lit("")), F.coalesce("memo", F.lit(""))
    searches = entries.select(
        "client_id", "check_number",
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("via"), payee.alias("d"), payee.alias("p")),
                F.struct(F.lit(2).alias("via"), memo.alias("d"), payee.alias("p")),
            )
        ).alias("v"),
    ).filter(F.col("v.d") != "").select("client_id", "check_number", "v.*")
    hits = rules.all_rules(searches, i.rules, ["client_id", "check_number", "via"], "d", "p")
    best = hits.groupBy("client_id", "check_number").agg(F.min_by(F.struct("via", "rules"), "via").alias("b"))
    return best.select(
        "client_id", "check_number", (F.col("b.via") == 2).alias("via_memo"),
        F.array_join("b.rules.rule_id", ",").alias("rule_ids"),
    )


@query("j6_rules_for_unknown_code", f"""WITH {q.TRIGGERS}
SELECT client_id, rule_pos, rule_id, account_name FROM flagged_rules JOIN rule_owner ON client_id = own_client
WHERE NOT generic_only OR client_all_generic""")
def j6(i):
    return rules.specific_rules(i.rules).select("client_id", "rule_pos", "rule_id", "account_name")


@query("j11_rules_missing_in_coa", """
SELECT client_id, rule_pos, rule_id, account_id, account_name FROM rules r
WHERE trim(account_id) <> '' AND trim(account_name) <> ''
  AND NOT EXISTS (SELECT 1 FROM coa c WHERE c.client_id = r.client_id AND lower(trim(c.account_id)) = lower(trim(r.account_id)))
  AND NOT EXISTS (SELECT 1 FROM coa c WHERE c.client_id = r.client_id AND lower(trim(c.account)) = lower(trim(r.account_name)))""")
def j11(i):
    return rules.rules_missing_in_coa(i.rules, i.coa).select("client_id", "rule_pos", "rule_id", "account_id", "account_name")


PROPOSAL_SQL = f"""{q.TRIGGERS},
offer AS (SELECT client_id AS o_client, description AS o_desc, lower(account_name) AS pn, lower(account_id) AS pa, rule_id AS pr,
    greatest(0.0, least(1.0, coalesce(confidence, 0.0))) AS conf FROM model_proposal),
offer_hit AS (SELECT o.*, f.rule_pos, f.rule_id, f.account_name, f.account_id, f.category_type, f.trigger_payee_contains,
    f.generic_only AND NOT w.client_all_generic AS dropped,
    CASE WHEN (coalesce(pn, '') <> '' AND trim(f.account_name) <> '' AND contains(lower(trim(f.account_name)), pn))
      OR (coalesce(pa, '') <> '' AND trim(f.account_id) <> '' AND contains(lower(trim(f.account_id)), pa)) THEN 1
      WHEN f.rule_id = pr THEN 2 END AS ord
  FROM offer o JOIN flagged_rules f ON o.o_client = f.client_id JOIN rule_owner w ON f.client_id = w.own_client),
offer_rule AS (SELECT o_client, o_desc, conf, arg_min(rule_id, ord * 1000 + rule_pos) AS any_rule,
    arg_min(rule_id, ord * 1000 + rule_pos) FILTER (NOT dropped) AS specific_rule
  FROM offer_hit WHERE ord IS NOT NULL GROUP BY o_client, o_desc, conf)"""
REJECTION = "'Artificial intelligence confidence ' || CAST(CAST(conf AS DECIMAL(4,2)) AS VARCHAR) || ' is below the minimum threshold 0.70.'"


@query("j21_model_proposal_gate", f"""WITH {PROPOSAL_SQL}
SELECT o.o_client AS client_id, o.o_desc AS description, o.conf AS confidence, CASE WHEN o.conf >= 0.70 THEN any_rule END AS rule_id,
  CASE WHEN r.conf < 0.70 THEN replace({REJECTION}, 'x', 'x') END AS rejection
FROM offer o LEFT JOIN offer_rule r USING (o_client, o_desc)""".replace("CAST(conf AS", "CAST(o.conf AS"))
def j21(i):
    return rules.proposal_rules(i.model_proposal, i.rules).select(
        "client_id", "description", "confidence", "any_rule.rule_id", F.col("any_rejection").alias("rejection")
    )


@query("j24_rule_behind_row", f"""WITH {LABELLED_SQL}
SELECT l.row_pos, l.matched_rule_id AS rule_id, r.logic, r.account_id, len(r.trigger_payee_contains) AS n_triggers
FROM labelled l JOIN rules r ON l.client_id = r.client_id AND l.matched_rule_id = r.rule_id""")
def j24(i):
    rows = labelled(i).select("row_pos", "client_id", F.col("matched_rule_id").alias("rule_id"))
    return rows.join(i.rules, ["client_id", "rule_id"]).select(
        "row_pos", "rule_id", "logic", "account_id", F.size("trigger_payee_contains").cast("bigint").alias("n_triggers")
    )
