"""Change application to rule bases, runs, clients and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.catalog import sqltext as q
from tallyspark.catalog.base import query
from tallyspark.catalog.matching import LABELLED_SQL, labelled
from tallyspark.operators import health, ledger, maintenance

C = F.col
NORM = "list_sort(list_distinct([upper(trim(x)) for x in {} if trim(x) <> '']))"


def changes(i, op: str):
    return i.rule_change.filter(C("op") == op)


@query("m1_insert_rules", f"""SELECT client_id, rule_pos, rule_id, account_id, account_name, category_type, array_to_string(trigger_payee_contains, '|') AS triggers FROM rules
UNION ALL SELECT client_id, 1000 + rule_pos, rule_id || '-new', coalesce(trim(account_id), ''), trim(account_name), coalesce(nullif(trim(category_type), ''), 'Expense'), array_to_string({NORM.format('tr')}, '|')
FROM (SELECT c.*, CASE WHEN c.rule_pos % 8 = 7 THEN [] ELSE r.trigger_payee_contains END AS tr FROM rule_change c JOIN rules r USING (client_id, rule_pos) WHERE op = 'insert') n
WHERE len({NORM.format('tr')}) > 0 AND coalesce(trim(account_name), '') <> ''""")
def m1(i):
    triggers = i.rules.select("client_id", "rule_pos", C("trigger_payee_contains").alias("tr"))
    new = changes(i, "insert").join(triggers, ["client_id", "rule_pos"]).withColumn(
        "trigger_payee_contains", F.when(C("rule_pos") % 8 != 7, C("tr"))
    )
    new = new.withColumn("rule_pos", C("rule_pos") + 1000).withColumn("rule_id", F.concat("rule_id", F.lit("-new")))
    return maintenance.insert_rules(i.rules, new).select(
        "client_id", "rule_pos", "rule_id", "account_id", "account_name", "category_type", F.array_join("trigger_payee_contains", "|").alias("triggers")
    )


@query("m2_update_rules", f"""SELECT r.client_id, r.rule_pos, coalesce(nullif(trim(c.account_id), ''), r.account_id) AS account_id, coalesce(nullif(trim(c.account_name), ''), r.account_name) AS account_name,
  coalesce(nullif(trim(c.category_type), ''), r.category_type) AS category_type, coalesce(c.ach_vendor_only, r.ach_vendor_only) AS ach_vendor_only,
  array_to_string(CASE WHEN len({NORM.format('coalesce(c.trigger_payee_contains, [])')}) > 0 THEN {NORM.format('c.trigger_payee_contains')} ELSE r.trigger_payee_contains END, '|') AS triggers
FROM rules r LEFT JOIN (SELECT * FROM rule_change WHERE op = 'update') c USING (client_id, rule_id)""")
def m2(i):
    # an earlier change of the same rule is replaced by the later one
    c = changes(i, "update")
    earlier = c.withColumn("account_name", F.lit("Earlier")).withColumn("changed_at", C("changed_at") - 100)
    return maintenance.update_rules(i.rules, c.unionByName(earlier)).select(
        "client_id", "rule_pos", "account_id", "account_name", "category_type", "ach_vendor_only", F.array_join("trigger_payee_contains", "|").alias("triggers")
    )


@query("m3_delete_rules", "SELECT client_id, count(*) AS rule_count FROM rules r WHERE NOT EXISTS (SELECT 1 FROM rule_change c WHERE c.op = 'delete' AND c.client_id = r.client_id AND c.rule_id = r.rule_id) GROUP BY client_id")
def m3(i):
    left = maintenance.delete_rules(i.rules, changes(i, "delete"))
    return left.groupBy("client_id").agg(F.count("*").alias("rule_count"))


SLOTS = """SELECT client_id, rule_id, account_name, 'current' AS slot FROM {rules} WHERE rule_pos % 2 = 0
  UNION ALL SELECT client_id, rule_id, concat(account_name, ' (before)'), 'old' FROM {rules} WHERE rule_pos % 3 = 0"""
SLOTS_SQL = SLOTS.replace("{rules}", "rules")


@query("m4_rotate_slots", f"""WITH s AS ({SLOTS_SQL}), n AS (SELECT client_id, rule_id, account_name FROM rules WHERE client_id % 2 = 0 AND rule_pos % 5 = 0)
SELECT client_id, rule_id, account_name, CASE WHEN client_id % 2 = 0 THEN 'old' ELSE slot END AS slot FROM s WHERE client_id % 2 = 1 OR slot = 'current'
UNION ALL SELECT client_id, rule_id, account_name, 'current' FROM n""")
def m4(i):
    regenerated = i.rules.filter("client_id % 2 = 0 AND rule_pos % 5 = 0").select("client_id", "rule_id", "account_name")
    return maintenance.rotate_slots(i.sql(SLOTS), regenerated)


J23_SQL = f"""WITH s AS ({SLOTS_SQL})
SELECT * FROM s UNION ALL SELECT client_id, rule_id, account_name, 'current' FROM s o WHERE slot = 'old' AND client_id < 20 AND NOT EXISTS (SELECT 1 FROM s c WHERE c.slot = 'current' AND c.client_id = o.client_id AND c.rule_id = o.rule_id)"""


def keep_old(i):
    return maintenance.keep_old_rules(i.sql(SLOTS), i.rules.filter("client_id < 20"))


@query("j23_copy_old_rule", J23_SQL)
def j23(i):
    return keep_old(i)


@query("m5_keep_old_rule", f"SELECT client_id, slot, count(*) AS n FROM ({J23_SQL}) k GROUP BY ALL")
def m5(i):
    return keep_old(i).groupBy("client_id", "slot").agg(F.count("*").alias("n"))


HEADERS = "SELECT n_nationkey AS client_id, n_name AS client_name, 'Trucking' AS nature_of_business, CAST(n_nationkey AS BIGINT) AS created_at, CAST(0 AS BIGINT) AS updated_at FROM {nation} WHERE n_nationkey < 15"
HEADER_CHANGES = """SELECT CAST(s_suppkey % 25 AS INT) AS client_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS client_name, CASE WHEN s_suppkey % 3 = 0 THEN 'Food' END AS nature_of_business,
  CAST(100 + s_suppkey AS BIGINT) AS created_at, CAST(200 + s_suppkey AS BIGINT) AS updated_at FROM {supplier}"""


@query("m6_upsert_header", f"""WITH b AS ({HEADERS.replace('{nation}', 'nation')}), c AS ({HEADER_CHANGES.replace('{supplier}', 'supplier')}),
l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY updated_at DESC) = 1), f AS (SELECT client_id, min(created_at) AS created_at FROM c GROUP BY 1)
SELECT coalesce(b.client_id, l.client_id) AS client_id, coalesce(l.client_name, b.client_name) AS client_name, coalesce(l.nature_of_business, b.nature_of_business) AS nature_of_business,
  CASE WHEN b.client_id IS NOT NULL THEN b.created_at ELSE f.created_at END AS created_at, coalesce(l.updated_at, b.updated_at) AS updated_at
FROM b FULL JOIN l ON b.client_id = l.client_id LEFT JOIN f ON f.client_id = l.client_id""")
def m6(i):
    return maintenance.upsert(i.sql(HEADERS), i.sql(HEADER_CHANGES), ["client_id"])


OV = """SELECT CAST(c_nationkey AS INT) AS client_id, concat('run-', CAST(c_custkey % 50 AS STRING)) AS run_id, c_mktsegment AS transaction_fingerprint, concat('Account ', CAST(c_custkey AS STRING)) AS account_name,
  c_custkey AS created_at, c_custkey AS updated_at FROM {customer} WHERE """
OV_BASE, OV_CHANGE = OV + "c_custkey % 4 = 0", OV + "c_custkey % 4 > 0"


def last_of(text: str, alias: str) -> str:
    return f"{alias} AS (SELECT * EXCLUDE (created_at), min(created_at) OVER (PARTITION BY client_id, run_id, transaction_fingerprint) AS created_at FROM ({text}) x QUALIFY row_number() OVER (PARTITION BY client_id, run_id, transaction_fingerprint ORDER BY updated_at DESC) = 1)"


@query("m7_upsert_override", f"""WITH {last_of(OV_BASE.replace('{customer}', 'customer'), 'b')}, {last_of(OV_CHANGE.replace('{customer}', 'customer'), 'c')}
SELECT coalesce(b.client_id, c.client_id) AS client_id, coalesce(b.run_id, c.run_id) AS run_id, coalesce(b.transaction_fingerprint, c.transaction_fingerprint) AS transaction_fingerprint,
  coalesce(c.account_name, b.account_name) AS account_name, CASE WHEN b.client_id IS NOT NULL THEN b.created_at ELSE c.created_at END AS created_at, coalesce(c.updated_at, b.updated_at) AS updated_at
FROM b FULL JOIN c ON b.client_id = c.client_id AND b.run_id = c.run_id AND b.transaction_fingerprint = c.transaction_fingerprint""")
def m7(i):
    keys = ["client_id", "run_id", "transaction_fingerprint"]
    stored = i.sql(OV_BASE)
    empty = stored.filter("false")
    base = maintenance.upsert(empty, stored, keys)
    return maintenance.upsert(base, i.sql(OV_CHANGE), keys)


@query("m8_replace_run_rows", f"""WITH {LABELLED_SQL},
r AS (SELECT row_pos, client_id, 'run-' || bank AS run_id, account_name FROM labelled)
SELECT row_pos, client_id, run_id, CASE WHEN client_id % 3 = 0 AND run_id = 'run-Chase Bank' THEN 'Replaced' ELSE account_name END AS account_name FROM r""")
def m8(i):
    stored = labelled(i).select("row_pos", "client_id", F.concat(F.lit("run-"), "bank").alias("run_id"), "account_name")
    new = stored.filter("client_id % 3 = 0 AND run_id = 'run-Chase Bank'").withColumn("account_name", F.lit("Replaced"))
    return maintenance.replace_runs(stored, new)


@query("m9_upsert_status", """SELECT client_id, arg_max(status, event_id) AS status, min(event_id) AS created_at, max(event_id) AS updated_at FROM (SELECT CAST(client_id AS INT) AS client_id, status, event_id FROM web_event) e GROUP BY client_id""")
def m9(i):
    events = i.web_event.select(C("client_id").cast("int").alias("client_id"), "status", C("event_id").alias("created_at"), C("event_id").alias("updated_at"))
    return maintenance.upsert(events.filter("false"), events, ["client_id"])


INDEXES = "SELECT n_nationkey AS client_id, lower(n_name) AS index_name, CAST(n_nationkey AS BIGINT) AS created_at, CAST(0 AS BIGINT) AS updated_at FROM {nation}"
INDEX_CHANGES = "SELECT CAST(s_suppkey % 30 AS INT) AS client_id, CASE WHEN s_suppkey % 4 > 0 THEN lower(s_name) END AS index_name, CAST(s_suppkey AS BIGINT) AS created_at, CAST(s_suppkey AS BIGINT) AS updated_at FROM {supplier}"


@query("m10_upsert_index", f"""WITH b AS ({INDEXES.replace('{nation}', 'nation')}), c AS ({INDEX_CHANGES.replace('{supplier}', 'supplier')}),
l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY updated_at DESC) = 1), f AS (SELECT client_id, min(created_at) AS created_at FROM c GROUP BY 1)
SELECT coalesce(b.client_id, l.client_id) AS client_id, CASE WHEN l.client_id IS NOT NULL THEN l.index_name ELSE b.index_name END AS index_name,
  CASE WHEN b.client_id IS NOT NULL THEN b.created_at ELSE f.created_at END AS created_at, coalesce(l.updated_at, b.updated_at) AS updated_at FROM b FULL JOIN l ON b.client_id = l.client_id LEFT JOIN f ON f.client_id = l.client_id""")
def m10(i):
    return maintenance.upsert(i.sql(INDEXES), i.sql(INDEX_CHANGES), ["client_id"], overwrite_nulls=True)


CORRECTIONS = """SELECT CAST(10000000 + p_partkey AS BIGINT) AS change_pos, CAST(p_size % 25 AS INT) AS client_id, CASE WHEN p_partkey % 5 = 0 THEN concat(p_name, ' # ', CAST(p_partkey AS STRING)) ELSE upper(p_name) END AS description,
  CASE WHEN p_partkey % 3 = 0 THEN 'Fixed' ELSE lower(p_type) END AS category, p_partkey % 2 = 0 AS force FROM {part}"""


@query("m11_ledger_corrections", f"""WITH c AS (SELECT *, {q.description_key('description')} AS k FROM ({CORRECTIONS.replace('{part}', 'part')}) x QUALIFY row_number() OVER (PARTITION BY client_id, {q.description_key('description')} ORDER BY change_pos DESC) = 1),
g AS (SELECT *, {q.description_key('memo')} AS k FROM gl_entry),
t AS (SELECT c.client_id, c.k, change_pos, description, c.category AS new_category, force, row_pos, lower(trim(g.category)) = lower(trim(c.category)) AS same FROM c LEFT JOIN g ON c.client_id = g.client_id AND c.k = g.k
  QUALIFY row_number() OVER (PARTITION BY c.client_id, c.k ORDER BY CASE WHEN lower(trim(g.category)) = lower(trim(c.category)) THEN 0 ELSE 1 END, row_pos) = 1),
a AS (SELECT *, CASE WHEN row_pos IS NULL THEN 'created' WHEN same AND NOT force THEN 'already_exists' ELSE 'updated' END AS action FROM t)
SELECT g.client_id, g.row_pos, g.memo, CASE WHEN action = 'updated' THEN trim(new_category) ELSE g.category END AS category, action FROM g LEFT JOIN a ON g.client_id = a.client_id AND g.row_pos = a.row_pos
UNION ALL SELECT client_id, change_pos, trim(description), trim(new_category), action FROM a WHERE action = 'created'""")
def m11(i):
    return ledger.apply_corrections(i.gl_entry, i.sql(CORRECTIONS)).select("client_id", "row_pos", "memo", "category", "action")


@query("m12_delete_ledger_rows", "SELECT client_id, count(*) AS n FROM gl_entry WHERE NOT (client_id = 4 OR coalesce(debit > 60000, false)) GROUP BY client_id")
def m12(i):
    left = ledger.delete_entries(i.gl_entry, (C("client_id") == 4) | (C("debit") > 60000))
    return left.groupBy("client_id").agg(F.count("*").alias("n"))


@query("m13_delete_rule_base", "SELECT n_nationkey AS client_id, count(rule_id) AS rule_count FROM nation LEFT JOIN (SELECT * FROM rules WHERE client_id % 6 > 0) r ON n_nationkey = client_id GROUP BY ALL")
def m13(i):
    left = maintenance.drop_keys(i.rules, i.rules.filter("client_id % 6 = 0"), ["client_id"])
    return health.rule_counts(left, i.nation.select(C("n_nationkey").alias("client_id")))
