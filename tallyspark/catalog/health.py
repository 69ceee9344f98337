"""Rule-base and ledger health, rule merging, ledger upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark import constants as K
from tallyspark.catalog import sqltext as q
from tallyspark.catalog.base import query
from tallyspark.functions import dates
from tallyspark.operators import health, ingest, ledger, rulebase

C = F.col


@query("a9_ledger_duplicates", """
WITH g AS (SELECT *, lower(trim(memo)) AS m, lower(trim(category)) AS c FROM gl_entry WHERE trim(memo) <> '' AND trim(category) <> '')
SELECT client_id, arg_min(trim(memo), row_pos) AS memo, arg_min(trim(category), row_pos) AS split, arg_min(date, row_pos) AS date,
  list(credit ORDER BY row_pos)[1] AS credit, list(debit ORDER BY row_pos)[1] AS debit, count(*) AS occurrence_count
FROM g GROUP BY client_id, m, c HAVING count(*) > 1""")
def a9(i):
    return health.ledger_duplicates(i.gl_entry)


def conflicts_sql(unknown: str) -> str:
    return f"""SELECT client_id, trigger, string_agg(account, ', ' ORDER BY account) AS accounts FROM (
  SELECT DISTINCT client_id, coalesce(nullif(trim(coalesce(account_name, '')), ''), nullif(trim(coalesce(category_type, '')), ''), '{unknown}') AS account, upper({q.squeeze('t')}) AS trigger
  FROM (SELECT *, unnest(trigger_payee_contains) AS t FROM rules) r) x WHERE trigger <> '' GROUP BY client_id, trigger HAVING count(*) > 1"""


@query("a10_trigger_conflicts", conflicts_sql("Unknown"))
def a10(i):
    return health.trigger_conflicts(i.rules).select("client_id", "trigger", F.array_join("accounts", ", ").alias("accounts"))


@query("a11_trigger_overlaps", conflicts_sql("unknown"))
def a11(i):
    return health.trigger_conflicts(i.rules, "unknown").select("client_id", "trigger", F.array_join("accounts", ", ").alias("accounts"))


GENERIC_WORD = q.squeeze("regexp_replace(upper(x), '[^A-Za-z0-9 ]', ' ', 'g')") + " IN " + q.in_list(K.GENERIC_PAYMENT_PHRASES)
A12_SQL = f"""SELECT client_id, rule_id, account_name, array_to_string([x for x in trigger_payee_contains if {GENERIC_WORD}], '|') AS generic_triggers
FROM rules WHERE len([x for x in trigger_payee_contains if {GENERIC_WORD}]) > 0"""


@query("a12_generic_trigger_rules", A12_SQL)
def a12(i):
    return health.generic_trigger_rules(i.rules).select("client_id", "rule_id", "account_name", F.array_join("generic_triggers", "|").alias("generic_triggers"))


@query("a13_rule_base_health", f"""
WITH miss AS (SELECT client_id, count(*) AS n FROM rules r WHERE trim(account_id) <> '' AND trim(account_name) <> ''
    AND NOT EXISTS (SELECT 1 FROM coa c WHERE c.client_id = r.client_id AND lower(trim(c.account_id)) = lower(trim(r.account_id))) AND NOT EXISTS (SELECT 1 FROM coa c WHERE c.client_id = r.client_id AND lower(trim(c.account)) = lower(trim(r.account_name))) GROUP BY 1),
gen AS (SELECT client_id, count(*) AS n FROM ({A12_SQL}) g GROUP BY 1), ov AS (SELECT client_id, count(*) AS n FROM ({conflicts_sql('unknown')}) o GROUP BY 1),
t AS (SELECT r.client_id, r.n AS rule_count, r.n < 30 AS low_rule_count, coalesce(miss.n, 0) AS missing_count, coalesce(gen.n, 0) AS generic_count, coalesce(ov.n, 0) AS overlap_count
  FROM (SELECT client_id, count(*) AS n FROM rules GROUP BY 1) r LEFT JOIN miss USING (client_id) LEFT JOIN gen USING (client_id) LEFT JOIN ov USING (client_id))
SELECT *, array_to_string(list_filter([CASE WHEN low_rule_count THEN 'Only ' || rule_count || ' rules were generated. This may be too low for strong coverage.' END,
  CASE WHEN missing_count > 0 THEN missing_count || ' rule(s) reference account identifiers or names not found in chart of accounts.' END,
  CASE WHEN generic_count > 0 THEN generic_count || ' rule(s) include generic trigger wording that can cause mis-categorization.' END,
  CASE WHEN overlap_count > 0 THEN overlap_count || ' trigger phrase(s) appear in more than one account category.' END], lambda x: x IS NOT NULL), '|') AS warnings FROM t""")
def a13(i):
    return health.rule_base_health(i.rules, i.coa).withColumn("warnings", F.array_join("warnings", "|"))


def _short(c: str) -> str:
    return f"CAST(month({c}) AS VARCHAR) || '/' || CAST(day({c}) AS VARCHAR) || '/' || substr(CAST(year({c}) AS VARCHAR), 3, 2)"


@query("a14_ledger_date_range", f"""WITH d AS (SELECT client_id, {q.parse_date('date')} AS d FROM gl_raw),
a AS (SELECT client_id, min(d) AS lo, max(d) AS hi, array_to_string(list_sort(list_distinct(list(year(d)))), ',') AS gl_years FROM d WHERE d IS NOT NULL GROUP BY client_id)
SELECT client_id, {_short('lo')} AS gl_start_date, {_short('hi')} AS gl_end_date, gl_years FROM a""")
def a14(i):
    r = health.ledger_date_range(i.gl_raw, ["client_id"], dates.parse_date(C("date")))
    return r.withColumn("gl_years", F.array_join(F.transform("gl_years", lambda y: y.cast("string")), ","))


MERGE_SQL = f"""
keyed AS (SELECT *, {q.account_id_core('account_id')} AS norm_id, lower(trim(account_name)) AS norm_name, list_distinct([upper(trim(x)) for x in trigger_payee_contains if trim(x) <> '']) AS tr FROM rules),
merged AS (SELECT client_id, norm_id, norm_name, min(rule_pos) AS rule_pos, arg_min(rule_id, rule_pos) AS rule_id, arg_min(account_id, rule_pos) AS account_id, arg_min(trim(account_name), rule_pos) AS account_name,
    arg_min(category_type, rule_pos) AS category_type, arg_min(nullif(trim(vendor_code), ''), rule_pos) AS vendor_code, bool_or(coalesce(ach_vendor_only, false)) AS ach_vendor_only,
    list_sort(list_distinct(flatten(list(tr)))) AS tr FROM keyed GROUP BY client_id, norm_id, norm_name)"""


@query("a15_merge_rules", f"WITH {MERGE_SQL} SELECT client_id, rule_pos, rule_id, account_id, account_name, category_type, vendor_code, ach_vendor_only, array_to_string(tr, '|') AS triggers FROM merged")
def a15(i):
    return rulebase.merge_rules(i.rules).select(
        "client_id", "rule_pos", "rule_id", "account_id", "account_name", "category_type", "vendor_code", "ach_vendor_only",
        F.array_join("trigger_payee_contains", "|").alias("triggers"),
    )


# the greedy merge, one step for each comparison: the head meets the open groups in order, then the next head starts
ABSORB_SQL = f"""{MERGE_SQL},
by_id AS (SELECT client_id, norm_id, list(struct_pack(pos := rule_pos, tr := tr) ORDER BY rule_pos) AS gs FROM merged GROUP BY ALL),
absorb AS (SELECT client_id, norm_id, gs[1] AS head, gs[2:] AS todo, gs[1:0] AS rest, gs[1:0] AS done FROM by_id
  UNION ALL
  SELECT client_id, norm_id,
    CASE WHEN len(todo) = 0 THEN rest[1] WHEN alike THEN struct_pack(pos := head.pos, tr := list_sort(list_distinct(list_concat(head.tr, todo[1].tr)))) ELSE head END,
    CASE WHEN len(todo) = 0 THEN rest[2:] ELSE todo[2:] END,
    CASE WHEN len(todo) = 0 THEN rest[1:0] WHEN alike THEN rest ELSE list_append(rest, todo[1]) END,
    CASE WHEN len(todo) = 0 THEN list_append(done, head) ELSE done END
  FROM (SELECT *, coalesce(len(head.tr) > 0 AND len(todo[1].tr) > 0 AND CAST(len(list_intersect(head.tr, todo[1].tr)) AS DOUBLE)
      / greatest(len(list_distinct(list_concat(head.tr, todo[1].tr))), 1) > CAST(0.7 AS DOUBLE), false) AS alike FROM absorb WHERE len(todo) > 0 OR len(rest) > 0) s),
absorbed AS (SELECT a.client_id, x.pos AS rule_pos, rule_id, account_id, account_name, category_type, x.tr AS tr
  FROM (SELECT client_id, norm_id, unnest(list_append(done, head)) AS x FROM absorb WHERE len(todo) = 0 AND len(rest) = 0) a
    JOIN merged m ON m.client_id = a.client_id AND m.norm_id = a.norm_id AND m.rule_pos = x.pos)"""


@query("a16_absorb_similar_rules", f"WITH {ABSORB_SQL} SELECT client_id, rule_pos, rule_id, account_id, account_name, array_to_string(tr, '|') AS triggers FROM absorbed")
def a16(i):
    return rulebase.absorb_similar(rulebase.merge_rules(i.rules)).select(
        "client_id", "rule_pos", "rule_id", "account_id", "account_name", F.array_join("trigger_payee_contains", "|").alias("triggers")
    )


@query("a16_similar_rule_pairs", f"""WITH {MERGE_SQL},
p AS (SELECT a.client_id, a.norm_id, a.rule_pos, b.rule_pos AS other_pos, len(list_intersect(a.tr, b.tr)) AS common, len(list_distinct(list_concat(a.tr, b.tr))) AS united
  FROM merged a JOIN merged b ON a.client_id = b.client_id AND a.norm_id = b.norm_id AND a.rule_pos < b.rule_pos)
SELECT client_id, norm_id, rule_pos, other_pos, common, CAST(common AS DOUBLE) / united AS similarity FROM p WHERE CAST(common AS DOUBLE) / united > 0.4""")
def a16_pairs(i):
    return rulebase.trigger_similarity(rulebase.merge_rules(i.rules), 0.4).select("client_id", "norm_id", "rule_pos", "other_pos", "common", "similarity")


@query("a17_final_dedupe", f"""WITH {ABSORB_SQL},
by_name AS (SELECT client_id, lower(trim(coalesce(account_name, ''))) AS kn, lower(trim(coalesce(category_type, ''))) AS kc, list(struct_pack(pos := rule_pos, tr := tr) ORDER BY rule_pos) AS gs FROM absorbed GROUP BY ALL),
fold AS (SELECT client_id, kn, kc, gs[1] AS head, gs[2:] AS todo, gs[1:0] AS done FROM by_name
  UNION ALL
  SELECT client_id, kn, kc, CASE WHEN alike THEN struct_pack(pos := head.pos, tr := list_sort(list_distinct(list_concat(head.tr, todo[1].tr)))) ELSE todo[1] END, todo[2:],
    CASE WHEN alike THEN done ELSE list_append(done, head) END
  FROM (SELECT *, len(head.tr) > 0 AND len(todo[1].tr) > 0 AND 2 * len(list_intersect(head.tr, todo[1].tr)) > len(list_distinct(list_concat(head.tr, todo[1].tr))) AS alike FROM fold WHERE len(todo) > 0) s)
SELECT f.client_id, x.pos AS rule_pos, rule_id, account_name, array_to_string(x.tr, '|') AS triggers
FROM (SELECT client_id, unnest(list_append(done, head)) AS x FROM fold WHERE len(todo) = 0) f JOIN absorbed a ON a.client_id = f.client_id AND a.rule_pos = x.pos""")
def a17(i):
    merged = rulebase.absorb_similar(rulebase.merge_rules(i.rules))
    return rulebase.final_dedupe(merged).select(
        "client_id", "rule_pos", "rule_id", "account_name", F.array_join("trigger_payee_contains", "|").alias("triggers")
    )


@query("a18_record_count", "SELECT client_id, count_if(coalesce(trim(memo), '') <> '' OR coalesce(trim(split), '') <> '') AS records FROM gl_raw GROUP BY client_id")
def a18(i):
    return health.record_count(i.gl_raw.select("client_id", "memo", "split"), ["client_id"])


@query("a19_rules_per_client", "SELECT n_nationkey AS client_id, n_name AS client_name, count(rule_id) AS rule_count FROM nation LEFT JOIN rules ON n_nationkey = client_id GROUP BY ALL")
def a19(i):
    return health.rule_counts(i.rules, i.nation.select(C("n_nationkey").alias("client_id"), C("n_name").alias("client_name")))


@query("a20_ledger_rows_per_client", "SELECT CAST(s_suppkey AS INT) AS client_id, count(row_pos) AS n, count(row_pos) > 0 AS has_data FROM supplier LEFT JOIN gl_entry ON s_suppkey = client_id GROUP BY ALL")
def a20(i):
    return health.ledger_counts(i.gl_entry, i.supplier.select(C("s_suppkey").cast("int").alias("client_id")))


@query("a21_blank_names", "SELECT client_id, count(*) AS total, count_if(trim(name) = '') AS blank_names FROM gl_entry GROUP BY client_id")
def a21(i):
    return health.blank_name_share(i.gl_entry, ["client_id"])


@query("j12_client_exists", "SELECT client_id, count(*) AS n FROM gl_entry WHERE client_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) GROUP BY client_id")
def j12(i):
    clients = i.nation.filter("n_regionkey < 3").select(C("n_nationkey").alias("client_id"))
    return ledger.existing_clients(i.gl_entry, clients).groupBy("client_id").agg(F.count("*").alias("n"))


SPLIT_CASE = """CASE CAST(row_pos % 9 AS INT) WHEN 0 THEN 'Wells Fargo Chk XXXX8615' WHEN 1 THEN 'Chase Business #5678' WHEN 2 THEN 'BMO Savings 9012'
  WHEN 3 THEN 'Chase the deer' WHEN 4 THEN concat('US Bank ', CAST(client_id AS STRING)) ELSE category END"""


def bank_splits(i):
    return i.gl_entry.withColumn("category", F.expr(SPLIT_CASE))


BANK_LABEL = "(" + q.any_of("lower(category)", K.BANK_LABEL_NAMES) + " AND regexp_matches(lower(category), '\\b(" + "|".join(K.BANK_LABEL_TYPES) + ")\\b|#\\s*\\d+|x{2,}\\d+|\\b\\d{4,}\\b'))"


@query("j13_drop_bank_rows", f"SELECT row_pos, category FROM (SELECT row_pos, {SPLIT_CASE} AS category FROM gl_entry) g WHERE NOT {BANK_LABEL}")
def j13(i):
    return ledger.drop_bank_rows(bank_splits(i)).select("row_pos", "category")


@query("j13_supplied_labels", """SELECT doc_id, source FROM documents WHERE source NOT IN
  (SELECT source FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING count_if(quality = 0) * 2 > count(*))""")
def j13_supplied(i):
    labelled = i.documents.select("doc_id", "source").join(i.labels, "doc_id").groupBy("source").agg(
        (F.count_if(C("quality") == 0) * 2 > F.count("*")).alias("is_bank")
    )
    return ledger.drop_bank_rows(i.documents.select("doc_id", "source"), "source", labelled).select("doc_id", "source")


@query("d5_distinct_splits", f"SELECT DISTINCT category FROM (SELECT {SPLIT_CASE} AS category FROM gl_entry) g WHERE trim(category) <> ''")
def d5(i):
    return ledger.distinct_splits(bank_splits(i))


@query("j14_coa_keyword_match", f"""WITH w AS (SELECT client_id AS wc, trim(account) AS account, coa_pos, unnest(regexp_split_to_array(lower(trim(account)), '\\s+')) AS word FROM coa),
t AS (SELECT DISTINCT client_id, description FROM bank_txn),
h AS (SELECT client_id, description, arg_min(account, lpad(CAST(coa_pos AS VARCHAR), 6, '0') || account) AS category FROM t JOIN w ON client_id = wc AND length(word) > 3 AND contains(lower(description), word) GROUP BY client_id, description)
SELECT t.client_id, t.description, category FROM t LEFT JOIN h USING (client_id, description)""")
def j14(i):
    return ledger.coa_keyword_match(i.bank_txn, i.coa)


@query("j15_organiser_list", """SELECT coalesce(CAST(r_regionkey AS VARCHAR), CAST(ref AS VARCHAR), '') AS "categoryId", coalesce(r_name, '') AS "categoryName", coalesce(CAST(n_nationkey AS VARCHAR), '') AS "subcategoryId",
  coalesce(n_name, '') AS "subcategoryName", CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) ELSE '' END AS priority
FROM region FULL JOIN (SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 3 THEN 77 ELSE n_regionkey END AS ref FROM nation) s ON ref = r_regionkey""")
def j15(i):
    categories = i.region.select(C("r_regionkey").alias("id"), C("r_name").alias("name"))
    subs = i.nation.select(
        C("n_nationkey").alias("id"), C("n_name").alias("name"), F.when(C("n_regionkey") == 3, 77).otherwise(C("n_regionkey")).alias("category_id"),
        F.when(C("n_nationkey") % 2 == 0, C("n_nationkey")).alias("priority"),
    )
    return ledger.organiser_list(categories, subs)


@query("d1_dedupe_output", """SELECT bank, coalesce(account_number, 'NA') AS account, date, description, amount, min(row_pos) AS row_pos
FROM (SELECT row_pos, bank, account_number, date, lower(trim(description)) AS description, CAST(floor(coalesce(credit, -debit) / 100000) AS BIGINT) AS amount FROM bank_txn) t GROUP BY ALL""")
def d1(i):
    rows = i.bank_txn.withColumn("amount", F.floor(F.coalesce("credit", -C("debit")) / 100000).cast("bigint"))
    return ingest.dedupe_output(rows).select(
        "bank", F.coalesce("account_number", F.lit("NA")).alias("account"), "date", F.lower(F.trim("description")).alias("description"), "amount", "row_pos"
    )


@query("d2_dedupe_statement", """SELECT client_id, date, description, credit, debit, min(row_pos) AS row_pos FROM (SELECT * FROM bank_txn UNION ALL SELECT * FROM bank_txn) t
WHERE description <> '' AND (coalesce(credit, 0) <> 0 OR coalesce(debit, 0) <> 0) GROUP BY ALL""")
def d2(i):
    return ingest.dedupe_statement(i.bank_txn.unionByName(i.bank_txn)).select("client_id", "date", "description", "credit", "debit", "row_pos")


@query("d3_union_statements", "SELECT bank, account_number, count(*) AS n FROM (SELECT bank, account_number FROM bank_txn UNION ALL SELECT bank, account_number FROM bank_export) u GROUP BY ALL")
def d3(i):
    both = i.bank_txn.select("bank", "account_number").unionByName(i.bank_export.select("bank", "account_number"))
    return both.groupBy("bank", "account_number").agg(F.count("*").alias("n"))


@query("d4_ordered_distinct", """SELECT client_id, rule_pos, string_agg(x, '|' ORDER BY k) AS triggers FROM (
  SELECT client_id, rule_pos, x, min(k) AS k FROM (SELECT client_id, rule_pos, unnest(list_concat(trigger_payee_contains, list_reverse(trigger_payee_contains))) AS x,
    generate_subscripts(list_concat(trigger_payee_contains, trigger_payee_contains), 1) AS k FROM rules) e GROUP BY ALL) d GROUP BY ALL""")
def d4(i):
    doubled = F.array_distinct(F.concat("trigger_payee_contains", F.reverse("trigger_payee_contains")))
    return i.rules.select("client_id", "rule_pos", F.array_join(doubled, "|").alias("triggers"))


@query("d6_union_subaccounts", "SELECT row_pos, bank, coalesce(account_number, 'NA') AS account, description FROM bank_txn")
def d6(i):
    main = i.bank_txn.filter("account_number IS NULL").select("row_pos", "bank", F.lit("NA").alias("account"), "description")
    subs = i.bank_txn.filter("account_number IS NOT NULL").select("row_pos", "bank", C("account_number").alias("account"), "description")
    return main.unionByName(subs)
