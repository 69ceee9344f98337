"""Nearest neighbours, history matches and the similarity cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark import constants as K
from tallyspark.catalog import sqltext as q
from tallyspark.catalog.base import query
from tallyspark.catalog.extract import PAYEE_SQL
from tallyspark.functions import text as tx
from tallyspark.operators import ingest, ledger, neighbours, review
from tallyspark.session import materialise

C = F.col
AMA = K.DEFAULT_CATEGORY


def top_sql(queries: str = "query_vectors", k: int = 50, p: str = "", vector: str = "embedding") -> str:
    return f"""
{p}qv AS (SELECT client_id, txn_id, [CAST(x AS DOUBLE) / sqrt(list_sum([CAST(y AS DOUBLE) * CAST(y AS DOUBLE) for y in {vector}])) for x in {vector}] AS v FROM {queries}),
{p}hv AS (SELECT client_id, vec_id, [CAST(x AS DOUBLE) / sqrt(list_sum([CAST(y AS DOUBLE) * CAST(y AS DOUBLE) for y in embedding])) for x in embedding] AS v FROM ledger_vectors),
{p}sc AS (SELECT a.client_id, txn_id, vec_id, round(list_dot_product(a.v, b.v), 6) AS score FROM {p}qv a JOIN {p}hv b ON a.client_id = b.client_id AND txn_id <> vec_id),
{p}top AS (SELECT *, row_number() OVER (PARTITION BY client_id, txn_id ORDER BY score DESC, vec_id) AS rank FROM {p}sc QUALIFY rank <= {k})"""


TOP = top_sql()
NAME_TOP = top_sql(p="n", vector="name_embedding")


def cand_sql(ranked: str = "top") -> str:
    return f"""{TOP},
cand0 AS (SELECT t.*, qq.memo AS q_memo, qq.amount AS q_amount, qq.is_check, qq.payee, h.memo, h.name, h.category, h.date, h.amount AS h_amount,
    lower(trim(qq.memo)) AS a, lower(trim(h.memo)) AS b, {q.check_memo_key('qq.memo')} AS ka, {q.check_memo_key('h.memo')} AS kb
  FROM {ranked} t JOIN query_vectors qq USING (client_id, txn_id) JOIN ledger_vectors h USING (client_id, vec_id)),
cand AS (SELECT *, a = b OR (ka <> '' AND ka = kb) OR (length(a) >= 4 AND length(b) >= 4 AND (contains(a, b) OR contains(b, a))) AS memo_match,
    abs(q_amount) > 0 AND abs(h_amount) > 0 AND abs(abs(q_amount) - abs(h_amount)) < 0.01 AS amount_match FROM cand0),
tier0 AS (SELECT *, CASE WHEN memo_match AND amount_match THEN 1 WHEN memo_match AND score >= 0.8 THEN 2 WHEN rank <= 20 AND score >= 0.8 THEN 3 WHEN rank <= 5 THEN 4 END AS tier,
    coalesce(date, DATE '0001-01-01') AS dd FROM cand),
best AS (SELECT * FROM tier0 WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY client_id, txn_id ORDER BY tier,
    CASE WHEN tier = 4 THEN -score END, CASE WHEN tier < 4 THEN dd END DESC, CASE WHEN tier = 3 THEN -score END, CASE WHEN tier = 4 THEN dd END DESC, rank NULLS LAST, vec_id) = 1)"""


CAND = cand_sql()
# the neighbours, and every pair of equal memo and amount over the whole ledger
WHOLE = """(SELECT * FROM top UNION ALL SELECT a.client_id, a.txn_id, b.vec_id, NULL, NULL FROM query_vectors a JOIN ledger_vectors b
    ON a.client_id = b.client_id AND a.txn_id <> b.vec_id AND abs(a.amount) = abs(b.amount)
    WHERE lower(trim(a.memo)) = lower(trim(b.memo)) OR ({key_a} <> '' AND {key_a} = {key_b}))""".format(key_a=q.check_memo_key("a.memo"), key_b=q.check_memo_key("b.memo"))

PAYEES = "payee_source AS (SELECT memo AS description FROM query_vectors)," + PAYEE_SQL.format(source="payee_source").lstrip()

NAMES = f"""{PAYEES},
named AS (SELECT qq.*, payee AS sname FROM (SELECT client_id, txn_id, memo FROM query_vectors WHERE NOT is_check) qq JOIN payees ON d = trim(memo) WHERE payees.payee <> ''),
nexact AS (SELECT n.client_id, n.txn_id, h.category, h.name AS h_name FROM named n JOIN ledger_vectors h ON n.client_id = h.client_id AND lower(trim(h.name)) = lower(trim(sname)) AND h.vec_id <> n.txn_id
  WHERE trim(h.name) <> '' AND trim(h.category) <> '' QUALIFY row_number() OVER (PARTITION BY n.client_id, n.txn_id ORDER BY coalesce(h.date, DATE '0001-01-01') DESC, h.vec_id) = 1),
nm AS (SELECT t.*, h.category, h.name AS h_name, coalesce(h.date, DATE '0001-01-01') AS dd
  FROM ntop t JOIN named USING (client_id, txn_id) JOIN ledger_vectors h USING (client_id, vec_id) WHERE (t.client_id, txn_id) NOT IN (SELECT (client_id, txn_id) FROM nexact)),
nbest AS (SELECT client_id, txn_id, true AS exact, category, CAST(1 AS DOUBLE) AS score, h_name FROM nexact UNION ALL
  (SELECT client_id, txn_id, false, category, score, h_name FROM nm WHERE score >= 0.8 QUALIFY row_number() OVER (PARTITION BY client_id, txn_id ORDER BY dd DESC, rank) = 1))"""

PAYCAT = """
paycat AS (SELECT client_id, lower(trim(name)) AS k, arg_max(category, coalesce(date, DATE '0001-01-01')) AS x FROM ledger_vectors GROUP BY ALL),
payrank AS (SELECT client_id, lower(trim(name)) AS k, category AS pcat, name AS pname FROM ledger_vectors WHERE trim(name) <> '' AND trim(category) <> ''
  QUALIFY row_number() OVER (PARTITION BY client_id, lower(trim(name)) ORDER BY coalesce(date, DATE '0001-01-01') DESC, vec_id) = 1)"""

PROPOSALS = "SELECT client_id, txn_id AS query_id, CASE CAST(txn_id % 3 AS INT) WHEN 0 THEN 'STANDARD ITEMS' WHEN 1 THEN 'fuel' ELSE 'nothing' END AS proposal FROM query_vectors"
COA_CATS = f"coacats AS (SELECT DISTINCT client_id, lower({q.squeeze('account')}) AS ccat FROM coa WHERE lower(trim(account)) NOT IN ('', 'nan', 'none', 'null'))"

CASCADE = f"""{cand_sql(WHOLE)},{NAME_TOP},{PAYCAT},{NAMES},{COA_CATS},
prop AS (SELECT p.client_id, query_id, ccat FROM ({PROPOSALS}) p JOIN coacats c ON p.client_id = c.client_id AND lower(trim(proposal)) = ccat),
sim0 AS (SELECT qq.client_id, qq.txn_id, qq.memo, qq.amount, qq.is_check, qq.payee, CASE WHEN NOT qq.is_check OR best.tier = 1 THEN best.tier END AS tier, nullif(trim(best.category), '') AS bcat, best.name AS bname,
    pcat, nullif(trim(nbest.category), '') AS ncat, ccat
  FROM query_vectors qq LEFT JOIN best USING (client_id, txn_id) LEFT JOIN payrank ON qq.is_check AND payrank.client_id = qq.client_id AND k = lower(trim(qq.payee)) AND qq.payee <> ''
    LEFT JOIN nbest ON nbest.client_id = qq.client_id AND nbest.txn_id = qq.txn_id LEFT JOIN prop ON prop.client_id = qq.client_id AND prop.query_id = qq.txn_id),
sim AS (SELECT client_id, txn_id AS query_id, memo, amount, is_check, payee, tier, CASE WHEN is_check THEN CASE WHEN tier = 1 THEN coalesce(bcat, '{AMA}') ELSE coalesce(pcat, '{AMA}') END
      ELSE coalesce(bcat, ncat, ccat, '{AMA}') END AS category,
    CASE WHEN is_check THEN CASE WHEN tier = 1 THEN coalesce(nullif(trim(bname), ''), payee) WHEN pcat IS NOT NULL THEN payee ELSE '' END WHEN tier = 1 THEN trim(bname) ELSE '' END AS payee_name FROM sim0)"""


def cascade(i):
    proposals = i.sql(PROPOSALS.replace("query_vectors", "{query_vectors}"))
    cats = ingest.coa_categories(i.coa, ["client_id"])
    return neighbours.similarity_cascade(i.query_vectors, i.ledger_vectors, cats, proposals, exclude_self=True)


@query("j16_top_k_neighbours", f"WITH {TOP} SELECT client_id, txn_id AS query_id, vec_id AS entry_id, score, rank FROM top")
def j16(i):
    return neighbours.top_k(i.query_vectors, i.ledger_vectors, 50, exclude_self=True)


@query("j17_exact_history_match", f"WITH {CAND} SELECT client_id, txn_id AS query_id, vec_id AS entry_id, memo, h_amount, date FROM cand WHERE memo_match AND amount_match")
def j17(i):
    c = neighbours.match_flags(neighbours.candidates(i.query_vectors, i.ledger_vectors, 50, True))
    return c.filter("memo_match AND amount_match").select("client_id", "query_id", "entry_id", "memo", "h_amount", "date")


@query("j17_equal_memo_and_amount", """
WITH b AS (SELECT row_pos, client_id, CASE WHEN row_pos % 2 = 0 THEN upper(memo) ELSE memo END AS memo, coalesce(debit, credit) AS amount FROM gl_entry),
h AS (SELECT client_id, lower(trim(memo)) AS k, coalesce(debit, credit) AS amount, count(*) AS n FROM gl_entry GROUP BY ALL)
SELECT row_pos, n FROM b JOIN h ON b.client_id = h.client_id AND lower(trim(b.memo)) = h.k AND b.amount = h.amount""")
def j17_equal(i):
    amount = F.coalesce("debit", "credit").alias("amount")
    key = F.lower(tx.strip(C("memo"))).alias("k")
    b = i.gl_entry.withColumn("memo", F.when(C("row_pos") % 2 == 0, F.upper("memo")).otherwise(C("memo"))).select("row_pos", "client_id", key, amount)
    h = i.gl_entry.select("client_id", key, amount).groupBy("client_id", "k", "amount").agg(F.count("*").alias("n"))
    return b.join(h, ["client_id", "k", "amount"]).select("row_pos", "n")


@query("j18_memo_only_match", f"WITH {CAND} SELECT client_id, txn_id AS query_id, vec_id AS entry_id, score FROM cand WHERE memo_match AND NOT amount_match AND score >= 0.8")
def j18(i):
    c = neighbours.match_flags(neighbours.candidates(i.query_vectors, i.ledger_vectors, 50, True))
    return c.filter((C("memo_match") & ~C("amount_match")) & (C("score") >= K.HIGH_SCORE)).select("client_id", "query_id", "entry_id", "score")


@query("j19_category_by_payee", f"WITH {PAYCAT.lstrip()} SELECT txn_id, pcat AS category FROM query_vectors qq LEFT JOIN payrank ON qq.client_id = payrank.client_id AND k = lower(trim(payee)) WHERE is_check")
def j19(i):
    names = i.query_vectors.filter("is_check").select("client_id", "txn_id", C("payee").alias("name"))
    return ledger.category_by_name(names, i.ledger_vectors.withColumnRenamed("vec_id", "entry_id")).select("txn_id", "category")


@query("j20_name_search", f"WITH {NAME_TOP},{PAYCAT},{NAMES} SELECT client_id, txn_id AS query_id, category, CASE WHEN exact THEN 'exact' ELSE 'similar' END AS match_type, score, h_name AS name FROM nbest")
def j20(i):
    from tallyspark.functions import payee

    named = i.query_vectors.filter("NOT is_check").select("client_id", "txn_id", "name_embedding", payee.payee_from_description(C("memo")).alias("search_name"))
    named = materialise(named.filter("search_name <> ''"), "names")  # read for the exact names and for the search
    return neighbours.name_search(named, i.ledger_vectors, "search_name", 50, True)


@query("j22_coa_proposals", f"WITH {COA_CATS} SELECT p.client_id, query_id, ccat AS category FROM ({PROPOSALS}) p JOIN coacats c ON p.client_id = c.client_id AND lower(trim(proposal)) = ccat")
def j22(i):
    proposals = i.sql(PROPOSALS.replace("query_vectors", "{query_vectors}"))
    return neighbours.accept_coa_proposals(proposals, ingest.coa_categories(i.coa, ["client_id"])).select("client_id", "query_id", "category")


@query("c3_similarity_cascade", f"WITH {CASCADE} SELECT client_id, query_id, category, payee_name, tier FROM sim WHERE NOT is_check")
def c3(i):
    return cascade(i).filter("NOT is_check").select("client_id", "query_id", "category", "payee_name", "tier")


@query("c4_check_rows", f"WITH {CASCADE} SELECT client_id, query_id, category, payee_name, tier FROM sim WHERE is_check")
def c4(i):
    return cascade(i).filter("is_check").select("client_id", "query_id", "category", "payee_name", "tier")


@query("c5_legacy_payee", f"""WITH {CASCADE}
SELECT client_id, query_id, coalesce(nullif(trim(sim.payee), ''), nullif(trim(payee_name), ''), nullif(payees.payee, ''), '{AMA}') AS payee_out FROM sim JOIN payees ON d = trim(memo)""")
def c5(i):
    rows = cascade(i)
    return rows.select("client_id", "query_id", neighbours.legacy_payee(rows).alias("payee_out"))


@query("c8_legacy_default", f"WITH {CAND} SELECT txn_id, coalesce(nullif(trim(best.category), ''), 'Uncategorized') AS category FROM query_vectors LEFT JOIN best USING (client_id, txn_id)")
def c8(i):
    best = neighbours.best_candidate(neighbours.candidates(i.query_vectors, i.ledger_vectors, 50, True)).withColumnRenamed("query_id", "txn_id")
    rows = i.query_vectors.select("client_id", "txn_id").join(best, ["client_id", "txn_id"], "left")
    return rows.select("txn_id", F.coalesce(F.nullif(tx.strip(C("best.category")), F.lit("")), F.lit(K.UNCATEGORIZED)).alias("category"))


def look_sql(k: int, by: str) -> str:
    return f"""WITH {top_sql(k=k, vector="embedding" if by == "memo" else "name_embedding")},
lb AS (SELECT top.*, h.memo, h.name, h.category, h.date, lower(trim(h.{by})) AS ht, lower(trim(h.{by})) = lower(trim(qq.q)) AS ex, score >= 0.8 AS hi, coalesce(h.date, DATE '0001-01-01') AS dd
  FROM top JOIN (SELECT client_id, txn_id, {"memo" if by == "memo" else "upper(substr(memo, length(memo) - 7))"} AS q FROM query_vectors) qq USING (client_id, txn_id) JOIN ledger_vectors h USING (client_id, vec_id)),
sel AS (SELECT client_id, txn_id, ht AS s_text, score AS s_score FROM lb WHERE ex OR hi QUALIFY row_number() OVER (PARTITION BY client_id, txn_id ORDER BY ex DESC, dd DESC, rank) = 1)
SELECT client_id, txn_id AS query_id, rank, vec_id AS entry_id, memo, name, category, round(score, 4) AS similarity_score, date, ex AS is_exact_match, hi AS is_high_score,
  coalesce(ht = s_text AND abs(score - s_score) < 0.0001, false) AS is_selected FROM lb LEFT JOIN sel USING (client_id, txn_id)"""


@query("c11_memo_look_back", look_sql(25, "memo"))
def c11(i):
    return neighbours.look_back(i.query_vectors, i.ledger_vectors, 25, True, "memo")


@query("c12_name_look_back", look_sql(50, "name"))
def c12(i):
    named = i.query_vectors.withColumn("embedding", C("name_embedding")).withColumn("name", F.upper(F.expr("substr(memo, length(memo) - 7)")))
    return neighbours.look_back(named, i.ledger_vectors, 50, True, "name")


@query("c13_first_neighbour", f"WITH {top_sql(k=1)} SELECT txn_id AS query_id, coalesce(h.category, 'unknown') AS category FROM query_vectors qq LEFT JOIN top USING (client_id, txn_id) LEFT JOIN ledger_vectors h USING (client_id, vec_id)")
def c13(i):
    return neighbours.first_category(i.query_vectors, i.ledger_vectors, True).select("query_id", "category")


SKIP = "trim(qq.memo) = '' OR NOT regexp_matches(qq.memo, '[a-zA-Z]') OR regexp_matches(qq.memo, '(?i)\\bloan\\b') OR regexp_matches(qq.memo, '(?i)\\bcheck\\b')"


@query("c14_label_file", f"WITH {top_sql(k=1)} SELECT txn_id AS query_id, CASE WHEN {SKIP} THEN 'unknown' ELSE coalesce(h.category, 'unknown') END AS category FROM query_vectors qq LEFT JOIN top USING (client_id, txn_id) LEFT JOIN ledger_vectors h USING (client_id, vec_id)")
def c14(i):
    return neighbours.label_file(i.query_vectors, i.ledger_vectors, True).select("query_id", "category")


def flagged(i):
    return neighbours.match_flags(neighbours.candidates(i.query_vectors, i.ledger_vectors, 50, True))


@query("t1_newest_candidate", f"WITH {CAND} SELECT client_id, txn_id AS query_id, vec_id AS entry_id, date FROM cand WHERE memo_match QUALIFY row_number() OVER (PARTITION BY client_id, txn_id ORDER BY date DESC NULLS LAST, rank) = 1")
def t1(i):
    rows = flagged(i).filter("memo_match").withColumnRenamed("rank", "score_rank")
    return review.latest_per_key(rows, ["client_id", "query_id"], [C("date").desc_nulls_last(), C("score_rank")]).select("client_id", "query_id", "entry_id", "date")


@query("t2_newest_high_score", f"WITH {CAND} SELECT client_id, txn_id AS query_id, vec_id AS entry_id, date, score FROM cand WHERE score >= 0.8 AND rank <= 20 QUALIFY row_number() OVER (PARTITION BY client_id, txn_id ORDER BY date DESC NULLS LAST, score DESC, rank) = 1")
def t2(i):
    rows = flagged(i).filter("rank <= 20 AND score >= 0.8").withColumnRenamed("rank", "score_rank")
    return review.latest_per_key(rows, ["client_id", "query_id"], [C("date").desc_nulls_last(), C("score").desc(), C("score_rank")]).select("client_id", "query_id", "entry_id", "date", "score")


@query("t3_best_of_top_five", f"WITH {CAND} SELECT client_id, txn_id AS query_id, vec_id AS entry_id, score FROM cand WHERE rank <= 5 QUALIFY row_number() OVER (PARTITION BY client_id, txn_id ORDER BY score DESC, date DESC NULLS LAST, rank) = 1")
def t3(i):
    rows = flagged(i).filter("rank <= 5").withColumnRenamed("rank", "score_rank")
    return review.latest_per_key(rows, ["client_id", "query_id"], [C("score").desc(), C("date").desc_nulls_last(), C("score_rank")]).select("client_id", "query_id", "entry_id", "score")


@query("t4_ranked_neighbours", f"WITH {CAND} SELECT client_id, txn_id AS query_id, rank, vec_id AS entry_id, round(score, 4) AS score, memo_match, score >= 0.8 AS is_high_score FROM cand")
def t4(i):
    return flagged(i).select("client_id", "query_id", "rank", "entry_id", neighbours.four_decimals(C("score")).alias("score"), "memo_match", (C("score") >= K.HIGH_SCORE).alias("is_high_score"))
