"""Statement text to transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark import constants as K
from tallyspark.catalog import sqltext as q
from tallyspark.catalog.base import query
from tallyspark.operators import statements

C = F.col


def money(c: str) -> str:
    return f"TRY_CAST(regexp_replace({c}, '[$,]', '', 'g') AS DECIMAL(18,2))"


def matches(c: str, p: str) -> str:
    return f"regexp_matches({c}, {q.lit(p)})"


def clean(source: str) -> str:
    return f"""cl AS (SELECT statement_id, page_no, line_no, {q.strip('text')} AS text FROM {source} WHERE {q.strip('text')} <> '' AND NOT {matches(q.strip('text'), K.FURNITURE_PATTERN)})"""


HEADER = "CASE " + " ".join(f"WHEN {matches('text', p)} THEN '{n}'" for n, p in K.SECTION_PATTERNS.items()) + " END"


def sections(source: str) -> str:
    return f"""{clean(source)},
hd AS (SELECT *, {HEADER} AS header, {matches('text', K.LEDGER_END_PATTERN)} AS ends FROM cl),
sx AS (SELECT *, last_value(header IGNORE NULLS) OVER w AS section, count_if(ends) OVER w AS end_count FROM hd WINDOW w AS (PARTITION BY statement_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
sec AS (SELECT statement_id, page_no, line_no, text, section FROM sx WHERE end_count = 0 AND header IS NULL)"""


def accounts(source: str) -> str:
    return f"""ah AS (SELECT *, nullif(regexp_extract(text, {q.lit(K.ACCOUNT_HEADER_PATTERN)}, 1), '') AS acct FROM {source}),
ac0 AS (SELECT *, last_value(acct IGNORE NULLS) OVER (PARTITION BY statement_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS account FROM ah),
ac AS (SELECT * EXCLUDE (acct) FROM ac0 WHERE acct IS NULL)"""


def continued(source: str, start: str, stop: str = "false") -> str:
    return f"""mk AS (SELECT *, {start} AS starts, {start} OR {stop} AS breaks FROM {source}),
gr AS (SELECT *, count_if(breaks) OVER (PARTITION BY statement_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS row_no FROM mk),
rw AS (SELECT statement_id, row_no, min(line_no) AS line_no, arg_min(text, line_no) AS text, arg_min(starts, line_no) AS starts, coalesce(string_agg(text, ' ' ORDER BY line_no) FILTER (NOT breaks), '') AS more
  FROM gr WHERE row_no > 0 GROUP BY statement_id, row_no)"""


@query("l1_clean_lines", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
SELECT doc_id, CAST(line_no AS INT) AS line_no, md5({q.strip('t')}) AS h FROM l WHERE {q.strip('t')} <> '' AND NOT {matches(q.strip('t'), K.FURNITURE_PATTERN)}""")
def l1(i):
    lines = statements.clean_lines(statements.text_lines(i.documents, "doc_id", "text"))
    return lines.select("doc_id", "line_no", F.md5("text").alias("h"))


@query("l2_section_labels", f"WITH {sections('statement_block')} SELECT statement_id, line_no, text, section FROM sec")
def l2(i):
    return statements.with_sections(statements.clean_lines(i.statement_block)).select("statement_id", "line_no", "text", "section")


def inline_part(n: int) -> str:
    return f"nullif(regexp_extract(text, {q.lit(K.INLINE_ROW_PATTERN)}, {n}), '')"


@query("l3_inline_rows", f"WITH {clean('statement_inline')} SELECT statement_id, line_no, {inline_part(1)} AS posted, {inline_part(2)} AS effective, {money(inline_part(3))} AS amount, {inline_part(4)} AS detail FROM cl WHERE {matches('text', K.INLINE_ROW_PATTERN)}")
def l3(i):
    return statements.inline_rows(statements.clean_lines(i.statement_inline)).select("statement_id", "line_no", "posted", "effective", "amount", "detail")


STOPS = f"({matches('text', K.TOTAL_PATTERN)} OR {matches('text', K.AMOUNT_LINE_PATTERN)} OR {matches('text', K.DATE_LINE_PATTERN)})"
INLINE_SQL = f"""{sections('statement_inline')},{continued('sec', matches('text', K.INLINE_ROW_PATTERN), STOPS)},
tr AS (SELECT rw.statement_id, rw.line_no, sec.section, {inline_part(1).replace('text', 'rw.text')} AS posted, {inline_part(2).replace('text', 'rw.text')} AS effective,
  {q.squeeze("concat_ws(' ', " + inline_part(4).replace('text', 'rw.text') + ", more)")} AS description, {money(inline_part(3).replace('text', 'rw.text'))} AS amount FROM rw JOIN sec USING (statement_id, line_no) WHERE starts)"""


@query("l4_continuation_lines", f"WITH {INLINE_SQL} SELECT statement_id, line_no, section, posted, effective, description, CASE WHEN section = 'credit' THEN amount END AS credit, CASE WHEN NOT coalesce(section = 'credit', false) THEN amount END AS debit FROM tr")
def l4(i):
    return statements.inline_transactions(i.statement_inline)


def block_sql(pick: str) -> str:
    agg = "min" if pick == "first" else "max"
    return f"""WITH {sections('statement_block')},
{accounts('sec')},
nc AS (SELECT * FROM ac WHERE coalesce(section, '') <> 'checks'),
mk AS (SELECT *, {matches('text', K.DATE_LINE_PATTERN)} AS is_date, {matches('text', K.DATE_LINE_PATTERN)} OR {matches('text', '(?i)^\\s*Total\\b')} AS breaks, {matches('text', K.AMOUNT_LINE_PATTERN)} AS is_amount FROM nc),
gr AS (SELECT *, count_if(breaks) OVER (PARTITION BY statement_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS row_no FROM mk),
al AS (SELECT statement_id, row_no, {agg}(line_no) AS amount_line FROM gr WHERE is_amount AND row_no > 0 GROUP BY ALL),
b AS (SELECT gr.statement_id, gr.row_no, min(line_no) AS line_no, arg_min(section, line_no) AS section, list(account ORDER BY line_no)[1] AS account, arg_min(text, line_no) AS date, arg_min(is_date, line_no) AS is_date,
    any_value({money('text')}) FILTER (line_no = amount_line) AS amount, coalesce(string_agg(text, ' ' ORDER BY line_no) FILTER (NOT breaks AND line_no <> amount_line), '') AS words
  FROM gr JOIN al ON gr.statement_id = al.statement_id AND gr.row_no = al.row_no GROUP BY gr.statement_id, gr.row_no)
SELECT statement_id, line_no, section, account, date, {q.squeeze('words')} AS description, amount FROM b WHERE is_date AND {q.squeeze('words')} <> ''"""


@query("l5_block_rows", block_sql("first"))
def l5(i):
    return statements.block_transactions(i.statement_block)


@query("l5_block_rows_last_amount", block_sql("last"))
def l5_last(i):
    return statements.block_transactions(i.statement_block, "last")


@query("l6_check_rows", f"""WITH {sections('statement_block')},
ck AS (SELECT * FROM sec WHERE section = 'checks' AND NOT {matches('text', K.CHECK_MARKER_PATTERN)}),
ld AS (SELECT *, lead(text, 1) OVER w AS d, lead(text, 2) OVER w AS a FROM ck WINDOW w AS (PARTITION BY statement_id ORDER BY line_no))
SELECT statement_id, line_no, d AS date, 'Check ' || regexp_replace(text, '\\D', '', 'g') AS description, {money('a')} AS debit FROM ld
WHERE {matches('text', K.CHECK_LINE_PATTERN)} AND {matches('d', K.DATE_LINE_PATTERN)} AND {matches('a', K.AMOUNT_LINE_PATTERN)}""")
def l6(i):
    return statements.check_transactions(i.statement_block)


@query("l7_polarity", f"""SELECT row_pos, CASE WHEN sect IN ('credit', 'debit') THEN sect WHEN {q.any_of('lower(description)', K.POLARITY_CREDIT_WORDS)} THEN 'credit' ELSE 'debit' END AS polarity
FROM (SELECT row_pos, description, CASE CAST(row_pos % 7 AS INT) WHEN 0 THEN 'credit' WHEN 1 THEN 'debit' END AS sect FROM bank_txn) t""")
def l7(i):
    section = F.when(C("row_pos") % 7 == 0, "credit").when(C("row_pos") % 7 == 1, "debit")
    amount = F.concat(F.lit("-"), F.coalesce("credit", "debit").cast("string"))
    return i.bank_txn.select("row_pos", statements.polarity(section, C("description"), amount).alias("polarity"))


TABLE_START = "^\\d{1,2}/\\d{1,2}(?:/\\d{2,4})?\\b"


@query("l8_amount_columns", f"""WITH {clean('statement_table')},{continued('cl', matches('text', TABLE_START))},
p AS (SELECT *, regexp_extract(text, '^(\\S+)', 1) AS date, regexp_replace(text, '^\\S+\\s*', '') AS rest FROM rw WHERE starts),
m AS (SELECT *, [{money('x')} for x in regexp_extract_all(rest, {q.lit(K.MONEY_PATTERN)})] AS m, trim(regexp_replace(rest, {q.lit(K.MONEY_PATTERN)}, '', 'g')) AS words FROM p),
k AS (SELECT *, len(m) AS n, {q.any_of('lower(words)', K.TABLE_CREDIT_HINTS)} AS cl, {q.any_of('lower(words)', K.TABLE_DEBIT_HINTS)} AS dl,
  {q.any_of('lower(words)', K.TABLE_TWO_AMOUNT_CREDIT_WORDS)} OR NOT {q.any_of('lower(words)', K.TABLE_TWO_AMOUNT_DEBIT_WORDS)} AS two, {q.any_of('lower(words)', K.TABLE_ONE_AMOUNT_CREDIT_WORDS)} AS one FROM m),
z AS (SELECT *, CASE WHEN cl AND NOT dl THEN true WHEN dl AND NOT cl THEN false WHEN n = 2 THEN two ELSE one END AS cr FROM k)
SELECT statement_id, line_no, date, trim(concat_ws(' ', words, nullif(more, ''))) AS description, CASE WHEN n = 3 OR (n IN (1, 2) AND cr) THEN m[1] END AS credit,
  CASE WHEN n = 3 THEN m[2] WHEN n IN (1, 2) AND NOT cr THEN m[1] END AS debit, CASE WHEN n = 3 THEN m[3] WHEN n = 2 THEN m[2] END AS balance FROM z""")
def l8(i):
    return statements.table_transactions(i.statement_table)


@query("l9_account_blocks", f"WITH {clean('statement_block')},{accounts('cl')} SELECT statement_id, line_no, text, account FROM ac")
def l9(i):
    return statements.with_accounts(statements.clean_lines(i.statement_block)).select("statement_id", "line_no", "text", "account")


BALANCE_TEXT = "CASE CAST(row_pos % 3 AS INT) WHEN 0 THEN concat('paid ', CAST(coalesce(credit, debit) AS STRING), ' Balance 7,100.25') WHEN 1 THEN concat('Balance 55.10 after ', CAST(coalesce(credit, debit) AS STRING)) ELSE concat(description, ' .50 x ', CAST(coalesce(credit, debit) AS STRING)) END"
AMOUNT_RE = "((?:\\d{1,3}(?:,\\d{3})*|\\d*)\\.\\d{2})"


@query("l10_amount_before_balance", f"""SELECT row_pos, {money(f"coalesce(nullif(regexp_extract(regexp_replace(t, '(?is)\\bBalance\\b.*$', ''), '{AMOUNT_RE}', 1), ''), nullif(regexp_extract(t, '{AMOUNT_RE}', 1), ''))")} AS amount
FROM (SELECT row_pos, {BALANCE_TEXT} AS t FROM bank_txn) b""")
def l10(i):
    return i.bank_txn.select("row_pos", statements.amount_before_balance(F.expr(BALANCE_TEXT)).alias("amount"))


FINAL_TEXT = "CASE CAST(row_pos % 8 AS INT) WHEN 0 THEN concat('Total ', description) WHEN 1 THEN '' ELSE description END"


@query("l11_final_filter", f"SELECT row_pos, description FROM (SELECT row_pos, {FINAL_TEXT} AS description, CASE WHEN row_pos % 9 > 0 THEN credit END AS credit, CASE WHEN row_pos % 9 > 0 THEN debit END AS debit FROM bank_txn) b WHERE description <> '' AND NOT regexp_matches(description, '(?i)\\b(total|summary)\\b') AND coalesce(credit, debit, 0) <> 0")
def l11(i):
    rows = i.bank_txn.withColumn("description", F.expr(FINAL_TEXT))
    for c in ("credit", "debit"):
        rows = rows.withColumn(c, F.when(C("row_pos") % 9 > 0, C(c)))
    return statements.final_rows(rows).select("row_pos", "description")


@query("l12_valid_description", f"SELECT row_pos, length(description) >= 3 AND ({q.any_of('lower(description)', K.SHORT_DESCRIPTION_WORDS)} OR (len(regexp_split_to_array(trim(description), '\\s+')) >= 3 AND {q.any_of('lower(description)', K.LONG_DESCRIPTION_WORDS)})) AS valid FROM bank_txn")
def l12(i):
    return i.bank_txn.select("row_pos", statements.is_valid_description(C("description")).alias("valid"))


def page_sql(cards: bool) -> str:
    patterns = K.CARD_PAGE_HEADER_PATTERNS if cards else K.PAGE_HEADER_PATTERNS
    header = " OR ".join(matches("text", p) for p in patterns)
    date, amount = matches("text", K.PAGE_DATE_PATTERN), matches("text", K.PAGE_AMOUNT_PATTERN)
    on = f"{date} AND {amount} AND NOT {matches('text', K.PAGE_SUMMARY_PATTERN)}" if cards else f"{amount} AND ({date} OR length({q.strip('text')}) > 200)"
    return f"""WITH f AS (SELECT statement_id, page_no, CASE WHEN {header} THEN 'header' WHEN NOT ({on}) THEN 'stop' END AS event FROM doc_page),
c AS (SELECT *, last_value(event IGNORE NULLS) OVER (PARTITION BY statement_id ORDER BY page_no ROWS UNBOUNDED PRECEDING) AS state, bool_or(coalesce(event = 'header', false)) OVER (PARTITION BY statement_id) AS any_header FROM f)
SELECT statement_id, page_no FROM c WHERE NOT any_header OR coalesce(state, 'stop') = 'header'"""


@query("l13_transaction_pages", page_sql(False))
def l13(i):
    return statements.transaction_pages(i.doc_page).select("statement_id", "page_no")


@query("l13_card_pages", page_sql(True))
def l13_cards(i):
    return statements.transaction_pages(i.doc_page, True).select("statement_id", "page_no")


@query("l14_generic_layout", f"""WITH {clean('statement_trailing')},{continued('cl', matches('text', K.GENERIC_ROW_PATTERN))},
p AS (SELECT *, {money(f"regexp_extract(text, {q.lit(K.GENERIC_ROW_PATTERN)}, 3)")} AS amount FROM rw WHERE starts)
SELECT statement_id, line_no, regexp_extract(text, {q.lit(K.GENERIC_ROW_PATTERN)}, 1) AS date, concat_ws(' ', trim(regexp_extract(text, {q.lit(K.GENERIC_ROW_PATTERN)}, 2)), nullif(more, '')) AS description,
  CASE WHEN amount >= 0 THEN amount END AS credit, CASE WHEN amount < 0 THEN -amount END AS debit FROM p""")
def l14(i):
    return statements.pattern_transactions(i.statement_trailing)


@query("l15_balance_pairs", f"""WITH p AS (SELECT statement_id, line_no, regexp_extract_all(text, {q.lit(K.BALANCE_PAIR_PATTERN)}, 1) AS d, regexp_extract_all(text, {q.lit(K.BALANCE_PAIR_PATTERN)}, 2) AS v FROM balance_line),
e AS (SELECT statement_id, line_no, unnest(range(len(d))) AS k, d, v FROM p)
SELECT statement_id, line_no, CAST(k AS INT) AS pair_no, d[k + 1] AS date, {money('v[k + 1]')} AS balance FROM e""")
def l15(i):
    return statements.balance_rows(i.balance_line)


GROUP_AMOUNT = "([0-9]{1,3}(?:,[0-9]{3})*\\.\\d{2})"
GROUPED = """SELECT statement_id, page_no, line_no, text FROM {statement_block} UNION ALL SELECT statement_id, 0 AS page_no, line_no * 10 + 7 AS line_no, '88.15' AS text FROM {balance_line} WHERE line_no % 2 = 0
  UNION ALL SELECT statement_id, 0, line_no * 10 + 4, 'Check' FROM {balance_line} WHERE line_no % 30 = 1"""


@query("l16_grouped_amount", f"""WITH gsrc AS ({GROUPED.replace('{statement_block}', 'statement_block').replace('{balance_line}', 'balance_line')}),{clean('gsrc')},{accounts('cl')},
mk AS (SELECT *, {matches('text', K.DATE_LINE_PATTERN)} AS is_date FROM ac),
gr AS (SELECT *, count_if(is_date) OVER (PARTITION BY statement_id ORDER BY line_no, text ROWS UNBOUNDED PRECEDING) AS row_no FROM mk),
g AS (SELECT statement_id, row_no, list(account ORDER BY line_no)[1] AS account, string_agg(text, chr(10) ORDER BY line_no, text) AS joined FROM gr WHERE row_no > 0 AND NOT is_date GROUP BY ALL),
p AS (SELECT *, string_split(regexp_replace(joined, '(?im)^(\\d{{3,6}})\\*?\\ncheck$', 'Check \\1', 'g'), chr(10)) AS parts FROM g),
a AS (SELECT *, flatten([regexp_extract_all(x, '{GROUP_AMOUNT}', 1) for x in parts]) AS amounts, [x for x in parts if regexp_matches(x, '{GROUP_AMOUNT}')] AS wa FROM p)
SELECT statement_id, row_no, account, {q.squeeze(f"array_to_string([trim(regexp_replace(x, '{GROUP_AMOUNT}', '', 'g')) for x in parts if NOT {matches('x', K.AMOUNT_LINE_PATTERN)} AND trim(regexp_replace(x, '{GROUP_AMOUNT}', '', 'g')) <> ''], ' ')")} AS description,
  {money(f"CASE WHEN len(amounts) >= 2 AND {matches('wa[-1]', K.AMOUNT_LINE_PATTERN)} THEN amounts[-2] ELSE amounts[1] END")} AS amount FROM a WHERE len(amounts) > 0""")
def l16(i):
    return statements.grouped_transactions(i.sql(GROUPED))
