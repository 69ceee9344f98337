"""Text extraction expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark import constants as K
from tallyspark.catalog import sqltext as q
from tallyspark.catalog.base import query
from tallyspark.catalog.normalise import long_date
from tallyspark.functions import codes, dates, money, payee, text as tx, web
from tallyspark.operators import rulebase, statements

C = F.col


def per_description(i, **columns):
    return i.bank_txn.select("row_pos", *[c.alias(n) for n, c in columns.items()])


@query("s1_strip_bank_noise", f"SELECT row_pos, {q.strip_noise('description')} AS cleaned FROM bank_txn")
def s1(i):
    return per_description(i, cleaned=tx.strip_bank_noise(C("description")))


@query("s2_check_number", f"SELECT row_pos, {q.check_number('description')} AS n, {q.check_number('reverse_text')} AS n2 FROM (SELECT *, regexp_extract(description, '(\\d+)', 1) || ' Check' AS reverse_text FROM bank_txn) t")
def s2(i):
    other = F.concat(F.regexp_extract("description", r"(\d+)", 1), F.lit(" Check"))
    return per_description(i, n=codes.check_number(C("description")), n2=codes.check_number(other))


@query("s3_check_like", f"SELECT row_pos, {q.is_check_like('description')} AS is_check FROM bank_txn")
def s3(i):
    return per_description(i, is_check=codes.is_check_like(C("description")))


@query("s4_legacy_check_number", f"""SELECT row_pos, {q.check_key(f"coalesce(nullif(trim(cheque_no), ''), nullif(regexp_extract(description, {q.lit(K.LEGACY_CHECK_PATTERN)}, 1), ''))")} AS n FROM bank_export""")
def s4(i):
    return i.bank_export.select("row_pos", codes.legacy_check_number(C("cheque_no"), C("description")).alias("n"))


@query("s5_ach_payment", f"SELECT row_pos, {q.is_ach('description')} AS is_ach FROM bank_txn")
def s5(i):
    return per_description(i, is_ach=codes.is_ach_payment(C("description")))


@query("s6_vendor_code", f"SELECT row_pos, {q.vendor_code('description')} AS code, {q.ach_code('description')} AS ach_code FROM bank_txn")
def s6(i):
    return per_description(i, code=codes.vendor_code(C("description")), ach_code=codes.ach_vendor_code(C("description")))


_GENERIC = q.in_list(K.PAYEE_GENERIC_TERMS)
_PHRASE = "coalesce(" + ", ".join(
    f"CASE WHEN length(trim(regexp_extract(d, {q.lit(p)}, 1))) BETWEEN 3 AND 99 THEN trim(regexp_extract(d, {q.lit(p)}, 1)) END" for p in K.PAYEE_PHRASES
) + ")"
# words with their flags; a name is the run of taken words before the first stop
PAYEE_SQL = f"""
pd AS (SELECT DISTINCT description AS d FROM {{source}}),
pw AS (SELECT d, p, w, upper(w) AS u, upper(w) IN {_GENERIC} OR (length(w) <= 3 AND w = upper(w) AND w <> lower(w)) AS gen,
    regexp_matches(w, '\\d') AS dig, left(w, 1) = upper(left(w, 1)) AND left(w, 1) <> lower(left(w, 1)) AS cap,
    regexp_matches(regexp_replace(w, '[.,]', '', 'g'), '^\\d+$') OR (length(w) >= 6 AND length(regexp_replace(w, '\\D', '', 'g')) * 10 >= length(w) * 7) AS code
  FROM (SELECT d, unnest(regexp_split_to_array(d, '\\s+')) AS w, generate_subscripts(regexp_split_to_array(d, '\\s+'), 1) AS p FROM pd) x),
pc AS (SELECT d, min(p) FILTER (code) AS code_at, max(p) AS n FROM pw GROUP BY d),
pm AS (SELECT pw.*, NOT gen AND NOT dig AND cap AS take, NOT gen AND NOT dig AND NOT cap AS low FROM pw JOIN pc USING (d) WHERE code_at > 4 AND p >= 4 AND p < code_at),
pmt AS (SELECT *, count_if(take) OVER v AS taken, count_if(take) OVER (PARTITION BY d ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM pm WINDOW v AS (PARTITION BY d ORDER BY p)),
pmx AS (SELECT d, min(p) FILTER (low AND before > 0) AS cut FROM pmt GROUP BY d),
pmn AS (SELECT d, string_agg(w, ' ' ORDER BY p) AS nm FROM pmt JOIN pmx USING (d) WHERE take AND taken <= 3 AND p < coalesce(cut, 1000) GROUP BY d),
ps AS (SELECT *, u IN {q.in_list(K.PAYEE_STOP_TERMS)} OR (NOT gen AND dig) AS stop, NOT gen AND NOT dig AND cap AS take, NOT gen AND NOT dig AND NOT cap AS low FROM pw WHERE p <= 5),
pst AS (SELECT *, count_if(take) OVER v AS taken, count_if(take) OVER (PARTITION BY d ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ps WINDOW v AS (PARTITION BY d ORDER BY p)),
psx AS (SELECT d, min(p) FILTER (stop OR (low AND before > 0)) AS cut FROM pst GROUP BY d),
psn AS (SELECT d, string_agg(w, ' ' ORDER BY p) AS nm FROM pst JOIN psx USING (d) WHERE take AND taken <= 3 AND p < coalesce(cut, 1000) GROUP BY d),
pe AS (SELECT d, k, string_agg(w, ' ' ORDER BY p) AS nm, bool_and(NOT gen AND NOT dig AND cap) AS ok
  FROM pw JOIN pc USING (d), (VALUES (2), (3), (4)) z(k) WHERE n >= k AND p > n - k GROUP BY d, k),
pen AS (SELECT d, arg_min(nm, k) AS nm FROM pe WHERE ok AND length(nm) BETWEEN 3 AND 99 AND NOT regexp_matches(upper(nm), 'INC|LLC|LTD|CORP|CORPORATION|CARRIER|INC\\.') GROUP BY d),
payees AS (SELECT pd.d, coalesce({_PHRASE}, CASE WHEN length(pmn.nm) BETWEEN 3 AND 99 THEN pmn.nm END, CASE WHEN length(psn.nm) BETWEEN 3 AND 99 THEN psn.nm END, pen.nm, '') AS payee
  FROM pd LEFT JOIN pmn ON pd.d = pmn.d LEFT JOIN psn ON pd.d = psn.d LEFT JOIN pen ON pd.d = pen.d)""".replace("coalesce(coalesce(", "coalesce(coalesce(").replace("regexp_extract(d,", "regexp_extract(pd.d,")

WORDY = """SELECT description FROM bank_txn UNION ALL SELECT concat('BUSINESS TO BUSINESS ACH ', description, ' STO 123456') FROM bank_txn
  UNION ALL SELECT concat('wire ref ', c_name, ' Mary Ann Jones') FROM customer"""


@query("s7_payee_from_description", "WITH wordy AS (" + WORDY + ")," + PAYEE_SQL.format(source="wordy").lstrip() + " SELECT d AS description, payee FROM payees")
def s7(i):
    d = i.sql(WORDY.replace("bank_txn", "{bank_txn}").replace("customer", "{customer}")).distinct()
    return d.select("description", payee.payee_from_description(C("description")).alias("payee"))


@query("s8_description_key", f"SELECT row_pos, {q.description_key('description')} AS k FROM bank_txn")
def s8(i):
    return per_description(i, k=tx.description_key(C("description")))


@query("s9_check_memo_key", f"SELECT row_pos, {q.check_memo_key('description')} AS k FROM bank_txn")
def s9(i):
    return per_description(i, k=tx.check_memo_key(C("description")))


@query("s10_fingerprint", f"SELECT row_pos, {q.fingerprint('date', 'description', 'credit', 'debit', 'bank', 'account_number')} AS fp FROM bank_txn_gaps")
def s10(i):
    return i.bank_txn_gaps.select("row_pos", codes.fingerprint(C("date"), C("description"), C("credit"), C("debit"), C("bank"), C("account_number")).alias("fp"))


@query("s11_generic_trigger", f"SELECT client_id, rule_pos, x, {q.is_generic('x')} AS generic FROM (SELECT client_id, rule_pos, unnest(trigger_payee_contains) AS x FROM rules) r")
def s11(i):
    return i.rules.select("client_id", "rule_pos", F.explode("trigger_payee_contains").alias("x")).withColumn("generic", tx.is_generic_trigger(C("x")))


@query("s12_generic_rule", f"SELECT client_id, rule_pos, len([x for x in trigger_payee_contains if NOT {q.is_generic('x')}]) = 0 AS generic FROM rules")
def s12(i):
    return i.rules.select("client_id", "rule_pos", tx.is_generic_rule(C("trigger_payee_contains")).alias("generic"))


@query("s13_loan_ids", f"""SELECT row_pos, array_to_string(CASE WHEN len(regexp_extract_all(description, {q.lit(K.LOAN_ID_PATTERN)}, 1)) > 0
  THEN regexp_extract_all(description, {q.lit(K.LOAN_ID_PATTERN)}, 1) ELSE regexp_extract_all(description, {q.lit(K.LOAN_DIGITS_PATTERN)}, 1) END, ',') AS ids FROM bank_txn""")
def s13(i):
    return per_description(i, ids=F.array_join(codes.loan_ids(C("description")), ","))


def _period(which: int) -> str:
    return "coalesce(" + ", ".join(
        f"CASE WHEN {long_date(f'regexp_extract(text, {q.lit(p)}, 1)')} IS NOT NULL AND {long_date(f'regexp_extract(text, {q.lit(p)}, 2)')} IS NOT NULL "
        f"THEN {long_date(f'regexp_extract(text, {q.lit(p)}, {which})')} END" for p in K.STATEMENT_PERIOD_PATTERNS
    ) + ")"


@query("s14_statement_period", f"SELECT statement_id, {_period(1)} AS start_date, {_period(2)} AS end_date, CAST(year({_period(1)}) AS INT) AS year FROM statement_text")
def s14(i):
    return i.statement_text.select("statement_id", dates.statement_period(C("text")).alias("p")).select("statement_id", "p.start_date", "p.end_date", "p.year")


@query("s15_month_day_year", """SELECT row_pos, mmdd, CAST(try_strptime(mmdd || '/' || CAST(y AS VARCHAR), '%m/%d/%Y') AS DATE) AS d
FROM (SELECT row_pos, CAST(month(date) AS VARCHAR) || '/' || CAST(day(date) + row_pos % 3 AS VARCHAR) AS mmdd, 2023 AS y FROM bank_txn) t""")
def s15(i):
    mmdd = F.concat_ws("/", F.month("date").cast("string"), (F.dayofmonth("date") + C("row_pos") % 3).cast("string"))
    return i.bank_txn.select("row_pos", mmdd.alias("mmdd")).withColumn("d", dates.month_day_date(C("mmdd"), F.lit(2023)))


def _any(words, c="t"):
    return q.any_of(c, words)


DETECT_SQL = f"""WITH l AS (SELECT statement_id, unnest(string_split(lower(text), chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM statement_text),
f AS (SELECT statement_id, {', '.join(f"bool_or({_any(words, 'line')}) AS {name}" for name, words in [('wells', K.WELLS_KEYS), ('wcard', K.WELLS_CARD_KEYS), ('wtwo', K.WELLS_SECOND_KEYS), ('bcard', K.BOA_CARD_KEYS), ('ccard', K.CHASE_CARD_KEYS)])},
  bool_or({_any(K.BOA_KEYS, 'line')}) AS boa, bool_or({_any(K.CHASE_KEYS, 'line')}) AS chase FROM l GROUP BY statement_id)
SELECT statement_id, CASE WHEN wells THEN 'Wells Fargo' WHEN boa THEN 'Bank of America' WHEN chase THEN 'Chase Bank' ELSE 'unknown' END AS bank,
  CASE WHEN wells THEN CASE WHEN wcard THEN 'credit_card' WHEN wtwo THEN 'format_02' ELSE 'format_01' END WHEN boa THEN CASE WHEN bcard THEN 'credit_card' ELSE 'format_01' END
    WHEN chase THEN CASE WHEN ccard THEN 'credit_card' ELSE 'format_01' END END AS layout FROM f"""


@query("s16_detect_bank_and_layout", DETECT_SQL)
def s16(i):
    return statements.detect_bank(statements.text_lines(i.statement_text, "statement_id", "text"))


def _bank_text(c):
    t = f"replace(upper({c}), chr(160), ' ')"
    return f"""CASE WHEN contains({t}, 'WELLS FARGO') THEN 'Wells Fargo' WHEN contains({t}, 'BMO') THEN 'BMO' WHEN contains({t}, 'JPMORGAN CHASE BANK') OR contains({t}, 'CHASE BANK') THEN 'Chase Bank'
  WHEN contains({t}, 'BANK OF AMERICA') THEN 'Bank of America' WHEN contains({t}, 'CHASE') AND contains({t}, 'CREDIT CARD STATEMENT') THEN 'Chase Credit Card'
  WHEN contains({t}, 'CREDIT CARD STATEMENT') THEN 'Credit Card' ELSE 'Unknown' END"""


BOTH_TEXTS = "SELECT CONCAT('s', CAST(statement_id AS STRING)) AS id, text FROM statement_text UNION ALL SELECT CONCAT('d', CAST(doc_id AS STRING)), text FROM documents"


def both_texts(i):
    return i.sql(BOTH_TEXTS.replace("statement_text", "{statement_text}").replace("documents", "{documents}"))


@query("s16b_bank_from_text", f"SELECT id, {_bank_text('text')} AS bank FROM ({BOTH_TEXTS}) t")
def s16b(i):
    return both_texts(i).select("id", web.bank_from_text(C("text")).alias("bank"))


@query("s16c_is_bank_statement", f"SELECT id, ({' + '.join(f'CAST(contains(lower(text), {q.lit(k)}) AS INT)' for k in K.STATEMENT_KEYWORDS)}) >= 2 AS is_statement FROM ({BOTH_TEXTS}) t")
def s16c(i):
    return both_texts(i).select("id", web.is_bank_statement(C("text")).alias("is_statement"))


DEVICE_SQL = """CASE WHEN ua = '' THEN NULL WHEN contains(ua, 'mobile') OR contains(ua, 'android') OR contains(ua, 'iphone') OR contains(ua, 'ipad')
    THEN CASE WHEN contains(ua, 'tablet') OR contains(ua, 'ipad') THEN 'Tablet' ELSE 'Mobile' END ELSE 'Desktop' END AS device,
  CASE WHEN ua = '' THEN NULL WHEN contains(ua, 'chrome') AND NOT contains(ua, 'edg') THEN 'Chrome' WHEN contains(ua, 'firefox') THEN 'Firefox'
    WHEN contains(ua, 'safari') AND NOT contains(ua, 'chrome') THEN 'Safari' WHEN contains(ua, 'edg') THEN 'Edge' ELSE 'Other' END AS browser,
  CASE WHEN ua = '' THEN NULL WHEN contains(ua, 'windows') THEN 'Windows' WHEN contains(ua, 'mac') THEN 'macOS' WHEN contains(ua, 'linux') THEN 'Linux'
    WHEN contains(ua, 'android') THEN 'Android' WHEN contains(ua, 'ios') OR contains(ua, 'iphone') OR contains(ua, 'ipad') THEN 'iOS' ELSE 'Other' END AS os"""
ADDRESS_SQL = "coalesce(trim(split_part(nullif(x_forwarded_for, ''), ',', 1)), nullif(x_real_ip, ''), host)"


@query("s17_device_info", f"SELECT event_id, {DEVICE_SQL} FROM (SELECT event_id, lower(user_agent) AS ua FROM web_event) e")
def s17(i):
    return i.web_event.select("event_id", web.device_info(C("user_agent")).alias("d")).select("event_id", "d.*")


@query("s18_client_address", f"SELECT event_id, {ADDRESS_SQL} AS ip FROM web_event")
def s18(i):
    return i.web_event.select("event_id", web.client_address(C("x_forwarded_for"), C("x_real_ip"), C("host")).alias("ip"))


def _loan_field(field: str) -> str:
    c = "text" if field == "legal_name" else "lower(text)"
    return q.strip(q.first_group(c, ["(?i)" + p for p in K.LOAN_TEXT_PATTERNS[field]]))


PAY_TEXT = "regexp_replace(regexp_replace(payment, '[\\$,\\s]', '', 'g'), '(?i)/month|/mo|/monthly', '', 'g')"
LOAN_FIELDS = [f for f in K.LOAN_TEXT_PATTERNS if f != "due_date"]


@query("s19_loan_fields", f"""WITH f AS (SELECT doc_id, {', '.join(f'{_loan_field(f)} AS {f}' for f in LOAN_FIELDS)} FROM loan_text)
SELECT doc_id, {q.squeeze('legal_name')} AS legal_name, replace(funding_provided, ',', '') AS funding_provided, annual_percentage_rate, replace(finance_charge, ',', '') AS finance_charge,
  replace(total_payment_amount, ',', '') AS total_payment_amount, regexp_extract({PAY_TEXT}, '(\\d+\\.?\\d*)', 1) AS payment, account_no, start_date FROM f""")
def s19(i):
    return rulebase.loan_fields(i.loan_text, "text")


@query("s20_due_date_with_month", """SELECT doc_id, d AS due FROM (SELECT doc_id, trim(regexp_extract(text, '(?i)(?:finance|equipment|schedule|agreement|master).*?dated\\s+([A-Za-z]+\\s+\\d{1,2},?\\s+\\d{4})', 1)) AS d1,
  trim(regexp_extract(text, '(?i)due\\s+date[:\\s]+([A-Za-z]+\\s+\\d{1,2},?\\s+\\d{4})', 1)) AS d2, coalesce(nullif(d1, ''), nullif(d2, '')) AS d FROM loan_text) t WHERE regexp_matches(d, '(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)')""")
def s20(i):
    return i.loan_text.select("doc_id", dates.loan_due_date(C("text")).alias("due")).filter("due IS NOT NULL")


@query("s21_loan_money", f"""WITH f AS (SELECT doc_id, {', '.join(f'{_loan_field(f)} AS {f}' for f in ['funding_provided', 'total_payment_amount', 'payment'])} FROM loan_text)
SELECT doc_id, {q.lenient('funding_provided')} AS funding, {q.lenient('total_payment_amount')} AS total, TRY_CAST(nullif(regexp_extract({PAY_TEXT}, '(\\d+\\.?\\d*)', 1), '') AS DECIMAL(18,2)) AS payment FROM f""")
def s21(i):
    f = {n: dates.loan_text_field(C("text"), n) for n in ["funding_provided", "total_payment_amount", "payment"]}
    return i.loan_text.select(
        "doc_id", money.lenient_amount(f["funding_provided"]).alias("funding"), money.lenient_amount(f["total_payment_amount"]).alias("total"),
        money.payment_text(f["payment"]).try_cast(money.MONEY).alias("payment"),
    )


@query("s22_control_characters", "SELECT doc_id, md5(regexp_replace(chr(7) || text || chr(31) || chr(9), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) AS h FROM documents")
def s22(i):
    noisy = F.concat(F.char(F.lit(7)), C("text"), F.char(F.lit(31)), F.lit("\t"))
    return i.documents.select("doc_id", F.md5(tx.remove_control_characters(noisy)).alias("h"))


@query("s23_rules_from_replies", """WITH o AS (SELECT client_id, chunk_no, unnest(regexp_extract_all(reply, '\\{(?:[^{}"]|"(?:[^"\\\\]|\\\\.)*"|\\{(?:[^{}"]|"(?:[^"\\\\]|\\\\.)*")*\\})*\\}')) AS obj, generate_subscripts(regexp_extract_all(reply, '\\{(?:[^{}"]|"(?:[^"\\\\]|\\\\.)*"|\\{(?:[^{}"]|"(?:[^"\\\\]|\\\\.)*")*\\})*\\}'), 1) AS p FROM model_reply)
SELECT client_id, chunk_no, CAST(p - 1 AS INT) AS reply_pos, obj ->> 'rule_id' AS rule_id, obj ->> 'account_id' AS account_id, obj ->> 'account_name' AS account_name,
  obj ->> 'category_type' AS category_type, obj ->> '$.trigger_payee_contains[0]' AS first_trigger FROM o WHERE obj ->> 'rule_id' IS NOT NULL AND obj ->> 'account_name' IS NOT NULL""")
def s23(i):
    return rulebase.rules_from_replies(i.model_reply).select(
        "client_id", "chunk_no", "reply_pos", "rule_id", "account_id", "account_name", "category_type",
        F.get("trigger_payee_contains", F.lit(0)).alias("first_trigger"),
    )


@query("s24_csv_escape", """SELECT doc_id, md5(CASE WHEN contains(t, ',') OR contains(t, '"') OR contains(t, chr(10)) THEN '"' || replace(t, '"', '""') || '"' ELSE t END) AS h
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN 'say "' || lang || '"' ELSE text END AS t FROM documents) d""")
def s24(i):
    t = F.when(C("doc_id") % 3 == 0, C("source")).when(C("doc_id") % 3 == 1, F.concat(F.lit('say "'), "lang", F.lit('"'))).otherwise(C("text"))
    return i.documents.select("doc_id", F.md5(tx.csv_escape(t)).alias("h"))


@query("s25_label_key", f"SELECT client_id, rule_pos, x, upper({q.squeeze('x')}) AS k FROM (SELECT client_id, rule_pos, unnest(trigger_payee_contains) AS x FROM rules) r")
def s25(i):
    return i.rules.select("client_id", "rule_pos", F.explode("trigger_payee_contains").alias("x")).withColumn("k", tx.label_key(C("x")))
