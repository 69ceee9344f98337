"""Input views (bank transactions, ledger, rules, register, loans, ...) derived from the driver tables.

Each view is one SQL text that gives the same rows in Spark and in the oracle engine; views are
written over the driver tables and over each other with ``{name}`` references. They keep every row of
the tables they are built on, so their size follows the scale factor.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# rule_pos, triggers, account_id, account_name, category_type, logic, vendor_code, ach_vendor_only
_BASE_RULES = [
    (["EQUIPMENT LOAN"], "2500", "Equipment Loan", "Liability", "loan payments", None, False),
    (["PILOT TRAVEL", "PILOT"], "EXP-6100", "Fuel", "Expense", "truck stop", None, False),
    (["LOVES TRAVEL", "PILOT TRAVEL", "PILOT"], "6100", "fuel", "Expense", "", None, False),
    (["OFFICE DEPOT", "OFFICE  DEPOT"], "6200", "Office Supplies", "Expense", "stationery", None, False),
    (["ADP"], "6300", "Payroll Taxes", "Expense", "", None, False),
    (["CHEFS TOYS"], "COGS-5000", "Kitchen Supplies", "COGS", "", None, False),
    (["CHEFS TOYS", "ADP TAX"], "5000", "Kitchen Smallwares", "COGS", "", None, False),
    (["TRIUMPH FINANCE", "TRIUMPH"], "6400", "Factoring Fees", "Expense", "", None, False),
    (["DIRECT PAY", "ACH PAYMENT"], "6500", "Misc Payments", "Expense", "generic", None, False),
    (["DEPOSIT 1-URGENT", "DEPOSIT 2-HIGH"], "REVENUE-4000", "Sales", "Revenue", "", None, False),
    (["DEPOSIT 2-HIGH", "DEPOSIT 1-URGENT"], "4000", "Sales Income", "Revenue", "", None, False),
    (["PAYMENT", "Wire"], "6510", "", "Expense", "generic", None, False),
]
RULES = (
    _BASE_RULES
    + [
        ([f"VENDOR {2000 + i}"], f"EXP-70{i:02d}", f"Vendor {2000 + i}", "Expense", "coded", str(2000 + i), True)
        for i in range(12)
    ]
    + [
        ([f"DIRECT PAY {3000 + i}"], f"71{i:02d}", f"Contractor {3000 + i}", "Expense", "coded", None, True)
        for i in range(10)
    ]
)


def _literal(value, dialect: str) -> str:
    if value is None:
        return "CAST(NULL AS STRING)"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, list):
        items = ", ".join(_literal(v, dialect) for v in value)
        return f"array({items})" if dialect == "spark" else f"[{items}]"
    return "'" + str(value).replace("'", "''") + "'"


def _rules_sql(dialect: str) -> str:
    rows = [
        ", ".join(_literal(v, dialect) for v in (pos, *rule))
        for pos, rule in enumerate(RULES)
    ]
    names = (
        "rule_pos, trigger_payee_contains, account_id, account_name, category_type, logic, "
        "vendor_code, ach_vendor_only"
    )
    if dialect == "spark":
        source = "{nation} LATERAL VIEW inline(array(" + ", ".join(f"struct({r})" for r in rows) + f")) r AS {names}"
    else:
        source = "{nation}, (VALUES " + ", ".join(f"({r})" for r in rows) + f") AS r({names})"
    return f"""
SELECT n_nationkey AS client_id, CAST(rule_pos AS INT) AS rule_pos,
  concat('C', CAST(n_nationkey AS STRING), '-R', CAST(rule_pos AS STRING)) AS rule_id,
  trigger_payee_contains, account_id, account_name, category_type, logic, vendor_code, ach_vendor_only
FROM {source}
WHERE NOT (n_nationkey % 5 = 0 AND rule_pos >= 24)"""


_AMOUNT_TEXT = """CASE WHEN {x} >= 1000 THEN concat(CAST(CAST(floor({x} / 1000) AS BIGINT) AS STRING), ',',
    substr(lpad(CAST({x} AS STRING), 14, '0'), 9, 6)) ELSE CAST({x} AS STRING) END"""


def _amount_text(column: str) -> str:
    return _AMOUNT_TEXT.replace("{x}", column)


_MMDD = "concat(lpad(CAST(month({d}) AS STRING), 2, '0'), '/', lpad(CAST(day({d}) AS STRING), 2, '0'))"
_MDY = "concat(" + _MMDD + ", '/', CAST(year({d}) AS STRING))"


def _mmdd(column: str) -> str:
    return _MMDD.replace("{d}", column)


def _mdy(column: str) -> str:
    return _MDY.replace("{d}", column)


_MERCHANT = """CASE CAST(o_custkey % 6 AS INT) WHEN 0 THEN 'PILOT TRAVEL' WHEN 1 THEN 'OFFICE DEPOT'
    WHEN 2 THEN 'ADP TAX' WHEN 3 THEN 'CHEFS TOYS' WHEN 4 THEN 'LOVES TRAVEL' ELSE 'TRIUMPH FINANCE' END"""

VIEWS: dict[str, str] = {}

VIEWS["bank_txn"] = f"""
SELECT o_orderkey AS row_pos, c_nationkey AS client_id, CAST(o_orderdate AS DATE) AS date,
  CASE CAST(o_orderkey % 10 AS INT)
    WHEN 0 THEN concat('Purchase authorized on 07/01 SQ *', m, ' 714-702-1058 CA S585 Card 2979')
    WHEN 1 THEN concat('Check # ', CAST(1000 + o_orderkey % 500 AS STRING))
    WHEN 2 THEN concat('ACH DEBIT VENDOR PAYMENT ', CAST(2000 + c_custkey % 40 AS STRING))
    WHEN 3 THEN concat('DIRECT PAY ', CAST(3000 + c_custkey % 20 AS STRING))
    WHEN 4 THEN concat(m, ' PAYMENT 241231 100771')
    WHEN 5 THEN concat('EQUIPMENT LOAN CO ID:AC', CAST(10000 + c_custkey % 100 AS STRING))
    WHEN 6 THEN concat('Online transfer to ', m)
    WHEN 7 THEN replace(m, ' ', '')
    WHEN 8 THEN concat('DEPOSIT ', o_orderpriority)
    ELSE concat('CHK 00', CAST(1000 + o_orderkey % 500 AS STRING)) END AS description,
  CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS credit,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS debit,
  CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'Wells Fargo' WHEN 1 THEN 'Chase Bank'
    ELSE 'Bank of America' END AS bank,
  CASE WHEN c_custkey % 7 <> 0 THEN CAST(1000 + c_custkey % 5 AS STRING) END AS account_number,
  CASE WHEN o_orderkey % 10 = 8 AND c_custkey % 4 = 0 THEN 'Office Depot Store' END AS payee_name
FROM (SELECT *, {_MERCHANT} AS m FROM {{orders}}) o JOIN {{customer}} ON o_custkey = c_custkey"""

# raw rows with gaps: blank dates, memos and amounts, for the standardising step
VIEWS["bank_txn_gaps"] = """
SELECT row_pos, client_id,
  CASE WHEN row_pos % 17 = 0 THEN NULL ELSE date END AS date,
  CASE WHEN row_pos % 34 = 0 THEN NULL ELSE date_add_days END AS post_date,
  CASE WHEN row_pos % 19 = 0 THEN '   ' ELSE concat(' ', description, ' ') END AS description,
  CASE WHEN row_pos % 23 = 0 THEN NULL ELSE credit END AS credit,
  CASE WHEN row_pos % 23 = 0 THEN NULL ELSE debit END AS debit,
  bank, account_number, payee_name
FROM (SELECT *, date AS date_add_days FROM {bank_txn}) t"""

VIEWS["gl_entry"] = """
SELECT l_orderkey * 10 + n AS row_pos, CAST(l_suppkey % 25 AS INT) AS client_id, CAST(l_shipdate AS DATE) AS date,
  CASE WHEN l_linenumber = 7 THEN '' ELSE p_brand END AS name, p_name AS memo, p_type AS category,
  CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS debit,
  CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS credit
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS n FROM {lineitem}) l
  JOIN {part} ON l_partkey = p_partkey"""

# a rule for every part and texts that name parts: triggers of a client grow with the data
VIEWS["part_rules"] = """
SELECT CAST(p_partkey % 25 AS INT) AS client_id, CAST(p_partkey AS INT) AS rule_pos, concat('P', CAST(p_partkey AS STRING)) AS rule_id,
  split(concat(p_name, ' lot ', CAST(p_partkey AS STRING), ';', p_brand, ' ', CAST(p_partkey AS STRING)), ';') AS trigger_payee_contains,
  CAST(p_partkey AS STRING) AS account_id, concat('Goods ', CAST(p_partkey AS STRING)) AS account_name, p_type AS category_type,
  '' AS logic, CAST(NULL AS STRING) AS vendor_code, p_partkey % 9 = 0 AS ach_vendor_only
FROM {part}"""
VIEWS["part_text"] = """
SELECT CAST(p_partkey % 25 AS INT) AS client_id,
  CASE CAST(l_linenumber % 4 AS INT)
    WHEN 0 THEN concat('Invoice ', CAST(l_linenumber AS STRING), ' ', p_name, ' lot ', CAST(p_partkey AS STRING))
    WHEN 1 THEN concat('ACH DEBIT VENDOR PAYMENT ', p_brand, CAST(p_partkey AS STRING))
    WHEN 2 THEN concat(p_name, ' ', CAST(p_partkey AS STRING), ' LOT')
    ELSE CAST(p_partkey AS STRING) END AS description,
  CASE WHEN l_returnflag = 'R' THEN p_type END AS payee_name
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""

# ledger export as text, with signs, separators and blanks
VIEWS["gl_raw"] = f"""
SELECT row_pos, client_id,
  CASE CAST(row_pos % 3 AS INT) WHEN 0 THEN {_mdy('date')} WHEN 1 THEN CAST(date AS STRING)
    ELSE concat('Q', CAST(row_pos % 4 + 1 AS STRING)) END AS date,
  concat(' ', name) AS name, CASE WHEN row_pos % 29 = 0 THEN ' ' ELSE concat(memo, ' ') END AS memo,
  CASE WHEN row_pos % 31 = 0 THEN NULL ELSE category END AS split,
  CASE WHEN row_pos % 37 = 0 THEN '0' WHEN debit IS NOT NULL THEN concat('($', {_amount_text('debit')}, ')') END AS debit,
  CASE WHEN row_pos % 37 = 0 THEN '' WHEN credit IS NOT NULL THEN concat('$', {_amount_text('credit')}) END AS credit,
  CASE WHEN debit IS NOT NULL THEN concat('-', {_amount_text('debit')})
    WHEN credit IS NOT NULL THEN {_amount_text('credit')} END AS amount
FROM {{gl_entry}}"""

VIEWS["bank_export"] = f"""
SELECT row_pos, client_id,
  CASE WHEN row_pos % 41 = 0 THEN '' ELSE {_mdy('date')} END AS date_text,
  CASE WHEN row_pos % 43 = 0 THEN NULL ELSE description END AS description,
  CASE WHEN row_pos % 3 = 0 THEN concat(CASE WHEN credit IS NULL THEN '-' ELSE '' END,
      CAST(coalesce(credit, debit) AS STRING), ' ACH_ENTRY') WHEN row_pos % 3 = 1 THEN 'FEE' END AS type_text,
  CASE WHEN row_pos % 3 <> 2 THEN {_amount_text('credit')} END AS credit_text,
  CASE WHEN row_pos % 3 <> 2 THEN '$' || {_amount_text('debit')} END AS debit_text,
  concat(CASE WHEN credit IS NULL THEN '-' ELSE '' END,
    CASE WHEN row_pos % 47 = 0 THEN '0.00' ELSE CAST(coalesce(credit, debit) AS STRING) END) AS amount_text,
  CASE WHEN row_pos % 10 = 1 THEN CAST(1000 + row_pos % 500 AS STRING) END AS cheque_no,
  account_number, bank
FROM {{bank_txn}}"""

VIEWS["check_register"] = """
SELECT CAST(p_partkey AS BIGINT) AS row_pos, CAST(p_size % 20 AS INT) AS client_id,
  concat(' 00', CAST(1000 + p_partkey % 500 AS STRING)) AS check_number,
  CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'PILOT TRAVEL' WHEN 1 THEN 'OFFICE DEPOT' WHEN 2 THEN 'ADP TAX'
    WHEN 3 THEN 'CHEFS TOYS' WHEN 4 THEN 'Unknown Person' ELSE NULL END AS payee_name,
  CASE WHEN p_size % 2 = 0 AND p_partkey % 3 = 0 THEN p_type END AS category,
  CASE WHEN p_size % 3 = 0 THEN 'Triumph finance fee' WHEN p_size % 3 = 1 THEN 'no such words' END AS memo,
  CASE WHEN p_size % 4 = 0 THEN 'COGS' END AS type,
  CASE WHEN p_size % 4 = 0 THEN CAST(p_size AS STRING) END AS split_amount
FROM {part}"""

VIEWS["client_loans"] = """
SELECT CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey, o_orderkey) AS BIGINT) AS loan_pos,
  c_nationkey AS client_id, c_name AS legal_name,
  concat('$', CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 40 AS STRING)) AS funding_provided,
  '6.5%' AS annual_percentage_rate, CAST(NULL AS STRING) AS finance_charge,
  CASE WHEN c_custkey % 5 = 0 THEN '0' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 48 AS STRING) END AS total_payment_amount,
  CASE WHEN o_orderkey % 10 = 5 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS payment,
  concat('AC', CAST(10000 + c_custkey % 100 AS STRING), CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '-1' END) AS account_no,
  CASE WHEN o_orderkey % 20 = 5 THEN CAST(make_date(CAST(year(o_orderdate) AS INT) - 1, CAST(month(o_orderdate) AS INT), 1) AS STRING)
    ELSE CAST(make_date(CAST(year(o_orderdate) AS INT) - 9, CAST(month(o_orderdate) AS INT), 1) AS STRING) END AS start_date
FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""

VIEWS["coa"] = """
SELECT client_id, account, account_id, min(coa_pos) AS coa_pos FROM (
  SELECT CAST(p_size % 25 AS INT) AS client_id, concat(' ', p_type, '  items ') AS account, CAST(length(p_type) AS STRING) AS account_id,
    CAST(p_partkey % 1000 AS INT) AS coa_pos FROM {part}
  UNION ALL
  SELECT client_id, account_name AS account, account_id, rule_pos AS coa_pos FROM {rules}
  WHERE account_name <> 'Factoring Fees' AND account_name <> ''
) c GROUP BY client_id, account, account_id"""

VIEWS["ledger_vectors"] = """
SELECT vec_id, CAST(vec_id % 5 AS INT) AS client_id, {shifted} AS embedding,
  coalesce(p_name, concat('item ', CAST(vec_id % 50 AS STRING))) AS memo,
  coalesce(p_brand, concat('Brand ', CAST(vec_id % 20 AS STRING))) AS name,
  CASE WHEN vec_id % 13 = 0 THEN '' ELSE coalesce(p_type, 'STANDARD') END AS category,
  CASE WHEN vec_id % 17 = 0 THEN NULL
    ELSE make_date(2023 + CAST(vec_id % 2 AS INT), 1 + CAST(vec_id % 12 AS INT), 1 + CAST(vec_id % 28 AS INT)) END AS date,
  CAST(10 * (1 + vec_id % 7) AS DECIMAL(18,2)) AS amount
FROM {embeddings} LEFT JOIN {part} ON p_partkey = vec_id"""

VIEWS["query_vectors"] = """
SELECT v.vec_id AS txn_id, v.client_id, v.embedding, coalesce(n.embedding, v.embedding) AS name_embedding,
  CASE WHEN v.vec_id % 6 = 0 THEN upper(v.memo) WHEN v.vec_id % 6 = 1 THEN concat('ACH DEBIT ', v.memo, ' 123456')
    WHEN v.vec_id % 12 = 2 THEN concat('Payment to ', v.name, ' Unknown') WHEN v.vec_id % 6 = 2 THEN concat('Payment to ', v.name) ELSE v.memo END AS memo,
  CASE WHEN v.vec_id % 2 = 0 THEN v.amount ELSE -v.amount END AS amount,
  v.vec_id % 11 = 0 AS is_check, CASE WHEN v.vec_id % 11 = 0 THEN upper(v.name) ELSE '' END AS payee
FROM {ledger_vectors} v LEFT JOIN {ledger_vectors} n ON n.vec_id = v.vec_id + 5"""

VIEWS["model_proposal"] = """
SELECT client_id, description,
  CASE WHEN min(row_pos) % 3 = 0 THEN 'office' WHEN min(row_pos) % 3 = 1 THEN 'Fuel' ELSE 'No such account' END AS account_name,
  CASE WHEN min(row_pos) % 5 = 0 THEN '6400' END AS account_id,
  CASE WHEN min(row_pos) % 7 = 0 THEN concat('C', CAST(client_id AS STRING), '-R4') END AS rule_id,
  CAST((min(row_pos) % 12) AS DOUBLE) / 10 AS confidence
FROM {bank_txn} GROUP BY client_id, description"""

VIEWS["rule_change"] = """
SELECT client_id, rule_pos, rule_id,
  CASE rule_pos % 4 WHEN 1 THEN 'update' WHEN 2 THEN 'delete' WHEN 3 THEN 'insert' ELSE 'none' END AS op,
  CASE WHEN rule_pos % 8 = 1 THEN trigger_payee_contains END AS trigger_payee_contains,
  CASE WHEN rule_pos % 3 = 0 THEN '  ' ELSE concat('9', account_id) END AS account_id,
  CASE WHEN rule_pos % 6 = 5 THEN '' ELSE concat(' New ', account_name, ' ') END AS account_name,
  CASE WHEN rule_pos % 5 = 0 THEN 'COGS' END AS category_type, CAST(NULL AS STRING) AS logic,
  vendor_code, CASE WHEN rule_pos % 2 = 1 THEN true END AS ach_vendor_only, CAST(rule_pos AS BIGINT) AS changed_at
FROM {rules} WHERE rule_pos % 4 > 0"""

VIEWS["web_event"] = """
SELECT event_id, ts AS created_at, CAST(user_id AS STRING) AS user_id, user_id % 25 AS client_id,
  event_type, CASE WHEN value > 100 THEN 'failed' WHEN value > 50 THEN 'error' ELSE 'success' END AS status, props,
  CASE CAST(event_id % 7 AS INT)
    WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0 Safari/537.36'
    WHEN 1 THEN 'Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36 Edg/120.0'
    WHEN 2 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Version/17.0 Mobile Safari/604.1'
    WHEN 3 THEN 'Mozilla/5.0 (X11; Linux x86_64; rv:109.0) Gecko/20100101 Firefox/119.0'
    WHEN 4 THEN 'Mozilla/5.0 (iPad; CPU OS 16_0) Version/16.0 Safari/604.1'
    WHEN 5 THEN 'Dalvik/2.1.0 (Android 13; Pixel) Mobile' ELSE '' END AS user_agent,
  CASE WHEN event_id % 3 = 0 THEN concat('10.0.0.', CAST(event_id % 256 AS STRING), ' , 10.1.1.1') END AS x_forwarded_for,
  CASE WHEN event_id % 3 = 1 THEN concat('10.2.0.', CAST(event_id % 256 AS STRING)) END AS x_real_ip,
  CASE WHEN event_id % 5 > 0 THEN '127.0.0.1' END AS host
FROM {events}"""

_STATEMENT_BASE = """(SELECT row_pos, CAST(floor(row_pos / 100) AS BIGINT) AS statement_id,
    CAST(floor((row_pos % 100) / 25) AS INT) AS page_no, date, description, coalesce(credit, debit) AS amount,
    credit IS NULL AS is_debit, bank, account_number, client_id, CAST(floor(row_pos / 20) % 3 AS INT) AS sect FROM {bank_txn}) b"""

# block layout: date line, text lines, amount line; section headers, page furniture, totals, ledger end
VIEWS["statement_block"] = f"""
SELECT statement_id, page_no, row_pos * 10 + k AS line_no, text FROM (
  SELECT statement_id, page_no, row_pos, 0 AS k, CASE sect WHEN 0 THEN 'Credits' WHEN 1 THEN 'Debits' ELSE 'Checks paid' END AS text
    FROM {_STATEMENT_BASE} WHERE row_pos % 20 = 0
  UNION ALL SELECT statement_id, page_no, row_pos, 1, concat('Account number: ', CAST(100000 + client_id AS STRING))
    FROM {_STATEMENT_BASE} WHERE row_pos % 50 = 0
  UNION ALL SELECT statement_id, page_no, row_pos, 2, 'Page 1 of 3' FROM {_STATEMENT_BASE} WHERE row_pos % 25 = 7
  UNION ALL SELECT statement_id, page_no, row_pos, 3, CASE WHEN sect = 2 THEN CAST(1000 + row_pos % 500 AS STRING) ELSE {_mmdd('date')} END
    FROM {_STATEMENT_BASE}
  UNION ALL SELECT statement_id, page_no, row_pos, 4, CASE WHEN sect = 2 THEN {_mmdd('date')} ELSE description END FROM {_STATEMENT_BASE}
  UNION ALL SELECT statement_id, page_no, row_pos, 5, concat('ref ', CAST(row_pos AS STRING)) FROM {_STATEMENT_BASE} WHERE row_pos % 4 = 1 AND sect <> 2
  UNION ALL SELECT statement_id, page_no, row_pos, 6, {_amount_text('amount')} FROM {_STATEMENT_BASE}
  UNION ALL SELECT statement_id, page_no, row_pos, 7, '' FROM {_STATEMENT_BASE} WHERE row_pos % 9 = 0
  UNION ALL SELECT statement_id, page_no, row_pos, 8, 'Total credits' FROM {_STATEMENT_BASE} WHERE row_pos % 20 = 19
  UNION ALL SELECT statement_id, page_no, row_pos, 9, 'Daily Ledger Balance Summary' FROM {_STATEMENT_BASE} WHERE row_pos % 100 = 94
) s"""

# inline layout: one line per row with continuation lines
VIEWS["statement_inline"] = f"""
SELECT statement_id, page_no, row_pos * 10 + k AS line_no, text FROM (
  SELECT statement_id, page_no, row_pos, 0 AS k, CASE sect WHEN 0 THEN 'Credits' ELSE 'Debits' END AS text
    FROM {_STATEMENT_BASE} WHERE row_pos % 20 = 0
  UNION ALL SELECT statement_id, page_no, row_pos, 2, concat({_mmdd('date')},
      CASE WHEN row_pos % 5 = 0 THEN concat(' ', {_mmdd('date')}) ELSE '' END, ' ', {_amount_text('amount')}, ' ', description)
    FROM {_STATEMENT_BASE}
  UNION ALL SELECT statement_id, page_no, row_pos, 3, concat('cont ', bank) FROM {_STATEMENT_BASE} WHERE row_pos % 6 = 0
  UNION ALL SELECT statement_id, page_no, row_pos, 4, 'All rights reserved' FROM {_STATEMENT_BASE} WHERE row_pos % 30 = 3
  UNION ALL SELECT statement_id, page_no, row_pos, 5, concat('more ', CAST(row_pos % 7 AS STRING)) FROM {_STATEMENT_BASE} WHERE row_pos % 12 = 0
) s"""

# table layout: date text amounts (3, 2 or 1), with continuation lines
VIEWS["statement_table"] = f"""
SELECT statement_id, page_no, row_pos * 10 + k AS line_no, text FROM (
  SELECT statement_id, page_no, row_pos, 0 AS k, concat({_mmdd('date')}, ' ', description, ' ',
      CASE WHEN row_pos % 3 = 0 THEN concat({_amount_text('amount')}, ' 0.00 12.50')
        WHEN row_pos % 3 = 1 THEN concat({_amount_text('amount')}, ' 99.10') ELSE {_amount_text('amount')} END) AS text
    FROM {_STATEMENT_BASE}
  UNION ALL SELECT statement_id, page_no, row_pos, 3, concat('store ', CAST(row_pos % 11 AS STRING)) FROM {_STATEMENT_BASE} WHERE row_pos % 6 = 0
) s"""

# trailing amounts: date text amount
VIEWS["statement_trailing"] = f"""
SELECT statement_id, page_no, row_pos * 10 + k AS line_no, text FROM (
  SELECT statement_id, page_no, row_pos, 0 AS k, concat({_mmdd('date')}, ' ', description, ' ',
      CASE WHEN is_debit THEN '-' ELSE '' END, {_amount_text('amount')}) AS text FROM {_STATEMENT_BASE}
  UNION ALL SELECT statement_id, page_no, row_pos, 3, concat('store ', CAST(row_pos % 11 AS STRING)) FROM {_STATEMENT_BASE} WHERE row_pos % 6 = 0
) s"""

VIEWS["balance_line"] = f"""
SELECT statement_id, line_no, concat(left_text, ' ', right_text) AS text FROM (
  SELECT statement_id, row_pos AS line_no, concat({_mmdd('date')}, ' ', {_amount_text('amount')}) AS left_text,
    CASE WHEN row_pos % 3 = 0 THEN concat({_mmdd('date')}, ' ', {_amount_text('amount')}) ELSE 'end' END AS right_text
  FROM {_STATEMENT_BASE}) s"""

VIEWS["statement_text"] = f"""
SELECT c_custkey AS statement_id, c_nationkey AS client_id, concat(
  CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN 'Wells Fargo Bank, N.A.' WHEN 1 THEN 'JPMorgan Chase Bank statement'
    WHEN 2 THEN 'Bank of America, N.A.' WHEN 3 THEN 'BMO Harris Bank' WHEN 4 THEN 'Chase card. Credit card statement'
    ELSE 'Community Union' END, chr(10),
  CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'January 1, 2024 - January 31, 2024' WHEN 1 THEN 'Feb 1, 2024 - Feb 29, 2024'
    WHEN 2 THEN '1/2/2024 - 01/31/2024' WHEN 3 THEN 'for March 1, 2024 to March 31, 2024' ELSE 'no period' END, chr(10),
  CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN 'Minimum payment due' WHEN 1 THEN 'Primary account number' WHEN 2 THEN 'Business checking'
    WHEN 3 THEN 'Late fee warning' WHEN 4 THEN 'Account summary and deposits' ELSE 'Opening balance 10.00' END) AS text
FROM {{customer}}"""

VIEWS["loan_text"] = f"""
SELECT c_custkey AS doc_id, concat('Legal Name: ', replace(c_name, '#', ' '), chr(10), 'Funding provided: $', CAST(CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS STRING), chr(10),
  CASE WHEN c_custkey % 3 = 0 THEN 'APR: 7.25 %' ELSE 'Annual Percentage Rate 6.5%' END, chr(10),
  CASE WHEN c_custkey % 4 = 0 THEN 'Monthly payment: $1,250.50/month' WHEN c_custkey % 4 = 1 THEN 'Payment 310' ELSE 'none' END, chr(10),
  'Total of payments: $12,000.00', chr(10), 'Account Number: ', CAST(10000 + c_custkey % 100 AS STRING), '-X', chr(10),
  CASE WHEN c_custkey % 5 = 0 THEN 'Finance Agreement dated July 29, 2025' WHEN c_custkey % 5 = 1 THEN 'Due date: March 3 2024'
    WHEN c_custkey % 5 = 2 THEN 'Due date: 04/05/2024' ELSE 'start date: 3/4/2024' END, chr(10)) AS text
FROM {{customer}}"""

VIEWS["model_reply"] = """
SELECT client_id, chunk_no, CASE CAST(client_id % 3 AS INT)
    WHEN 0 THEN concat('```json', chr(10), '[', body, ']', chr(10), '```')
    WHEN 1 THEN concat('Here it is: [', body, '] done')
    ELSE concat('[', body, ', ', chr(123), '"rule_id": "cut", "account_na') END AS reply
FROM (SELECT client_id, CAST(floor(rule_pos / 8) AS INT) AS chunk_no,
    concat(min(CASE WHEN rule_pos % 8 = 0 THEN obj END), ', ', coalesce(min(CASE WHEN rule_pos % 8 = 3 THEN obj END), min(obj))) AS body
  FROM (SELECT client_id, rule_pos, concat(chr(123), '"rule_id": "', rule_id, '", "trigger_payee_contains": ["', trigger_payee_contains[{first}], '"], "account_id": "',
      account_id, '", "account_name": "', account_name, '", "category_type": "', category_type, '", "logic": "use ', chr(123), 'code', chr(125), '"', CASE WHEN rule_pos % 3 = 0 THEN concat(', "meta": ', chr(123), '"k": "', chr(125), '"', chr(125)) ELSE '' END, chr(125)) AS obj FROM {rules}) o
  GROUP BY client_id, CAST(floor(rule_pos / 8) AS INT)) b"""

VIEWS["doc_page"] = """
SELECT p.page_id, CAST(floor(p.page_id / 10) AS BIGINT) AS statement_id, CAST(p.page_id % 10 AS INT) AS page_no,
  CASE CAST(p.page_id % 10 AS INT) WHEN 2 THEN concat('Transaction history ', p.html)
    WHEN 3 THEN concat('01/05 $1,200.00 ', p.html) WHEN 4 THEN concat('row 12/31 44.10 ', p.html)
    WHEN 5 THEN 'Account summary' WHEN 6 THEN concat('99.99 ', p.html) WHEN 8 THEN concat('Account Activity ', p.html) ELSE p.html END AS text
FROM {pages} p"""


def view_sql(name: str, dialect: str) -> str:
    text = _rules_sql(dialect) if name == "rules" else VIEWS[name]
    # the driver's vectors are far apart; a shift by label brings some of them above the high-score limit
    shift = "CAST(x AS DOUBLE) + CAST(0.15 AS DOUBLE) + CAST(0.05 AS DOUBLE) * (label % 4)"
    shifted = f"transform(embedding, x -> {shift})" if dialect == "spark" else f"[{shift} for x in embedding]"
    return text.replace("{first}", "0" if dialect == "spark" else "1").replace("{shifted}", shifted)


def references(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z_]+)\}", text)))


VIEW_NAMES = ["rules", *VIEWS]


class Inputs:
    """Lazy access to the driver tables and the derived views for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in TABLES:
                self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self._cache[name] = self.sql(view_sql(name, "spark"))
        return self._cache[name]

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Run a view text with ``{name}`` bound to tables, views or the frames given."""
        bound = {n: frames[n] if n in frames else self.get(n) for n in references(text)}
        return self.spark.sql(text, **bound) if bound else self.spark.sql(text)


def oracle_cte(text: str) -> str:
    """The oracle SQL with the views it names placed in front as common table expressions."""
    needed: dict[str, str] = {}

    def add(name: str) -> None:
        if name in TABLES or name in needed:
            return
        body = view_sql(name, "oracle")
        for inner in references(body):
            add(inner)
        needed[name] = re.sub(r"\{([a-z_]+)\}", r"\1", body)

    for word in dict.fromkeys(re.findall(r"[a-z_]+", text)):
        if word in VIEW_NAMES:
            add(word)
    text = text.strip()
    own = ""
    match = re.match(r"(?is)^with\s+(recursive\s+)?", text)
    if match:
        own, text = ",\n", text[match.end():]
    ctes = ",\n".join(f"{name} AS ({body})" for name, body in needed.items())
    if not ctes:
        return ("WITH RECURSIVE " + text) if match else text
    return f"WITH RECURSIVE {ctes}{own if own else chr(10)}{text}"
