"""Worked examples for the column expressions."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import codes, dates, money, payee, text as tx, web
from tallyspark.operators import loans, statements


def values(spark, items, build):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(items)], "k int, v string")
    return [r.x for r in df.select("k", build(F.col("v")).alias("x")).orderBy("k").collect()]


CASES = {
    "check_number": (
        codes.check_number,
        ["Check 1234", "CHK 1234", "2550 Check", "Deposited OR Cashed Check 1234", "Check # 007", "no number", None],
        ["1234", "1234", "2550", "1234", "7", None, None],
    ),
    "check_like": (codes.is_check_like, ["Check 12", "my checkbook", "a chk b", "deposit", None], [True, True, True, False, False]),
    "vendor_code": (codes.vendor_code, ["DIRECT PAY 2013", "ACH PAYMENT CODE 3004", "VENDOR 4021", "ACH 99 1234", "plain 1234"], ["2013", "3004", "4021", "1234", None]),
    "account_id": (tx.account_id_core, ["REVENUE-4000", "COGS-5000", "EXP-6100", "5000", "expense-1", "XEXP-1", None], ["4000", "5000", "6100", "5000", "1", "XEXP-1", ""]),
    "description_key": (tx.description_key, ["CHECK # 3360", "CHECK  3360", "a-b_c"], ["check 3360", "check 3360", "a b c"]),
    "check_memo_key": (tx.check_memo_key, ["Check 3340", "CHECK # 3340", "chk 3340", "checks 1"], ["3340", "3340", "3340", "checks 1"]),
    "partition_name": (tx.partition_name, ["Blue River Trucking", "north engineering", "x-data"], ["blue-river-trucking-data", "north-engineering-data", "x-data"]),
    "type_amount": (money.type_column_amount, ["13000 CHECK_DEPOSIT", "-1148 ACH_DEBIT", "FEE"], [Decimal("13000.00"), Decimal("-1148.00"), None]),
    "ledger_amount": (money.ledger_amount, ["($1,200.50)", "-3", "", None, "x"], [Decimal("1200.50"), Decimal("-3.00"), Decimal(0), Decimal(0), Decimal(0)]),
    "accounting_amount": (money.accounting_amount, ["($1,200.50)", "−3.10", "4", "x"], [Decimal("-1200.50"), Decimal("-3.10"), Decimal("4.00"), None]),
    "payment_text": (money.payment_text, ["$1,250.50/month", "310/mo", "abc", None], ["1250.50", "310", "abc", None]),
    "check_key": (codes.check_key, [" 00 1836 ", "1836.0", "000", None], ["1836", "1836", "0", None]),
    "noise": (
        tx.strip_bank_noise,
        ["Purchase authorized on 07/01 SQ *OFFICE DEPOT 714-702-1058 CA S585 Card 2979", "Fsp*American", "PY *Homeshield", "  "],
        ["OFFICE DEPOT", "American", "Homeshield", ""],
    ),
    "payee": (
        payee.payee_from_description,
        ["BUSINESS TO BUSINESS ACH LOVES TRAVEL STO PAYMENTS 241231 100771", "TRIUMPH FINANCE Payment 241231", "Online transfer to Acme 1", "", "wire 1 Mary Jones"],
        ["LOVES TRAVEL", "TRIUMPH FINANCE", "Acme", "", "Mary Jones"],
    ),
    "bank": (web.bank_from_text, ["at WELLS FARGO", "chase bank", "Chase credit card statement", "x", None], ["Wells Fargo", "Chase Bank", "Chase Credit Card", "Unknown", "Unknown"]),
    "generic": (tx.is_generic_trigger, ["DIRECT PAY", "direct-pay", "WIRE TO ACME", "DIRECT PAY 2013", "PILOT", "PAYMENTS"], [True, True, True, False, False, False]),
    "valid_description": (statements.is_valid_description, ["ab", "fee", "one two three", "one two transfer"], [False, True, False, True]),
    "amount_before_balance": (statements.amount_before_balance, ["paid 12.50 Balance 99.10", "Balance 55.10", "x .02 y"], [Decimal("12.50"), Decimal("55.10"), Decimal("0.02")]),
    "csv": (tx.csv_escape, ["a", 'say "x"', "a,b", None], ["a", '"say ""x"""', '"a,b"', ""]),
}


@pytest.mark.parametrize("name", CASES)
def test_expression(spark, name):
    build, items, want = CASES[name]
    assert values(spark, items, build) == want


def test_dates(spark):
    got = values(spark, ["01/02/2024", "25/12/2023", "2024-3-4", "1/2/69", "13/1/24", "n/a", None], dates.parse_date)
    assert got == [dt.date(2024, 1, 2), dt.date(2023, 12, 25), dt.date(2024, 3, 4), dt.date(1969, 1, 2), dt.date(2024, 1, 13), None, None]


def test_statement_period(spark):
    got = values(spark, ["x January 1, 2024 - January 31, 2024 y", "13/40/2024 - 1/2/2024 for March 1, 2024 to March 31, 2024", "none"], dates.statement_period)
    assert (got[0].start_date, got[0].year) == (dt.date(2024, 1, 1), 2024)
    assert (got[1].start_date, got[1].end_date) == (dt.date(2024, 3, 1), dt.date(2024, 3, 31))
    assert got[2] is None


def test_loan_months_from_total_and_payment(spark):
    row = ("1", 1, "A", "500", "65000", "50000", "6%", "2024-01-15")
    df = spark.createDataFrame([row], "client_id string, loan_pos long, account_no string, payment string, total_payment_amount string, funding_provided string, annual_percentage_rate string, start_date string")
    assert loans.loan_terms(df).first().months == 130


def test_fingerprint(spark):
    import hashlib

    df = spark.createDataFrame([("2024-01-05", " pay x ", None, Decimal("12.50"), "Chase", None)], "d string, t string, c decimal(18,2), e decimal(18,2), b string, a string")
    got = df.select(codes.fingerprint(*[F.col(c) for c in "dtceba"])).first()[0]
    assert got == hashlib.sha256(b"2024-01-05|PAY X|-12.50|CHASE|").hexdigest()[:24]
