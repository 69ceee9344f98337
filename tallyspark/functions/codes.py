"""Check numbers, ACH vendor codes, loan IDs and transaction fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark import constants as K
from tallyspark.functions.money import signed_amount
from tallyspark.functions.text import contains_any, first_group, strip


def _drop_zeros(c: Column) -> Column:
    stripped = F.regexp_replace(c, "^0+", "")
    return F.when(c.isNull(), None).when(stripped == "", "0").otherwise(stripped)


def check_key(c: Column) -> Column:
    """Check number as join key: no blanks, no leading zeros, no `.0` of a number read as float."""
    return _drop_zeros(F.regexp_replace(F.replace(strip(c.cast("string")), F.lit(" "), F.lit("")), r"\.0$", ""))


def check_number(description: Column) -> Column:
    return _drop_zeros(first_group(description, K.CHECK_NUMBER_PATTERNS))


def is_check_like(description: Column) -> Column:
    d = F.lower(strip(description))
    worded = d.contains("check") | d.startswith("chk ") | d.contains(" chk ") | d.endswith(" chk")
    return F.coalesce(check_number(description).isNotNull() | worded, F.lit(False))


def legacy_check_number(given: Column, description: Column) -> Column:
    """A given check number first, else the number after check, chk or ck."""
    found = F.nullif(F.regexp_extract(description, K.LEGACY_CHECK_PATTERN, 1), F.lit(""))
    return check_key(F.coalesce(F.nullif(strip(given), F.lit("")), found))


def is_ach_payment(description: Column) -> Column:
    d = F.upper(F.coalesce(description, F.lit("")))
    return contains_any(d, K.ACH_WORDS) & contains_any(d, K.ACH_PAYMENT_HINTS)


def vendor_code(description: Column) -> Column:
    """Four-digit vendor code: explicit wording first, else the first four-digit token of an ACH row."""
    d = F.upper(description)
    fallback = F.when(contains_any(d, K.ACH_WORDS), F.nullif(F.regexp_extract(d, K.FOUR_DIGITS, 1), F.lit("")))
    return F.coalesce(first_group(d, K.VENDOR_CODE_PATTERNS), fallback)


def ach_vendor_code(description: Column) -> Column:
    return F.when(is_ach_payment(description), vendor_code(description))


def loan_ids(memo: Column) -> Column:
    """All `ID:xxx` tokens, else all runs of four or more digits."""
    tagged = F.regexp_extract_all(memo, F.lit(K.LOAN_ID_PATTERN), 1)
    return F.when(F.size(tagged) > 0, tagged).otherwise(F.regexp_extract_all(memo, F.lit(K.LOAN_DIGITS_PATTERN), 1))


def fingerprint(date: Column, description: Column, credit: Column, debit: Column, bank: Column, account: Column) -> Column:
    """Stable key of a transaction row."""

    def text(c: Column) -> Column:
        return F.upper(strip(F.coalesce(c.cast("string"), F.lit(""))))

    raw = F.concat_ws(
        "|", strip(F.coalesce(date.cast("string"), F.lit(""))), text(description),
        signed_amount(credit, debit).cast("string"), text(bank), text(account),
    )
    return F.substring(F.sha2(raw, 256), 1, 24)
