"""Amounts: text to decimal, sign handling, polarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark import constants as K
from tallyspark.functions.text import contains_any, strip

MONEY = "decimal(18,2)"


def lenient_amount(c: Column) -> Column:
    """Number without `,` and `$`; blank or unreadable text gives null."""
    return F.translate(c, ",$", "").try_cast(MONEY)


def ledger_amount(c: Column) -> Column:
    """Ledger number; parentheses are dropped and do not negate; unreadable text is zero."""
    return F.coalesce(F.translate(c, ",$()", "").try_cast(MONEY), F.lit(0).cast(MONEY))


def accounting_amount(c: Column) -> Column:
    """Number in accounting notation: parentheses or a Unicode minus negate."""
    s = strip(F.replace(F.regexp_replace(c, "[$,]", ""), F.lit("−"), F.lit("-")))
    bracketed = s.startswith("(") & s.endswith(")")
    value = F.regexp_replace(s, r"^\((.*)\)$", "$1").try_cast(MONEY)
    return F.when(bracketed, -F.abs(value)).otherwise(value)


def digits_amount(c: Column) -> Column:
    """Money text of an extraction: only digits and dot count."""
    return F.regexp_replace(c, r"[^\d.]", "").try_cast(MONEY)


def type_column_amount(c: Column) -> Column:
    """Signed amount in front of a type text such as `-1148 ACH_DEBIT`."""
    return F.regexp_extract(c, r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast(MONEY)


def payment_text(c: Column) -> Column:
    """Numeric part of a payment text such as `$1,250.50/month`."""
    s = F.regexp_replace(F.regexp_replace(c, r"[\$,\s]", ""), r"(?i)/month|/mo|/monthly", "")
    number = F.regexp_extract(s, r"(\d+\.?\d*)", 1)
    return F.nullif(F.when(number != "", number).otherwise(s), F.lit(""))


def credit_part(signed: Column) -> Column:
    return F.when(signed >= 0, signed)


def debit_part(signed: Column) -> Column:
    return F.when(signed < 0, -signed)


def nonzero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast(MONEY)) != 0


def signed_amount(credit: Column, debit: Column) -> Column:
    """Credit, else minus debit; a zero side counts as absent."""
    return (
        F.when(nonzero(credit), credit).when(nonzero(debit), -debit).otherwise(F.lit(0)).cast(MONEY)
    )


def card_is_credit(description: Column, amount: Column) -> Column:
    """Card polarity: wording first, else the sign."""
    d = F.lower(description)
    return (
        F.when(contains_any(d, K.CARD_CREDIT_WORDS), F.lit(True))
        .when(contains_any(d, K.CARD_DEBIT_WORDS), F.lit(False))
        .otherwise(amount >= 0)
    )


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with two decimals, computed on integers so that ties never depend on floats."""
    part, whole = part.cast("bigint"), whole.cast("bigint")
    hundredths = F.floor((part * 20000 + whole) / F.nullif(whole * 2, F.lit(0)))
    return F.coalesce(hundredths.cast("double") / 100, F.lit(0.0))
