"""Text keys, noise removal and small text tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark import constants as K


def strip(c: Column) -> Column:
    """Trim white space of every kind, not only blanks."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def missing_to_null(c: Column) -> Column:
    """Trimmed text, or null for the words that stand for a missing value."""
    trimmed = strip(c)
    return F.when(~F.lower(trimmed).isin(K.MISSING_WORDS), trimmed)


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def first_group(c: Column, patterns: list[str], group: int = 1) -> Column:
    """The first non-empty match of the patterns, tried in order."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, group), F.lit("")) for p in patterns])


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def strip_bank_noise(c: Column) -> Column:
    """The core payee wording of a bank description."""
    s = strip(c)
    s = strip(F.regexp_replace(s, "(?i)^(" + "|".join(K.NOISE_PREFIXES) + ")", ""))
    s = F.regexp_replace(s, K.NOISE_DATE, "")
    s = F.regexp_replace(s, K.NOISE_STARS, " ")
    s = strip(F.regexp_replace(s, K.NOISE_PROCESSOR, ""))
    s = F.regexp_replace(s, K.NOISE_PHONE, " ")
    s = F.regexp_replace(s, K.NOISE_CARD_STATE, " ")
    s = F.regexp_replace(s, K.NOISE_CARD, " ")
    return F.coalesce(strip(s), F.lit(""))


def description_key(c: Column) -> Column:
    """Case, separator and space insensitive key of a description."""
    return squeeze(F.translate(F.lower(F.coalesce(c, F.lit(""))), "#-_", "   "))


def check_memo_key(c: Column) -> Column:
    """Memo key under which `Check 3340` and `CHECK # 3340` agree."""
    s = F.lower(strip(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("#"), F.lit("")), F.lit("  "), F.lit(" "))))
    for prefix in ["check", "chk", "ch"]:
        s = F.regexp_replace(s, rf"^{prefix} \s*", "")
    return s


def label_key(c: Column) -> Column:
    return F.upper(squeeze(c))


def remove_control_characters(c: Column) -> Column:
    return F.regexp_replace(c, K.CONTROL_CHARACTERS, "")


def csv_escape(c: Column) -> Column:
    """The text of a CSV cell, quoted only when it has to be."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike('[,"\n]'), quoted).otherwise(c)


def partition_name(c: Column) -> Column:
    """Client name to the name of its ledger partition."""
    s = F.regexp_replace(F.lower(strip(c)), " ", "-")
    return F.when(s.endswith("-data"), s).otherwise(F.concat(s, F.lit("-data")))


def account_id_core(c: Column) -> Column:
    """Account ID without its type prefix."""
    prefixes = "|".join(p.rstrip("-") for p in K.ACCOUNT_ID_PREFIXES)
    return F.coalesce(F.regexp_replace(c, f"(?i)^({prefixes})-", ""), F.lit(""))


def normalise_triggers(c: Column) -> Column:
    upper = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.upper(strip(t)))
    return F.array_sort(F.array_distinct(F.filter(upper, lambda t: t != "")))


def is_generic_trigger(c: Column) -> Column:
    """Wording that says how money moved but not to whom; a four-digit code makes it specific."""
    t = F.upper(strip(c))
    compact = squeeze(F.regexp_replace(t, "[^A-Z0-9 ]", " "))
    starts = reduce(lambda a, b: a | b, [compact.startswith(p + " ") for p in K.GENERIC_PAYMENT_PHRASES])
    return ~t.rlike(K.FOUR_DIGITS) & (compact.isin(K.GENERIC_PAYMENT_PHRASES) | starts)


def is_generic_rule(triggers: Column) -> Column:
    return (F.size(triggers) > 0) & F.forall(triggers, is_generic_trigger)


def tax_subcategory(description: Column) -> Column:
    d = F.upper(description)
    return (
        F.when(d.contains("FTB"), "FTB-Taxes")
        .when(d.contains("IRS"), "IRS-Taxes")
        .when(d.contains("CDTFA"), "CDTFA-Taxes")
        .otherwise("Other-Taxes")
    )


def not_categorisable(description: Column) -> Column:
    d = F.coalesce(strip(description), F.lit(""))
    return (d == "") | ~d.rlike("[a-zA-Z]") | d.rlike(r"(?i)\bloan\b") | d.rlike(r"(?i)\bcheck\b")


def is_last_year_return(label: Column, subcategory: Column) -> Column:
    """Organiser rows that hold last year's income tax return."""
    return F.coalesce(label, F.lit("")).contains("Last year's income tax return(s)") | F.coalesce(
        subcategory, F.lit("")
    ).rlike(r"(?i)last\s+year['\s]*(?:s)?\s*income\s+tax\s+return")
