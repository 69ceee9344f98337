"""Dates from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark import constants as K
from tallyspark.functions.text import first_group, strip


def _try(c: Column, pattern: str, fmt: str) -> Column:
    # the pattern guard keeps two- and four-digit years apart
    return F.when(c.rlike(pattern), F.try_to_date(c, fmt))


def parse_date(c: Column) -> Column:
    """First of the five accepted formats (`K.DATE_FORMATS`) that fits; two-digit years 69-99 mean 1969-1999.

    The parts are put in ISO order and cast, which costs a fraction of a parser that is given a pattern.
    """
    s = strip(c)
    a, b, year = F.substring_index(s, "/", 1), F.substring_index(F.substring_index(s, "/", 2), "/", -1), F.substring_index(s, "/", -1)

    def day(year: Column, month: Column, day: Column) -> Column:
        return F.concat_ws("-", year, month, day).try_cast("date")

    century = F.when(F.length(year) == 4, "").when(year >= "69", "19").otherwise("20")
    full = F.concat(century, year)
    return F.when(s.rlike(r"^\d{1,2}/\d{1,2}/(\d{4}|\d{2})$"), F.coalesce(day(full, a, b), day(full, b, a))).when(
        s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), s.try_cast("date")
    )


def iso_or_text(c: Column) -> Column:
    """ISO text of a readable date, else the trimmed text."""
    return F.coalesce(parse_date(c).cast("string"), F.nullif(strip(c), F.lit("")))


def parse_long_date(c: Column) -> Column:
    """`January 5, 2024`, `Jan 5 2024` or `1/5/2024`."""
    s = F.regexp_replace(F.regexp_replace(strip(c), r"\s*,\s*", " "), r"\s+", " ")
    return F.coalesce(
        _try(s, r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
        _try(s, r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
        _try(s, r"^[A-Za-z]+ \d{1,2} \d{4}$", "MMMM d yyyy"),
    )


def statement_period(text: Column) -> Column:
    """Struct of start, end and year; each layout must give two readable dates."""
    found = F.array(
        *[F.struct(F.regexp_extract(text, p, 1).alias("a"), F.regexp_extract(text, p, 2).alias("b")) for p in K.STATEMENT_PERIOD_PATTERNS]
    )
    parsed = F.transform(
        found, lambda x: F.struct(parse_long_date(x["a"]).alias("start_date"), parse_long_date(x["b"]).alias("end_date"))
    )
    first = F.get(F.filter(parsed, lambda x: x["start_date"].isNotNull() & x["end_date"].isNotNull()), F.lit(0))
    return F.when(first.isNotNull(), first.withField("year", F.year(first["start_date"])))


def month_day_date(mmdd: Column, year: Column) -> Column:
    """`MM/dd` with the statement year; impossible days give null."""
    return F.try_to_date(F.concat_ws("/", mmdd, year.cast("string")), "M/d/yyyy")


def short_date_text(d: Column) -> Column:
    """`m/d/yy` as shown for ledger ranges."""
    return F.concat_ws("/", F.month(d), F.dayofmonth(d), F.substring(F.year(d).cast("string"), 3, 2))


def loan_due_date(text: Column) -> Column:
    """Due date of an agreement, only when it names a month."""
    hits = [F.regexp_extract(text, "(?i)" + p, 1) for p in K.LOAN_TEXT_PATTERNS["due_date"]]
    return F.coalesce(*[F.when(h.rlike(K.MONTH_NAMES), strip(h)) for h in hits])


def loan_text_field(text: Column, field: str) -> Column:
    """First hit for one agreement field; names keep their case, the rest is read in lower case."""
    patterns = ["(?i)" + p for p in K.LOAN_TEXT_PATTERNS[field]]
    return strip(first_group(text if field == "legal_name" else F.lower(text), patterns))
