"""Statement text to transactions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyspark import constants as K
from tallyspark.functions import text as tx


def text_lines(texts: DataFrame, key: str, column: str) -> DataFrame:
    """Trimmed lines of a text with their number; blank lines are dropped but keep their number."""
    rows = texts.select(key, F.posexplode(F.split(F.col(column), "\n")).alias("line_no", "text"))
    return rows.withColumn("text", tx.strip(F.col("text"))).filter(F.col("text") != "")


def detect_bank(lines: DataFrame, key: str = "statement_id") -> DataFrame:
    """Bank and layout per statement from keyword flags over the whole text."""
    low = F.lower("text")

    def flag(words: list[str]) -> Column:
        return F.bool_or(tx.contains_any(low, words))

    flags = lines.groupBy(key).agg(
        flag(K.WELLS_KEYS).alias("wells"), flag(K.WELLS_CARD_KEYS).alias("wells_card"), flag(K.WELLS_SECOND_KEYS).alias("wells_second"),
        flag(K.BOA_KEYS).alias("boa"), flag(K.BOA_CARD_KEYS).alias("boa_card"),
        flag(K.CHASE_KEYS).alias("chase"), flag(K.CHASE_CARD_KEYS).alias("chase_card"),
    )
    bank = F.when(F.col("wells"), "Wells Fargo").when(F.col("boa"), "Bank of America").when(F.col("chase"), "Chase Bank").otherwise("unknown")
    layout = (
        F.when(F.col("wells") & F.col("wells_card"), "credit_card")
        .when(F.col("wells") & F.col("wells_second"), "format_02")
        .when(F.col("wells"), "format_01")
        .when(F.col("boa") & F.col("boa_card"), "credit_card")
        .when(F.col("boa"), "format_01")
        .when(F.col("chase") & F.col("chase_card"), "credit_card")
        .when(F.col("chase"), "format_01")
    )
    return flags.select(key, bank.alias("bank"), layout.alias("layout"))


BLOCK = 10_000  # line numbers per block of the running computations


def running(rows: DataFrame, key: list[str], order: str, carries: dict[str, str] | None = None, counts: dict[str, str] | None = None,
            totals: dict[str, str] | None = None, block: int = BLOCK) -> DataFrame:
    """Running values per key in order, all in one pass.

    `carries` maps a new column to the column whose last non-null value is carried down, `counts` maps a new
    column to the flag that is counted so far, `totals` to the flag counted over the whole key.

    Rows are cut into blocks of order numbers: windows run inside a block, and only one row per block takes
    part in the window that passes values from block to block. A key of any length is spread over tasks.
    """
    carries, counts, totals = carries or {}, counts or {}, totals or {}
    b = rows.withColumn("_b", F.floor(F.col(order) / F.lit(block)))
    ends = b.groupBy(*key, "_b").agg(
        F.count("*").alias("_rows"),
        *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(f"_e_{o}") for o, v in carries.items()],
        *[F.count_if(f).alias(f"_n_{o}") for o, f in counts.items()],
        *[F.count_if(f).alias(f"_t_{o}") for o, f in totals.items()],
    )
    whole = W.partitionBy(*key)
    earlier = whole.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    passed = ends.select(
        *key, "_b",
        *[F.last(f"_e_{o}", ignorenulls=True).over(earlier).alias(f"_e_{o}") for o in carries],
        *[F.coalesce(F.sum(f"_n_{o}").over(earlier), F.lit(0)).alias(f"_n_{o}") for o in counts],
        *[F.sum(f"_t_{o}").over(whole).alias(o) for o in totals],
    )
    inside = W.partitionBy(*key, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    own = b.select(
        "*",
        *[F.last(v, ignorenulls=True).over(inside).alias(f"_o_{o}") for o, v in carries.items()],
        *[F.count_if(f).over(inside).alias(f"_o_{o}") for o, f in counts.items()],
    )
    joined = own.join(passed, [*key, "_b"])
    return joined.select(
        *rows.columns,
        *[F.coalesce(f"_o_{o}", f"_e_{o}").alias(o) for o in carries],
        *[(F.col(f"_o_{o}") + F.col(f"_n_{o}")).alias(o) for o in counts],
        *totals,
    )


STATEMENT = ["statement_id"]


def clean_lines(lines: DataFrame) -> DataFrame:
    """Trimmed lines without blank lines and page furniture."""
    t = tx.strip(F.col("text"))
    return lines.withColumn("text", t).filter((F.col("text") != "") & ~F.col("text").rlike(K.FURNITURE_PATTERN))


def section_header(c: Column) -> Column:
    chain = None
    for name, pattern in K.SECTION_PATTERNS.items():
        chain = F.when(c.rlike(pattern), name) if chain is None else chain.when(c.rlike(pattern), name)
    return chain


def _marks(lines: DataFrame) -> DataFrame:
    """Marks that depend on the line alone: section header, ledger end, account header."""
    text = F.col("text")
    return lines.withColumns(
        {
            "header": section_header(text),
            "ends": text.rlike(K.LEDGER_END_PATTERN),
            "acct": F.nullif(F.regexp_extract(text, K.ACCOUNT_HEADER_PATTERN, 1), F.lit("")),
        }
    )


def _body(marked: DataFrame) -> DataFrame:
    """Lines that are neither header lines nor behind the ledger end."""
    return marked.filter((F.col("end_count") == 0) & F.col("header").isNull())


def with_sections(lines: DataFrame) -> DataFrame:
    """Body lines with the section carried down from header lines; lines after the ledger end are dropped."""
    marked = running(_marks(lines), STATEMENT, "line_no", {"section": "header"}, {"end_count": "ends"})
    return _body(marked).drop("header", "ends", "acct", "end_count")


def with_accounts(lines: DataFrame) -> DataFrame:
    """Lines with the number of the last account header."""
    marked = running(_marks(lines), STATEMENT, "line_no", {"account": "acct"})
    return marked.filter("acct IS NULL").drop("header", "ends", "acct")


def _money(c: Column) -> Column:
    return F.regexp_replace(c, "[$,]", "").try_cast("decimal(18,2)")


def inline_rows(lines: DataFrame) -> DataFrame:
    """`date [date] amount text` rows: posting date, effective date, amount and text."""

    def part(n: int) -> Column:
        return F.nullif(F.regexp_extract("text", K.INLINE_ROW_PATTERN, n), F.lit(""))

    return lines.filter(F.col("text").rlike(K.INLINE_ROW_PATTERN)).withColumns(
        {"posted": part(1), "effective": part(2), "amount": _money(part(3)), "detail": part(4)}
    )


def _row_groups(lines: DataFrame, starts: Column, stops: Column | None = None, sectioned: bool = True) -> DataFrame:
    """Body lines with `section`, `account`, `starts`, `breaks` and the running row number `row_no`.

    A row begins at a start line; stop lines and section headers end it, what follows them up to the next
    start belongs to no row. Layouts without sections (`sectioned=False`) know neither headers nor a ledger end.
    """
    stop = F.coalesce(stops, F.lit(False)) if stops is not None else F.lit(False)
    marked = _marks(lines).withColumn("starts", starts)
    if not sectioned:
        marked = marked.withColumn("header", F.lit(None).cast("string")).withColumn("ends", F.lit(False))
    marked = marked.withColumn("breaks", F.col("starts") | stop | F.col("header").isNotNull())
    numbered = running(
        marked, STATEMENT, "line_no", {"section": "header", "account": "acct"}, {"end_count": "ends", "row_no": "breaks"}
    )
    return _body(numbered).filter("row_no > 0 AND acct IS NULL").drop("header", "ends", "acct", "end_count")


def with_continuations(lines: DataFrame, row_pattern: str, stops: Column | None = None, sectioned: bool = False) -> DataFrame:
    """Row lines with the lines below them appended, up to the next row or stop line.

    `text` of the result is the row line, `more` the appended text.
    """
    grouped = _row_groups(lines, F.col("text").rlike(row_pattern), stops, sectioned)
    # a group holds the lines of one row
    rows = grouped.groupBy(*STATEMENT, "row_no").agg(
        F.min_by(F.struct("line_no", "text", "starts", "section"), "line_no").alias("first"),
        F.array_sort(F.collect_list(F.when(~F.col("breaks"), F.struct("line_no", "text")))).alias("rest"),
    )
    return rows.filter("first.starts").select(
        *STATEMENT, "first.line_no", "first.text", "first.section", F.array_join("rest.text", " ").alias("more")
    )


def inline_transactions(lines: DataFrame) -> DataFrame:
    """Sectioned inline layout: rows with continuation lines, polarity from the section."""
    text = F.col("text")
    stops = text.rlike(K.TOTAL_PATTERN) | text.rlike(K.AMOUNT_LINE_PATTERN) | text.rlike(K.DATE_LINE_PATTERN)
    rows = inline_rows(with_continuations(clean_lines(lines), K.INLINE_ROW_PATTERN, stops, sectioned=True))
    credit = F.coalesce(F.col("section") == "credit", F.lit(False))
    return rows.select(
        *STATEMENT, "line_no", "section", "posted", "effective", tx.squeeze(F.concat_ws(" ", "detail", "more")).alias("description"),
        F.when(credit, F.col("amount")).alias("credit"), F.when(~credit, F.col("amount")).alias("debit"),
    )


def block_transactions(lines: DataFrame, pick: str = "first") -> DataFrame:
    """Block layout: a date line, text lines, an amount line; the first or the last amount line counts."""
    text = F.col("text")
    grouped = _row_groups(clean_lines(lines), text.rlike(K.DATE_LINE_PATTERN), text.rlike(r"(?i)^\s*Total\b"))
    grouped = grouped.filter(F.coalesce("section", F.lit("")) != "checks")
    amount = F.when(text.rlike(K.AMOUNT_LINE_PATTERN), _money(text))
    at = F.when(amount.isNotNull(), F.col("line_no"))
    chosen = F.min_by(amount, at) if pick == "first" else F.max_by(amount, at)
    where = F.min(at) if pick == "first" else F.max(at)
    rows = grouped.groupBy(*STATEMENT, "row_no").agg(
        F.min_by(F.struct("line_no", "text", "starts", "section", "account"), "line_no").alias("first"), chosen.alias("amount"),
        where.alias("amount_line"), F.array_sort(F.collect_list(F.when(~F.col("breaks"), F.struct("line_no", "text")))).alias("rest"),
    )
    words = F.filter("rest", lambda r: r["line_no"] != F.col("amount_line"))
    rows = rows.filter("first.starts AND amount IS NOT NULL").select(
        *STATEMENT, "first.line_no", "first.section", "first.account", F.col("first.text").alias("date"),
        tx.squeeze(F.array_join(words["text"], " ")).alias("description"), "amount",
    )
    return rows.filter("description <> ''")


def check_transactions(lines: DataFrame) -> DataFrame:
    """Check rows of a checks section: number, date and amount on following lines; marker lines do not count."""
    body = clean_lines(lines).filter(~F.col("text").rlike(K.CHECK_MARKER_PATTERN))
    grouped = _row_groups(body, F.col("text").rlike(K.CHECK_LINE_PATTERN)).filter("section = 'checks'")
    rows = grouped.groupBy(*STATEMENT, "row_no").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("line_no", "text", "starts"))), 1, 3).alias("l")
    )
    number, date, amount = (F.get("l", F.lit(n)) for n in range(3))
    complete = number["starts"] & date["text"].rlike(K.DATE_LINE_PATTERN) & amount["text"].rlike(K.AMOUNT_LINE_PATTERN)
    return rows.filter(complete).select(
        *STATEMENT, number["line_no"].alias("line_no"), date["text"].alias("date"),
        F.concat(F.lit("Check "), F.regexp_replace(number["text"], r"\D", "")).alias("description"), _money(amount["text"]).alias("debit"),
    )


def polarity(section: Column, description: Column, amount_text: Column) -> Column:
    """Section first, then wording, then parentheses or minus; debit when nothing says otherwise."""
    d = F.lower(description)
    return (
        F.when(section.isin("credit", "debit"), section)
        .when(tx.contains_any(d, K.POLARITY_CREDIT_WORDS), "credit")
        .when(tx.contains_any(d, K.POLARITY_DEBIT_WORDS), "debit")
        .when(amount_text.rlike(r"\(\s*\d|\-\s*\$?"), "debit")
        .otherwise("debit")
    )


def table_transactions(lines: DataFrame) -> DataFrame:
    """Table layout: (credit, debit, balance), (amount, balance) or (amount) behind the text of a dated row."""
    rows = with_continuations(clean_lines(lines), r"^\d{1,2}/\d{1,2}(?:/\d{2,4})?\b")
    rest = F.regexp_replace("text", r"^\S+\s*", "")
    money = F.transform(F.regexp_extract_all(rest, F.lit(f"({K.MONEY_PATTERN})"), 1), _money)
    described = tx.strip(F.regexp_replace(rest, K.MONEY_PATTERN, ""))
    rows = rows.select(
        *STATEMENT, "line_no", F.regexp_extract("text", r"^(\S+)", 1).alias("date"), described.alias("words"), money.alias("m"), "more"
    )
    d = F.lower("words")
    credit_like, debit_like = tx.contains_any(d, K.TABLE_CREDIT_HINTS), tx.contains_any(d, K.TABLE_DEBIT_HINTS)
    two = tx.contains_any(d, K.TABLE_TWO_AMOUNT_CREDIT_WORDS) | ~tx.contains_any(d, K.TABLE_TWO_AMOUNT_DEBIT_WORDS)
    one = tx.contains_any(d, K.TABLE_ONE_AMOUNT_CREDIT_WORDS)
    is_credit = F.when(credit_like & ~debit_like, True).when(debit_like & ~credit_like, False).otherwise(F.when(F.size("m") == 2, two).otherwise(one))
    n = F.size("m")
    a, b, c = (F.get("m", F.lit(k)) for k in range(3))
    rows = rows.withColumn("is_credit", is_credit)
    few = (n == 1) | (n == 2)
    return rows.select(
        *STATEMENT, "line_no", "date", tx.strip(F.concat_ws(" ", "words", F.nullif("more", F.lit("")))).alias("description"),
        F.when(n == 3, a).when(few & F.col("is_credit"), a).alias("credit"),
        F.when(n == 3, b).when(few & ~F.col("is_credit"), a).alias("debit"),
        F.when(n == 3, c).when(n == 2, b).alias("balance"),
    )


def amount_before_balance(text: Column) -> Column:
    """First amount before the word Balance, else the first amount anywhere."""
    pattern = r"(?:\d{1,3}(?:,\d{3})*|\d*)\.\d{2}"
    before = F.regexp_extract(text, rf"(?i)^((?:(?!\bBalance\b).)*)", 1)
    first = F.coalesce(*[F.nullif(F.regexp_extract(c, f"({pattern})", 1), F.lit("")) for c in (before, text)])
    return _money(first)


def is_valid_description(c: Column) -> Column:
    """Wording test for noisy layouts."""
    d = F.lower(c)
    words = F.size(F.split(tx.strip(c), r"\s+"))
    return (F.length(c) >= 3) & (
        tx.contains_any(d, K.SHORT_DESCRIPTION_WORDS) | ((words >= 3) & tx.contains_any(d, K.LONG_DESCRIPTION_WORDS))
    )


def final_rows(rows: DataFrame) -> DataFrame:
    """Rows with a description that is no total or summary, and with an amount."""
    text = F.coalesce("description", F.lit(""))
    amount = F.coalesce(F.col("credit"), F.col("debit"))
    return rows.filter((text != "") & ~text.rlike(r"(?i)\b(total|summary)\b") & (F.coalesce(amount, F.lit(0)) != 0))


def grouped_transactions(lines: DataFrame) -> DataFrame:
    """Date-led groups with several amounts: of two or more, the last but one if the last stands alone on its
    line (it is the balance), else the first; a number line followed by `Check` becomes `Check n`."""
    grouped = _row_groups(clean_lines(lines), F.col("text").rlike(K.DATE_LINE_PATTERN), sectioned=False).filter("NOT starts")
    rows = grouped.groupBy(*STATEMENT, "row_no").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"), F.min_by("account", "line_no").alias("account")
    )
    joined = F.regexp_replace(F.array_join("l.text", "\n"), r"(?i)(^|\n)(\d{3,6})\*?\ncheck(?=\n|$)", "$1Check $2")
    rows = rows.select(*STATEMENT, "row_no", "account", F.split(joined, "\n").alias("parts"))
    amount = r"([0-9]{1,3}(?:,[0-9]{3})*\.\d{2})"
    amounts = F.flatten(F.transform("parts", lambda p: F.regexp_extract_all(p, F.lit(amount), 1)))
    with_amount = F.filter("parts", lambda p: p.rlike(amount))
    alone = F.element_at(with_amount, -1).rlike(K.AMOUNT_LINE_PATTERN)
    chosen = F.when((F.size("amounts") >= 2) & alone, F.get("amounts", F.size("amounts") - 2)).otherwise(F.get("amounts", F.lit(0)))
    words = F.filter(
        F.transform(F.filter("parts", lambda p: ~p.rlike(K.AMOUNT_LINE_PATTERN)), lambda p: tx.strip(F.regexp_replace(p, amount, ""))), lambda p: p != ""
    )
    rows = rows.withColumn("amounts", amounts).filter(F.size("amounts") > 0)
    return rows.select(*STATEMENT, "row_no", "account", tx.squeeze(F.array_join(words, " ")).alias("description"), _money(chosen).alias("amount"))


def pattern_transactions(lines: DataFrame, pattern: str = K.GENERIC_ROW_PATTERN) -> DataFrame:
    """Any layout with `date text amount` lines: rows with continuation lines, polarity from the sign."""
    rows = with_continuations(clean_lines(lines), pattern)
    amount = _money(F.regexp_extract("text", pattern, 3))
    description = F.concat_ws(" ", tx.strip(F.regexp_extract("text", pattern, 2)), F.nullif("more", F.lit("")))
    return rows.select(
        *STATEMENT, "line_no", F.regexp_extract("text", pattern, 1).alias("date"), description.alias("description"),
        F.when(amount >= 0, amount).alias("credit"), F.when(amount < 0, -amount).alias("debit"),
    )


def balance_rows(lines: DataFrame) -> DataFrame:
    """One row per (date, balance) pair of a line."""
    dates = F.regexp_extract_all("text", F.lit(K.BALANCE_PAIR_PATTERN), 1)
    values = F.regexp_extract_all("text", F.lit(K.BALANCE_PAIR_PATTERN), 2)
    pairs = lines.select(*STATEMENT, "line_no", F.posexplode(F.arrays_zip(dates.alias("d"), values.alias("v"))).alias("pair_no", "p"))
    return pairs.select(*STATEMENT, "line_no", "pair_no", F.col("p.d").alias("date"), _money(F.col("p.v")).alias("balance"))


def transaction_pages(pages: DataFrame, cards: bool = False) -> DataFrame:
    """Pages with a section header and the run of transaction pages after one; statements without a header
    keep all pages. Pages carry their whole text."""
    text = F.col("text")
    patterns = K.CARD_PAGE_HEADER_PATTERNS if cards else K.PAGE_HEADER_PATTERNS
    header = reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])
    date, amount = text.rlike(K.PAGE_DATE_PATTERN), text.rlike(K.PAGE_AMOUNT_PATTERN)
    if cards:
        goes_on = date & amount & ~text.rlike(K.PAGE_SUMMARY_PATTERN)
    else:
        goes_on = amount & (date | (F.length(tx.strip(text)) > K.PAGE_CONTENT_LENGTH))
    event = F.when(header, "header").when(~goes_on, "stop")
    flagged = pages.select(*STATEMENT, "page_no", event.alias("event")).withColumn("is_header", F.col("event") == "header")
    state = running(flagged, STATEMENT, "page_no", {"state": "event"}, totals={"headers": "is_header"})
    kept = state.filter((F.col("headers") == 0) | (F.coalesce("state", F.lit("stop")) == "header"))
    return pages.join(kept.select(*STATEMENT, "page_no"), [*STATEMENT, "page_no"], "left_semi")
