"""Standard rows from raw inputs: ledger rows, bank rows, register rows, charts of accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyspark import constants as K
from tallyspark.functions import dates, money, text as tx


def ledger_rows(raw: DataFrame) -> DataFrame:
    """Ledger rows from resolved text columns (date, name, memo, split and debit, credit or amount).

    Both sides, else the signed amount (positive is credit), else the one side present.
    """
    names = set(raw.columns)
    zero = F.lit(0).cast(money.MONEY)
    debit = money.ledger_amount(F.col("debit")) if "debit" in names else zero
    credit = money.ledger_amount(F.col("credit")) if "credit" in names else zero
    if "amount" in names and not {"debit", "credit"} <= names:
        signed = money.ledger_amount(F.col("amount"))
        given = F.col("amount").isNotNull()
        credit, debit = (
            F.when(given, F.greatest(signed, zero)).otherwise(credit),
            F.when(given, F.greatest(-signed, zero)).otherwise(debit),
        )

    def text(name: str, default: str = "") -> Column:
        return F.coalesce(tx.strip(F.col(name)), F.lit(default)) if name in names else F.lit(default)

    keep = [c for c in raw.columns if c not in {"date", "name", "memo", "split", "debit", "credit", "amount"}]
    date = F.coalesce(dates.iso_or_text(F.col("date")), F.lit("")) if "date" in names else F.lit("")
    rows = raw.select(
        *keep, date.alias("date"), text("name").alias("name"), text("memo").alias("memo"),
        text("split", K.UNCATEGORIZED).alias("category"), debit.cast(money.MONEY).alias("debit"), credit.cast(money.MONEY).alias("credit"),
    )
    return rows.filter((F.col("memo") != "") & ((F.col("debit") != 0) | (F.col("credit") != 0)))


def bank_csv_rows(raw: DataFrame) -> DataFrame:
    """Bank CSV rows: number of the type text, else debit or credit columns, else signed amount."""
    names = set(raw.columns)

    def amount(name: str) -> Column:
        return money.lenient_amount(F.col(name)) if name in names else F.lit(None).cast(money.MONEY)

    typed = money.type_column_amount(F.col("type")) if "type" in names else F.lit(None).cast(money.MONEY)
    keep = [c for c in raw.columns if c not in {"date", "description", "type", "amount", "credit", "debit"}]
    # parse once, combine afterwards: the parsed columns stay columns instead of being repeated as expressions
    parsed = raw.select(
        *keep, tx.strip(F.col("date")).alias("date"), tx.strip(F.col("description")).alias("description"),
        F.array(typed, amount("credit"), amount("debit"), amount("amount")).alias("v"),
    ).filter((F.col("date") != "") & (F.col("description") != ""))
    ty, cr, de, am = (F.get("v", F.lit(k)) for k in range(4))
    sides = cr.isNotNull() | de.isNotNull()
    credit = F.when(ty.isNotNull(), money.credit_part(ty)).when(sides, cr).otherwise(money.credit_part(am))
    debit = F.when(ty.isNotNull(), money.debit_part(ty)).when(sides, de).otherwise(money.debit_part(am))
    rows = parsed.filter(F.coalesce(ty, cr, de, am).isNotNull()).withColumn("c", credit).withColumn("d", debit)
    return rows.withColumn("credit", F.when(F.col("c") > 0, F.col("c"))).withColumn(
        "debit", F.when(~F.coalesce(F.col("c") > 0, F.lit(False)) & (F.col("d") > 0), F.col("d"))
    ).drop("c", "d", "v")


def bank_sheet_rows(raw: DataFrame) -> DataFrame:
    """Bank spreadsheet rows: sign only, zero dropped, date as MM/dd/yyyy, unreadable dates dropped."""
    signed = F.col("amount").try_cast(money.MONEY)
    keep = [c for c in raw.columns if c not in {"date", "description", "amount"}]
    rows = raw.select(
        *keep, F.date_format(dates.parse_date(F.col("date")), "MM/dd/yyyy").alias("date"),
        tx.strip(F.col("description")).alias("description"),
        F.when(signed > 0, signed).alias("credit"), F.when(signed < 0, -signed).alias("debit"),
    )
    return rows.filter(
        F.col("date").isNotNull() & (F.col("description") != "") & F.coalesce("credit", "debit").isNotNull()
    )


def tabular_rows(raw: DataFrame) -> DataFrame:
    """Rows of a tabular export: explicit sides first, the signed amount only when both are null."""
    names = set(raw.columns)

    def amount(name: str) -> Column:
        return money.lenient_amount(F.col(name)) if name in names else F.lit(None).cast(money.MONEY)

    no_side = amount("credit").isNull() & amount("debit").isNull()
    signed = amount("amount")
    credit = F.when(no_side, money.credit_part(signed)).otherwise(amount("credit"))
    debit = F.when(no_side, money.debit_part(signed)).otherwise(amount("debit"))
    keep = [c for c in raw.columns if c not in {"date", "description", "amount", "credit", "debit", "bank", "account_number"}]

    def text(name: str) -> Column:
        return tx.strip(F.col(name)) if name in names else F.lit(None).cast("string")

    rows = raw.select(
        *keep, (dates.iso_or_text(F.col("date")) if "date" in names else F.lit(None).cast("string")).alias("date"),
        text("description").alias("description"), credit.alias("credit"), debit.alias("debit"),
        F.coalesce(text("bank"), F.lit("Unknown")).alias("bank"), text("account_number").alias("account_number"),
        F.lit(None).cast("string").alias("payee_name"),
    )
    return rows.filter((F.col("description") != "") & (money.nonzero(F.col("credit")) | money.nonzero(F.col("debit"))))


def extracted_rows(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """Extracted rows: digits of the money texts, credit wins over debit, bank and account from the statement."""
    credit, debit = money.digits_amount(F.col("credit")), money.digits_amount(F.col("debit"))
    head = statements.select("statement_id", F.col("bank").alias("s_bank"), F.col("account_number").alias("s_account"))
    out = rows.join(head, "statement_id", "left").withColumn("credit", credit).withColumn(
        "debit", F.when(~money.nonzero(F.col("credit")), debit)
    )
    out = out.withColumn("bank", F.coalesce(F.nullif("bank", F.lit("")), "s_bank", F.lit("Unknown"))).withColumn(
        "account_number", F.coalesce(F.nullif("account_number", F.lit("")), "s_account")
    ).withColumn("description", tx.strip(F.coalesce("description", F.lit(""))))
    return out.filter(money.nonzero(F.col("credit")) | money.nonzero(F.col("debit"))).drop("s_bank", "s_account")


def standard_rows(txns: DataFrame, keep: tuple[str, ...] = ("row_pos", "client_id")) -> DataFrame:
    """Date, Memo, signed Amount; rows missing one of them are dropped. Other columns travel with the row."""
    amount = F.when(F.col("credit").isNotNull(), F.col("credit")).otherwise(-F.col("debit"))
    payee = F.coalesce(F.nullif("payee_name", F.lit("")), F.lit(""))
    rows = txns.select(
        *keep, F.coalesce("date", "post_date").alias("Date"), tx.strip(F.col("description")).alias("Memo"),
        amount.cast(money.MONEY).alias("Amount"), F.coalesce("bank", F.lit("")).alias("Bank"), payee.alias("Payee"),
    )
    return rows.filter(F.col("Date").isNotNull() & (F.col("Memo") != "") & F.col("Amount").isNotNull())


def drop_counts(txns: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dropped by the standardising step, by first cause."""
    dated = F.coalesce("date", "post_date").isNotNull()
    memo = F.coalesce(tx.strip(F.col("description")), F.lit("")) != ""
    amount = F.coalesce("credit", "debit").isNotNull()
    return txns.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(~dated).alias("no_date"), F.count_if(dated & ~memo).alias("no_memo"),
        F.count_if(dated & memo & ~amount).alias("no_amount"), F.count_if(dated & memo & amount).alias("kept"),
    )


def account_groups(txns: DataFrame) -> DataFrame:
    """Transactions and statements per (bank, account)."""
    return txns.groupBy("bank", F.coalesce("account_number", F.lit("NA")).alias("account")).agg(
        F.count("*").alias("transactions"), F.count_distinct("statement_id").alias("statements")
    )


def nested_accounts(txns: DataFrame) -> DataFrame:
    """Banks with their accounts, both sorted; only counts are nested, rows stay in the table."""
    counts = txns.groupBy("bank", F.coalesce("account_number", F.lit("NA")).alias("account")).agg(F.count("*").alias("n"))
    return counts.groupBy("bank").agg(F.array_sort(F.collect_list(F.struct("account", "n"))).alias("accounts"))


def legacy_amounts(signed: Column) -> tuple[Column, Column]:
    """Credit and debit texts of the legacy file; debits are negative."""
    text = signed.cast(money.MONEY).cast("string")
    return F.when(signed >= 0, text).otherwise(""), F.when(signed < 0, text).otherwise("")


def dedupe_first(rows: DataFrame, keys: list[Column], position: str) -> DataFrame:
    """First row per key by position.

    Written as an aggregate, not a window, so copies collapse before the shuffle and a hot key stays small.
    """
    named = [k.alias(f"_k{n}") for n, k in enumerate(keys)]
    return (
        rows.groupBy(*named).agg(F.min_by(F.struct(*rows.columns), F.col(position)).alias("r")).select("r.*")
    )


def dedupe_output(rows: DataFrame) -> DataFrame:
    """Output rows once per (bank, account, date, memo in lower case, amount)."""
    return dedupe_first(
        rows,
        [F.col("bank"), F.coalesce(F.col("account_number"), F.lit("NA")), F.col("date"), F.lower(tx.strip(F.col("description"))), F.col("amount")],
        "row_pos",
    )


def dedupe_statement(rows: DataFrame) -> DataFrame:
    """Complete statement rows once per (date, description, credit, debit)."""
    complete = rows.filter((F.coalesce("description", F.lit("")) != "") & (money.nonzero(F.col("credit")) | money.nonzero(F.col("debit"))))
    return dedupe_first(complete, [F.col("client_id"), F.col("date"), F.col("description"), F.col("credit"), F.col("debit")], "row_pos")


def batches(rows: DataFrame, keys: list[str], position: str, size: int) -> DataFrame:
    """Batch number per row in order and number of batches, per key.

    The running number is built from per-bucket counts (positions split into ranges), so no key is ordered
    in one task: rows are numbered inside (key, bucket) and offset by the rows of earlier buckets.
    """
    bucket = F.floor(F.col(position) / F.lit(100_000)).alias("bucket")
    b = rows.withColumn("bucket", bucket)
    counts = b.groupBy(*keys, "bucket").agg(F.count("*").alias("in_bucket"))
    before = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"),
        F.sum("in_bucket").over(W.partitionBy(*keys)).alias("total"),
    )
    within = F.row_number().over(W.partitionBy(*keys, "bucket").orderBy(position))
    numbered = b.withColumn("n", within).join(offsets, [*keys, "bucket"])
    return numbered.withColumn("batch_num", F.ceil((F.col("n") + F.col("offset")) / size).cast("bigint")).withColumn(
        "batch_total", F.ceil(F.col("total") / size).cast("bigint")
    ).drop("n", "bucket", "offset", "total")


def coa_rows(raw: DataFrame) -> DataFrame:
    """Chart of accounts: all columns as trimmed text, missing as empty text."""
    return raw.select(*[F.coalesce(tx.strip(F.col(f"`{c}`").cast("string")), F.lit("")).alias(c) for c in raw.columns])


def coa_categories(coa: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct category names: per row the first non-missing of the known columns, squeezed, lower case."""
    by_name = {c.lower(): c for c in reversed(coa.columns)}
    present = [tx.missing_to_null(F.col(f"`{by_name[c]}`")) for c in K.COA_CATEGORY_COLUMNS if c in by_name]
    name = F.lower(tx.squeeze(F.coalesce(*present)))
    return coa.select(*(keys or []), name.alias("category")).filter(F.coalesce("category", F.lit("")) != "").distinct()


ORGANISER_FIELDS = ["documentLabel", "categoryId", "categoryName", "subcategoryId", "subcategoryName", "priority"]


def organiser_rows(replies: DataFrame, column: str) -> DataFrame:
    """Mapped documents of a JSON reply in a fixed all-string shape, one row per document."""
    schema = "mapped array<struct<" + ",".join(f"{f}:string" for f in ORGANISER_FIELDS) + ">>"
    keep = [c for c in replies.columns if c != column]
    rows = replies.select(*keep, F.explode(F.from_json(column, schema)["mapped"]).alias("m"))
    return rows.select(*keep, *[F.coalesce(F.col(f"m.{f}"), F.lit("")).alias(f) for f in ORGANISER_FIELDS])
