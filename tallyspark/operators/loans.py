"""Loan lookup, amortisation and the split of loan payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyspark import constants as K
from tallyspark.functions import codes, dates, money, text as tx


def cents(c: Column) -> Column:
    """Double rounded to cents on the scaled value."""
    return F.round(c * 100) / 100


def loan_terms(loans: DataFrame) -> DataFrame:
    """Parsed terms; months come from total / payment and default to 60."""
    payment = money.lenient_amount(F.col("payment"))
    total = money.lenient_amount(F.col("total_payment_amount"))
    months = F.when((payment > 0) & (total > 0), F.bround(total / payment).cast("int"))
    rate = F.replace(tx.strip(F.col("annual_percentage_rate")), F.lit("%"), F.lit("")).try_cast("double") / 100
    return loans.select(
        "client_id", "loan_pos", "account_no", payment.alias("payment"),
        money.lenient_amount(F.col("funding_provided")).alias("principal"), rate.alias("rate"),
        F.coalesce(months, F.lit(K.LOAN_DEFAULT_MONTHS)).alias("months"),
        dates.parse_date(F.col("start_date")).alias("start_date"),
    )


def valid_loans(loans: DataFrame) -> DataFrame:
    """Rows that describe a loan: a payment or a funding amount is present."""
    return loans.filter(F.coalesce("payment", "funding_provided").isNotNull())


def match_loans(txns: DataFrame, loans: DataFrame, keys: list[str]) -> DataFrame:
    """Best loan per transaction: same client, same payment, an ID of the memo inside the account number."""
    t = txns.select(
        *keys, "client_id", "date", F.abs(F.coalesce("debit", "credit")).alias("payment"),
        codes.loan_ids(F.col("description")).alias("ids"),
    ).filter(F.size("ids") > 0)
    terms = loan_terms(loans)
    account = F.coalesce("account_no", F.lit(""))
    j = t.join(terms, ["client_id", "payment"]).filter(F.exists("ids", lambda i: F.contains(F.lower(account), F.lower(i))))
    score = (
        F.when(F.array_contains("ids", account), K.LOAN_SCORE_EXACT)
        .when(F.exists("ids", lambda i: F.contains(account, i)), K.LOAN_SCORE_CONTAINS)
        .otherwise(0)
        + K.LOAN_SCORE_AMOUNT + K.LOAN_SCORE_CLIENT
    )
    best = F.min_by(
        F.struct("loan_pos", "account_no", "score", "principal", "rate", "months", "start_date"),
        F.struct(-F.col("score"), F.col("loan_pos")),
    )
    return (
        j.withColumn("score", score)
        .groupBy(*keys, "client_id", "date", "payment").agg(best.alias("loan"))
        .select(*keys, "client_id", "date", "payment", "loan.*")
    )


def balance_before(principal: Column, rate: Column, payment: Column, k: Column) -> Column:
    """Balance before payment k (1-based), folded month by month on doubles."""
    monthly = rate / F.lit(12.0)
    p = payment.cast("double")
    steps = F.when(k > 1, F.sequence(F.lit(2), k)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, principal.cast("double"), lambda b, _: b - (p - b * monthly))


def schedule_entry(principal: Column, rate: Column, payment: Column, months: Column, k: Column) -> Column:
    """Row k of the schedule: interest, principal part, payment and ending balance, rounded to cents."""
    balance = balance_before(principal, rate, payment, k)
    interest = balance * (rate / F.lit(12.0))
    part = F.when(k == months, balance).otherwise(payment.cast("double") - interest)
    total = F.when(k == months, interest + balance).otherwise(payment.cast("double"))
    return F.struct(
        cents(total).alias("total_payment"),
        cents(interest).alias("interest_expense"),
        cents(part).alias("principal_liability"),
        cents(F.greatest(balance - part, F.lit(0.0))).alias("ending_balance"),
    )


def schedules(terms: DataFrame) -> DataFrame:
    """Whole schedules, one row per month: the balances of all months in one fold, then exploded."""
    usable = terms.filter(
        F.col("principal").isNotNull() & F.col("rate").isNotNull() & F.col("start_date").isNotNull() & (F.col("months") > 0)
    )
    monthly = F.col("rate") / F.lit(12.0)
    p = F.col("payment").cast("double")
    balances = F.aggregate(
        F.when(F.col("months") > 1, F.sequence(F.lit(2), F.col("months"))).otherwise(F.array().cast("array<int>")),
        F.array(F.col("principal").cast("double")),
        lambda acc, _: F.concat(
            acc, F.array(F.element_at(acc, -1) - (p - F.element_at(acc, -1) * monthly))
        ),
    )
    rows = usable.select("*", F.posexplode(balances).alias("i", "balance"))
    last = F.col("i") + 1 == F.col("months")
    interest = F.col("balance") * monthly
    part = F.when(last, F.col("balance")).otherwise(p - interest)
    return rows.select(
        "client_id", "loan_pos", (F.col("i") + 1).alias("month_no"),
        F.add_months("start_date", F.col("i")).alias("payment_date"),
        cents(F.when(last, interest + F.col("balance")).otherwise(p)).alias("total_payment"),
        cents(interest).alias("interest_expense"),
        cents(part).alias("principal_liability"),
        cents(F.greatest(F.col("balance") - part, F.lit(0.0))).alias("ending_balance"),
    )


def month_number(start: Column, day: Column) -> Column:
    """1-based month of `day` counted from the month of `start`."""
    return ((F.year(day) - F.year(start)) * 12 + F.month(day) - F.month(start) + 1).cast("int")


def loan_months(matched: DataFrame) -> DataFrame:
    """The schedule row of the transaction's own month; rows outside the term get none."""
    k = month_number(F.col("start_date"), F.col("date"))
    inside = (k >= 1) & (k <= F.col("months")) & F.col("principal").isNotNull() & F.col("rate").isNotNull()
    entry = schedule_entry(F.col("principal"), F.col("rate"), F.col("payment"), F.col("months"), F.col("month_no"))
    return (
        matched.withColumn("month_no", F.when(inside, k))
        .filter(F.col("month_no").isNotNull())
        .withColumn("entry", entry)
    )


def split_loan_rows(rows: DataFrame, loans: DataFrame, keys: list[str]) -> DataFrame:
    """Loan rows with a usable schedule month become a principal row and an interest row.

    Adds `split_part` (0 whole row, 1 principal, 2 interest). Amounts keep the side of the source row.
    """
    is_loan = F.lower(F.coalesce("account_name", F.lit(""))).contains("loan")
    months = loan_months(match_loans(rows.filter(is_loan), loans, keys)).select(
        *keys,
        F.col("entry.interest_expense").cast(money.MONEY).alias("interest_part"),
        F.col("entry.principal_liability").cast(money.MONEY).alias("principal_part"),
    )
    joined = rows.join(months, keys, "left")
    splits = is_loan & (F.col("interest_part") > 0) & (F.col("principal_part") > 0)
    part = F.when(F.coalesce(splits, F.lit(False)), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    exploded = joined.withColumn("split_part", F.explode(part))
    amount = F.when(F.col("split_part") == 1, F.col("principal_part")).when(F.col("split_part") == 2, F.col("interest_part"))
    on_credit = money.nonzero(F.col("credit"))
    whole = F.col("split_part") == 0
    return (
        exploded.withColumn("new_credit", F.when(whole, F.col("credit")).when(on_credit, amount))
        .withColumn("debit", F.when(whole, F.col("debit")).when(~on_credit, amount))
        .withColumn("credit", F.col("new_credit"))
        .withColumn(
            "account_name", F.when(F.col("split_part") == 2, K.INTEREST_CATEGORY).otherwise(F.col("account_name"))
        )
        .drop("new_credit", "interest_part", "principal_part")
    )
