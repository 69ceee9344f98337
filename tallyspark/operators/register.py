"""Check register: one row per normalised check number, and lookups through it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import codes, text as tx

INFO = ["payee_name", "category", "memo", "type", "split_amount"]


def register_by_check(register: DataFrame) -> DataFrame:
    """Last informative row per (client, check number)."""
    rows = register.filter(F.col("check_number").isNotNull()).select(
        "client_id", "row_pos", codes.check_key(F.col("check_number")).alias("check_number"),
        *[tx.strip(F.col(c)).alias(c) for c in INFO],
    ).filter(F.coalesce(*INFO).isNotNull())
    last = F.max_by(F.struct(*INFO), "row_pos").alias("entry")
    return rows.groupBy("client_id", "check_number").agg(last).select("client_id", "check_number", "entry.*")


def check_payees(register: DataFrame) -> DataFrame:
    """Reduced map: number and payee, both present; a later row replaces an earlier one."""
    rows = register.select(
        "client_id", "row_pos", codes.check_key(F.col("check_number")).alias("check_number"),
        tx.strip(F.col("payee_name")).alias("payee_name"),
    ).filter(F.col("check_number").isNotNull() & (F.col("payee_name") != ""))
    return rows.groupBy("client_id", "check_number").agg(F.max_by("payee_name", "row_pos").alias("payee_name"))


def match_register(txns: DataFrame, register: DataFrame) -> DataFrame:
    """Transactions with the register entry of their check number (null without one)."""
    entries = register_by_check(register).select(
        "client_id", "check_number", F.struct(*INFO).alias("entry")
    )
    return txns.withColumn("check_number", codes.check_number(F.col("description"))).join(
        entries, ["client_id", "check_number"], "left"
    )
