"""Ledger upkeep: bank-account rows, history lookups, corrections, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import constants as K
from tallyspark.functions import text as tx


def is_bank_label(c: Column) -> Column:
    """A category that names a bank account: a bank name with an account word, a `#` number or a masked number."""
    t = F.lower(F.coalesce(c, F.lit("")))
    types = "|".join(K.BANK_LABEL_TYPES)
    return tx.contains_any(t, K.BANK_LABEL_NAMES) & t.rlike(rf"\b({types})\b|#\s*\d+|x{{2,}}\d+|\b\d{{4,}}\b")


def distinct_splits(entries: DataFrame, column: str = "category") -> DataFrame:
    return entries.select(column).filter(tx.strip(F.coalesce(column, F.lit(""))) != "").distinct()


def label_splits(splits: DataFrame, column: str = "category", supplied: DataFrame | None = None) -> DataFrame:
    """Bank flag per distinct split; a supplied label table wins over the pattern test."""
    flagged = splits.withColumn("is_bank", is_bank_label(F.col(column)))
    if supplied is None:
        return flagged
    s = supplied.select(column, F.col("is_bank").alias("given"))
    return flagged.join(s, column, "left").select(column, F.coalesce("given", "is_bank").alias("is_bank"))


def drop_bank_rows(entries: DataFrame, column: str = "category", supplied: DataFrame | None = None) -> DataFrame:
    """Rows whose split is not a bank account. Labels are computed once per distinct split."""
    labels = label_splits(distinct_splits(entries, column), column, supplied).filter("is_bank").select(column)
    return entries.join(labels, column, "left_anti")


def existing_clients(rows: DataFrame, clients: DataFrame) -> DataFrame:
    return rows.join(clients.select("client_id"), "client_id", "left_semi")


def coa_keyword_match(texts: DataFrame, coa: DataFrame, description: str = "description", name: str = "account") -> DataFrame:
    """First chart row of the client of which a word longer than three letters is in the text.

    Chart rows reduce to distinct words with their first position, one vocabulary row per client (bounded by the
    size of a chart), so a text is looked up by one equi join and scanned in place.
    """
    account = tx.strip(F.col(name))
    words = (
        coa.select("client_id", account.alias("account"), "coa_pos", F.explode(F.split(F.lower(account), r"\s+")).alias("word"))
        .filter(F.length("word") > 3)
        .groupBy("client_id", "word").agg(F.min(F.struct("coa_pos", "account")).alias("first"))
    )
    vocabulary = words.groupBy("client_id").agg(F.array_sort(F.collect_list(F.struct("first", "word"))).alias("vocabulary"))
    t = texts.select("client_id", description).distinct().join(vocabulary, "client_id", "left")
    hit = F.get(F.filter("vocabulary", lambda w: F.contains(F.lower(F.col(description)), w["word"])), F.lit(0))
    return t.select("client_id", description, hit["first"]["account"].alias("category"))


def organiser_list(categories: DataFrame, subcategories: DataFrame) -> DataFrame:
    """Sub-categories with their parent if any, plus parents without children."""
    c = categories.select(F.col("id").cast("string").alias("cid"), F.coalesce("name", F.lit("")).alias("cname"))
    s = subcategories.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("sid"), F.coalesce("name", F.lit("")).alias("sname"),
        F.coalesce(F.col("category_id").cast("string"), F.lit("")).alias("ref"), F.coalesce(F.col("priority").cast("string"), F.lit("")).alias("priority"),
    )
    j = s.join(c, F.col("ref") == F.col("cid"), "full_outer")

    def text(*columns: str) -> Column:
        return F.coalesce(*columns, F.lit(""))

    return j.select(
        text("cid", "ref").alias("categoryId"), text("cname").alias("categoryName"), text("sid").alias("subcategoryId"),
        text("sname").alias("subcategoryName"), text("priority").alias("priority"),
    )


def newest_by_name(history: DataFrame) -> DataFrame:
    """client_id, name_key, category, name, entry_id of the newest history row per (client, name), case-insensitive, over all rows.

    The maximum combines map-side, so a payee with a third of the history stays cheap.
    """
    key = F.lower(tx.strip(F.col("name")))
    h = history.select("client_id", key.alias("name_key"), "category", "name", "date", "entry_id").filter(
        (F.col("name_key") != "") & (tx.strip(F.coalesce("category", F.lit(""))) != "")
    )
    # missing dates last, ties by smallest entry id
    order = F.struct(F.coalesce("date", F.lit("0001-01-01").cast("date")), -F.col("entry_id"))
    newest = h.groupBy("client_id", "name_key").agg(F.max_by(F.struct("category", "name", "entry_id"), order).alias("n"))
    return newest.select("client_id", "name_key", "n.category", "n.name", "n.entry_id")


def category_by_name(names: DataFrame, history: DataFrame) -> DataFrame:
    """Rows of `names` with the category of the newest history row of that name."""
    newest = newest_by_name(history).drop("name", "entry_id")
    return names.withColumn("name_key", F.lower(tx.strip(F.col("name")))).join(newest, ["client_id", "name_key"], "left").drop("name_key")


def apply_corrections(entries: DataFrame, corrections: DataFrame) -> DataFrame:
    """Ledger after corrections, with the action taken per touched row.

    A correction (client, description, category, force) finds the first entry with the same description key
    and category (`already_exists`, or `updated` when forced), else the first with the key (`updated`), else it
    is added (`created`). One correction per (client, description key); a later one wins.
    """
    c = (
        corrections.select("client_id", tx.description_key(F.col("description")).alias("k"), F.struct("change_pos", tx.strip(F.col("description")).alias("description"),
                           tx.strip(F.col("category")).alias("category"), "force").alias("c"))
        .groupBy("client_id", "k").agg(F.max("c").alias("c"))
    )
    e = entries.withColumn("k", tx.description_key(F.col("memo")))
    same = F.lower(tx.strip(F.coalesce("category", F.lit("")))) == F.lower(F.col("c.category"))
    # the entry that answers a correction: same category first, then position
    target = (
        e.join(c, ["client_id", "k"]).groupBy("client_id", "k").agg(
            F.min(F.struct(F.when(same, 0).otherwise(1).alias("rank"), "row_pos")).alias("t")
        )
    )
    answered = c.join(target, ["client_id", "k"], "left")
    action = (
        F.when(F.col("t").isNull(), "created")
        .when((F.col("t.rank") == 0) & ~F.col("c.force"), "already_exists")
        .otherwise("updated")
    )
    answered = answered.withColumn("action", action)
    hits = answered.filter(F.col("t").isNotNull()).select(
        "client_id", F.col("t.row_pos").alias("row_pos"), F.col("c.category").alias("new_category"), "action"
    )
    kept = entries.join(hits, ["client_id", "row_pos"], "left").withColumn("previous_category", F.when(F.col("action") == "updated", F.col("category")))
    kept = kept.withColumn("category", F.when(F.col("action") == "updated", F.col("new_category")).otherwise(F.col("category"))).drop("new_category")
    added = answered.filter("action = 'created'").select(
        "client_id", F.col("c.change_pos").alias("row_pos"), F.col("c.description").alias("memo"), F.lit("").alias("name"),
        F.col("c.category").alias("category"), "action",
    )
    return kept.unionByName(added, allowMissingColumns=True)


def delete_entries(entries: DataFrame, condition: Column) -> DataFrame:
    """Snapshot without the rows that meet the condition; null counts as not met."""
    return entries.filter(~F.coalesce(condition, F.lit(False)))
