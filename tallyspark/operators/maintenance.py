"""Table maintenance as change application: a change table and a base table give a new snapshot.

Changes are reduced to the last one per key before they meet the base table, so a key with many changes
costs one row in the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text as tx

RULE_KEY = ["client_id", "rule_id"]
TEXT_FIELDS = ["account_id", "account_name", "category_type", "logic", "vendor_code"]


def latest_changes(changes: DataFrame, keys: list[str], order: str = "changed_at") -> DataFrame:
    """Last change per key."""
    others = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("c")).select(*keys, "c.*")


def _given(c: Column) -> Column:
    return F.nullif(tx.strip(c), F.lit(""))


def insert_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Rules with the valid new ones appended; new rules need triggers and an account name."""
    text = {f: F.coalesce(tx.strip(F.col(f)), F.lit("")) for f in ("account_id", "account_name", "logic")}
    prepared = new.select(
        "client_id", "rule_pos", "rule_id", tx.normalise_triggers(F.col("trigger_payee_contains")).alias("trigger_payee_contains"),
        text["account_id"].alias("account_id"), text["account_name"].alias("account_name"),
        F.coalesce(_given(F.col("category_type")), F.lit("Expense")).alias("category_type"), text["logic"].alias("logic"),
        _given(F.col("vendor_code")).alias("vendor_code"), "ach_vendor_only",
    )
    valid = prepared.filter((F.size("trigger_payee_contains") > 0) & (F.col("account_name") != ""))
    return rules.unionByName(valid)


def update_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Rules with updated fields; null, blank text and an empty trigger list keep the old value."""
    last = latest_changes(changes.select(*RULE_KEY, "trigger_payee_contains", *TEXT_FIELDS, "ach_vendor_only", "changed_at"), RULE_KEY)
    fields = [*TEXT_FIELDS, "trigger_payee_contains", "ach_vendor_only"]
    c = last.select(*RULE_KEY, F.struct(*fields).alias("c"))
    j = rules.join(c, RULE_KEY, "left")
    triggers = tx.normalise_triggers(F.col("c.trigger_payee_contains"))
    out = j.withColumn(
        "trigger_payee_contains", F.when(F.size(triggers) > 0, triggers).otherwise(F.col("trigger_payee_contains"))
    ).withColumn("ach_vendor_only", F.coalesce("c.ach_vendor_only", "ach_vendor_only"))
    for f in TEXT_FIELDS:
        out = out.withColumn(f, F.coalesce(_given(F.col(f"c.{f}")), F.col(f)))
    return out.select(*rules.columns)


def delete_rules(rules: DataFrame, deletions: DataFrame) -> DataFrame:
    return rules.join(deletions.select(*RULE_KEY).distinct(), RULE_KEY, "left_anti")


def rotate_slots(stored: DataFrame, regenerated: DataFrame) -> DataFrame:
    """Two-slot history: regenerated rules become current, the current ones become old, older ones go.

    Clients without regenerated rules keep both slots.
    """
    touched = regenerated.select("client_id").distinct().withColumn("touched", F.lit(True))
    marked = stored.join(touched, "client_id", "left")
    kept = marked.filter(F.col("touched").isNull() | (F.col("slot") == "current")).withColumn(
        "slot", F.when(F.col("touched"), "old").otherwise(F.col("slot"))
    )
    return kept.drop("touched").unionByName(regenerated.withColumn("slot", F.lit("current")))


def keep_old_rules(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Old-slot rules copied into the current slot where they are absent."""
    old = stored.filter("slot = 'old'").join(wanted.select(*RULE_KEY).distinct(), RULE_KEY, "left_semi")
    current = stored.filter("slot = 'current'").select(*RULE_KEY)
    added = old.join(current, RULE_KEY, "left_anti").withColumn("slot", F.lit("current"))
    return stored.unionByName(added)


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: str = "updated_at", created: str | None = "created_at",
           overwrite_nulls: bool = False) -> DataFrame:
    """Base with the last change per key applied: new keys are added, known keys take the changed fields.

    Null fields keep the old value unless `overwrite_nulls` is set; the creation time of known keys is kept.
    """
    firsts = changes.groupBy(*keys).agg(F.min(created).alias("_created")) if created else None
    last = latest_changes(changes, keys, order)
    fields = [c for c in base.columns if c not in keys]
    c = last.select(*keys, F.struct(*[f for f in fields if f in last.columns]).alias("_c"))
    if firsts is not None:
        c = c.join(firsts, keys)
    j = base.withColumn("_known", F.lit(True)).join(c, keys, "full_outer")
    changed = F.col("_c").isNotNull()
    out = j
    for f in fields:
        if f == created:
            value = F.when(F.col("_known"), F.col(f)).otherwise(F.col("_created"))
        elif f not in last.columns:
            value = F.col(f)
        elif overwrite_nulls:
            value = F.when(changed, F.col(f"_c.{f}")).otherwise(F.col(f))
        else:
            value = F.coalesce(F.col(f"_c.{f}"), F.col(f))
        out = out.withColumn(f, value)
    return out.select(*base.columns)


def replace_runs(stored: DataFrame, replacements: DataFrame, keys: tuple[str, ...] = ("client_id", "run_id")) -> DataFrame:
    """Rows of the replaced runs exchanged, all other runs unchanged."""
    touched = replacements.select(*keys).distinct()
    return stored.join(touched, list(keys), "left_anti").unionByName(replacements)


def drop_keys(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")
