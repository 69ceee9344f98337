"""Rule bases: rules from stored model replies, merging, deduplication, change application."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyspark import constants as K
from tallyspark.functions import dates, money, text as tx

RULE_JSON = (
    "rule_id string, trigger_payee_contains array<string>, account_id string, account_name string, category_type string, "
    "logic string, vendor_code string, ach_vendor_only boolean"
)
RULE_STRUCT = ", ".join(c.replace(" ", ": ") for c in RULE_JSON.split(", "))
RULE_COLUMNS = [c.split()[0] for c in RULE_JSON.split(", ")]


def loan_fields(texts: DataFrame, column: str) -> DataFrame:
    """Loan fields of agreement texts, first pattern that hits per field."""
    t = F.col(column)
    f = {name: dates.loan_text_field(t, name) for name in K.LOAN_TEXT_PATTERNS if name != "due_date"}
    keep = [c for c in texts.columns if c != column]

    def no_commas(name: str):
        return F.replace(f[name], F.lit(","), F.lit(""))

    return texts.select(
        *keep, tx.squeeze(f["legal_name"]).alias("legal_name"), no_commas("funding_provided").alias("funding_provided"),
        f["annual_percentage_rate"].alias("annual_percentage_rate"), no_commas("finance_charge").alias("finance_charge"),
        no_commas("total_payment_amount").alias("total_payment_amount"), money.payment_text(f["payment"]).alias("payment"),
        f["account_no"].alias("account_no"), f["start_date"].alias("start_date"),
    )


_STRING = r'"(?:[^"\\]|\\.)*+"'
_FLAT = rf'\{{(?:[^{{}}"]|{_STRING})*+\}}'
#: A complete object: braces stand inside strings or in objects one level down.
_OBJECT = rf'(\{{(?:[^{{}}"]|{_STRING}|{_FLAT})*+\}})'


def rules_from_replies(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Rules of stored model replies.

    What lies between the first and the last square bracket is read as an array of objects, whatever those hold besides.
    Where it isn't one (cut-off replies), every complete object is read on its own. Objects without rule ID or account name
    are left out; `reply_pos` counts the array's elements, or the complete objects.
    """
    keep = [c for c in replies.columns if c != column]
    text = F.col(column)
    array = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    # a probe of its own: a reader for the fields alone could stop at the first object of a broken array
    whole = F.get_json_object(F.concat(F.lit('{"a":'), array, F.lit("}")), "$.a").isNotNull() & (array != "")
    parsed = F.from_json(F.when(whole, array), f"array<struct<{RULE_STRUCT}>>")
    objects = F.regexp_extract_all(text, F.lit(_OBJECT), 1)
    recovered = F.transform(objects, lambda o: F.from_json(o, RULE_JSON))
    rows = replies.select(*keep, F.posexplode(F.coalesce(parsed, recovered)).alias("reply_pos", "r")).select(*keep, "reply_pos", "r.*")
    return rows.filter(F.col("rule_id").isNotNull() & F.col("account_name").isNotNull())


def merge_rules(rules: DataFrame) -> DataFrame:
    """One rule per (client, account ID without prefix, account name in lower case).

    Fields come from the first rule, triggers are united in upper case, the first vendor code is kept and the
    ACH flag is or-ed. `rule_pos` of the result is the position of the first rule.
    """
    name = tx.strip(F.coalesce("account_name", F.lit("")))
    keyed = rules.withColumn("norm_id", tx.account_id_core(F.col("account_id"))).withColumn("norm_name", F.lower(name))
    code = F.nullif(tx.strip(F.coalesce("vendor_code", F.lit(""))), F.lit(""))
    head = keyed.groupBy("client_id", "norm_id", "norm_name").agg(
        F.min("rule_pos").alias("rule_pos"),
        F.min_by(F.struct("rule_id", "account_id", name.alias("account_name"), "category_type", F.coalesce("logic", F.lit("")).alias("logic")), "rule_pos").alias("h"),
        F.min_by(code, F.when(code.isNotNull(), F.col("rule_pos"))).alias("vendor_code"),
        F.bool_or(F.coalesce("ach_vendor_only", F.lit(False))).alias("ach_vendor_only"),
        # distinct triggers of one account: bounded by its vocabulary, not by the number of rules
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(tx.normalise_triggers(F.col("trigger_payee_contains")))))).alias("trigger_payee_contains"),
    )
    return head.select("client_id", "norm_id", "rule_pos", "h.*", "vendor_code", "ach_vendor_only", "trigger_payee_contains")


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def _absorb(pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy in order: a group takes over open groups with trigger overlap above 0.7 and grows with them."""
    pdf = pdf.sort_values("rule_pos", kind="stable").reset_index(drop=True)
    sets = [set(t) for t in pdf["trigger_payee_contains"]]
    open_groups, kept = list(range(len(sets))), []
    while open_groups:
        head, rest = open_groups[0], []
        for other in open_groups[1:]:
            if _jaccard(sets[head], sets[other]) > 0.7:
                sets[head] |= sets[other]
            else:
                rest.append(other)
        kept.append(head)
        open_groups = rest
    out = pdf.loc[kept].copy()
    out["trigger_payee_contains"] = [sorted(sets[k]) for k in kept]
    return out


def absorb_similar(merged: DataFrame) -> DataFrame:
    """Merge of groups with the same account ID and similar triggers.

    Runs per (client, account ID); a group is the handful of account names that share one ID, never the rows
    of a client. Only IDs with more than one group go through Python.
    """
    per_id = W.partitionBy("client_id", "norm_id")
    counted = merged.withColumn("groups", F.count("*").over(per_id))
    single = counted.filter("groups = 1").drop("groups")
    several = counted.filter("groups > 1").drop("groups")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in merged.schema.fields)
    return single.unionByName(several.groupBy("client_id", "norm_id").applyInPandas(_absorb, schema))


def trigger_similarity(merged: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs of groups of one account ID with trigger overlap above the threshold.

    Pairs come from an equi join on shared triggers, so groups without a common trigger never meet.
    """
    t = merged.select("client_id", "norm_id", "rule_pos", F.size("trigger_payee_contains").alias("n"), F.explode("trigger_payee_contains").alias("t"))
    b = t.select("client_id", "norm_id", "t", F.col("rule_pos").alias("other_pos"), F.col("n").alias("other_n"))
    shared = t.join(b, ["client_id", "norm_id", "t"]).filter("rule_pos < other_pos")
    counted = shared.groupBy("client_id", "norm_id", "rule_pos", "other_pos", "n", "other_n").agg(F.count("*").alias("common"))
    similarity = F.col("common") / (F.col("n") + F.col("other_n") - F.col("common"))
    return counted.withColumn("similarity", similarity).filter(F.col("similarity") > threshold)


def final_dedupe(rules: DataFrame) -> DataFrame:
    """Rules of one (account name, category type): a rule that shares more than half of its triggers with the
    last kept rule of the key is merged into it.

    The fold runs as one `aggregate` over the ordered rules of a key. After merging, the rules of a key differ
    in account ID, so a key holds no more rows than one account name has IDs in a client's chart.
    """
    key = [F.lower(tx.strip(F.coalesce(c, F.lit("")))).alias(f"k_{c}") for c in ["account_name", "category_type"]]
    columns = [c for c in rules.columns if c not in {"client_id", "trigger_payee_contains"}]
    row = F.struct(*[F.col(c) for c in ["rule_pos", *[c for c in columns if c != "rule_pos"]]], F.col("trigger_payee_contains"))
    grouped = rules.withColumn("trigger_payee_contains", F.col("trigger_payee_contains")).groupBy("client_id", *key).agg(
        F.array_sort(F.collect_list(row)).alias("rows")
    )

    def triggers(r):
        return F.array_distinct(F.transform(r["trigger_payee_contains"], lambda t: F.upper(tx.strip(t))))

    def step(acc, r):
        last = F.element_at(acc, -1)
        a, b = triggers(last), triggers(r)
        common, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
        similar = (F.size(acc) > 0) & (F.size(a) > 0) & (F.size(b) > 0) & (common * 2 > union)
        merged = last.withField("trigger_payee_contains", F.array_sort(F.array_union(a, b)))
        return F.when(
            F.coalesce(similar, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(merged))
        ).otherwise(F.concat(acc, F.array(r)))

    kept = F.aggregate(
        F.expr("slice(rows, 2, size(rows))"), F.slice("rows", 1, 1), step
    )
    return grouped.select("client_id", F.explode(kept).alias("r")).select("client_id", "r.*")
