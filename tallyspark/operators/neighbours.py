"""Nearest neighbours in ledger history and the similarity cascade built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyspark import constants as K
from tallyspark.functions import payee, text as tx
from tallyspark.operators import ledger
from tallyspark.operators.nearest import top_k
from tallyspark.session import materialise


def candidates(queries: DataFrame, history: DataFrame, k: int = 50, exclude_self: bool = False) -> DataFrame:
    """Neighbours with the facts of both sides: query memo and amount, entry memo, name, category, date, amount."""
    ranked = top_k(queries, history, k, exclude_self=exclude_self)
    q = queries.select("client_id", F.col("txn_id").alias("query_id"), F.col("memo").alias("q_memo"), F.col("amount").alias("q_amount"), "is_check", "payee")
    h = history.select("client_id", F.col("vec_id").alias("entry_id"), "memo", "name", "category", "date", F.col("amount").alias("h_amount"))
    return ranked.join(q, ["client_id", "query_id"]).join(h, ["client_id", "entry_id"])


def exact_history(queries: DataFrame, history: DataFrame, exclude_self: bool = False) -> DataFrame:
    """The newest history row with the query's memo (any case, or as a check memo) and amount, over the whole ledger.

    Same columns as `candidates`, without score and rank. Rows of one memo and amount collapse to the newest map-side, so
    a memo with a third of the ledger meets each query once.
    """

    def keyed(df: DataFrame, amount: str) -> DataFrame:
        text, check = F.lower(tx.strip(F.coalesce("memo", F.lit("")))), tx.check_memo_key(F.col("memo"))
        keys = F.array(F.concat(F.lit("t:"), text), F.when(check != "", F.concat(F.lit("c:"), check)))
        return df.withColumn("cents", F.abs(amount)).filter("cents > 0").withColumn("key", F.explode(F.array_compact(keys)))

    on = ["client_id", "key", "cents"]
    h = keyed(history.withColumnRenamed("vec_id", "entry_id"), "amount").select(*on, "entry_id", "memo", "name", "category", "date", F.col("amount").alias("h_amount"))
    row = F.struct("entry_id", "memo", "name", "category", "date", "h_amount")

    def newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*on).agg(F.min_by(row, F.struct(-_newest(), F.col("entry_id"))).alias("e")).select(*on, "e.*")

    first = newest(h)
    if exclude_self:  # the next one stands in where the newest is the query itself
        first = first.union(newest(h.join(first.select(*on, "entry_id"), [*on, "entry_id"], "left_anti")))
    q = keyed(queries, "amount").select(*on, F.col("txn_id").alias("query_id"), F.col("memo").alias("q_memo"), F.col("amount").alias("q_amount"), "is_check", "payee")
    found = q.join(first, on).filter("query_id <> entry_id") if exclude_self else q.join(first, on)
    return found.drop("key", "cents").withColumn("score", F.lit(None).cast("double")).withColumn("rank", F.lit(None).cast("int")).distinct()


def match_flags(c: DataFrame) -> DataFrame:
    """Memo and amount agreement per candidate."""
    a, b = F.lower(tx.strip(F.col("q_memo"))), F.lower(tx.strip(F.coalesce("memo", F.lit(""))))
    ka, kb = tx.check_memo_key(F.col("q_memo")), tx.check_memo_key(F.col("memo"))
    exact = (a == b) | ((ka != "") & (ka == kb))
    partial = (F.length(a) >= 4) & (F.length(b) >= 4) & (F.contains(a, b) | F.contains(b, a))
    x, y = F.abs("q_amount"), F.abs("h_amount")
    amount = (x > 0) & (y > 0) & (F.abs(x - y) < F.lit("0.01").cast("decimal(18,2)"))
    return c.withColumn("memo_match", exact | partial).withColumn("amount_match", F.coalesce(amount, F.lit(False)))


def _newest() -> Column:
    """Sort key for newest first with missing dates last."""
    return F.datediff(F.coalesce("date", F.lit("0001-01-01").cast("date")), F.lit("1970-01-01").cast("date"))


def tiered(c: DataFrame) -> DataFrame:
    """Candidates with their tier and the order inside the tier.

    1 memo and amount agree (newest), 2 memo agrees with a high score (newest), 3 high score in the top 20
    (newest, then score), 4 top 5 (score, then newest). Ties keep the incoming rank, rows without one come last, by entry.
    """
    high = F.col("score") >= K.HIGH_SCORE
    tier = (
        F.when(F.col("memo_match") & F.col("amount_match"), 1)
        .when(F.col("memo_match") & high, 2)
        .when((F.col("rank") <= 20) & high, 3)
        .when(F.col("rank") <= 5, 4)
    )
    by_date, tie = (-_newest()).cast("double"), (F.coalesce(F.col("rank"), F.lit(2**31 - 1)).alias("c"), F.col("entry_id").alias("d"))
    order = F.when(F.col("tier") == 4, F.struct((-F.col("score")).alias("a"), by_date.alias("b"), *tie)).when(
        F.col("tier") == 3, F.struct(by_date.alias("a"), (-F.col("score")).alias("b"), *tie)
    ).otherwise(F.struct(by_date.alias("a"), F.lit(0.0).alias("b"), *tie))
    return match_flags(c).withColumn("tier", tier).filter("tier IS NOT NULL").withColumn("tier_order", order)


def best_candidate(c: DataFrame) -> DataFrame:
    """Winner per query over all tiers, and the exact winner alone (for check rows)."""
    row = F.struct("tier", "entry_id", "score", "name", "category", "date")
    best = F.min_by(row, F.struct("tier", "tier_order"))
    return tiered(c).groupBy("client_id", "query_id").agg(best.alias("best"))


def name_search(queries: DataFrame, history: DataFrame, name: str = "name", k: int = 50, exclude_self: bool = False,
                vector: str = "name_embedding") -> DataFrame:
    """Category by name: the exact name over all history rows, else high scores among the neighbours of the name's vector; the newest wins.

    With `exclude_self` a query's own row (entry of its id) answers neither: the next row of that name does, and a name that
    no other row has goes on to its neighbours.
    """
    key = F.lower(tx.strip(F.col(name)))
    named = queries.filter(F.coalesce(name, F.lit("")) != "").withColumn("embedding", F.col(vector)).withColumn("name_key", key)
    # written: the facts of the ledger and the exact names are read several times, and their tables would be broadcast each time
    rows = materialise(history.select("client_id", F.col("vec_id").alias("entry_id"), "name", "category", "date"), "history")
    newest = ledger.newest_by_name(rows).withColumn("place", F.lit(0))
    if exclude_self:  # the next one stands in where the newest is the query itself
        others = rows.join(newest.select("client_id", "entry_id"), ["client_id", "entry_id"], "left_anti")
        newest = newest.unionByName(ledger.newest_by_name(others).withColumn("place", F.lit(1)))
    met = named.select("client_id", F.col("txn_id").alias("query_id"), "name_key").join(newest.withColumnRenamed("name", "h_name"), ["client_id", "name_key"])
    if exclude_self:
        met = met.filter("query_id <> entry_id")
    exact = met.groupBy("client_id", "query_id").agg(F.min_by(F.struct("category", "h_name"), "place").alias("e")).select("client_id", "query_id", "e.*")
    exact = materialise(exact, "exact")
    named = named.join(exact.select("client_id", F.col("query_id").alias("txn_id")), ["client_id", "txn_id"], "left_anti")
    ranked = top_k(named, history, k, exclude_self=exclude_self)
    h = rows.withColumnRenamed("name", "h_name")
    usable = ranked.filter(F.col("score") >= K.HIGH_SCORE).join(h, ["client_id", "entry_id"])
    best = F.min_by(F.struct("category", "score", "h_name"), F.struct(-_newest(), F.col("rank")))
    similar = usable.groupBy("client_id", "query_id").agg(best.alias("b"))
    return exact.select(
        "client_id", "query_id", "category", F.lit("exact").alias("match_type"), F.lit(1.0).alias("score"), F.col("h_name").alias("name")
    ).unionByName(
        similar.select("client_id", "query_id", "b.category", F.lit("similar").alias("match_type"), "b.score", F.col("b.h_name").alias("name"))
    )


def accept_coa_proposals(proposals: DataFrame, coa_categories: DataFrame) -> DataFrame:
    """Model proposals that equal a category of the chart, any case."""
    known = coa_categories.select("client_id", F.lower("category").alias("key"), "category")
    return proposals.withColumn("key", F.lower(tx.strip(F.col("proposal")))).join(known, ["client_id", "key"]).drop("key")


def similarity_cascade(queries: DataFrame, history: DataFrame, coa_categories: DataFrame | None = None, proposals: DataFrame | None = None,
                       exclude_self: bool = False) -> DataFrame:
    """Category per transaction from history: best candidate (exact ones from the whole ledger), else name search, else accepted proposal.

    Check rows take only the exact tier, then the category of their payee.
    """
    default = F.lit(K.DEFAULT_CATEGORY)

    def category(c: Column) -> Column:
        return F.nullif(tx.strip(F.coalesce(c, F.lit(""))), F.lit(""))

    base = queries.select("client_id", F.col("txn_id").alias("query_id"), "memo", "amount", "is_check", "payee")
    near = candidates(queries, history, 50, exclude_self)
    best = best_candidate(near.unionByName(exact_history(queries, history, exclude_self)))
    found = base.join(best, ["client_id", "query_id"], "left")
    exact = F.col("best.tier") == 1
    usable = F.when(~F.col("is_check") | exact, F.col("best"))
    found = found.withColumn("best", usable).withColumn("exact", F.coalesce(F.col("best.tier") == 1, F.lit(False)))
    found = found.withColumn("found_category", category(F.col("best.category")))
    # used twice below (result and rows left for the name search): written once instead of searched twice
    found = materialise(found, "similarity")

    by_payee = ledger.category_by_name(
        base.filter(F.col("is_check") & (F.coalesce("payee", F.lit("")) != "")).select("client_id", "query_id", F.col("payee").alias("name")),
        history.withColumnRenamed("vec_id", "entry_id"),
    ).select("client_id", "query_id", F.col("category").alias("payee_category"))

    open_rows = found.filter(~F.col("is_check") & F.col("found_category").isNull()).select(
        "client_id", F.col("query_id").alias("txn_id"), payee.payee_from_description(F.col("memo")).alias("search_name")
    )
    searched = materialise(open_rows.join(queries.select("client_id", "txn_id", "name_embedding"), ["client_id", "txn_id"]), "names")
    by_name = name_search(searched, history, "search_name", 50, exclude_self).select(
        "client_id", "query_id", F.col("category").alias("name_category")
    )
    out = found.join(by_payee, ["client_id", "query_id"], "left").join(by_name, ["client_id", "query_id"], "left")
    if proposals is not None and coa_categories is not None:
        accepted = accept_coa_proposals(proposals, coa_categories).select("client_id", "query_id", F.col("category").alias("coa_category"))
        out = out.join(accepted, ["client_id", "query_id"], "left")
    else:
        out = out.withColumn("coa_category", F.lit(None).cast("string"))
    plain = F.coalesce("found_category", category(F.col("name_category")), "coa_category", default)
    check = F.when(F.col("exact"), F.coalesce("found_category", default)).otherwise(F.coalesce(category(F.col("payee_category")), default))
    payee_name = F.when(
        F.col("is_check"),
        F.when(F.col("exact"), F.coalesce(F.nullif(tx.strip(F.col("best.name")), F.lit("")), "payee"))
        .when(F.col("payee_category").isNotNull(), F.col("payee")).otherwise(F.lit("")),
    ).otherwise(F.when(F.col("exact"), tx.strip(F.col("best.name"))).otherwise(F.lit("")))
    return out.select(
        "client_id", "query_id", "memo", "amount", "is_check", "payee", F.when(F.col("is_check"), check).otherwise(plain).alias("category"),
        F.coalesce(payee_name, F.lit("")).alias("payee_name"), F.col("best.tier").alias("tier"),
    )


def legacy_payee(rows: DataFrame) -> Column:
    """Payee of a legacy row: given payee, name of an exact match, text of the memo, else the default."""
    return F.coalesce(
        F.nullif(tx.strip(F.coalesce("payee", F.lit(""))), F.lit("")), F.nullif(tx.strip(F.coalesce("payee_name", F.lit(""))), F.lit("")),
        F.nullif(payee.payee_from_description(F.col("memo")), F.lit("")), F.lit(K.DEFAULT_CATEGORY),
    )


def look_back(queries: DataFrame, history: DataFrame, k: int = 25, exclude_self: bool = False, by: str = "memo") -> DataFrame:
    """Ranked neighbours per query with exact, high-score and selected flags.

    Exact means equal memo (or name) in any case. The newest exact row is selected, else the newest high
    score; rows equal to the selected one in text and score share the flag.
    """
    ranked = top_k(queries, history, k, exclude_self=exclude_self)
    q = queries.select("client_id", F.col("txn_id").alias("query_id"), F.lower(tx.strip(F.col(by))).alias("q_text"))
    h = history.select("client_id", F.col("vec_id").alias("entry_id"), "memo", "name", "category", "date")
    j = ranked.join(q, ["client_id", "query_id"]).join(h, ["client_id", "entry_id"])
    j = j.withColumn("h_text", F.lower(tx.strip(F.coalesce(by, F.lit(""))))).withColumn("is_exact_match", F.col("h_text") == F.col("q_text"))
    j = j.withColumn("is_high_score", F.col("score") >= K.HIGH_SCORE)
    # exact rows tie by rank alone; high scores tie by score when looking up memos
    tie = F.col("rank")
    order = F.struct(F.when(F.col("is_exact_match"), 0).otherwise(1).alias("x"), (-_newest()).alias("d"), tie.alias("r"))
    usable = F.col("is_exact_match") | F.col("is_high_score")
    w = W.partitionBy("client_id", "query_id")
    selected = F.min_by(F.struct("h_text", "score"), F.when(usable, order)).over(w)
    j = j.withColumn("s", selected)
    chosen = (F.col("h_text") == F.col("s.h_text")) & (F.abs(F.col("score") - F.col("s.score")) < 0.0001)
    return j.select(
        "client_id", "query_id", "rank", "entry_id", "memo", "name", "category", four_decimals(F.col("score")).alias("similarity_score"), "date",
        "is_exact_match", "is_high_score", F.coalesce(chosen, F.lit(False)).alias("is_selected"),
    )


def four_decimals(c: Column) -> Column:
    return F.round(c * 10000) / 10000


def first_category(queries: DataFrame, history: DataFrame, exclude_self: bool = False) -> DataFrame:
    """Category of the first neighbour, else `unknown`."""
    top = top_k(queries, history, 1, exclude_self=exclude_self)
    h = history.select("client_id", F.col("vec_id").alias("entry_id"), "category")
    hit = top.join(h, ["client_id", "entry_id"]).select("client_id", "query_id", "category")
    return queries.select("client_id", F.col("txn_id").alias("query_id"), "memo").join(hit, ["client_id", "query_id"], "left").withColumn(
        "category", F.coalesce("category", F.lit("unknown"))
    )


def label_file(queries: DataFrame, history: DataFrame, exclude_self: bool = False) -> DataFrame:
    """Whole-file run: rows that cannot be categorised are `unknown`, the rest take the first neighbour's
    category, tax rows get their sub-category."""
    skip = tx.not_categorisable(F.col("memo"))
    hit = first_category(queries.filter(~skip), history, exclude_self).select("client_id", "query_id", F.col("category").alias("found"))
    rows = queries.select("client_id", F.col("txn_id").alias("query_id"), "memo").join(hit, ["client_id", "query_id"], "left")
    found = F.coalesce("found", F.lit("unknown"))
    return rows.select(
        "client_id", "query_id", F.when(F.lower(found) == "taxes", tx.tax_subcategory(F.col("memo"))).otherwise(found).alias("category")
    )
