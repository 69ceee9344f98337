"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Each document has a 36-bit hash of its id. Sizes are summed by source and hash bucket; the bucket in which a source's
budget ends is split again, twice, until one hash value is left, so no document is ever sorted. A larger budget only
raises the threshold: mixes of growing budgets are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import SPACES
from tallyspark.session import materialise

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
LEVEL_BITS = 12
LEVELS = 3
SALTS = 32


def size_of(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_of(doc_id: Column) -> Column:
    """36 bits of the id's MD5, the same in other engines; a null id counts as an empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 9), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: weights shared out, no source above MOST_EPOCHS times its size.

    Water filling: with sources by rising ratio of limit to weight, the level is the largest of
    (total - limits before) / (weights from here on). One row for each source, so one window over all of them is small.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*(F.lit(x) for x in WEIGHTS)), (F.pmod(F.row_number().over(named) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighted = by_source.withColumn("weight", weight).withColumn("most", F.lit(float(MOST_EPOCHS)) * F.col("source_size"))
    rising = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    whole = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = F.lit(0.0)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), none)) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), none))
    levels = weighted.withColumn("level", level)
    return levels.select("source", "source_size", F.least(F.col("most"), F.max("level").over(whole) * F.col("weight")).alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """source, passes, threshold: whole passes over the source, then the documents whose hash lies below the threshold."""
    state = targets.filter("source_size > 0").select(
        "source", F.floor(F.col("target") / F.col("source_size")).alias("passes"), F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("sum_before"),
        (F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")).alias("budget"),
    )
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        here = F.shiftright(F.col("h"), shift)
        s = state.select(F.col("source").alias("s_source"), "passes", "prefix", "sum_before", "budget")
        if level == 0:
            hist = sizes.groupBy("source", here.alias("bucket")).agg(F.sum("size").alias("n"))
            joined = hist.join(s, hist["source"].eqNullSafe(s["s_source"]))
        else:
            # the boundary bucket only; each (source, bucket) keeps one row for each of its sub-buckets
            inside = sizes.join(s, sizes["source"].eqNullSafe(s["s_source"]) & (F.shiftright(F.col("h"), shift + LEVEL_BITS) == F.col("prefix")))
            joined = inside.groupBy("source", here.alias("bucket"), "passes", "sum_before", "budget").agg(F.sum("size").alias("n"))
        w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        running = joined.withColumn("upto", F.col("sum_before") + F.sum("n").over(w))
        found = running.filter(F.col("upto") > F.col("budget")).groupBy("source").agg(
            F.min(F.struct("bucket", "passes", "budget", "upto", "n")).alias("x")
        )
        state = found.select("source", "x.passes", F.col("x.bucket").alias("prefix"), (F.col("x.upto") - F.col("x.n")).alias("sum_before"), "x.budget", F.col("x.upto").alias("upto"))
    closer = (F.col("upto") - F.col("budget")) < (F.col("budget") - F.col("sum_before"))
    return state.select("source", "passes", (F.col("prefix") + F.when(closer, 1).otherwise(0)).alias("threshold"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, taken for every row of `docs`.

    Null texts have size 0 and are never counted; null sources form one source, the last; rows with equal ids are taken
    together. Sources of size 0 have target 0. An empty table gives an empty result.
    """
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        size_of(F.col("text").cast("string")).alias("size"), hash_of(F.col("doc_id")).alias("h"),
    )
    sizes = materialise(slim, "mix-sizes")
    targets = materialise(source_targets(sizes), "mix-targets")
    rows = _with_epochs(sizes, _per_source(sizes, targets))
    return rows.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"))


def _per_source(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each source and salt: a source that holds a third of all rows is joined in SALTS parts."""
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    x = thresholds(sizes, targets).select(F.col("source").alias("x_source"), "passes", "threshold")
    joined = t.join(x, t["t_source"].eqNullSafe(x["x_source"]), "left").drop("x_source")
    return joined.withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _with_epochs(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    salted = rows.withColumn("salt", F.pmod(F.col("h"), F.lit(SALTS)).cast("int"))
    met = salted.join(per_source, salted["source"].eqNullSafe(per_source["t_source"]) & (salted["salt"] == per_source["t_salt"]), "left")
    epochs = F.coalesce(F.col("passes"), F.lit(0)) + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)
    return met.withColumn("epochs", F.least(epochs, F.lit(MOST_EPOCHS)).cast("long"))


def repeat_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the mix takes, with their own columns, as often as it takes them.

    Epochs depend on source and id hash alone: the mix is joined by one row for each source, never by document.
    """
    slim = docs.select(
        F.col("source").cast("string").alias("source"), size_of(F.col("text").cast("string")).alias("size"), hash_of(F.col("doc_id")).alias("h")
    )
    sizes = materialise(slim, "mix-sizes")
    targets = materialise(source_targets(sizes), "mix-targets")
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    whole = docs.select(own, F.col("source").cast("string").alias("source"), hash_of(F.col("doc_id")).alias("h"), (size_of(F.col("text").cast("string")) > 0).alias("any"))
    taken = _with_epochs(whole, _per_source(sizes, targets))
    # a document without words adds nothing to any target: it stays once
    times = F.when(F.col("any"), F.col("epochs")).otherwise(1).cast("int")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).select("row.*")


def query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH d AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
           CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) AS BIGINT) AS h
    FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), wt AS (
    SELECT *, 3.0::DOUBLE * source_size AS most,
           ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % 3 + 1] AS weight
    FROM s
), lv AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
    FROM wt WINDOW r AS (ORDER BY most / weight, source IS NULL, source)
), t AS (
    SELECT source, source_size, least(most, max(level) OVER () * weight) AS target FROM lv
), p AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t
), v AS (
    SELECT source, h, sum(size) AS n FROM d GROUP BY source, h
), c AS (
    SELECT v.*, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM v
), b AS (
    SELECT p.source, p.source_size, p.target, p.passes,
           min(CASE WHEN c.upto > p.target - p.passes * p.source_size THEN c.h END) AS edge
    FROM p LEFT JOIN c ON c.source IS NOT DISTINCT FROM p.source GROUP BY ALL
), e AS (
    SELECT b.*, edge + CASE WHEN c.upto - (target - passes * source_size) < (target - passes * source_size) - (c.upto - c.n) THEN 1 ELSE 0 END AS threshold
    FROM b LEFT JOIN c ON c.source IS NOT DISTINCT FROM b.source AND c.h = b.edge
)
SELECT d.doc_id, d.size, e.source_size, e.target,
       CAST(d.size * least(3, e.passes + CASE WHEN d.h < e.threshold AND e.source_size > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
