"""Document fingerprints from closed syncmers (DataFrame functions only).

A text is a row of units: its words. Runs of more than UNIT characters without white space (long words, Chinese, base64) are
cut by content, whatever their length: before each character at which the hash of GRAM characters is less than those at the
NEAR characters on either side. What is still longer than UNIT is cut every UNIT characters from its cut. A window of K units is an anchor if the
smallest hash of its inner substrings (S = 1 unit) lies at one of its two ends. Whether a window is an anchor depends on
nothing outside it, so a passage keeps its anchors wherever it stands (in a long run: from its first cut on), and at least one lies in any K units and K - 2
more. The fingerprint lists the distinct anchors in the order of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import let, texts
from tallyspark.session import materialise

UNIT, K = 16, 4
#: Characters of a hash that may cut a run, and how many neighbours on either side it must be less than: a cut for every five characters or so.
GRAM, NEAR = 3, 2
_LOW = (1 << 32) - 1


def _cut(run: Column) -> Column:
    """A run with a space at each of its cuts; none where the text is of one character."""

    def of_grams(c, h):
        def mark(x, i):
            around = [F.get(h, i + k) for k in range(-NEAR, NEAR + 1) if k]
            return F.when((i >= NEAR) & (i + NEAR < F.size(h)) & (F.get(h, i) < F.least(*around)), F.concat(F.lit(" "), x)).otherwise(x)

        return F.array_join(F.transform(c, mark), "")

    def of_characters(c):
        grams = F.transform(F.slice(c, F.lit(1), F.size(c) - (GRAM - 1)), lambda x, i: F.xxhash64(x, *(F.get(c, i + k) for k in range(1, GRAM))))
        return let(grams, lambda h: of_grams(c, h))

    return let(F.split(run, ""), of_characters)


def unit_hashes(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.transform(runs, lambda r: F.when(F.length(r) > UNIT, _cut(r)).otherwise(r)), " ")
    text = F.when(text.rlike(rf"[^\x20\x09-\x0D]{{{UNIT + 1}}}"), cut).otherwise(text)
    units = F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{UNIT}}}"), F.lit(0))
    return F.transform(units, lambda u: F.xxhash64(u))


def _short(*hashes: Column) -> Column:
    return F.xxhash64(*hashes).bitwiseAND(F.lit(_LOW).cast("long"))


def anchors(text: Column) -> Column:
    """array<struct<position, hash>> of a text; position: the unit at which the anchor begins.

    A text of fewer than K units, or in which no window qualifies, has one anchor over all its units; no units: none.
    """

    def of_units(h):
        starts = F.slice(h, F.lit(1), F.greatest(F.size(h) - (K - 1), F.lit(0)))

        def anchor(x, i):
            inner = [F.get(h, i + k) for k in range(1, K - 1)]
            last = F.get(h, i + (K - 1))
            return F.when(F.least(x, last) <= F.least(*inner), F.struct(i.alias("position"), _short(x, *inner, last).alias("hash")))

        whole = F.array(F.struct(F.lit(0).alias("position"), _short(h).alias("hash")))
        found = F.array_compact(F.transform(starts, anchor))
        return F.when(F.size(h) == 0, F.slice(whole, 1, 0)).otherwise(let(found, lambda a: F.when(F.size(a) == 0, whole).otherwise(a)))

    return let(unit_hashes(text), of_units)


def anchor_hashes(text: Column) -> Column:
    """Distinct anchor hashes in the order of the text."""

    def of_units(h):
        starts = F.slice(h, F.lit(1), F.greatest(F.size(h) - (K - 1), F.lit(0)))

        def anchor(x, i):
            inner = [F.get(h, i + k) for k in range(1, K - 1)]
            last = F.get(h, i + (K - 1))
            return F.when(F.least(x, last) <= F.least(*inner), _short(x, *inner, last))

        found = F.array_distinct(F.array_compact(F.transform(starts, anchor)))
        whole = F.when(F.size(h) == 0, F.slice(h, 1, 0)).otherwise(F.array(_short(h)))
        return let(found, lambda a: F.when(F.size(a) == 0, whole).otherwise(a))

    return let(unit_hashes(text), of_units)


def encoded(hashes: Column) -> Column:
    """The fingerprint as a string: eight hex digits for each anchor."""
    return F.array_join(F.transform(hashes, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Twice the shared anchors over all anchors of both; 1 for two texts without any."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint for every row of `docs` (null text: empty); other columns are ignored."""
    return texts(docs).select("doc_id", F.length("text").cast("long").alias("n_chars"), encoded(anchor_hashes(F.col("text"))).alias("fingerprint"))


def shared_anchors(pairs: DataFrame) -> DataFrame:
    """For rows (left_id, left_text, right_id, right_text): left_id, right_id, shift, anchors, by falling number.

    Positional matching: shared anchors by how far apart they stand; a copied passage has many at one shift.
    """
    side = [F.transform(anchors(F.coalesce(F.col(f"{s}_text"), F.lit(""))), lambda a: a).alias(s) for s in ("left", "right")]
    p = pairs.select("left_id", "right_id", *side)
    left = p.select("left_id", "right_id", F.inline("left").alias("left_position", "hash"))
    right = p.select("left_id", "right_id", F.inline("right").alias("right_position", "hash"))
    # one row for each anchor hash of a side: its positions stay apart only where a text repeats itself
    met = left.groupBy("left_id", "right_id", "hash").agg(F.min("left_position").alias("l")).join(
        right.groupBy("left_id", "right_id", "hash").agg(F.min("right_position").alias("r")), ["left_id", "right_id", "hash"]
    )
    return met.groupBy("left_id", "right_id", (F.col("r") - F.col("l")).alias("shift")).agg(F.count(F.lit(1)).alias("anchors"))


def next_documents(keys: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_chars, next_id, next_hash, next_copies by falling doc_id (null last), then hash; after the last comes the first.

    Ranges of rows are numbered apart, written once, and joined at their ends by one row for each range.
    """
    order = F.col("doc_id").desc_nulls_last(), F.col("text_hash")
    # one text for each key is kept; repeated rows are one document here
    distinct = keys.groupBy("doc_id", "text_hash").agg(F.max("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    ranged = materialise(distinct.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "next-ranges")
    key = F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id").cast("decimal(20,0)")).alias("falling"), "text_hash", "doc_id", "copies")
    heads = ranged.groupBy("part").agg(F.min(key).alias("head"))
    parts = Window.orderBy("part")
    whole = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = heads.select("part", F.coalesce(F.lead("head").over(parts), F.first("head").over(whole)).alias("follows"))
    inside = Window.partitionBy("part").orderBy(*order)
    me = F.struct("doc_id", "text_hash", "copies")
    led = ranged.withColumn("next", F.lead(me).over(inside)).join(following, "part")
    end = F.struct(F.col("follows.doc_id").alias("doc_id"), F.col("follows.text_hash").alias("text_hash"), F.col("follows.copies").alias("copies"))
    led = led.withColumn("next", F.coalesce("next", end))
    return led.select("doc_id", "text_hash", "n_chars", F.col("next.doc_id").alias("next_id"), F.col("next.text_hash").alias("next_hash"), F.col("next.copies").alias("next_copies"))


def edit_probe(docs: DataFrame) -> DataFrame:
    """The query's rows: every text, its edited text, and their likeness.

    Null and empty texts have no characters and no anchors; rows that agree in id and text have the same next document;
    a single document follows itself; an empty table gives an empty result.
    """
    base = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    nexts = materialise(next_documents(base.select("doc_id", "text_hash", F.length("text").cast("long").alias("n_chars"))), "next-documents")
    # what a document hands to the one before it: as many first characters as that one needs, and its own anchors
    wanted = nexts.select(
        F.col("next_id").alias("k_id"), F.col("next_hash").alias("k_hash"), F.col("doc_id").alias("to_id"), F.col("text_hash").alias("to_hash"),
        F.floor(F.col("n_chars") / 3).cast("int").alias("take"), "next_copies",
    )

    def hand(to: DataFrame) -> DataFrame:
        pairs = base.join(to, base["doc_id"].eqNullSafe(to["k_id"]) & (base["text_hash"] == to["k_hash"]))
        return pairs.select("to_id", "to_hash", F.substring(F.col("text"), F.lit(1), F.col("take")).alias("head"), anchor_hashes(F.col("text")).alias("next_anchors"))

    # repeated rows hand over once
    handed = hand(wanted.filter("next_copies = 1")).union(hand(wanted.filter("next_copies > 1")).dropDuplicates(["to_id", "to_hash"]))
    met = base.join(handed, base["doc_id"].eqNullSafe(handed["to_id"]) & (base["text_hash"] == handed["to_hash"]))
    n = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 3).cast("int")), F.col("head"))
    both = met.select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "next_anchors")
    marked = both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.struct(anchor_hashes(F.col("text")).alias("own"), anchor_hashes(F.col("edited")).alias("edited"), F.col("next_anchors").alias("next")).alias("a"),
    )
    bound = F.transform(
        F.array("a"),
        lambda a: F.struct(
            encoded(a["own"]).alias("fingerprint"), encoded(a["edited"]).alias("edited_fingerprint"),
            likeness(a["own"], a["edited"]).alias("near_edited"), likeness(a["own"], a["next"]).alias("near_next"),
        ),
    )[0]
    return marked.select("doc_id", "n_chars", "edited_sha256", bound.alias("r")).select("doc_id", "n_chars", "edited_sha256", "r.*")


def query(docs: DataFrame) -> DataFrame:
    return edit_probe(docs)
