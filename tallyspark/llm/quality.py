"""Quality rules as a ledger of rule bits (DataFrame functions only).

Every rule is evaluated once; the ledger keeps the measurements and one failure bit for each rule. Policies are
versioned bit masks over the ledger, so a new policy or an ablation never reads the texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import SPACES, let, texts, words

POSITION_BITS = 24


@dataclass(frozen=True)
class Rule:
    """A document fails the rule where `fails` holds; the bit is the rule's place in RULES."""

    name: str
    fails: str


#: Bits 0 and 1 are the base rules. SQL over the measurements, integers only.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_word_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("odd_word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
)
BASE_MASK = 0b00011


@dataclass(frozen=True)
class Policy:
    version: str
    mask: int


POLICIES = {"base": Policy("base", BASE_MASK), "v1": Policy("v1", 0b11111)}


def _covered(positions: Column) -> Column:
    """Number of words in 3-word windows that start at the sorted positions."""
    steps = F.transform(positions, lambda p, j: F.least(F.lit(3), F.get(positions, j + 1) - p))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)


def repeat_words(w: Column) -> Column:
    """Words covered by 3-word windows found twice or more in the array `w`, first occurrences included.

    Windows are sorted as 40 hash bits with the position behind them, in one long; neighbours with equal bits are
    compared as words. Should two different windows share their bits, or the text be too long for the position bits,
    the windows themselves are sorted instead.
    """
    mask = F.lit((1 << POSITION_BITS) - 1).cast("long")
    n = F.size(w)
    starts = F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0)))

    def same_bits(x, y):
        return F.shiftright(x, POSITION_BITS) == F.shiftright(y, POSITION_BITS)

    def same_words(x, y):
        a, b = x.bitwiseAND(mask).cast("int"), y.bitwiseAND(mask).cast("int")
        return (F.get(w, a) == F.get(w, b)) & (F.get(w, a + 1) == F.get(w, b + 1)) & (F.get(w, a + 2) == F.get(w, b + 2))

    packed = F.sort_array(
        F.transform(starts, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")))
    )
    repeated = let(packed, lambda s: F.filter(s, lambda x, j: same_bits(x, F.get(s, j - 1)) | same_bits(x, F.get(s, j + 1))))

    windows = F.sort_array(F.transform(starts, lambda x, i: F.struct(x.alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("p"))))

    def same_window(x, y):
        return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    exact = let(windows, lambda s: F.filter(s, lambda x, j: same_window(x, F.get(s, j - 1)) | same_window(x, F.get(s, j + 1))))
    slow = let(F.sort_array(F.transform(exact, lambda x: x["p"].cast("long"))), _covered)

    def from_packed(r):
        clash = F.exists(F.transform(r, lambda x, j: same_bits(x, F.get(r, j + 1)) & ~same_words(x, F.get(r, j + 1))), lambda c: F.coalesce(c, F.lit(False)))
        fast = let(F.sort_array(F.transform(r, lambda x: x.bitwiseAND(mask))), _covered)
        return F.when(F.size(r) == 0, F.lit(0).cast("long")).when(clash, slow).otherwise(fast)

    return F.when(n < 3, F.lit(0).cast("long")).when(n >= 1 << POSITION_BITS, slow).otherwise(let(repeated, from_packed))


def measure(text: Column) -> Column:
    """All measurements of one text as a struct; the text is split once."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit("\x20\x09\x0a\x0b\x0c\x0d"))) > 0)

    def of_words(w):
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).alias("n_repeat_words"),
        )

    return F.struct(
        let(words(text), of_words).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )


MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and `fail_bits` for every row of `docs`.

    Null or empty texts have no words and fail the first rule; repeated rows each get a row; other columns are ignored.
    """
    m = texts(docs).select("doc_id", measure(F.col("text")).alias("m"))
    flat = m.select(
        "doc_id", F.col("m.w.n_words").alias("n_words"), F.col("m.w.word_chars").alias("word_chars"), F.col("m.n_symbols").alias("n_symbols"),
        F.col("m.l.n_lines").alias("n_lines"), F.col("m.l.n_dup_lines").alias("n_dup_lines"), F.col("m.w.n_repeat_words").alias("n_repeat_words"),
    )
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(RULES)), F.lit(0))
    return flat.withColumn("fail_bits", bits)


def kept(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) == 0


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects.

    One row for each combination of bits is left after the first aggregate, at most 2 ** len(RULES).
    """
    combos = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count(F.lit(1)).alias("docs"))
    rules = F.array(*(F.struct(F.lit(k).alias("bit"), F.lit(r.name).alias("rule")) for k, r in enumerate(RULES) if policy.mask >> k & 1))
    per_rule = combos.select("bits", "docs", F.inline(rules))
    flag = F.expr("shiftleft(1, bit)")
    return per_rule.groupBy(F.lit(policy.version).alias("policy"), "rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(flag) != 0, F.col("docs")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("bits") == flag, F.col("docs")).otherwise(0)).alias("fails_alone"),
    )


def filter_documents(docs: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    """The rows of `docs` that a policy keeps, with their own columns; measured in the same pass, without a join."""
    carried = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), measure(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("m"))
    flat = carried.select("row", "m.w.*", "m.l.*", "m.n_symbols")
    failing = [F.expr(r.fails) for k, r in enumerate(RULES) if policy.mask >> k & 1]
    bad = failing[0]
    for f in failing[1:]:
        bad = bad | f
    return flat.filter(~bad).select("row.*")


def query(docs: DataFrame) -> DataFrame:
    base = POLICIES["base"]
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~kept(base)).alias("base_failed"), kept(POLICIES["v1"]).alias("kept"), F.col("fail_bits").cast("long").alias("fail_bits"),
    )


SQL = rf"""
WITH w AS (
    SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM documents
), windows AS (
    SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), twice AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1
), covered AS (
    SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r
), m AS (
    SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
           len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
    FROM w LEFT JOIN covered USING (r)
), b AS (
    SELECT *, {" + ".join(f"CASE WHEN {r.fails} THEN {1 << k} ELSE 0 END" for k, r in enumerate(RULES))} AS fail_bits FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (fail_bits & {BASE_MASK}) <> 0 AS base_failed, fail_bits = 0 AS kept, CAST(fail_bits AS BIGINT) AS fail_bits
FROM b
"""
