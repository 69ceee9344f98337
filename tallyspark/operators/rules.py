"""Matching of descriptions against ordered trigger rules.

A rule matches through any of its triggers; the winner is the smallest (rule_pos, trigger_pos). The
match is an equi join on client with a residual text predicate followed by one aggregate, so it runs on
distinct texts and never materialises text-trigger pairs that do not match.

Both sides carry a salt: triggers (the small side) are repeated per salt, texts are spread by hash. A client
that holds a third of all texts is thereby spread over `salts` tasks when Spark does not broadcast the triggers;
whether it does is left to the size statistics (`spark.sql.autoBroadcastJoinThreshold`, AQE).

For clients with thousands of triggers, `indexed=True` gives the same rows by an index of grams (`verified`): a text
meets only the triggers that share a key with it, found by an equi join on (client, salt, key) and verified by the
predicate. Every form of the predicate forces a key of the trigger into the text, so the index loses no pair. Keys travel
with a hash of their text, not with the text, and pairs without the columns of their rule. The one form that common words
alone satisfy, a text that begins with a trigger's first word, is decided per word and not per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import codes, text as tx
from tallyspark.session import materialise

RULE_FIELDS = [
    "rule_id", "account_id", "account_name", "category_type", "vendor_code", "trigger_payee_contains",
]
#: Distinct texts of a client that meet its rules in one part.
TEXTS_PER_SALT = 20_000
#: A gram that more texts of a client have gives way to a longer run, one that so many times as many have to the longest; their lengths.
COMMON_GRAM, MORE_COMMON, LONG_GRAM, LONGEST_GRAM = 16, 64, 5, 7


def explode_triggers(rules: DataFrame) -> DataFrame:
    """One row per (rule, trigger) with explicit positions."""
    return rules.select(
        "client_id", "rule_pos", *RULE_FIELDS, "ach_vendor_only",
        F.posexplode("trigger_payee_contains").alias("trigger_pos", "trigger"),
    )


def with_generic_flags(rules: DataFrame) -> DataFrame:
    """Flags for unknown vendor codes: rule is generic only, and the client has no other rules."""
    flagged = rules.withColumn("generic_only", tx.is_generic_rule(F.col("trigger_payee_contains")))
    per_client = flagged.groupBy("client_id").agg(F.bool_and("generic_only").alias("client_all_generic"))
    return flagged.join(per_client, "client_id")


def specific_rules(rules: DataFrame) -> DataFrame:
    """Rules left for a coded row without mapping."""
    return (
        with_generic_flags(rules)
        .filter(~F.col("generic_only") | F.col("client_all_generic"))
        .drop("generic_only", "client_all_generic")
    )


def client_salts(texts: DataFrame, per: int = TEXTS_PER_SALT) -> DataFrame:
    """client_id and the number of parts that its texts are joined in, from their count."""
    return texts.groupBy("client_id").agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias("salts"))


def with_salt(texts: DataFrame, salts: DataFrame, column: str) -> DataFrame:
    """Texts with a `salt`, a function of the text."""
    counted = texts.join(salts, "client_id", "left")
    return counted.withColumn("salt", F.pmod(F.xxhash64(column), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")


def trigger_table(rules: DataFrame) -> DataFrame:
    """Triggers prepared for the text predicate."""
    flagged = with_generic_flags(rules)
    t = F.upper(tx.strip(F.col("trigger")))
    rows = flagged.select(
        F.col("client_id").alias("t_client"), "rule_pos", *RULE_FIELDS,
        F.coalesce("ach_vendor_only", F.lit(False)).alias("t_ach_only"),
        (F.col("generic_only") & ~F.col("client_all_generic")).alias("t_dropped_when_coded"),
        F.posexplode("trigger_payee_contains").alias("trigger_pos", "trigger"),
    ).filter(t != "")
    return with_trigger_forms(rows.withColumn("t_text", t))


def with_trigger_forms(rows: DataFrame) -> DataFrame:
    """Rows with the forms of `t_text` that the predicate uses."""
    # split at single blanks, which needs no pattern: this runs for each pair that is verified
    words = F.filter(F.split(F.translate("t_text", "\t\n\x0b\f\r", " " * 5), " "), lambda w: F.length(w) > 2)
    return (
        rows.withColumn("t_flat", F.replace(F.col("t_text"), F.lit(" "), F.lit("")))
        .withColumn("t_cut", F.expr("left(t_flat, length(t_flat) - 1)"))
        .withColumn("t_words", words)
        .withColumn("t_w1", F.get("t_words", F.lit(0)))
        .withColumn("t_w2", F.get("t_words", F.lit(1)))
    )


def grams(text: Column, n: int = 3) -> Column:
    """Distinct runs of n characters."""
    return F.array_distinct(runs(text, n))


def runs(text: Column, n: int) -> Column:
    """Every run of n characters, in order."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def trigger_keys(triggers: DataFrame, frequency: DataFrame, begins: DataFrame, per: int = TEXTS_PER_SALT) -> DataFrame:
    """Keys per (t_client, t_text), with the `probe` that leads texts to them and the parts that their texts are met in; a text
    that the trigger matches has at least one of them (see `text_keys`).

    - Two or more long words: each form of the predicate but "text begins with the first word" and "text inside trigger"
      needs all words in the text without spaces but a fifth of them by the 0.8 rule; the last one may lack its last
      character. So the rarest gram of one word more than may be missing is enough.
    - Otherwise a gram of the trigger without spaces, from five characters on without its last one.
    - A gram that more than `COMMON_GRAM` texts have gives way to a run of five characters around it, one that `MORE_COMMON`
      times as many have to one of seven, where its word is as long.
    - For a text that begins with the first word (five letters or more): `^` and the first five, for the triggers in `begins`.
    - A trigger of one or two characters is its own key.
    - For a text inside a trigger, `<` and a run of four or eight characters that texts begin with: the text has its first
      four as a key, from eight characters on its first eight.

    `frequency`: see `gram_frequency`; grams without a row are in no text.
    """
    distinct = with_trigger_forms(triggers.select("t_client", "t_text").distinct())
    size, flat = F.size("t_words"), F.col("t_flat")
    words = F.filter(
        F.transform("t_words", lambda w, k: F.when(k == size - 1, F.left(w, F.length(w) - 1)).otherwise(w)), lambda w: F.length(w) >= 3
    )
    whole = F.when(F.length(flat) >= 5, F.col("t_cut")).otherwise(flat)
    parts = distinct.select(
        "t_client", "t_text", F.when(size >= 2, F.floor(size / 5) + 1).otherwise(1).cast("int").alias("wanted"),
        F.posexplode_outer(F.when(size >= 2, words).otherwise(F.array(whole))).alias("at", "form"),
    )
    # one gram per form, then the rarest of the forms
    picked = (
        parts.select("*", F.posexplode_outer(runs(F.col("form"), 3)).alias("start", "gram"))
        .join(frequency.select("t_client", "gram", "texts"), ["t_client", "gram"], "left")
        .groupBy("t_client", "t_text", "wanted", "at", "form")
        .agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram", "start")).alias("g"))
        .groupBy("t_client", "t_text", "wanted")
        .agg(F.sort_array(F.collect_list(F.struct("g.texts", "g.gram", "g.start", "form"))).alias("g"))
        .select("t_client", "t_text", F.explode_outer(F.slice("g", F.lit(1), F.col("wanted"))).alias("g"))
        .select("t_client", "t_text", "g.*")
    )
    length = F.when(F.col("texts") <= COMMON_GRAM, 3).when(F.col("texts") <= MORE_COMMON * COMMON_GRAM, LONG_GRAM).otherwise(LONGEST_GRAM)
    # the run holds the rarest gram and lies in the form; what it begins with leads to it
    start = F.greatest(F.lit(0), F.least(F.col("start"), F.length("form") - length))
    rare = (
        picked.filter("gram IS NOT NULL").withColumn("key", F.substring(F.col("form"), start + 1, length))
        .select("t_client", "t_text", "key", F.left("key", F.lit(3)).alias("probe"), F.ceil(F.col("texts") / per).alias("salts"))
    )
    first = begins.filter((F.size("t_words") >= 2) & (F.length("t_w1") >= 5)).select(
        "t_client", "t_text", F.concat(F.lit("^"), F.left(F.col("t_w1"), F.lit(5))).alias("key"), F.lit("^").alias("probe")
    )
    own = distinct.filter(F.length(flat) < 3).select("t_client", "t_text", flat.alias("key"), F.length(flat).cast("string").alias("probe"))
    run = F.explode_outer(F.concat(grams(flat, 4), F.when(F.length(flat) >= 8, grams(flat, 8)).otherwise(F.array().cast("array<string>"))))
    around = (
        distinct.filter(F.length(flat) >= 4).select("t_client", "t_text", F.length(flat).alias("size"), run.alias("run"))
        .withColumn("gram", F.concat(F.lit("<"), F.when(F.length("run") == 4, F.col("run")).otherwise(F.left(F.col("run"), F.lit(3)))))
        .join(frequency.select("t_client", "gram", "shortest"), ["t_client", "gram"])
        .filter(F.col("size") >= F.col("shortest"))  # a text can only lie inside a trigger that is as long
        .select("t_client", "t_text", F.concat(F.lit("<"), F.col("run")).alias("key"), F.lit("<").alias("probe"))
    )
    # only a key of three characters can be as frequent as its gram
    salts = F.when((F.length("key") == 3) & (F.length("probe") == 3), F.greatest(F.lit(1), F.col("salts"))).otherwise(1).cast("int")
    others = first.unionByName(own).unionByName(around).withColumn("salts", F.lit(1).cast("long"))
    return rare.unionByName(others).withColumn("salts", salts)


def gram_frequency(texts: DataFrame) -> DataFrame:
    """t_client, gram, texts (that hold it) and their shortest length: for every gram of a client's texts, and with a `<` for
    what texts begin with: four characters of those under eight, three of the longer ones."""
    flat, size = F.col("s_flat"), F.length("s_flat")
    head = F.when(size >= 8, F.array(F.concat(F.lit("<"), F.left(flat, F.lit(3))))).when(
        size >= 4, F.array(F.concat(F.lit("<"), F.left(flat, F.lit(4))))
    ).otherwise(F.array().cast("array<string>"))
    # map-side combine leaves a row for each gram of a client and task
    return (
        texts.select(F.col("client_id").alias("t_client"), size.alias("size"), F.explode_outer(F.concat(grams(flat), head)).alias("gram"))
        .groupBy("t_client", "gram").agg(F.count(F.lit(1)).alias("texts"), F.min("size").alias("shortest"))
    )


def text_keys(texts: DataFrame, probes: DataFrame) -> DataFrame:
    """t_client, t_key, key, salt: keys of texts without spaces, of the kinds that triggers of their client have.

    `probes` has (t_client, probe, lengths of its keys and their parts, longest trigger). A gram of a text leads to the runs
    that begin with it, of the lengths in use; `^` to the five characters that the text begins with; `<` to its first four
    or eight; `1` and `2` to its single characters and pairs. So runs that no trigger asks for are not dealt out.
    """
    flat, size = F.col("s_flat"), F.length("s_flat")
    # runs have seven characters (spaces fill the last ones), the other two never
    found = F.concat(
        runs(F.concat(flat, F.lit(" " * (LONGEST_GRAM - 3))), LONGEST_GRAM),
        F.array(F.concat(F.lit("^"), F.left(flat, F.lit(5))), F.concat(F.lit("<"), F.left(flat, F.when(size < 8, 4).otherwise(8)))),
    )
    is_run = F.length("run") == LONGEST_GRAM
    key = F.when(is_run, F.left(F.col("run"), F.col("k.size"))).otherwise(F.col("run"))
    many = (
        texts.select(F.col("client_id").alias("t_client"), F.col("s_key").alias("t_key"), size.alias("size"), F.explode_outer(F.array_distinct(found)).alias("run"))
        .withColumn("probe", F.when(is_run, F.left(F.col("run"), F.lit(3))).otherwise(F.left(F.col("run"), F.lit(1))))
        .join(probes, ["t_client", "probe"])
        .filter((F.col("probe") != "<") | (F.col("size") <= F.col("longest")))
        .select("t_client", "t_key", "run", F.explode("lengths").alias("k"))
        .select("t_client", "t_key", key.alias("key"), F.pmod("t_key", "k.salts").cast("int").alias("salt"))
        .filter(~F.contains("key", F.lit(" ")))
    )
    short = probes.filter(F.col("probe").isin("1", "2")).select(F.col("t_client").alias("client_id")).distinct()
    few = texts.join(short, "client_id").select(
        F.col("client_id").alias("t_client"), F.col("s_key").alias("t_key"), F.explode_outer(F.concat(grams(flat, 1), grams(flat, 2))).alias("key"), F.lit(0).alias("salt")
    )
    return many.unionByName(few)


def candidate_pairs(texts: DataFrame, triggers: DataFrame, per: int = TEXTS_PER_SALT, begins: DataFrame | None = None) -> DataFrame:
    """Pairs (t_client, t_text, t_key) of triggers and texts that share a key; one that shares two keys comes twice.

    `texts` has client_id, s_flat and s_key. Texts of a key that many texts of a client have are met in parts of about `per`.
    `begins`: the triggers that texts are to meet by their beginning, if not all.
    """
    # filters on a generator's input would repeat the cleaning for every row: the generators are outer ones
    texts = texts.filter("client_id IS NOT NULL").select("client_id", "s_key", "s_flat")
    # written: grams, keys and what leads to them are small or needed whole before the texts are dealt out, and known to be
    # small they reach the texts where they are
    frequency = materialise(gram_frequency(texts), "gram-frequency")
    rows = materialise(trigger_keys(triggers, frequency, triggers if begins is None else begins, per).distinct(), "trigger-keys")
    probes = rows.groupBy("t_client", "probe").agg(
        F.collect_set(F.struct(F.length("key").alias("size"), "salts")).alias("lengths"),
        F.max(F.length(F.replace("t_text", F.lit(" "), F.lit("")))).alias("longest"),
    )
    probes = probes.withColumn("lengths", F.when(F.length("probe") == 3, F.col("lengths")).otherwise(F.slice("lengths", 1, 1)))
    keyed = text_keys(texts, materialise(probes, "trigger-probes"))
    rows = rows.select("t_client", "t_text", "key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return keyed.join(rows, ["t_client", "salt", "key"]).select("t_client", "t_text", "t_key")


def candidates(texts: DataFrame, triggers: DataFrame, per: int = TEXTS_PER_SALT) -> DataFrame:
    """Triggers by the texts that share a key with them: trigger columns, `t_key` (the text's `s_key`)."""
    return candidate_pairs(texts, triggers, per).join(triggers, ["t_client", "t_text"])


def matching_pairs(texts: DataFrame, triggers: DataFrame, per: int = TEXTS_PER_SALT, begins: DataFrame | None = None) -> DataFrame:
    """Pairs (t_client, t_text, t_key) that the predicate keeps; one may come twice. `texts` also has s_text.

    Pairs travel with the two texts alone. With `begins`, pairs by the beginning of the text are those of its triggers.
    """
    known = texts.select(F.col("client_id").alias("t_client"), F.col("s_key").alias("t_key"), "s_text").dropDuplicates(["t_client", "t_key"])
    pairs = candidate_pairs(texts, triggers, per, begins).join(known, ["t_client", "t_key"])
    pairs = pairs.withColumn("s_flat", F.replace("s_text", F.lit(" "), F.lit("")))
    return with_trigger_forms(pairs).filter(matches()).select("t_client", "t_text", "t_key")


def verified(texts: DataFrame, triggers: DataFrame, per: int = TEXTS_PER_SALT) -> DataFrame:
    """Triggers by the texts that they match, once each: trigger columns, `t_key`. `texts` also has s_text."""
    return matching_pairs(texts, triggers, per).distinct().join(triggers, ["t_client", "t_text"])


def search_columns(description: Column, payee: Column) -> dict[str, Column]:
    """Search text of a row: cleaned description, description, payee (absent payee is empty)."""
    d, p = F.coalesce(description, F.lit("")), F.coalesce(payee, F.lit(""))
    s = F.upper(tx.strip(F.concat_ws(" ", tx.strip_bank_noise(d), d, p)))
    return {"s_text": s, "s_ach": codes.is_ach_payment(d)}


def matches() -> Column:
    """Text predicate between search columns and trigger columns."""
    s, s_flat = F.col("s_text"), F.col("s_flat")
    t, t_flat, cut = F.col("t_text"), F.col("t_flat"), F.col("t_cut")
    w, w1, w2 = F.col("t_words"), F.col("t_w1"), F.col("t_w2")
    by_text = F.contains(s, t)
    flat_inside = F.contains(t_flat, s_flat) & (F.length(s_flat) >= 4)
    by_flat = (F.length(t_flat) >= 3) & (
        F.contains(s_flat, t_flat)
        | ((F.length(t_flat) >= 5) & F.contains(s_flat, cut))
        | (flat_inside & ((F.length(s_flat) >= 5) | (F.length(s_flat) * 10 >= F.length(t_flat) * 6)))
    )
    found = F.size(F.filter(w, lambda x: F.contains(s, x)))
    first_in = F.contains(s, w1)
    by_words = (F.size(w) >= 2) & (
        (found * 10 >= F.size(w) * 8)
        | (first_in & (F.length(w1) >= 5) & F.startswith(s_flat, w1))
        | (
            (F.size(w) == 2)
            & first_in
            & (
                F.contains(s_flat, w2)
                | ((F.length(w2) >= 4) & F.contains(s_flat, F.expr("left(t_w2, length(t_w2) - 1)")))
            )
        )
    )
    return (s != "") & (by_text | by_flat | by_words)


def rule_struct() -> Column:
    return F.struct("rule_pos", *RULE_FIELDS)


def begins_with_word() -> Column:
    """The form of the predicate by which a text matches every trigger of two or more long words that has its first word."""
    first = F.col("t_w1")
    return (F.size("t_words") >= 2) & F.contains(F.col("s_text"), first) & (F.length(first) >= 5) & F.startswith(F.col("s_flat"), first)


def allowed() -> Column:
    """Whether a search meets a trigger at all."""
    return (~F.col("t_ach_only") | F.col("s_ach")) & ~(F.col("coded_unknown") & F.col("t_dropped_when_coded"))


def indexed_tables(searches: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Searches with their key as `salt`, and triggers, written once: both are read several times by the index."""
    if "coded_unknown" not in searches.columns:
        searches = searches.withColumn("coded_unknown", F.lit(False))
    # an empty text matches nothing; its other columns spread it
    plain = [f.name for f in searches.schema if f.dataType.typeName() in ("string", "integer", "long")]
    key = F.when(F.col("s_text") == "", F.xxhash64(*plain)).otherwise(F.xxhash64("s_text"))
    searches = materialise(searches.withColumn("salt", key), "rule-searches")
    return searches.withColumn("s_flat", F.replace("s_text", F.lit(" "), F.lit(""))), materialise(trigger_table(rules), "rule-triggers")


def join_indexed(searches: DataFrame, triggers: DataFrame, how: str, begins: DataFrame | None = None, per: int = TEXTS_PER_SALT) -> DataFrame:
    """`indexed_tables` joined by the index, see `join_triggers`; a pair may come twice, and with `begins` see `matching_pairs`."""
    pairs = matching_pairs(searches.withColumnRenamed("salt", "s_key"), triggers, per, begins)
    triggers = pairs.join(triggers, ["t_client", "t_text"]).withColumnRenamed("t_key", "t_salt")
    condition = (F.col("client_id") == F.col("t_client")) & (F.col("salt") == F.col("t_salt")) & allowed() & matches()
    return searches.join(triggers, condition, how)


def join_triggers(searches: DataFrame, rules: DataFrame, how: str = "inner", per: int = TEXTS_PER_SALT, indexed: bool = False) -> DataFrame:
    """Searches (client_id, search columns, optional `coded_unknown`) joined to the triggers they match.

    The result keeps a `salt` column, which is a function of the search and may be used in grouping.
    """
    if "coded_unknown" not in searches.columns:
        searches = searches.withColumn("coded_unknown", F.lit(False))
    # derived from the finished text column, so the cleaning patterns run once per text
    searches = searches.select("*", F.replace("s_text", F.lit(" "), F.lit("")).alias("s_flat"))
    triggers = trigger_table(rules)
    if indexed:
        searches, triggers = indexed_tables(searches.drop("s_flat"), rules)
        triggers = verified(searches.withColumnRenamed("salt", "s_key"), triggers, per).withColumnRenamed("t_key", "t_salt")
    else:
        salts = client_salts(searches, per)
        searches = with_salt(searches, salts, "s_text")
        triggers = (
            triggers.join(salts.withColumnRenamed("client_id", "t_client"), "t_client")
            .withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
            .drop("salts")
        )
    condition = (
        (F.col("client_id") == F.col("t_client"))
        & (F.col("salt") == F.col("t_salt"))
        & allowed()
        & matches()
    )
    return searches.join(triggers, condition, how)


def first_rule(texts: DataFrame, rules: DataFrame, keys: list[str], description: str = "description",
               payee: str | None = "payee_name", indexed: bool = False) -> DataFrame:
    """First matching rule and trigger per distinct text; texts without a match keep null."""
    payee_col = F.col(payee) if payee else F.lit(None).cast("string")
    searches = texts.select("*", *[c.alias(n) for n, c in search_columns(F.col(description), payee_col).items()])
    if indexed:
        searches, triggers = indexed_tables(searches, rules)
        # of the triggers of one first word that a text begins with, only the first can win
        first = triggers.filter(F.length("t_w1") >= 5).groupBy("t_client", "t_w1", "t_ach_only", "t_dropped_when_coded").agg(
            F.min(F.when(F.size("t_words") >= 2, F.struct("rule_pos", "trigger_pos", "t_text", "t_words"))).alias("t")
        )
        hits = join_indexed(searches, triggers, "left", first.select("t_client", "t_w1", "t.t_text", "t.t_words"))
    else:
        hits = join_triggers(searches, rules, "left")
    best = F.min_by(
        F.struct(*RULE_FIELDS, F.col("rule_pos"), tx.strip(F.col("trigger")).alias("trigger")),
        F.when(F.col("rule_pos").isNotNull(), F.struct("rule_pos", "trigger_pos")),
    )
    return hits.groupBy(*keys, "salt").agg(best.alias("rule")).drop("salt")


def all_rules(texts: DataFrame, rules: DataFrame, keys: list[str], description: str = "description",
              payee: str | None = "payee_name", indexed: bool = False) -> DataFrame:
    """All matching rules per distinct text, once each, in rule order."""
    payee_col = F.col(payee) if payee else F.lit(None).cast("string")
    searches = texts.select("*", *[c.alias(n) for n, c in search_columns(F.col(description), payee_col).items()])
    if indexed:
        return all_rules_indexed(*indexed_tables(searches, rules), keys)
    hits = join_triggers(searches, rules)
    return (
        hits.groupBy(*keys, "salt")
        .agg(F.array_sort(F.collect_set(rule_struct())).alias("rules"))
        .drop("salt")
    )


def all_rules_indexed(searches: DataFrame, triggers: DataFrame, keys: list[str]) -> DataFrame:
    """`all_rules` over `indexed_tables`.

    A text that begins with a trigger's first word matches all triggers with that word, so they are listed once for each
    word, not in pairs. First words that one text begins with begin one another: the longest names the list.
    """
    head = F.left(F.col("t_w1"), F.lit(5)).alias("head")
    worded = triggers.filter((F.size("t_words") >= 2) & (F.length("t_w1") >= 5))
    words = materialise(worded.groupBy(F.col("t_client").alias("client_id"), head).agg(F.collect_set("t_w1").alias("firsts")), "first-words")
    begun = F.filter("firsts", lambda w: F.contains(F.col("s_text"), w) & F.startswith(F.col("s_flat"), w))
    searches = (
        searches.withColumn("head", F.left(F.col("s_flat"), F.lit(5))).join(words, ["client_id", "head"], "left")
        .withColumn("begun", F.array_max(begun)).drop("head", "firsts")
    )
    asked = searches.filter("begun IS NOT NULL").select("client_id", "begun", "s_ach", "coded_unknown").distinct()
    member = (F.col("client_id") == F.col("t_client")) & (F.left(F.col("begun"), F.lit(5)) == F.col("head")) & F.startswith("begun", "t_w1")
    lists = (
        asked.join(worded.withColumn("head", head), member & allowed())
        .groupBy("client_id", "begun", "s_ach", "coded_unknown").agg(F.array_sort(F.collect_set(rule_struct())).alias("listed"))
    )
    others = join_indexed(searches, triggers, "left", triggers.filter(F.lit(False)))
    in_list = F.coalesce(begins_with_word(), F.lit(False))
    per_text = others.groupBy(*keys, "salt").agg(
        F.collect_set(F.when(F.col("rule_pos").isNotNull() & ~in_list, rule_struct())).alias("own"),
        *[F.max(c).alias(c) for c in ("begun", "s_ach", "coded_unknown")],
    ).filter((F.size("own") > 0) | F.col("begun").isNotNull())
    # texts without a list are spread by a stand-in that no list has
    named = per_text.withColumn("begun", spread_key(F.col("begun"), F.col("salt")))
    joined = named.join(lists, ["client_id", "begun", "s_ach", "coded_unknown"], "left")
    own = F.filter("own", lambda r: ~F.array_contains("listed", r))
    rules = F.when(F.col("listed").isNull(), F.array_sort("own")).when(F.size("own") == 0, F.col("listed")).otherwise(F.array_sort(F.concat("listed", own)))
    return joined.withColumn("rules", rules).filter(F.size("rules") > 0).select(*keys, "rules")


def vendor_map(rules: DataFrame) -> DataFrame:
    """Vendor code to rule: an explicit code first, else a code inside a trigger; first rule wins."""
    explicit = F.transform(
        F.array(tx.strip(F.coalesce("vendor_code", F.lit("")))), lambda c: F.struct(F.lit(1).alias("via"), c.alias("code"))
    )
    in_triggers = F.transform(
        F.flatten(
            F.transform("trigger_payee_contains", lambda t: F.regexp_extract_all(F.upper(t), F.lit(r"\b(\d{4})\b"), 1))
        ),
        lambda c: F.struct(F.lit(2).alias("via"), c.alias("code")),
    )
    rows = rules.select("client_id", "rule_pos", *RULE_FIELDS, F.explode(F.concat(explicit, in_triggers)).alias("c"))
    return (
        rows.filter(F.col("c.code") != "")
        .groupBy("client_id", F.col("c.code").alias("code"))
        .agg(F.min_by(rule_struct(), F.struct("c.via", "rule_pos")).alias("vendor_rule"))
    )


def match_vendor_code(texts: DataFrame, rules: DataFrame, description: str = "description") -> DataFrame:
    """Adds `ach_payment`, `code`, `vendor_rule` to the texts."""
    coded = texts.withColumn("ach_payment", codes.is_ach_payment(F.col(description))).withColumn(
        "code", codes.ach_vendor_code(F.col(description))
    )
    # most texts have no code: a key of their own spreads them, and no rule has it
    keyed = coded.withColumn("_code", spread_key(F.col("code"), F.col(description)))
    return keyed.join(vendor_map(rules).withColumnRenamed("code", "_code"), ["client_id", "_code"], "left").drop("_code")


def spread_key(key: Column, text: Column) -> Column:
    """The key, or for rows without one a stand-in by their text, so that they don't all go to one task of a join."""
    return F.coalesce(key, F.concat(F.lit("none-"), F.pmod(F.xxhash64(text), F.lit(4096)).cast("string")))


def vendor_reason(ach_payment: Column, code: Column, vendor_rule: Column) -> Column:
    """Why an ACH vendor payment has no mapping."""
    from tallyspark import constants as K

    return F.when(ach_payment & code.isNull(), F.lit(K.REASON_NO_CODE)).when(
        ach_payment & vendor_rule.isNull(), F.concat(F.lit("No rule mapping found for ACH vendor code "), code, F.lit("."))
    )


def rules_missing_in_coa(rules: DataFrame, coa: DataFrame) -> DataFrame:
    """Rules with ID and name of which neither is in the client's chart of accounts."""

    def key(c: str) -> Column:
        return F.lower(tx.strip(F.col(c)))

    ids = coa.select("client_id", key("account_id").alias("id_key")).distinct()
    names = coa.select("client_id", key("account").alias("name_key")).distinct()
    named = rules.withColumn("id_key", key("account_id")).withColumn("name_key", key("account_name"))
    named = named.filter((F.col("id_key") != "") & (F.col("name_key") != ""))
    return (
        named.join(ids, ["client_id", "id_key"], "left_anti").join(names, ["client_id", "name_key"], "left_anti")
        .drop("id_key", "name_key")
    )


def proposal_rules(proposals: DataFrame, rules: DataFrame) -> DataFrame:
    """Model proposals gated: first rule by name or ID (equal or contained), else by rule ID.

    Gives per (client_id, description) the rule for plain rows and for coded rows without mapping, the
    confidence held in [0, 1] and the rejection text when the confidence is below the minimum.
    """
    from tallyspark import constants as K

    salts = client_salts(proposals)
    flagged = with_generic_flags(rules).join(salts, "client_id").select(
        F.col("client_id").alias("r_client"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("r_salt"), "rule_pos", *RULE_FIELDS, F.lower(tx.strip(F.col("account_name"))).alias("r_name"),
        F.lower(tx.strip(F.col("account_id"))).alias("r_account"),
        (F.col("generic_only") & ~F.col("client_all_generic")).alias("t_dropped_when_coded"),
    )
    offered = with_salt(proposals, salts, "description").select(
        "salt",
        "client_id", "description", F.lower("account_name").alias("p_name"), F.lower("account_id").alias("p_account"),
        F.col("rule_id").alias("p_rule"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))).alias("confidence"),
    )
    by_name = (F.coalesce("p_name", F.lit("")) != "") & (F.col("r_name") != "") & F.contains(F.col("r_name"), F.col("p_name"))
    by_account = (F.coalesce("p_account", F.lit("")) != "") & (F.col("r_account") != "") & F.contains(F.col("r_account"), F.col("p_account"))
    by_rule = F.col("rule_id") == F.col("p_rule")
    hit = F.coalesce(by_name, F.lit(False)) | F.coalesce(by_account, F.lit(False))
    joined = offered.join(
        flagged, (F.col("client_id") == F.col("r_client")) & (F.col("salt") == F.col("r_salt")) & (hit | F.coalesce(by_rule, F.lit(False))), "left"
    )
    order = F.struct(F.when(hit, 1).otherwise(2), F.col("rule_pos"))
    picked = joined.groupBy("client_id", "salt", "description", "confidence").agg(
        F.min_by(rule_struct(), F.when(F.col("rule_pos").isNotNull(), order)).alias("any_rule"),
        F.min_by(rule_struct(), F.when(F.col("rule_pos").isNotNull() & ~F.col("t_dropped_when_coded"), order)).alias(
            "specific_rule"
        ),
    )
    accepted = F.col("confidence") >= K.MODEL_MIN_CONFIDENCE
    text = F.concat(
        F.lit("Artificial intelligence confidence "), F.col("confidence").cast("decimal(4,2)").cast("string"),
        F.lit(" is below the minimum threshold 0.70."),
    )
    return picked.select(
        "client_id", "description", "confidence",
        F.when(accepted, F.col("any_rule")).alias("any_rule"),
        F.when(accepted, F.col("specific_rule")).alias("specific_rule"),
        F.when(~accepted & F.col("any_rule").isNotNull(), text).alias("any_rejection"),
        F.when(~accepted & F.col("specific_rule").isNotNull(), text).alias("specific_rejection"),
    )
