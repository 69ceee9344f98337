"""Invariants and brute-force comparisons on small frames, with one key that holds most rows."""

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyspark.operators import cascade, ingest, loans, nearest, neighbours, review, rulebase, rules, statements, summary
from tallyspark.plans.fixtures import Inputs


def test_schedule_pays_off_the_principal(inputs):
    s = loans.schedules(loans.loan_terms(inputs.client_loans))
    got = s.groupBy("client_id", "loan_pos").agg(F.sum("principal_liability").alias("paid"), F.count("*").alias("n"))
    terms = loans.loan_terms(inputs.client_loans)
    worst = got.join(terms, ["client_id", "loan_pos"]).select(F.max(F.abs(F.col("paid") - F.col("principal")) / F.col("n"))).first()[0]
    assert worst < 0.01  # cents of rounding per month at most


def test_split_keeps_the_payment(inputs):
    rows = cascade.categorise(inputs.bank_txn, inputs.rules, inputs.check_register, inputs.client_loans)
    parts = rows.filter("split_part > 0").groupBy("row_pos").agg(F.count("*").alias("n"), F.sum(F.coalesce("credit", "debit")).alias("paid"))
    joined = parts.join(inputs.bank_txn, "row_pos").filter(F.abs(F.col("paid") - F.coalesce("credit", "debit")) > Decimal("0.011"))
    assert parts.count() > 0 and parts.filter("n <> 2").count() == 0
    # the last month of a term clears the balance and may differ from the payment
    assert joined.count() <= parts.count() * 0.05


def test_dedupe_is_idempotent(inputs):
    rows = inputs.bank_txn.withColumn("amount", F.coalesce("credit", -F.col("debit")))
    once = ingest.dedupe_output(rows.unionByName(rows))
    assert once.count() == ingest.dedupe_output(once).count() == ingest.dedupe_output(rows).count()


def test_matched_and_unmatched_add_up(inputs):
    rows = cascade.categorise(inputs.bank_txn, inputs.rules, inputs.check_register)
    r = summary.match_rates(rows, ["client_id"])
    assert r.filter("matched + unmatched <> total").count() == 0
    assert r.agg(F.sum("total")).first()[0] == inputs.bank_txn.count()


def test_first_rule_is_among_all_rules(inputs):
    keys = ["client_id", "description", "payee_name"]
    texts = inputs.bank_txn.select("client_id", "description", F.coalesce("payee_name", F.lit("")).alias("payee_name")).distinct()
    first = rules.first_rule(texts, inputs.rules, keys).filter("rule IS NOT NULL").select(*keys, "rule.rule_id")
    every = rules.all_rules(texts, inputs.rules, keys).select(*keys, F.col("rules.rule_id").alias("ids"))
    j = first.join(every, keys, "left")
    assert j.filter("ids IS NULL OR ids[0] <> rule_id").count() == 0 and first.count() == every.count()


def test_reapply_twice_equals_once(inputs):
    rows = cascade.categorise(inputs.bank_txn, inputs.rules)
    some = rows.filter("row_pos % 50 = 0").select("client_id", "transaction_fingerprint", F.lit("Draw").alias("account_name"), F.lit(None).cast("string").alias("category_type"))
    once = review.apply_overrides(rows, some, ["client_id"])
    twice = review.apply_overrides(once.drop("overridden"), some, ["client_id"])
    columns = ["row_pos", "account_name", "categorization_source", "needs_review_reason"]
    assert once.select(columns).exceptAll(twice.select(columns)).count() == 0


def brute_match(search: str, trigger: str) -> bool:
    s, t = search.upper().strip(), trigger.upper().strip()
    if not s or not t:
        return False
    sn, tn = s.replace(" ", ""), t.replace(" ", "")
    words = [w for w in t.split() if len(w) > 2]
    conditions = [
        t in s,
        len(tn) >= 3 and tn in sn,
        len(tn) >= 5 and tn[:-1] in sn,
        len(tn) >= 3 and len(sn) >= 5 and sn in tn,
        len(tn) >= 3 and len(sn) >= 4 and sn in tn and len(sn) / len(tn) >= 0.6,
        len(words) >= 2 and sum(w in s for w in words) >= len(words) * 0.8,
        len(words) >= 2 and words[0] in s and len(words[0]) >= 5 and sn.startswith(words[0]),
        len(words) == 2 and words[0] in s and (words[1] in sn or (len(words[1]) >= 4 and words[1][:-1] in sn)),
    ]
    return any(conditions)


@pytest.mark.parametrize("indexed", [False, True])
def test_rule_predicate_against_brute_force(spark, indexed):
    rng = random.Random(7)
    vocabulary = ["PILOT", "TRAVEL", "OF", "DEPOT", "AB", "MARKET", "PAY", "SHOPS", "LOVES", "X"]
    texts = sorted({" ".join(rng.choices(vocabulary, k=rng.randint(1, 4))) for _ in range(120)})
    triggers = [[" ".join(rng.choices(vocabulary, k=rng.randint(1, 3)))[: rng.randint(2, 20)] for _ in range(rng.randint(1, 3))] for _ in range(25)]
    rule_rows = [(1, p, f"r{p}", t, "", f"acc{p}", "Expense", "", None, False) for p, t in enumerate(triggers)]
    schema = "client_id int, rule_pos int, rule_id string, trigger_payee_contains array<string>, account_id string, account_name string, category_type string, logic string, vendor_code string, ach_vendor_only boolean"
    rule_df = spark.createDataFrame(rule_rows, schema)
    # one client holds every text; the search text is cleaned text + text, so the cleaned part is read back
    text_df = spark.createDataFrame([(1, t) for t in texts], "client_id int, description string")
    searched = {r.description: r.s for r in text_df.select("description", rules.search_columns(F.col("description"), F.lit(None).cast("string"))["s_text"].alias("s")).collect()}
    got = {r.description: (r.rule_id, r.trigger) for r in rules.first_rule(text_df, rule_df, ["client_id", "description"], payee=None, indexed=indexed).select("description", "rule.rule_id", "rule.trigger").collect()}
    for t in texts:
        want = next(((f"r{p}", x.strip()) for p, ts in enumerate(triggers) for x in ts if brute_match(searched[t], x)), (None, None))
        assert got[t] == want, t


def test_index_of_grams_loses_no_pair(spark):
    """Every pair of the predicate is a candidate, over odd spaces, short texts and triggers of one to nine words."""
    rng = random.Random(11)
    letters = "ABCDE"
    words = ["".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(60)]
    texts = sorted({"".join(w + rng.choice(["", " ", "  "]) for w in rng.choices(words, k=rng.randint(1, 9))).strip() for _ in range(400)} | {"", "A", "ABCD"})
    triggers = sorted({" ".join(rng.choices(words, k=rng.choice([1, 1, 2, 2, 3, 4, 5, 6, 9])))[: rng.randint(1, 40)].strip() for _ in range(150)} - {""})
    # words of a text hidden behind a trigger with one word exchanged, and texts inside a trigger
    long = [" ".join(rng.sample([w for w in words if len(w) > 3], 6)) for _ in range(20)]
    texts += [" ".join(t.split()[1:]) + " X" for t in long] + [t[3:12] for t in long]
    triggers += long
    rows = [(1, p, f"r{p}", [t], "", f"acc{p}", "Expense", "", None, False) for p, t in enumerate(triggers)]
    schema = "client_id int, rule_pos int, rule_id string, trigger_payee_contains array<string>, account_id string, account_name string, category_type string, logic string, vendor_code string, ach_vendor_only boolean"
    table = rules.trigger_table(spark.createDataFrame(rows, schema))
    frame = spark.createDataFrame([(1, k, t, t.replace(" ", "")) for k, t in enumerate(texts)], "client_id int, s_key long, s_text string, s_flat string")
    got = {(r.t_key, r.rule_pos) for r in rules.candidates(frame, table, per=50).select("t_key", "rule_pos").collect()}
    want = {(k, p) for k, s in enumerate(texts) for p, t in enumerate(triggers) if brute_match(s, t)}
    assert len(want) > 1000 and want <= got


def test_index_keys_of_common_words_lose_no_pair(spark, monkeypatch):
    """Longer runs for common grams, texts that begin with a trigger's word, and texts of a common key in parts."""
    monkeypatch.setattr(rules, "COMMON_GRAM", 3)
    rng = random.Random(5)
    words = ["PAYMENT", "VENDOR", "SMALL", "BOLT", "LOT", "AB", "X"]
    texts = sorted({" ".join(rng.choices(words, k=rng.randint(1, 4)) + [str(rng.randint(9990, 10060))]) for _ in range(300)} | {"VENDOR", "BOLT", "LLBOLTLO", "NT 1000"})
    triggers = sorted({" ".join(rng.choices(words, k=rng.randint(1, 3)) + [str(rng.randint(999, 10060))]) for _ in range(80)} | {"BOLT", "AB", "PAYMENT"})
    schema = "client_id int, rule_pos int, rule_id string, trigger_payee_contains array<string>, account_id string, account_name string, category_type string, logic string, vendor_code string, ach_vendor_only boolean"
    table = rules.trigger_table(spark.createDataFrame([(1, p, f"r{p}", [t], "", f"acc{p}", "Expense", "", None, False) for p, t in enumerate(triggers)], schema))
    frame = spark.createDataFrame([(1, k, t, t.replace(" ", "")) for k, t in enumerate(texts)], "client_id int, s_key long, s_text string, s_flat string")
    got = [(r.t_key, r.rule_pos) for r in rules.verified(frame, table, per=20).select("t_key", "rule_pos").collect()]
    want = {(k, p) for k, s in enumerate(texts) for p, t in enumerate(triggers) if brute_match(s, t)}
    assert len(want) > 500 and sorted(got) == sorted(want)


def test_index_of_grams_meets_hardly_more_than_matches(inputs):
    """Texts and triggers that share a common word alone are no pair."""
    frame = inputs.part_text.select("client_id", "description").distinct()
    frame = frame.select("client_id", rules.search_columns(F.col("description"), F.lit(None).cast("string"))["s_text"].alias("s_text")).select(
        "client_id", "s_text", F.xxhash64("s_text").alias("s_key"), F.replace("s_text", F.lit(" "), F.lit("")).alias("s_flat")
    )
    table = rules.trigger_table(inputs.part_rules)
    met, matched = (f(frame, table).select("t_client", "t_key", "rule_pos", "trigger_pos").distinct().count() for f in (rules.candidates, rules.verified))
    assert 0 < matched and met < 2 * matched, (met, matched)


def test_index_of_grams_verifies_few_pairs(inputs):
    """Pairs per text stay far below the triggers of its client."""
    texts = inputs.part_text.select("client_id", "description").distinct()
    searched = texts.select("client_id", rules.search_columns(F.col("description"), F.lit(None).cast("string"))["s_text"].alias("s_text"))
    frame = searched.select("client_id", F.xxhash64("s_text").alias("s_key"), F.replace("s_text", F.lit(" "), F.lit("")).alias("s_flat"))
    table = rules.trigger_table(inputs.part_rules)
    every = frame.join(table, F.col("client_id") == F.col("t_client")).count()
    met = rules.candidates(frame, table).select("t_client", "t_key", "rule_pos", "trigger_pos").distinct().count()
    assert 0 < met * 3 < every


RULE_SCHEMA = "client_id int, rule_pos int, rule_id string, trigger_payee_contains array<string>, account_id string, account_name string, category_type string, logic string, vendor_code string, ach_vendor_only boolean"


def both_ways(texts, table):
    """First and all rules by the plain join and by the index, as comparable rows."""
    keys = ["client_id", "description", "payee_name"]
    for f, column in ((rules.first_rule, "rule"), (rules.all_rules, "rules")):
        yield [sorted(map(str, f(texts, table, keys, indexed=indexed).select(*keys, column).collect())) for indexed in (False, True)]


def test_indexed_match_writes_no_pair_for_a_common_first_word(spark, monkeypatch):
    """Texts that begin with the first word of every trigger match all of them; the index lists those once."""
    kept = {}
    pairs, write = rules.candidate_pairs, rules.materialise
    monkeypatch.setattr(rules, "candidate_pairs", lambda *a, **b: kept.setdefault("pairs", []).append(pairs(*a, **b)) or kept["pairs"][-1])
    monkeypatch.setattr(rules, "materialise", lambda df, name: kept.setdefault(name, write(df, name)) if name == "trigger-keys" else write(df, name))
    n = 300
    table = spark.createDataFrame([(1, k, f"r{k}", [f"small bolt lot {70000 + 7 * k}", f"Brand {70000 + 7 * k}"], "", f"acc{k}", "x", "", None, False) for k in range(n)], RULE_SCHEMA)
    texts = spark.createDataFrame([(1, f"small bolt {70000 + 7 * k} LOT", "") for k in range(n)], "client_id int, description string, payee_name string")
    for plain, indexed in both_ways(texts, table):
        assert indexed == plain and len(plain) == n
    assert all(p.count() < 20 * n for p in kept["pairs"])
    assert kept["trigger-keys"].count() < 5 * 2 * n


def test_indexed_match_equals_the_plain_join(spark):
    """First words inside one another, ACH rules, generic rules of coded rows, matches beside the listed ones."""
    r = random.Random(3)
    words = ["SMALL", "SMALLER", "SMALLEST", "HOT", "BOLT", "LOT 5", "PAYMENT", "WIRE", "AB", "LOANS"]
    table = spark.createDataFrame(
        [(k % 2, k, f"r{k}", [" ".join(r.choices(words, k=r.randint(1, 3))) + r.choice(["", f" {r.randint(1, 40)}"]) for _ in range(r.randint(1, 2))], "", f"acc{k}", "x", "", None, k % 3 == 0) for k in range(80)], RULE_SCHEMA
    )
    texts = {(k % 3, r.choice(["", "ACH DEBIT VENDOR PAYMENT ", "SMA "]) + r.choice(["", " "]).join(r.choices(words, k=r.randint(1, 4))) + f" {r.randint(1, 40)}", r.choice(["", "HOT"])) for k in range(250)}
    coded = {t: r.random() < 0.3 for t in texts}
    frame = spark.createDataFrame([(*t, coded[t]) for t in sorted(texts)], "client_id int, description string, payee_name string, coded_unknown boolean")
    for plain, indexed in both_ways(frame, table):
        assert indexed == plain and len(plain) > 100


@pytest.mark.parametrize("blocks", [(7, 5, 4), (1000, 1000, 1000), (1000, 3, 9)])
def test_neighbours_against_brute_force(spark, blocks):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(90, 6)).round(3)
    client = [0 if k % 3 else 1 + k % 4 for k in range(90)]  # client 0 holds two thirds
    rows = [(client[k], k, [float(x) for x in vectors[k]]) for k in range(90)] + [(0, 900, [0.0] * 6)]
    df = spark.createDataFrame(rows, "client_id int, vec_id long, embedding array<double>")
    q = df.withColumnRenamed("vec_id", "txn_id")
    got = neighbours.top_k(q, df, 4, exclude_self=True, query_block=blocks[0], corpus_block=blocks[1], cell_rows=blocks[2])
    found = {(r.query_id, r["rank"]): (r.entry_id, r.score) for r in got.collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    expected = {}
    for a in range(90):
        scored = sorted((-round(float(unit[a] @ unit[b]), 6), b) for b in range(90) if b != a and client[a] == client[b])
        for n, (s, b) in enumerate(scored[:4]):
            expected[(a, n + 1)] = (b, -s)
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in expected.items()}


def clustered(n, seed=5):
    """Vectors around 40 directions; every fourth one is a copy of the first, so that many scores tie."""
    rng = np.random.default_rng(seed)
    around = rng.normal(size=(40, 12))
    v = around[np.arange(n) % 40] + 0.05 * rng.normal(size=(n, 12))
    v[::4] = v[0]
    return v.astype(np.float32).astype(np.float64)


def test_neighbours_prune_cells_and_keep_ties(spark):
    pairs = {}
    for n in (600, 1200, 2400):
        v = clustered(n)
        rows = spark.createDataFrame([(1, k, [float(x) for x in v[k]]) for k in range(n)], "client_id int, vec_id long, embedding array<float>")
        asked = rows.withColumnRenamed("vec_id", "txn_id")
        found, visits = nearest.search(asked, rows, 5, exclude_self=True, query_block=500, corpus_block=500, cell_rows=10)
        pairs[n] = visits.agg({"rows": "sum"}).collect()[0][0]
        assert visits.groupBy("id", "cell").count().filter("count > 1").count() == 0
        if n == 600:
            unit = v / np.linalg.norm(v, axis=1, keepdims=True)
            scores = np.round(unit @ unit.T, 6)
            got = {}
            for r in found.orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append((r.entry_id, r.score))
            for a in range(n):
                order = [b for b in np.lexsort((np.arange(n), -scores[a])) if b != a][:5]
                assert [e for e, _ in got[a]] == order, a
    # a client of twice the rows visits clearly less than four times the pairs, copies (a quarter of its rows) included
    assert pairs[2400] < 3 * pairs[1200] < 9 * pairs[600], pairs
    assert pairs[2400] < 0.2 * 2400**2, pairs


def test_neighbours_of_unusable_vectors_and_empty_tables(spark):
    schema = "client_id int, vec_id long, embedding array<double>"
    rows = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 0.0]), (1, 3, None), (1, 4, [None, 1.0]), (1, 5, [float("nan"), 1.0]), (1, 6, [1.0, 1.0]), (2, 7, [1.0, 0.0])], schema)
    asked = rows.withColumnRenamed("vec_id", "txn_id")
    got = {(r.query_id, r.entry_id) for r in neighbours.top_k(asked, rows, 3, exclude_self=True).collect()}
    assert got == {(1, 6), (6, 1)}
    none = spark.createDataFrame([], schema)
    assert neighbours.top_k(asked, none, 3).count() == 0
    assert neighbours.top_k(none.withColumnRenamed("vec_id", "txn_id"), rows, 3).count() == 0


def brute_absorb(groups):
    groups, kept = [dict(g, t=set(g["t"])) for g in groups], []
    done = set()
    for a, g in enumerate(groups):
        if a in done:
            continue
        for b, h in enumerate(groups):
            if a != b and b not in done and g["id"] == h["id"] and g["t"] and h["t"] and len(g["t"] & h["t"]) / len(g["t"] | h["t"]) > 0.7:
                g["t"] |= h["t"]
                done.add(b)
        done.add(a)
        kept.append((g["pos"], tuple(sorted(g["t"]))))
    return sorted(kept)


def brute_final(rows):
    last, out = {}, []
    for pos, name, t in rows:
        key, s = name.lower().strip(), set(t)
        if key in last and s and set(last[key][2]) and len(s & set(last[key][2])) / len(s | set(last[key][2])) > 0.5:
            last[key][2] = sorted(s | set(last[key][2]))
            continue
        row = [pos, name, list(t)]
        last[key] = row
        out.append(row)
    return sorted((p, tuple(sorted(t))) for p, _, t in out)


def test_rule_merging_against_brute_force(spark):
    rng = random.Random(11)
    pool = [f"T{k}" for k in range(9)]
    base = [(p, rng.choice("AB"), f"Name {rng.randint(0, 3)}", sorted(set(rng.choices(pool, k=rng.randint(1, 7))))) for p in range(60)]
    merged_rows = [(1, i, p, f"r{p}", i, n, "Expense", "", None, False, t) for p, i, n, t in base]
    schema = "client_id int, norm_id string, rule_pos int, rule_id string, account_id string, account_name string, category_type string, logic string, vendor_code string, ach_vendor_only boolean, trigger_payee_contains array<string>"
    df = spark.createDataFrame(merged_rows, schema)
    got = sorted((r.rule_pos, tuple(r.trigger_payee_contains)) for r in rulebase.absorb_similar(df).collect())
    assert got == brute_absorb([{"pos": p, "id": i, "t": t} for p, i, _, t in base])
    final = sorted((r.rule_pos, tuple(sorted(r.trigger_payee_contains))) for r in rulebase.final_dedupe(df).collect())
    assert final == brute_final([(p, n, t) for p, _, n, t in base])


def test_running_values_do_not_depend_on_blocks(spark):
    rng = random.Random(5)
    rows = [(0 if rng.random() < 0.7 else 1, k, rng.choice(["h", "s", None, None]), rng.random() < 0.3) for k in range(400)]
    df = spark.createDataFrame(rows, "statement_id int, line_no int, v string, f boolean")
    got = statements.running(df, ["statement_id"], "line_no", {"last_v": "v"}, {"n": "f"}, {"all_f": "f"}, block=16)
    w = W.partitionBy("statement_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    want = df.select("*", F.last("v", True).over(w).alias("last_v"), F.count_if("f").over(w).alias("n"), F.count_if("f").over(W.partitionBy("statement_id")).alias("all_f"))
    assert got.exceptAll(want).count() == 0 and got.count() == 400


def test_batches_over_buckets(spark):
    df = spark.createDataFrame([(0, k * 30_001) for k in range(100)] + [(1, 5)], "client_id int, row_pos long")
    got = {(r.client_id, r.row_pos): (r.batch_num, r.batch_total) for r in ingest.batches(df, ["client_id"], "row_pos", 10).collect()}
    assert got[(1, 5)] == (1, 1)
    assert all(got[(0, k * 30_001)] == (k // 10 + 1, 10) for k in range(100))


def test_views_keep_all_rows(spark):
    i = Inputs(spark, "/root/testdata/sf0.001")
    assert i.bank_txn.count() == i.orders.count() and i.gl_entry.count() == i.lineitem.count() and i.ledger_vectors.count() == i.embeddings.count()
    assert i.check_register.count() == i.part.count() and i.client_loans.count() == i.orders.count()
    assert i.web_event.count() == i.events.count() and i.query_vectors.count() == i.embeddings.count()


def test_neighbours_blocks_follow_the_length_of_the_vectors(spark, monkeypatch):
    n, rng = 5000, np.random.default_rng(8)
    v = rng.normal(size=(n, 4)).round(3)
    rows = spark.createDataFrame([(1, k, [float(x) for x in v[k]]) for k in range(n)], "client_id int, vec_id long, embedding array<double>")
    asked = rows.withColumnRenamed("vec_id", "txn_id")
    whole, visits = nearest.search(asked, rows, 3, exclude_self=True)
    # short vectors fit one task's memory: each query travels once, and so does each row for a block of queries
    assert visits.count() == n
    for name, values in {"QUERY_VALUES": 4 * 700, "CELL_VALUES": 4 * 500, "PART_VALUES": 4 * 900}.items():
        monkeypatch.setattr(nearest, name, values)
    parts, visits = nearest.search(asked, rows, 3, exclude_self=True)
    assert visits.count() > n
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_rows_of_small_cells_travel_to_few_blocks(spark, monkeypatch):
    """What a part leaves free is room for queries: 1,000 queries meet 300 rows in two blocks, not in ten."""
    rng = np.random.default_rng(9)
    frames = [spark.createDataFrame([(1, k, [float(x) for x in rng.normal(size=3)]) for k in range(n)], f"client_id int, {key} long, embedding array<double>") for n, key in ((1000, "txn_id"), (300, "vec_id"))]
    sent, grouped = [], nearest._cogroup
    monkeypatch.setattr(nearest, "_cogroup", lambda left, right, *how: (sent.append((left.count(), right.count())), grouped(left, right, *how))[1])
    found = nearest.top_k(*frames, 2, query_block=100, corpus_block=1000)
    assert found.count() == 2000 and sent == [(1000, 600)], sent


def test_name_search_reads_its_tables_once(inputs):
    """The result stands on written facts, not on the tables again (which Spark would collect for one more broadcast)."""
    from tallyspark.catalog import load

    out = load()["j20_name_search"].build(inputs)
    assert out.count() > 0 and not [f for f in out.inputFiles() if "/sf0.001/" in f]


def test_dates_and_amounts_of_ledgers(spark):
    from tallyspark.functions import dates, money, text as tx

    texts = {
        " 1/2/2024\t": "2024-01-02", "13/2/2024": "2024-02-13", "2/30/2024": None, "2024-2-9": "2024-02-09", "2023-02-29": None, "1/2/68": "2068-01-02", "1/2/69": "1969-01-02",
        "29/2/72": "1972-02-29", "12/31/2075": "2075-12-31", "2080-01-05": "2080-01-05", "1/2/024": None, "1-2-2024": None, "Q1": None, "": None, None: None,
    }
    frame = spark.createDataFrame([(k, v) for k, v in texts.items()], "t string, want string")
    got = frame.select("t", "want", dates.parse_date(F.col("t")).cast("string").alias("got"), dates.iso_or_text(F.col("t")).alias("iso"), tx.strip(F.col("t")).alias("bare")).collect()
    for r in got:
        assert r.got == r.want and r.iso == (r.want or r.bare or None), r
    amounts = {"($1,234.50)": "1234.50", "$-5": "-5.00", "x": "0.00", "": "0.00", None: "0.00", " 7 ": "7.00"}
    rows = spark.createDataFrame([(k, v) for k, v in amounts.items()], "t string, want string")
    assert all(r.got == r.want for r in rows.select("want", money.ledger_amount(F.col("t")).cast("string").alias("got")).collect())
    plan = frame.select(dates.iso_or_text(F.col("t")), tx.strip(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "gettimestamp" not in plan  # patterns cost most of a row's time
