import hashlib
import random
import re
import struct

import xxhash
from pyspark.sql import functions as F
from small import documents, rows

from tallyspark.llm import syncmers


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return seed & 0xFFFFFFFF


def plain_units(run):
    """A run of more than 16 characters is cut where the hash of three characters is less than at two places on either side."""
    if len(run) <= 16:
        return [run]
    h = []
    for i in range(len(run) - 2):
        seed = 42
        for c in run[i : i + 3]:
            seed = xxhash.xxh64_intdigest(c, seed)
        h.append(signed(seed))
    cuts = [i for i in range(2, len(h) - 2) if h[i] < min(h[i - 2], h[i - 1], h[i + 1], h[i + 2])]
    parts = [run[a:b] for a, b in zip([0, *cuts], [*cuts, len(run)])]
    return [p[k : k + 16] for p in parts for k in range(0, len(p), 16)]


def plain_anchors(text):
    h = [signed(xxhash.xxh64_intdigest(u, 42)) for run in re.findall(r"[^\x20\x09-\x0D]+", text) for u in plain_units(run)]
    out = []
    for i in range(len(h) - 3):
        if min(h[i], h[i + 3]) <= min(h[i + 1], h[i + 2]):
            out.append((i, chained(h[i : i + 4])))
    return out or ([(0, chained(h))] if h else [])


def distinct(text):
    return list(dict.fromkeys(a for _, a in plain_anchors(text)))


def like(a, b):
    return 1.0 if not a and not b else 2 * len(set(a) & set(b)) / (len(a) + len(b))


def expected(data):
    """(doc_id, text): the query's rows."""
    unique = {(i, t or "") for i, t in data}
    order = sorted(unique, key=lambda x: (x[0] is None, -(x[0] or 0), signed(xxhash.xxh64_intdigest(x[1], 42))))
    after = {k: order[(j + 1) % len(order)] for j, k in enumerate(order)}
    out = []
    for i, t in data:
        t = t or ""
        follow = after[i, t][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + follow[:cut]
        own, changed = distinct(t), distinct(edited)
        hexes = ["".join(f"{a:08x}" for a in x) for x in (own, changed)]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *hexes, like(own, changed), like(own, distinct(follow))))
    return sorted(out, key=str)


def test_anchors(spark):
    texts = ["", " \n", "one", "a b c", "a b c d", "the the the the the", "x" * 90, " ".join(f"w{i % 13}é" for i in range(200))]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", syncmers.anchors(F.col("text")).alias("a")).collect()
    assert all([tuple(x) for x in r["a"]] == plain_anchors(r["text"]) for r in got)


def test_whole_tables(spark, sf_small):
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for docs, data in (
        (documents(spark), [(i, t) for i, t, *_ in rows()]),
        (d := spark.read.parquet(f"{sf_small}/documents.parquet"), [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()]),
        (documents(spark, rows()[:1]), [rows()[0][:2]]),
    ):
        result = syncmers.query(docs)
        assert result.columns == columns
        assert sorted(map(tuple, result.collect()), key=str) == expected(data)
    assert syncmers.query(documents(spark, [])).count() == 0


def test_shared_anchors_stand_at_one_shift(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    pairs = spark.createDataFrame([(1, passage, 2, "some words before it " + passage)], "left_id long, left_text string, right_id long, right_text string")
    best = syncmers.shared_anchors(pairs).orderBy(F.desc("anchors")).first()
    assert best["shift"] == 4 and best["anchors"] == len(plain_anchors(passage))


def test_passage_without_spaces_keeps_its_anchors(spark):
    r = random.Random(3)
    for letters in ([chr(k) for k in range(0x4E00, 0x5200)], list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), ["\U0001f600", "é", "a", "語"]):
        def noise(n):
            return "".join(r.choices(letters, k=n))

        before, passage, behind = noise(50), noise(600), noise(50)
        texts = [before + passage + behind] + [before + noise(k) + passage + behind for k in range(1, 16)] + [passage]
        # one more character in the middle
        texts.append(before + passage[:300] + noise(1) + passage[300:] + behind)
        frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
        got = {x["i"]: set(x["h"]) for x in frame.select("i", syncmers.anchor_hashes(F.col("text")).alias("h")).collect()}
        assert len(got[0]) > 20
        assert all(len(got[0] & got[i]) > 0.75 * len(got[0]) for i in got)


def test_runs_of_any_length_are_cut_by_content(spark):
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    cases = []
    for n in (20, 30, 45, 60, 64, 65, 100):
        for k in range(40):
            run = "".join(r.choices(letters, k=n))
            cases.append((n, run, "".join(r.choices(letters, k=1 + k % 15)) + run))
    hashes = [F.array_distinct(syncmers.unit_hashes(F.col(c))) for c in ("a", "b")]
    frame = spark.createDataFrame(cases, "n int, a string, b string").select("n", *(h.alias(c) for h, c in zip(hashes, "ab")))
    kept, units = {}, {}
    for x in frame.collect():
        kept[x["n"]] = kept.get(x["n"], 0) + len(set(x["a"]) & set(x["b"]))
        units[x["n"]] = units.get(x["n"], 0) + len(x["a"])
    # all but the first unit, and one more where the first cut lies close to the beginning
    assert all(kept[n] >= units[n] - 2 * 40 for n in kept) and kept[20] > 0.3 * units[20] and kept[60] > 0.75 * units[60], (kept, units)
