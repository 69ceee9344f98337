import hashlib
import random

import numpy as np
import pytest
from oracle import check_oracle
from small import documents, rows

from tallyspark.llm import repeats
from tallyspark.llm.suffixes import suffix_ranks


def brute(data):
    """(doc_id, text) rows: what the query gives for each."""
    first, out = {}, []
    order = lambda i: repeats.NO_ID if i is None else i
    bodies = [(order(i), (t or "").encode()) for i, t in data]
    for i, b in bodies:
        for s in range(len(b) - 49):
            g = b[s : s + 50]
            first[g] = min(first.get(g, i), i)
    for i, b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((None if i == repeats.NO_ID else i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def planted(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("ab c\nédef ") for _ in range(n))
    passages = [text(n) for n in (49, 50, 51, 60, 75, 76, 120, 400)]
    out = []
    for i in range(60):
        parts = [text(r.randrange(80)) if r.random() < 0.6 else r.choice(passages)[r.randrange(3) :] for _ in range(r.randrange(8))]
        out.append((r.randrange(50), "".join(parts)))
    return [*out, (900, "z" * 300), (901, "z" * 130), (902, "yz" * 90), (903, "zy" * 70), (None, passages[-1])]


def test_suffix_ranks():
    r = random.Random(2)
    for _ in range(150):
        s = "".join(r.choice(r.choice(["ab", "a", "abcdef"])) for _ in range(r.randrange(1, 90))) * r.choice([1, 1, 3])
        for depth in (5, 50, 10**6):
            rank = suffix_ranks(np.frombuffer(s.encode(), np.uint8).astype(np.int64), depth)
            got = sorted(range(len(s)), key=lambda i: rank[i])
            assert [s[i : i + depth] for i in got] == sorted(s[i : i + depth] for i in range(len(s)))


def test_ranks_are_counted_without_a_search_for_each_suffix(monkeypatch):
    r = random.Random(4)
    text = "".join(r.choices("abc", k=3000)) + "abcab" * 300
    asked, search = [0], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest, **more: asked.__setitem__(0, asked[0] + np.size(v)) or search(a, v, *rest, **more))
    rank = suffix_ranks(np.frombuffer(text.encode(), np.uint8).astype(np.int64), 10**6)
    assert asked[0] < 100
    order = sorted(range(len(text)), key=lambda i: text[i:])
    assert [int(rank[i]) for i in order] == sorted(map(int, rank)) and len(set(map(int, rank))) == len(text)


@pytest.mark.parametrize("chunk", [8 << 20, 3000])
def test_planted_passages(spark, monkeypatch, chunk):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    monkeypatch.setattr(repeats, "NAME_BUCKET", 4 * chunk)
    monkeypatch.setattr(repeats, "CONTEXT_BUCKET", chunk)
    for seed in (1, 2):
        data = planted(seed)
        frame = spark.createDataFrame([(i, t, None, "s", 1) for i, t in data], "doc_id long, text string, kept string, body string, n_bytes int").repartition(3)
        assert sorted(map(tuple, repeats.query(frame).collect()), key=str) == brute(data)


def test_odd_documents(spark):
    assert sorted(map(tuple, repeats.query(documents(spark)).collect()), key=str) == brute([(i, t) for i, t, *_ in rows()])
    assert repeats.query(documents(spark, [])).count() == 0


def test_oracle(spark, sf_small):
    check_oracle(spark, sf_small, "op9_suffix_dedup")


def test_a_common_phrase_is_dealt_to_many_groups(spark, monkeypatch):
    kept = {}
    write = repeats.materialise
    monkeypatch.setattr(repeats, "materialise", lambda df, name: kept.setdefault(name, write(df, name)))
    for name, value in (("CHUNK", 20_000), ("NAME_BUCKET", 80_000), ("CONTEXT_BUCKET", 4000), ("CROWDED", 40)):
        monkeypatch.setattr(repeats, name, value, raising=False)
    r = random.Random(5)
    noise = lambda n: "".join(map(chr, r.choices(range(33, 127), k=n)))
    phrase, passage = noise(30), noise(90)
    data = [(i, noise(70) + phrase + noise(70) + (passage if i % 3 == 0 else "")) for i in range(900)]
    data += [(1000 + i, noise(9) + data[i][1][55:120]) for i in range(0, 900, 9)]  # windows with the phrase that do repeat
    data += [(None, data[7][1]), (3, data[4][1])]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, repeats.query(frame).collect()), key=str) == brute(data)
    held = {}
    for x in kept["repeat-verdicts"].collect():  # four bytes for a context, one for a single window
        held[x["bucket"]] = held.get(x["bucket"], 0) + len(x["payload"]) // (4 if x["kind"] == 1 else 1)
    assert max(held.values()) < 200


@pytest.mark.parametrize("crowded", [0, 2])
def test_planted_passages_under_crowded_names(spark, monkeypatch, crowded):
    for name, value in (("CHUNK", 3000), ("NAME_BUCKET", 12_000), ("CONTEXT_BUCKET", 3000), ("CROWDED", crowded)):
        monkeypatch.setattr(repeats, name, value)
    data = planted(3)
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, repeats.query(frame).collect()), key=str) == brute(data)
