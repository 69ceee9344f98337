import itertools
import random

import numpy as np
import xxhash
from small import documents, rows

from tallyspark.llm import simhash
from tallyspark.llm.components import components


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    n = max(1, len(words) - 3)
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)


def brute_components(pairs):
    """doc_id and fingerprint: the smallest id reachable."""
    fps = sorted({f for _, f in pairs})
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 4):
            parent[root(fps[i + 1 + j])] = root(f)
    least = {}
    for i, f in pairs:
        r = root(f)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [(i, f"{f:016x}", least.get(root(f))) for i, f in pairs]


def by_id(rows_):
    return sorted(rows_, key=lambda x: (x[0] is None, x))


def test_triples_cover_every_four_positions():
    triples = simhash.turan_triples()
    assert len(triples) == 20
    assert all(any(set(t) <= set(four) for t in triples) for four in itertools.combinations(range(8), 4))


def test_fingerprints():
    for text in ("", " \n", "One", "a b c", "A b C d e", "É É x y z", "x y " * 70_000):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_links_in_blocks(spark):
    r = random.Random(3)
    fps = set()
    for _ in range(12):
        centre = r.getrandbits(64)
        for _ in range(60):
            f = centre
            for _ in range(r.randrange(9)):
                f ^= 1 << r.randrange(64)
            fps.add(f)
    pairs = list(enumerate(sorted(fps)))
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in pairs]
    frame = spark.createDataFrame(signed, "doc_id long, fp long")
    want = {f: c for _, f, c in brute_components(pairs)}
    for block in (8192, 7):
        got = {f"{r_['fp'] & (1 << 64) - 1:016x}": r_["component_id"] for r_ in simhash.classes(frame, block).collect()}
        assert got == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, k) for k in range(6, 40)] + [(-3, -3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {k: 5 for k in range(5, 40)}


def test_whole_tables(spark, sf_small):
    for docs in (documents(spark), spark.read.parquet(f"{sf_small}/documents.parquet")):
        pairs = [(d["doc_id"], plain_fingerprint(d["text"] or "")) for d in docs.collect()]
        assert by_id(map(tuple, simhash.query(docs).collect())) == by_id(brute_components(pairs))
    assert simhash.query(documents(spark, [])).count() == 0


def test_keep_one(spark):
    docs = documents(spark)
    want = {c for _, _, c in brute_components([(i, plain_fingerprint(t or "")) for i, t, *_ in rows()])}
    kept = simhash.keep_one(docs)
    got = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(got, key=str) == sorted(want, key=str)
