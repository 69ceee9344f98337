from collections import defaultdict

from oracle import check_oracle
from small import documents, rows

from tallyspark.llm import mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = total - sum(3 * sizes[s] for s in capped)
        share = {s: 3 * sizes[s] if s in capped else free * weight[s] / sum(weight[t] for t in names if t not in capped) for s in names}
        over = {s for s in names if share[s] > 3 * sizes[s]} - capped
        if not over:
            return share
        capped |= over


def check(got, docs):
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    source = {}
    for i, text, _, s, *_ in docs:
        sizes[s] += len((text or "").split())
        largest[s] = max(largest[s], len((text or "").split()))
    share = brute_targets(sizes)
    for r in got:
        s = r["source"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - share[s]) < 1e-6 * max(1, share[s])
        assert r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - share[s]) <= largest[s]


def test_oracle(spark, sf_small):
    check_oracle(spark, sf_small, "op7_mix_sources")


def test_odd_documents(spark):
    docs = documents(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows())
    check(got, rows())
    assert mixing.mix(documents(spark, [])).count() == 0
    again = mixing.mix(documents(spark).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_capped_sources(spark):
    data = [(i, "w " * (5 if s == "a" else 100), None, s, None, None, None, None, None) for i, s in enumerate(["a"] * 9 + ["b"] * 30 + [None] * 40 + ["d"] * 3)]
    check(mixing.mix(documents(spark, data)).collect(), data)
