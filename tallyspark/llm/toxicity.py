"""Toxicity by cumulative-link ordinal regression on sparse word features.

P(grade > k) = sigmoid(w.x - threshold_k): one weight vector is shared by all thresholds, which rise with k. The result
is the expected severity, the sum of those probabilities. Features are the words of a text and their beginnings, each
at the steps of its count; those whose presence depends on the grade in the sample are kept, by a bounded number of
hash buckets.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import texts, worker_store

#: Labelled rows that the model is fitted on at most, buckets of word hashes, least |z| of a kept feature, and rows that have it.
SAMPLE, BUCKETS, LEAST_Z, LEAST_ROWS = 6_000, 1 << 20, 5.0, 5
STEPS, RATE, RIDGE = 800, 0.05, 1e-5
#: Lengths of beginnings, and the counts of one that are features of their own.
BEGINNINGS, COUNTS = range(4, 9), (1, 2, 4, 8)
#: Words that a worker remembers.
REMEMBERED = 300_000
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    """Weights of the kept buckets, and the rising thresholds between grades."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def expected(self, score: float) -> float:
        return float(sum(1.0 / (1.0 + np.exp(-np.clip(score - t, -40, 40))) for t in self.thresholds))

    def toxic(self, score: float) -> float:
        """Probability of any grade above the lowest."""
        return float(1.0 / (1.0 + np.exp(-np.clip(score - self.thresholds[0], -40, 40))))


def units(word: str) -> list[str]:
    return [f"{word}.", *(word[:n] for n in BEGINNINGS if n <= len(word))]


def bucket(unit: str, count: int) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(f"{count}{unit}") % BUCKETS


def features(text: str) -> set[int]:
    seen: Counter[str] = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        for u in units(word):
            seen[u] += n
    return {bucket(u, c) for u, n in seen.items() for c in COUNTS if n >= c}


def graded(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Grades from labels of two values: 0 not toxic, 1 toxic, 2 toxic with more tell-tale features than the median toxic row."""
    z, with_word = tell_tale(rows, toxic)
    telling = (z >= LEAST_Z) & (with_word >= LEAST_ROWS)
    hits = np.array([telling[r].sum() for r in rows])
    high = toxic > 0
    return high.astype(np.int64) + (high & (hits > np.median(hits[high]))) if high.any() else np.zeros(len(rows), np.int64)


def tell_tale(rows: list[np.ndarray], grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket: z of its presence in rows above the lowest grade, and the rows that have it."""
    with_word, with_high = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for k in range(0, len(rows), 500):  # a part at a time: the sample's features are many numbers
        part, high = rows[k : k + 500], grades[k : k + 500] > 0
        with_word += np.bincount(np.concatenate(part), minlength=BUCKETS)
        toxic = [r for r, h in zip(part, high) if h]
        if toxic:
            with_high += np.bincount(np.concatenate(toxic), minlength=BUCKETS)
    share = (grades > 0).mean()
    return (with_high - with_word * share) / np.sqrt(np.maximum(with_word * share * (1 - share), 1e-9)), with_word


def fit(rows: list[np.ndarray], grades: np.ndarray) -> Model:
    """Maximum likelihood with a ridge, by gradient steps with Adam's scaling; `rows` hold the buckets of each document."""
    levels = int(grades.max()) if len(grades) else 0
    if levels < 1:
        return Model({}, (40.0,))
    z, with_word = tell_tale(rows, grades)
    kept = np.flatnonzero((np.abs(z) >= LEAST_Z) & (with_word >= LEAST_ROWS))
    share = (grades > 0).mean()
    place = np.full(BUCKETS, -1)
    place[kept] = np.arange(len(kept))
    own = [(x := place[r])[x >= 0] for r in rows]
    word, owner = np.concatenate(own), np.repeat(np.arange(len(rows)), list(map(len, own)))
    n, k = len(rows), len(kept)
    # thresholds: the first, then the logs of the steps to the next
    start = -np.log(max(share, 1e-6) / max(1 - share, 1e-6))
    at = np.concatenate((np.zeros(k), [start], np.zeros(levels - 1)))
    first, second = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, STEPS + 1):
        score = np.bincount(owner, at[word], minlength=n)
        rises = np.exp(at[k + 1 :])
        thresholds = at[k] + np.concatenate(([0.0], np.cumsum(rises)))
        p = 1.0 / (1.0 + np.exp(-np.clip(score[:, None] - thresholds, -40, 40)))
        edge = np.concatenate((np.ones((n, 1)), p, np.zeros((n, 1))), 1)
        row = np.arange(n)
        mass = np.maximum(edge[row, grades] - edge[row, grades + 1], 1e-12)
        # d log P(grade) / d p_j is +1 at the threshold below the grade, -1 at the one above it
        slope = p * (1 - p)
        by_level = np.zeros((n, levels))
        low, up = grades > 0, grades < levels
        by_level[row[low], grades[low] - 1] += 1
        by_level[row[up], grades[up]] -= 1
        by_level *= slope / mass[:, None]
        d_score = by_level.sum(1)
        d_thresholds = -by_level.sum(0)
        gradient = np.concatenate((np.bincount(word, d_score[owner], minlength=k), [d_thresholds.sum()], rises * np.cumsum(d_thresholds[::-1])[::-1][1:])) / n
        gradient[:k] -= RIDGE * at[:k]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        at = at + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    thresholds = at[k] + np.concatenate(([0.0], np.cumsum(np.exp(at[k + 1 :]))))
    return Model({int(b): float(w) for b, w in zip(kept, at[:k])}, tuple(map(float, thresholds)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` labelled rows, those of smallest hash.

    Rows without a label or id are left out; grades come from `graded`.
    """
    toxic = F.col("toxic").cast("int")
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & toxic.isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"), (toxic > 0).cast("int").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    )

    def run(batches):
        for batch in batches:
            own = [np.array(sorted(features(t.as_py())), np.int32).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), batch.column(1)], ["buckets", "grade"])

    # at most `sample` rows of two numbers: a proven bound for a broadcast
    labelled = texts(docs).join(F.broadcast(chosen), "doc_id").select("text", "grade").mapInArrow(run, "buckets binary, grade int").collect()
    rows = sorted((bytes(r["buckets"]), r["grade"]) for r in labelled)
    own = [np.frombuffer(b, np.int32) for b, _ in rows]
    toxic_rows = np.array([g for _, g in rows], np.int64)
    return fit(own, graded(own, toxic_rows) if rows else toxic_rows)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, toxic for every row of `docs`.

    Null and empty texts have no features and get the model's base rate; repeated rows each get a row; other columns are
    ignored.
    """

    def run(batches):
        weights = model.weights
        known: dict[str, tuple] = worker_store(f"toxicity:{hash((tuple(weights.items()), model.thresholds))}", dict)
        for batch in batches:
            out = []
            for text in batch.column(1):
                words = WORD.findall(text.as_py().lower())
                if len(known) > REMEMBERED:
                    known.clear()
                for w in set(words).difference(known):
                    known[w] = tuple(u for u in units(w) if any(bucket(u, c) in weights for c in COUNTS))
                counts = Counter(chain.from_iterable(filter(None, map(known.__getitem__, words))))
                # each bucket once, in a fixed order: reruns agree to the last digit
                own = sorted({b for u, n in counts.items() for c in COUNTS if n >= c and (b := bucket(u, c)) in weights})
                out.append(sum(weights[b] for b in own))
            columns = [batch.column(0), pa.array(map(model.expected, out), pa.float64()), pa.array(map(model.toxic, out), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "severity", "p_toxic"])

    scored = texts(docs).mapInArrow(run, "doc_id long, severity double, p_toxic double")
    return scored.withColumn("toxic", F.col("p_toxic") >= 0.5)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
