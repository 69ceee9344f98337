"""Language of a text by sparse multinomial logistic regression on TF-IDF character n-grams.

Letter runs, with a space on either side, give n-grams of one to four characters, hashed to buckets. The weight of a
bucket in a text is its share of the text's n-grams times its inverse document frequency, which is counted over all rows
to learn from. A text's score is the sum of its n-grams' weights over their number. Weights are learned by follow-the-regularised-leader steps with an elastic net, which leaves most of them
at zero, on a bounded sample that gives each language the same room; one temperature, fitted on rows of the sample
that the weights have not seen, turns scores into probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import worker_store

#: Labelled rows that weights and temperature are fitted on at most (a bound of the sample alone), and the share of them for the temperature.
SAMPLE, CALIBRATION = 2_000, 0.2
#: Buckets of hashed n-grams, the slices in which their counts are added up, and the longest n-gram.
BUCKETS, SLICES, LONGEST_GRAM = 1 << 18, 64, 4
#: Steps: passes over the sample, rate, smoothing of the rate, weights of the absolute and the squared penalty, scale of the features.
PASSES, RATE, SMOOTHING, L1, L2, SCALE = 4, 0.5, 1.0, 0.002, 0.01, 20.0
#: Numbers that a worker holds at once for the n-grams of a part.
PART = 2_000_000
UNKNOWN = "und"


def _kinds() -> np.ndarray:
    """For each code point: 1 a letter, 2 a mark that belongs to the letters around it, 0 anything else."""
    import sys
    import unicodedata

    kind = {"L": 1, "M": 2}
    return np.array([kind.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)], np.uint8)


def codes(text: str) -> tuple[np.ndarray, bool]:
    """Lower-cased code points between spaces, all but letters and marks as spaces; whether there is a letter."""
    kinds = worker_store("language-kinds", _kinds)
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds[points]
    return np.where(kind > 0, points, np.uint32(32)), bool((kind == 1).any())


def grams(points: np.ndarray) -> np.ndarray:
    """The bucket of the n-gram that starts at each code point, a row for each n; BUCKETS where there is none.

    Spaces stand at the ends of an n-gram only, and not at both ends of two.
    """
    out = np.full((LONGEST_GRAM, len(points)), BUCKETS, np.int32)
    blank = points == 32
    inner = np.ones(len(points), bool)  # no space between the ends
    h = np.zeros(len(points), np.uint32)
    for n in range(1, LONGEST_GRAM + 1):
        if n > len(points):
            break
        h = h[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :]
        m = h ^ np.uint32(0x9E3779B1 * n & 0xFFFFFFFF)
        m ^= m >> np.uint32(15)
        m *= np.uint32(0x2C1B3C6D)
        m ^= m >> np.uint32(12)
        m *= np.uint32(0x297A2D39)
        m ^= m >> np.uint32(15)
        if n > 2:
            inner = inner[: len(m)] & ~blank[n - 2 : n - 2 + len(m)]
        fits = ~blank if n == 1 else ~(blank[:-1] & blank[1:]) if n == 2 else inner[: len(m)]
        out[n - 1, : len(m)] = np.where(fits, (m & np.uint32(BUCKETS - 1)).astype(np.int32), BUCKETS)
    return out


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, and how often each occurs."""
    own = grams(codes(text)[0]).ravel()
    return np.unique(own[own < BUCKETS], return_counts=True)


@dataclass(frozen=True)
class Model:
    """Languages; the place of each bucket among the rows of `weights` (idf included; the last row is zero); intercepts; temperature."""

    languages: tuple[str, ...]
    place: np.ndarray
    weights: np.ndarray
    intercept: np.ndarray
    temperature: float

    def probabilities(self, sums: np.ndarray, total: np.ndarray) -> np.ndarray:
        """From the summed weights of each text's n-grams and their number."""
        z = (self.intercept + SCALE * sums / np.maximum(total, 1)[:, None]) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, features: int, classes: int, passes: int = PASSES) -> np.ndarray:
    """Weights [features, classes] by proximal follow-the-regularised-leader; rows hold places and values of their features."""
    z, n = np.zeros((features, classes)), np.zeros((features, classes))

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((SMOOTHING + np.sqrt(n)) / RATE + L2))

    for _ in range(passes):
        for (at, value), label in zip(rows, labels):
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            score = value @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[label] -= 1.0
            g = value[:, None] * p
            more = ns + g * g
            z[at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / RATE * w
            n[at] = more
    return weights(z, n)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of scores under which the labels are likeliest (golden section over its logarithm); 1 without rows.

    A label counts as certain only as far as the number of rows allows, so rows without an error don't drive it to zero.
    """
    if not len(labels):
        return 1.0
    wrong = 1.0 / (len(labels) + scores.shape[1])

    def loss(log_t: float) -> float:
        z = scores / np.exp(log_t)
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - (1 - wrong) * z[np.arange(len(labels)), labels] - wrong * z.mean(1)).mean())

    low, high, ratio = np.log(0.02), np.log(50.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) <= loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Rows of `texts` (one column), and in how many of them each bucket occurs; every row counts."""
    width = BUCKETS // SLICES

    def run(batches):
        held, rows, place = np.zeros(BUCKETS + 1, np.int64), 0, np.zeros(BUCKETS + 1, np.int32)
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0):
                own = grams(codes(text.as_py())[0]).ravel()
                order = np.arange(len(own), dtype=np.int32)
                place[own] = order
                held[own[place[own] == order]] += 1  # each bucket once
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int32()), pa.array([rows] * SLICES), pa.array([held[k * width : (k + 1) * width].tobytes() for k in range(SLICES)], pa.binary())],
            ["slice", "rows", "counts"],
        )

    def added(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                own = held.setdefault(r["slice"], [0, np.zeros(width, np.int64)])
                own[0] += r["rows"]
                own[1] += np.frombuffer(r["counts"], np.int64)
        yield pa.RecordBatch.from_pylist([{"slice": k, "rows": n, "counts": c.tobytes()} for k, (n, c) in held.items()], pa.schema([("slice", pa.int32()), ("rows", pa.int64()), ("counts", pa.binary())]))

    kind = "slice int, rows long, counts binary"
    parts = texts.mapInArrow(run, kind).repartition(SLICES, "slice").mapInArrow(added, kind).collect()  # BUCKETS numbers in all
    out, rows = np.zeros(BUCKETS, np.int64), 0
    for r in parts:
        rows = r["rows"]
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
    return rows, out


def sample(rows: DataFrame, size: int = SAMPLE) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, buckets, counts) of at most `size` rows (doc_id, text, lang), about as many of each language, by hash."""
    held = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    languages = held.count()
    h = F.xxhash64("doc_id", "lang").alias("h")
    share = F.col("h").bitwiseAND(F.lit((1 << 40) - 1).cast("long")) / float(1 << 40)
    # ids and languages alone are joined and sorted
    ranked = rows.select(h, "lang").join(held, "lang").select("h", (share * F.col("n") * float(languages / size)).alias("rank")).filter("rank < 1")
    first = ranked.groupBy("h").agg(F.min("rank").alias("rank")).orderBy("rank", "h").limit(size)
    chosen = rows.select(h, "lang", "text").join(F.broadcast(first), "h")  # `size` pairs of numbers at most

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                buckets, n = counts(batch.column(2)[k].as_py())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([buckets.astype("<i4").tobytes()], pa.binary()), pa.array([n.astype("<i4").tobytes()], pa.binary())],
                    ["rank", "lang", "buckets", "counts"],
                )

    made = chosen.select("rank", "lang", "text").mapInArrow(run, "rank double, lang string, buckets binary, counts binary")
    # `size` rows at most
    return [(r["lang"], np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["counts"], "<i4")) for r in made.orderBy("rank", "lang", "buckets", "counts").limit(size).collect()]


def train(rows: DataFrame, size: int = SAMPLE) -> Model | None:
    """Learns from rows (doc_id, text, lang) with a text and a language; None if there is none."""
    usable = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    drawn = sample(usable, size)
    if not drawn:
        return None
    documents, frequency = document_frequencies(usable.select("text"))
    idf = np.log((1.0 + documents) / (1.0 + frequency)) + 1.0
    languages = tuple(sorted({lang for lang, _, _ in drawn}))
    labels = np.array([languages.index(lang) for lang, _, _ in drawn])
    kept = np.unique(np.concatenate([b for _, b, _ in drawn]))
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    # the intercept is one more feature, always there
    vectors = [(np.append(place[b], len(kept)), np.append(SCALE * n / max(n.sum(), 1) * idf[b], 1.0)) for _, b, n in drawn]
    # ranks are random inside a language, so every language has rows in both parts
    apart = np.arange(len(drawn)) % max(int(1 / CALIBRATION), 2) == 1
    learn = np.flatnonzero(~apart)
    w = ftrl([vectors[k] for k in learn], labels[learn], len(kept) + 1, len(languages))
    scores = np.array([v @ w[at] for (at, v), a in zip(vectors, apart) if a]).reshape(-1, len(languages))
    t = temperature(scores, labels[apart])
    full = w[:-1] * idf[kept][:, None]
    used = np.flatnonzero(full.any(1))
    place = np.full(BUCKETS + 1, len(used), np.int32)
    place[kept[used]] = np.arange(len(used))
    return Model(languages, place, np.vstack((full[used], np.zeros((1, len(languages))))), w[-1], t)


def sums(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the summed weights of its n-grams, their number, and whether it has a letter.

    Short texts are taken together, long ones in slices, so memory stays bounded; a text's sum doesn't depend on the others.
    """
    total, number, lettered = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    room = max(PART // (1 + len(model.languages)), 1000)

    def add(rows: list[int], parts: list[np.ndarray]) -> None:
        points = np.concatenate(parts)
        begin = np.concatenate(([0], np.cumsum(list(map(len, parts)))[:-1]))
        buckets = grams(points)
        weight = model.weights[model.place[buckets[0]]]
        for row in buckets[1:]:
            weight += model.weights[model.place[row]]
        total[rows] += np.add.reduceat(weight, begin)
        number[rows] += np.add.reduceat((buckets < BUCKETS).sum(0), begin)

    rows, parts, held = [], [], 0
    for k, text in enumerate(texts):
        points, lettered[k] = codes(text)
        if len(points) > room:
            # an n-gram belongs to the slice that it starts in; spaces behind a slice's own starts end none that it doesn't have
            for at in range(0, len(points), room):
                piece = points[at : at + room + LONGEST_GRAM - 1]
                buckets = grams(piece)[:, : min(room, len(points) - at)]
                total[k] += model.weights[model.place[buckets]].sum((0, 1))
                number[k] += (buckets < BUCKETS).sum()
            continue
        rows.append(k)
        parts.append(points)
        held += len(points)
        if held > room:
            add(rows, parts)
            rows, parts, held = [], [], 0
    if rows:
        add(rows, parts)
    return total, number, lettered


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score for every row of `docs`, from its whole text alone.

    Null and empty texts and those without a letter get `und` and score 0, as does every text if nothing was learned; equal
    scores go to the language that sorts first; repeated rows and null ids each get a row; other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if model is None:
        return slim.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights of at most BUCKETS buckets

    def run(batches):
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            total, number, lettered = sums(batch.column(1).to_pylist(), m)
            p = m.probabilities(total, number)
            best = p.argmax(1)
            names = [m.languages[k] if some else UNKNOWN for k, some in zip(best.tolist(), lettered.tolist())]
            score = np.where(lettered, p[np.arange(len(best)), best], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: CRC32 of the id as text, modulo 3, is 1. A null id has no remainder and is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def query(docs: DataFrame) -> DataFrame:
    known = docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id")))
    return predict(docs, train(known)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
