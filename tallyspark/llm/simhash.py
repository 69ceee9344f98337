"""SimHash near-duplicates by an inverted index on the positional bytes of the fingerprints.

A fingerprint is eight bytes. Two that differ in at most four bits share at least four of them, so any such pair meets in
a posting list keyed by three byte positions out of a Turan system: 20 triples of which every four positions contain
one. In a list, the shared positional bytes are tallied for each pair, pairs below the guaranteed minimum are left, and
the rest is verified by its differing bits. Only distinct fingerprints are indexed, a list emits the edges of a spanning
forest instead of pairs, and a list above a size is cut into blocks of which each two meet in a task of their own.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import texts
from tallyspark.llm.components import components
from tallyspark.session import materialise

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: Distinct fingerprints of a posting list in one block.
BLOCK = 8192


def turan_triples() -> list[tuple[int, int, int]]:
    """Triples of the eight positions such that any four positions contain one: within a part of three, or two of a part and one of the next."""
    part = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for t in itertools.combinations(range(8), 3):
        count = [sum(part[p] == k for p in t) for k in range(3)]
        if 3 in count or any(count[k] == 2 and count[(k + 1) % 3] == 1 for k in range(3)):
            out.append(t)
    return out


def fingerprint(text: str) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles (no words: zero)."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[width - 1 :].tolist())), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        counts += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, carried: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and carried columns, for every row."""
    slim = texts(docs) if not carried else docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carried
    )
    rest = [f for f in slim.schema.fields if f.name not in ("doc_id", "text")]
    schema = "doc_id long, fp long" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rest)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], ["doc_id", "fp", *(f.name for f in rest)])

    return slim.mapInArrow(run, schema)


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what links within one posting list (distinct values), each to the first of its component."""
    out = []
    left = fps
    while len(left) > 1:
        seed, left = left[0], left[1:]
        todo = [seed]
        while todo and len(left):
            differ = left ^ todo.pop()
            shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)
            near = shared >= 8 - MOST_BITS
            near[near] = np.bitwise_count(differ[near]) <= MOST_BITS
            if near.any():
                hits = left[near]
                left = left[~near]
                todo.extend(hits)
                out += [(seed, h) for h in hits]
    return out


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) of a spanning forest in every posting list over the column fp of `distinct`."""

    def byte(p: int) -> Column:
        return F.shiftrightunsigned(F.col("fp"), 8 * p).bitwiseAND(F.lit(255).cast("long"))

    keys = [
        F.lit(k << 24).cast("long").bitwiseOR(F.shiftleft(byte(a), 16)).bitwiseOR(F.shiftleft(byte(b), 8)).bitwiseOR(byte(c))
        for k, (a, b, c) in enumerate(turan_triples())
    ]
    postings = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    large = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    cut = postings.join(large, "key", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = cut.select("key", "fp", mine.alias("mine"), other.alias("other")).select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp")
    dealt = met.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp")

    def run(batches):
        rest = np.empty((0, 4), np.int64)

        def edges(table: np.ndarray) -> pa.RecordBatch:
            new = np.flatnonzero((table[1:, :3] != table[:-1, :3]).any(1)) + 1
            found = []
            for lo, hi in zip(np.concatenate(([0], new)).tolist(), np.concatenate((new, [len(table)])).tolist()):
                if hi - lo > 1:
                    found += forest(table[lo:hi, 3].copy().view(np.uint64))
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "lo", "hi", "fp")])
            rest = np.concatenate((rest, rows))
            last = np.flatnonzero((rest[:, :3] != rest[-1, :3]).any(1))
            done = last[-1] + 1 if len(last) else 0
            if done:  # the last list may go on in the next batch
                yield edges(rest[:done])
                rest = rest[done:]
        if len(rest) > 1:
            yield edges(rest)

    return dealt.mapInArrow(run, "a long, b long")


def classes(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """fp, component_id for every distinct fingerprint of `rows` (doc_id, fp): the smallest doc_id reachable (null if none has an id)."""
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    found = components(links(distinct, block)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(found, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, fp, component_id for every row of `docs`.

    Null and empty texts have fingerprint zero and link like any other; rows with equal texts are one class; a null id
    is never a component's name unless all its ids are null; other columns are ignored.
    """
    rows = materialise(fingerprints(docs), "simhash")
    return rows.join(classes(rows, block), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row of each near-duplicate class, with the columns of `docs`: that of the smallest doc_id (null last), ties by the row's hash."""
    own = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_hash")
    rows = materialise(fingerprints(docs, (own,)), "simhash-rows")
    best = rows.join(classes(rows.select("doc_id", "fp"), block).withColumnRenamed("component_id", "c").withColumn("group", F.coalesce("c", "fp")), "fp")
    first = best.groupBy("group", F.col("c").isNull()).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")).alias("x"))
    winners = first.select(F.col("x.doc_id").alias("doc_id"), F.col("x.row_hash").alias("row_hash"))
    counted = materialise(rows.join(winners.withColumnRenamed("doc_id", "w"), "row_hash").filter(F.col("doc_id").eqNullSafe(F.col("w")))
                          .groupBy("row_hash", "doc_id").agg(F.count(F.lit(1)).alias("n")), "simhash-kept")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), own)
    # kept rows grow with the input: a merge join at every size
    once = whole.join(counted.filter("n = 1").select("row_hash").hint("merge"), "row_hash", "left_semi").select("row.*")
    repeated = whole.join(counted.filter("n > 1").select("row_hash").hint("merge"), "row_hash", "left_semi").select("row.*").dropDuplicates()
    return once.unionByName(repeated)


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
