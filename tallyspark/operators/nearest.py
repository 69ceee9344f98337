"""Exact nearest neighbours by cosine inside a client, pruned by cells.

The rows of a client are dealt to cells, each around one of its rows (the centre). A cell keeps the least and the largest
angle of its rows to the centre, which bounds the score that any of them can have with a query. A query first visits the
cells of the best bounds that hold k rows together; its k-th score there then rules out every cell whose bound is below.
What is left is visited in a second pass. No cell that could change the result is left out, so the result is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyspark.session import materialise

#: Numbers in the vectors that a block of queries (at least), a cell on average and a part of a cell hold. Queries travel once for
#: each part that they visit and rows once for each block that visits them, so the bytes moved fall with these as the pairs grow.
QUERY_VALUES, CELL_VALUES, PART_VALUES = 2**20, 2**21, 2**22
#: Scores that a task holds at once.
SCORES = 4_000_000
#: Scores are ranked on six decimals, so a bound this far below the k-th score may still reach it.
SLACK = 1e-6


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _slices(rows: int, width: int):
    step = max(1, SCORES // max(1, width))
    return (slice(a, a + step) for a in range(0, rows, step))


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _nearest_centre(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
    """Rows of a block with the centre of the least angle; equal angles go to the smallest centre."""
    if rows.empty or centres.empty:
        return pd.DataFrame(columns=["client_id", "id", "v", "cell", "angle"])
    centres = centres.sort_values("cell")
    unit, middle, names = _unit_rows(rows["v"]), _unit_rows(centres["v"]), centres["cell"].to_numpy()
    cell, angle = np.empty(len(rows), np.int64), np.empty(len(rows))
    for s in _slices(len(rows), len(names)):
        angles = _angles(unit[s], middle)
        at = angles.argmin(axis=1)
        cell[s], angle[s] = names[at], angles[np.arange(len(at)), at]
    return pd.DataFrame({"client_id": rows["client_id"].to_numpy(), "id": rows["id"].to_numpy(), "v": rows["v"].to_numpy(), "cell": cell, "angle": angle})


def _cells_to_visit(need: int):
    """Cells for each query: without a k-th score those of the best bounds that hold `need` rows, else all that may reach it."""

    def run(queries: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or cells.empty:
            return pd.DataFrame(columns=["client_id", "id", "v", "cell", "least"])
        cells = cells.sort_values("cell")
        unit, middle = _unit_rows(queries["v"]), _unit_rows(cells["v"])
        low, high, held, names = (cells[c].to_numpy() for c in ("low", "high", "rows", "cell"))
        first = "least" not in queries
        least = np.full(len(queries), -np.inf) if first else queries["least"].fillna(-np.inf).to_numpy()
        seen = None if first else queries["seen"].to_numpy()
        at_query, at_cell = [], []
        for s in _slices(len(unit), len(names)):
            angles = _angles(unit[s], middle)
            best = np.cos(np.maximum(0.0, np.maximum(angles - high, low - angles)))
            if first:
                order = np.lexsort((np.broadcast_to(names, best.shape), -best), axis=1)
                before = np.cumsum(held[order], axis=1) - held[order]
                q, place = np.nonzero(before < need)
                c = order[q, place]
            else:
                q, c = np.nonzero(best >= least[s][:, None] - SLACK)
                new = np.array([names[b] not in seen[s][a] for a, b in zip(q, c)], dtype=bool)
                q, c = q[new], c[new]
            at_query.append(q + s.start)
            at_cell.append(c)
        q, c = np.concatenate(at_query), np.concatenate(at_cell)
        rows = queries.iloc[q]
        return pd.DataFrame({"client_id": rows["client_id"].to_numpy(), "id": rows["id"].to_numpy(), "v": rows["v"].to_numpy(), "cell": names[c], "least": least[q]})

    return run


def _best_of_part(k: int, exclude_self: bool):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["client_id", "query_id", "entry_id", "score"])
        right = right.sort_values("id", kind="stable")
        # entries below the score that a query has k times already are not written
        unit, other, ids = _unit_rows(left["v"]), _unit_rows(right["v"]), right["id"].to_numpy()
        own, n = left["id"].to_numpy(), min(k, len(right))
        found = []
        for s in _slices(len(unit), len(ids)):
            scores = np.round(unit[s] @ other.T, 6)
            if exclude_self:
                scores[own[s][:, None] == ids[None, :]] = -np.inf
            scores[scores < left["least"].to_numpy()[s][:, None]] = -np.inf
            # only the entries at or above the k-th score are sorted; they stand in the order of their ids
            kth = -np.partition(-scores, n - 1, axis=1)[:, n - 1 : n]
            q, e = np.nonzero((scores >= kth) & np.isfinite(scores))
            value = scores[q, e]
            order = np.lexsort((e, -value, q))
            q, e, value = q[order], e[order], value[order]
            start = np.searchsorted(q, q)
            keep = np.arange(len(q)) - start < n
            found.append((q[keep] + s.start, e[keep], value[keep]))
        q, e, value = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"client_id": left["client_id"].to_numpy()[q], "query_id": own[q], "entry_id": ids[e], "score": value})

    return run


def _usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """client_id, id, v of the rows whose vector has a direction: not null, all entries numbers, one of them not zero."""
    v = F.col(vector)
    number = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    return rows.select("client_id", F.col(key).cast("bigint").alias("id"), v.alias("v")).filter(v.isNotNull() & number)


def _without_late_copies(rows: DataFrame, n: int) -> DataFrame:
    """Of the rows of a client with equal vectors those of the `n` smallest ids: they tie at every query, and the smallest go first."""
    place = F.dense_rank().over(W.partitionBy("client_id", "v").orderBy("id"))
    return rows.withColumn("place", place).filter(F.col("place") <= n).drop("place")


def _dealt(rows: DataFrame, few: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows in blocks of about `size` per client, and `few` repeated for each block of its client."""
    blocks = rows.groupBy("client_id").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("blocks"))
    left = rows.join(blocks, "client_id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    right = few.join(blocks, "client_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return left, right


def _cogroup(left: DataFrame, right: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    def fresh(df: DataFrame) -> DataFrame:
        # new attributes, so that frames of common origin can be grouped together
        return df.select(*[F.col(c).alias(c) for c in df.columns])

    return fresh(left).groupBy(*keys).cogroup(fresh(right).groupBy(*keys)).applyInPandas(run, schema)


def centres(rows: DataFrame, cell_rows: int | None = None) -> DataFrame:
    """client_id, cell, v: rows of a client chosen by a hash of their id, one for each cell that it shall have, at least one.

    Cells hold `cell_rows` on average, by default as many as `CELL_VALUES` allows; large clients have cells of about the square
    root of their rows.
    """
    h = F.xxhash64("id")
    n = F.col("n")
    usual = F.greatest(F.lit(1.0), F.lit(float(CELL_VALUES)) / F.col("width")) if cell_rows is None else F.lit(float(cell_rows))
    wanted = F.ceil(n / F.greatest(usual, F.sqrt(n)))
    facts = F.count("*").alias("n"), F.min(h).alias("least"), F.max(F.size("v")).alias("width")
    counted = rows.groupBy("client_id").agg(*facts).withColumn("wanted", wanted)
    drawn = (F.col("wanted") > 1) & (F.pmod(h, F.lit(2**31)) * n < F.col("wanted") * F.lit(2**31))
    chosen = rows.join(counted, "client_id").filter(drawn | (h == F.col("least")))
    return chosen.select("client_id", F.col("id").alias("cell"), "v").dropDuplicates(["client_id", "cell"]).dropDuplicates(["client_id", "v"])


def search(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "txn_id", entry_id: str = "vec_id", vector: str = "embedding",
           exclude_self: bool = False, query_block: int | None = None, corpus_block: int | None = None, cell_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact top-k neighbours (client_id, query_id, entry_id, score, rank), and the cells that the queries visited (client_id, id, cell, rows).

    Scores are rounded to six decimals and ties go to the smallest entry, so of equal vectors only the smallest k entries (and
    the own one) are searched, and copies of one text cost no more than one. Vectors that are null, zero or hold null or NaN
    entries have no neighbours and are none; rows of one id count as one query. Cells beyond `corpus_block` rows are cut into
    parts, queries of one cell into blocks of `query_block` and of what its part leaves free of `corpus_block`, so a task holds
    one block and one part, whatever a client or a cell holds; by default these follow from the length of the vectors. Queries,
    rows, centres, dealt rows, visits, the best rows of the first ones and the sizes of cells and blocks are written to the
    shared folder.
    """
    client = queries.schema["client_id"].dataType.simpleString()
    q, c = _usable(queries, query_id, vector), _usable(corpus, entry_id, vector)
    q_type, c_type = (d.schema["v"].dataType.simpleString() for d in (q, c))
    need = k + int(exclude_self)
    # written: both sides are read several times
    q, c = materialise(q, "queries"), materialise(_without_late_copies(c, need), "rows")
    # written: every later step must see the same centres
    middle = materialise(centres(c, cell_rows), "centres")
    width = middle.agg(F.max(F.size("v"))).first()[0] or 1
    query_block, corpus_block = query_block or max(1, QUERY_VALUES // width), corpus_block or max(1, PART_VALUES // width)
    alone = middle.groupBy("client_id").agg(F.count("*").alias("cells")).filter("cells > 1").isEmpty()
    if alone:  # nothing to choose from: rows and queries go to the only cell of their client
        dealt = c.join(middle.select("client_id", "cell"), "client_id")
        facts = materialise(dealt.groupBy("client_id", "cell").agg(F.count("*").alias("rows")), "facts")
    else:
        dealt = _cogroup(*_dealt(c, middle, corpus_block), ["client_id", "block"], _nearest_centre,
                         f"client_id {client}, id bigint, v {c_type}, cell bigint, angle double")
        dealt = materialise(dealt, "cells")
        facts = dealt.groupBy("client_id", "cell").agg(F.count("*").alias("rows"), F.min("angle").alias("low"), F.max("angle").alias("high"))
        facts = materialise(facts, "facts")
        cells = facts.join(middle, ["client_id", "cell"])

    def visits(asking: DataFrame) -> DataFrame:
        found = _cogroup(*_dealt(asking, cells, query_block), ["client_id", "block"], _cells_to_visit(need),
                         f"client_id {client}, id bigint, v {q_type}, cell bigint, least double")
        return materialise(found, "visits")

    def scored(visited: DataFrame) -> DataFrame:
        counts = visited.groupBy("client_id", "cell").agg(F.count("*").alias("asking"))
        parts = facts.select("client_id", "cell", "rows", F.ceil(F.col("rows") / F.lit(corpus_block)).cast("int").alias("parts"))
        # a part that is smaller than it may be leaves its room to the queries, so that its rows travel to fewer blocks
        block = F.lit(query_block + corpus_block) - F.ceil(F.col("rows") / F.col("parts"))
        blocks = F.ceil(F.col("asking") / block).cast("int").alias("blocks")
        sizes = counts.join(parts, ["client_id", "cell"]).select("client_id", "cell", blocks, "parts")
        # written: Spark then knows that they are small, and vectors are not shuffled for them
        sizes = materialise(sizes, "sizes")
        at = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        left = visited.join(sizes, ["client_id", "cell"]).select("client_id", "cell", "id", "v", "least", at[0].alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        right = dealt.join(sizes, ["client_id", "cell"]).select("client_id", "cell", "id", "v", at[1].alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        return _cogroup(left, right, ["client_id", "cell", "block", "part"], _best_of_part(k, exclude_self),
                        f"client_id {client}, query_id bigint, entry_id bigint, score double")

    def ranked(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("client_id", "query_id").orderBy(F.col("score").desc(), "entry_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    def with_rows(visited: DataFrame) -> DataFrame:
        return visited.select("client_id", "id", "cell").join(facts.select("client_id", "cell", "rows"), ["client_id", "cell"]).select("client_id", "id", "cell", "rows")

    if alone:
        first = q.join(middle.select("client_id", "cell"), "client_id").withColumn("least", F.lit(float("-inf")))
        return ranked(scored(first)), with_rows(first)
    first = visits(q)
    several = cells.groupBy("client_id").agg(F.count("*").alias("cells"))
    seen = first.groupBy("client_id", "id").agg(F.collect_set("cell").alias("seen"))
    unfinished = seen.join(several, "client_id").filter(F.size("seen") < F.col("cells")).drop("cells")
    if unfinished.isEmpty():  # every query has met all cells of its client
        return ranked(scored(first)), with_rows(first)
    best = materialise(ranked(scored(first)), "best")
    least = best.filter(F.col("rank") == k).select("client_id", F.col("query_id").alias("id"), F.col("score").alias("least"))
    second = visits(q.join(unfinished, ["client_id", "id"]).join(least, ["client_id", "id"], "left"))
    return ranked(best.drop("rank").unionByName(scored(second))), with_rows(first.unionByName(second))


def top_k(queries: DataFrame, corpus: DataFrame, k: int, **how) -> DataFrame:
    """Exact top-k cosine neighbours with client filter: (client_id, query_id, entry_id, score, rank); see `search`."""
    return search(queries, corpus, k, **how)[0]
