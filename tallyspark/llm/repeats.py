"""Passages repeated across documents, removed by a distributed difference-cover suffix sort.

1. Documents are packed into chunks, written once to the shared folder.
2. Every window of LENGTH bytes names itself by the smallest hash of its K-byte substrings: equal windows have equal
   names. Chunks send their distinct names; a name that two documents have is shared. Windows of other names cannot
   repeat and are left, which loses nothing.
3. A run of windows of one shared name is a context. Each chunk sends its distinct contexts, with the smallest doc_id
   of each, to the bucket of the name. A bucket sorts the suffixes of its contexts by the difference-cover method
   (sampled triples, recursion on their names, merge) and compares the prefixes of neighbours: equal windows are a
   class, with a smallest doc_id.
4. The verdicts go back to the chunks, which remove the bytes.

The interior of a passage in a third of all documents is one context in each chunk, however many documents repeat it.
Windows at its edges, and common strings of K to LENGTH - 1 bytes, are another context in each document: names of more
than CROWDED contexts are taken apart, each chunk sends their distinct windows to the bucket of the window's own hash.
A bucket of these holds a window once for each chunk at most.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import texts
from tallyspark.llm.suffixes import suffix_ranks
from tallyspark.session import materialise

LENGTH, K = 50, 25
WINDOWS = LENGTH - K + 1
NAME_BITS = 44
#: Bytes of text in a chunk and behind a bucket of names, bytes of contexts in a bucket.
CHUNK, NAME_BUCKET, CONTEXT_BUCKET = 16 << 20, 16 << 20, 1 << 20
PIECE = 1 << 16
#: Contexts, counted once in each chunk, that one name may bring to a bucket.
CROWDED = 8192
#: Stands for a null id: after all others.
NO_ID = np.iinfo(np.int64).max
_NO_NAME = np.uint64(1) << np.uint64(63)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * _A
    out += b * _B
    out ^= out >> np.uint64(32)
    return out


def _names_of_piece(data: np.ndarray) -> np.ndarray:
    """The names of all windows that lie in `data`."""
    n = len(data)
    grams, size = data.astype(np.uint64) * _C, 1
    while 2 * size <= K:
        grams = _joined(grams[:-size], grams[size:])
        size *= 2
    if size < K:
        grams = _joined(grams[: n - K + 1], grams[K - size :])
    grams *= _A
    grams ^= grams >> np.uint64(29)
    least, size = grams, 1
    while 2 * size <= WINDOWS:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < WINDOWS:
        least = np.minimum(least[: n - LENGTH + 1], least[WINDOWS - size :])
    # minima crowd at the low end: a multiplication spreads them, for buckets by range
    return (least * _A) >> np.uint64(64 - NAME_BITS)


class Chunk:
    """Texts of some documents, with the runs of windows of one name."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, body: bytes):
        self.ids, self.lengths, self.body = ids, lengths, body
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        data = np.frombuffer(body, np.uint8)
        total = max(0, len(data) - LENGTH + 1)
        empty = np.empty(0, np.int64)
        found = [(empty, empty, empty.astype(np.uint64)), *(self._runs(data, k, min(total, k + PIECE)) for k in range(0, total, PIECE))]
        self.run_start, self.run_size, self.run_name = map(np.concatenate, zip(*found))
        self.run_doc = np.searchsorted(self.starts, self.run_start, "right") - 1
        self._name_runs()

    def _runs(self, data: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, size and name of the runs among the windows that start in lo..hi; a run may be cut anywhere."""
        names = _names_of_piece(data[lo : hi + LENGTH - 1])
        first, last = np.searchsorted(self.ends, (lo, hi + LENGTH))
        for end in self.ends[first:last].tolist():
            names[max(0, end - LENGTH + 1 - lo) : max(0, end - lo)] = _NO_NAME  # windows over the end of a document
        start = np.concatenate(([0], np.flatnonzero(names[1:] != names[:-1]) + 1))
        size = np.diff(np.append(start, hi - lo))
        name = names[start]
        good = name != _NO_NAME
        start, size, name = start[good], size[good], name[good]
        parts = -(-size // WINDOWS)  # a text that repeats itself can have longer runs of one name
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        return np.repeat(start, parts) + within * WINDOWS + lo, np.minimum(np.repeat(size, parts) - within * WINDOWS, WINDOWS), np.repeat(name, parts)

    def _name_runs(self) -> None:
        """names: sorted and distinct; twice: whether two documents of this chunk have each; name_of_run: which of them a run has."""
        order = np.argsort(self.run_name)
        name, doc = self.run_name[order], self.run_doc[order]
        new = np.ones(len(name), bool)
        new[1:] = name[1:] != name[:-1]
        first = np.flatnonzero(new)
        self.names = name[first]
        self.twice = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(name) else np.empty(0, bool)
        self.name_of_run = np.empty(len(name), np.int64)
        self.name_of_run[order] = np.cumsum(new) - 1

    def contexts_per_name(self) -> np.ndarray:
        """For each distinct name: how many distinct contexts it has."""
        at, runs = self.name_of_run, np.bincount(self.name_of_run, minlength=len(self.names))
        rows = np.flatnonzero(runs[at] > 1)
        start = self.run_start[rows]
        body, seen = self.body, {}
        for k, s, e in zip(at[rows].tolist(), start.tolist(), (start + self.run_size[rows] + LENGTH - 1).tolist()):
            seen[body[s:e]] = k
        counts = np.bincount(np.fromiter(seen.values(), np.int64, len(seen)), minlength=len(runs))
        return np.where(runs > 1, counts, 1)


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names * np.uint64(buckets)) >> np.uint64(NAME_BITS)).astype(np.int64)


def _chunks(docs: DataFrame) -> DataFrame:
    """chunk, n_bytes, ids, lengths, body: documents in the order of their ids within a chunk, the body compressed."""
    slim = texts(docs)

    def run(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        held, size = [], 0

        def packed():
            held.sort(key=lambda x: x[0])
            body = b"".join(b for _, b in held)
            ids, lengths = np.array([i for i, _ in held], np.int64), np.array([len(b) for _, b in held], np.int64)
            row = [uuid.uuid4().int >> 65, len(body), ids.tobytes(), lengths.tobytes(), packer.compress(body)]
            return pa.RecordBatch.from_pylist([dict(zip(("chunk", "n_bytes", "ids", "lengths", "body"), row))])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).fill_null(NO_ID).to_pylist(), batch.column(1)):
                held.append((doc_id, text.as_buffer().to_pybytes()))
                size += len(held[-1][1])
                if size >= CHUNK:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    return slim.mapInArrow(run, "chunk long, n_bytes long, ids binary, lengths binary, body binary")


def _read_chunk(row: dict) -> Chunk:
    import zstandard

    body = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(1, row["n_bytes"]))
    return Chunk(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lengths"], np.int64), body)


def _names(chunks: DataFrame, buckets: int) -> DataFrame:
    """For each chunk and bucket: its sorted distinct names, as steps, which of them two of its documents have, and how many contexts each has."""

    def run(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _read_chunk(row)
                names, twice = chunk.names, chunk.twice
                contexts = chunk.contexts_per_name().astype(np.uint32)
                at = bucket_of(names, buckets)
                edges = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.empty(0, np.int64)
                out = []
                for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(at)]):
                    steps = np.diff(names[lo:hi], prepend=np.uint64(0))
                    small = steps[1:].astype(np.uint32) if (steps[1:] >> np.uint64(32) == 0).all() else steps[1:]
                    out.append({"bucket": int(at[lo]), "chunk": row["chunk"], "first": int(steps[0]), "steps": small.tobytes(),
                                "n": hi - lo, "twice": np.packbits(twice[lo:hi]).tobytes(), "contexts": packer.compress(contexts[lo:hi].tobytes())})
                if out:
                    yield pa.RecordBatch.from_pylist(out)

    return chunks.mapInArrow(run, "bucket long, chunk long, first long, steps binary, n long, twice binary, contexts binary")


#: kind 0: names (shared, crowded: their contexts), 1: contexts, 2: windows of crowded names.
REPLY = "chunk long, kind int, bucket long, shared long, crowded long, payload binary"


def _reply(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * 6
    kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["chunk", "kind", "bucket", "shared", "crowded", "payload"])


def _shared_names(crowded: int):
    """For each chunk of a bucket: which of its names two documents have, apart from and among those of more than `crowded` contexts."""

    def run(group: pa.Table) -> pa.Table:
        import zstandard

        opened = zstandard.ZstdDecompressor().decompress
        rows = group.to_pylist()
        names = []
        for r in rows:
            steps = np.frombuffer(r["steps"], np.uint32 if len(r["steps"]) == 4 * (r["n"] - 1) else np.uint64)
            names.append(np.cumsum(np.concatenate(([np.uint64(r["first"])], steps.astype(np.uint64))), dtype=np.uint64))
        twice = np.concatenate([np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=r["n"]) for r in rows])
        contexts = np.concatenate([np.frombuffer(opened(r["contexts"]), np.uint32) for r in rows]).astype(np.int64)
        every = np.concatenate(names)
        order = np.argsort(every)
        ordered = every[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        count = np.diff(np.append(first, len(ordered)))
        good = (count > 1) | (np.maximum.reduceat(twice[order], first) > 0)
        many = np.add.reduceat(contexts[order], first) > crowded
        shared, apart = np.empty(len(every), bool), np.empty(len(every), bool)
        shared[order] = np.repeat(good & ~many, count)
        apart[order] = np.repeat(good & many, count)
        out, at = [], 0
        for r in rows:
            own = slice(at, at + r["n"])
            at += r["n"]
            payload = np.packbits(shared[own]).tobytes() + (np.packbits(apart[own]).tobytes() if apart[own].any() else b"")
            out.append((r["chunk"], 0, r["bucket"], int(contexts[own][shared[own]].sum()), int(contexts[own][apart[own]].sum()), payload))
        return _reply(out)

    return run


class Windows:
    """Distinct windows of some runs of a chunk in the order of their buckets; for each window of the runs which it is."""

    def __init__(self, chunk: Chunk, runs: np.ndarray, buckets: int):
        size = chunk.run_size[runs]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        self.start = np.repeat(chunk.run_start[runs], size) + within
        self.doc = np.repeat(chunk.run_doc[runs], size)
        self.which = np.empty(len(self.start), np.int64)
        self.bucket = np.empty(0, np.int64)
        self.first, self.least_id = self.bucket, self.bucket
        if not len(self.start):
            return
        words = np.ndarray(len(chunk.body) - 7, np.uint64, chunk.body, strides=(1,))
        offsets = [*range(0, LENGTH - 7, 8), LENGTH - 8]
        own = np.zeros(len(self.start), np.uint64)
        for k in offsets:
            own = _joined(own, words[self.start + k])
        own *= _A

        def differ(order: np.ndarray) -> np.ndarray:
            place = self.start[order]
            new = np.zeros(len(place), bool)
            for k in offsets:
                w = words[place + k]
                new[1:] |= w[1:] != w[:-1]
            new[0] = True
            return new

        order = np.argsort(own, kind="stable")
        new = differ(order)
        if (new[1:] & (own[order][1:] == own[order][:-1])).any():  # two windows of one hash: their bytes decide
            order = np.lexsort([*(words[self.start + k] for k in offsets), own])
            new = differ(order)
        self.which[order] = np.cumsum(new) - 1
        first = order[new]  # the order is stable, and documents are in the order of their ids
        self.first, self.least_id = self.start[first], chunk.ids[self.doc[first]]
        self.bucket = bucket_of(own[first] >> np.uint64(64 - NAME_BITS), buckets)


class Contexts:
    """Distinct contexts of a chunk in the order of their buckets; for each shared run the context that it is. windows: those of crowded names."""

    def __init__(self, chunk: Chunk, replies: list[dict], name_buckets: int, buckets: int, window_buckets: int):
        names, name_of_run = chunk.names, chunk.name_of_run
        shared, crowded = np.zeros(len(names), bool), np.zeros(len(names), bool)
        at = bucket_of(names, name_buckets)
        for r in replies:
            if r["kind"] == 0:
                lo, hi = np.searchsorted(at, (r["bucket"], r["bucket"] + 1))
                bits = np.frombuffer(r["payload"], np.uint8)
                half = (hi - lo + 7) // 8
                shared[lo:hi] = np.unpackbits(bits[:half], count=hi - lo)
                if len(bits) > half:
                    crowded[lo:hi] = np.unpackbits(bits[half:], count=hi - lo)
        runs = np.flatnonzero(shared[name_of_run]) if len(names) else np.empty(0, np.int64)
        self.windows = Windows(chunk, np.flatnonzero(crowded[name_of_run]) if len(names) else runs, window_buckets)
        self.start, self.size, self.doc = chunk.run_start[runs], chunk.run_size[runs], chunk.run_doc[runs]
        seen: dict[bytes, int] = {}
        body = chunk.body
        self.context = np.fromiter(
            (seen.setdefault(body[s:e], len(seen)) for s, e in zip(self.start.tolist(), (self.start + self.size + LENGTH - 1).tolist())), np.int64, len(runs)
        )
        self.bodies = list(seen)
        first = np.unique(self.context, return_index=True)[1]  # documents are in the order of their ids
        self.least_id = chunk.ids[self.doc[first]]
        name = chunk.run_name[runs[first]]
        self.name = name.astype(np.uint32)
        self.bucket = bucket_of(name, buckets)
        self.order = np.argsort(self.bucket, kind="stable")


def _contexts(name_buckets: int, buckets: int, window_buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        packer, out = zstandard.ZstdCompressor(level=3), []
        replies = right.to_pylist()
        for row in left.to_pylist():
            chunk = _read_chunk(row)
            c = Contexts(chunk, replies, name_buckets, buckets, window_buckets)
            at = c.bucket[c.order]
            edges = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.empty(0, np.int64)
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(at)]):
                own = c.order[lo:hi]
                bodies = [c.bodies[k] for k in own.tolist()]
                sizes = np.array(list(map(len, bodies)), np.uint8)
                # contexts of a bucket are in the order of their documents, so the ids rise in small steps
                steps = np.diff(c.least_id[own], prepend=np.int64(0)).tobytes()
                packed = packer.compress(steps), packer.compress(sizes.tobytes()), c.name[own].tobytes(), packer.compress(b"".join(bodies))
                out.append((int(at[lo]), row["chunk"], *packed))
            w = c.windows
            edges = np.flatnonzero(np.concatenate(([True], w.bucket[1:] != w.bucket[:-1]))) if len(w.bucket) else np.empty(0, np.int64)
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(w.bucket)]):
                body = b"".join([chunk.body[s : s + LENGTH] for s in w.first[lo:hi].tolist()])
                steps = np.diff(w.least_id[lo:hi], prepend=np.int64(0)).tobytes()
                out.append((buckets + int(w.bucket[lo]), row["chunk"], packer.compress(steps), None, None, packer.compress(body)))
        columns = list(zip(*out)) if out else [[]] * 6
        kinds = pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], ["bucket", "chunk", "ids", "sizes", "names", "body"])

    return run


def window_classes(bodies: list[bytes], least_id: np.ndarray) -> np.ndarray:
    """For each window of the contexts, one after another: the smallest id of any equal window."""
    sizes = np.array(list(map(len, bodies)), np.int64)
    counts = sizes - LENGTH + 1
    text = np.frombuffer(b"".join(bodies), np.uint8)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(np.cumsum(sizes) - sizes, counts) + within
    owner = np.repeat(least_id, counts)
    order = np.argsort(suffix_ranks(text.astype(np.int64), LENGTH)[at])
    # neighbours whose first LENGTH bytes agree, by eight-byte words
    words = np.ndarray(len(text) - 7, np.uint64, text.tobytes(), strides=(1,))
    place = at[order]
    new = np.zeros(len(place), bool)
    new[0] = True
    for k in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        w = words[place + k]
        new[1:] |= w[1:] != w[:-1]
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(owner[order], first)
    out = np.empty(len(place), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(first, len(place))))
    return out


def _verdicts(group: pa.Table) -> pa.Table:
    """For each chunk of a bucket, in the order it sent them: a bit for each window of a context (a byte for each single window), set if a smaller id has it."""
    import zstandard

    opened = zstandard.ZstdDecompressor().decompress
    rows = group.to_pylist()
    if rows and rows[0]["names"] is None:
        ids = [np.cumsum(np.frombuffer(opened(r["ids"]), np.int64)) for r in rows]
        text = b"".join(opened(r["body"]) for r in rows)
        every = np.concatenate(ids)
        later = window_classes([text[k : k + LENGTH] for k in range(0, len(text), LENGTH)], every) < every
        parts = np.split(later, np.cumsum(list(map(len, ids)))[:-1])
        return _reply([(r["chunk"], 2, r["bucket"], 0, 0, p.tobytes()) for r, p in zip(rows, parts)])
    seen: dict[bytes, int] = {}
    entry, ids, names = [], [], []
    for r in rows:
        ends = np.cumsum(np.frombuffer(opened(r["sizes"]), np.uint8), dtype=np.int64)
        starts = np.concatenate(([0], ends[:-1]))
        body = opened(r["body"])
        entry += [seen.setdefault(body[s:e], len(seen)) for s, e in zip(starts.tolist(), ends.tolist())]
        ids.append(np.cumsum(np.frombuffer(opened(r["ids"]), np.int64)))
        names.append(np.frombuffer(r["names"], np.uint32))
    entry, ids, names = np.array(entry, np.int64), np.concatenate(ids), np.concatenate(names)
    bodies = list(seen)
    least = np.full(len(bodies), NO_ID)
    np.minimum.at(least, entry, ids)
    name = np.empty(len(bodies), np.uint32)
    name[entry] = names
    counts = np.array(list(map(len, bodies)), np.int64) - LENGTH + 1
    first = np.cumsum(counts) - counts
    smallest = np.repeat(least, counts)
    # a context that is alone under its name equals no other: only the rest is sorted
    order = np.argsort(name)
    edge = np.flatnonzero(np.concatenate(([True], name[order][1:] != name[order][:-1])))
    together = np.diff(np.append(edge, len(order)))
    several = np.sort(order[np.repeat(together > 1, together)])
    if len(several):
        found = window_classes([bodies[k] for k in several.tolist()], least[several])
        mine = counts[several]
        smallest[np.repeat(first[several], mine) + np.arange(mine.sum()) - np.repeat(np.cumsum(mine) - mine, mine)] = found
    n = counts[entry]
    edges = np.cumsum(n) - n
    within = np.arange(n.sum()) - np.repeat(edges, n)
    bits = (smallest[np.repeat(first[entry], n) + within] < np.repeat(ids, n)).astype(np.uint32) << within.astype(np.uint32)
    masks = np.add.reduceat(bits, edges).astype(np.uint32)
    out, at = [], 0
    for r in rows:
        size = len(r["names"]) // 4
        out.append((r["chunk"], 1, r["bucket"], 0, 0, masks[at : at + size].tobytes()))
        at += size
    return _reply(out)


def _removed(name_buckets: int, buckets: int, window_buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        replies = sorted(right.to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
        for row in left.to_pylist():
            chunk = _read_chunk(row)
            c = Contexts(chunk, replies, name_buckets, buckets, window_buckets)
            masks = np.zeros(len(c.bodies), np.uint32)
            payload = [np.frombuffer(r["payload"], np.uint32) for r in replies if r["kind"] == 1]
            if payload:
                masks[c.order] = np.concatenate(payload)
            repeated = np.zeros(len(chunk.body) + 1, np.int32)  # windows that start here and repeat
            later = chunk.ids[c.doc] > c.least_id[c.context]
            mask = np.where(later, np.uint32((1 << WINDOWS) - 1), masks[c.context])
            for k in range(WINDOWS):
                hit = (mask >> np.uint32(k) & np.uint32(1)).astype(bool) & (c.size > k)
                repeated[c.start[hit] + k] = 1
            w = c.windows
            if len(w.first):
                verdict = np.concatenate([np.frombuffer(r["payload"], bool) for r in replies if r["kind"] == 2])
                hit = (chunk.ids[w.doc] > w.least_id[w.which]) | verdict[w.which]
                repeated[w.start[hit]] = 1
            total = np.cumsum(repeated[:-1], dtype=np.int32)
            gone = total > 0
            gone[LENGTH:] = total[LENGTH:] > total[:-LENGTH]
            for doc_id, start, end in zip(chunk.ids.tolist(), chunk.starts.tolist(), chunk.ends.tolist()):
                own = gone[start:end]
                body = chunk.body[start:end]
                if own.any():
                    turn = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
                    spans = turn.reshape(-1, 2).tolist()
                    body = np.frombuffer(body, np.uint8)[~own].tobytes()
                else:
                    spans = []
                out.append((None if doc_id == NO_ID else doc_id, end - start, [{"start": s, "end": e} for s, e in spans], body))
        columns = list(zip(*out)) if out else [[]] * 4
        kinds = pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], ["doc_id", "n_bytes", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans array<struct<start, end>> (removed bytes, ends exclusive), kept binary, for every row of `docs`.

    A byte is removed if a LENGTH-byte string that covers it also starts in a document with a smaller doc_id. Null and
    empty texts have no bytes; rows with equal ids remove nothing from each other; rows without an id come after all
    others; an empty table gives an empty result; other columns are ignored. A document is handled whole in a task.
    """
    chunks = materialise(_chunks(docs), "repeat-chunks")
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    name_buckets = max(1, total // NAME_BUCKET)
    asked = _names(chunks, name_buckets).groupBy("bucket").applyInArrow(_shared_names(CROWDED), REPLY)
    shared = materialise(asked, "repeat-names")
    sent, single = shared.agg(F.sum("shared"), F.sum("crowded")).first()
    buckets = max(1, (sent or 0) * (LENGTH + WINDOWS // 2) // CONTEXT_BUCKET)
    sizes = name_buckets, buckets, max(1, (single or 0) * (WINDOWS // 2) * LENGTH // CONTEXT_BUCKET)
    contexts = chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(
        _contexts(*sizes), "bucket long, chunk long, ids binary, sizes binary, names binary, body binary"
    )
    verdicts = materialise(contexts.groupBy("bucket").applyInArrow(_verdicts, REPLY), "repeat-verdicts")
    replies = shared.unionByName(verdicts)
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        _removed(*sizes), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    )


def query(docs: DataFrame) -> DataFrame:
    lengths = F.transform("spans", lambda s: s["end"] - s["start"])
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
    SELECT r, doc_id, s, substr(x, 2 * s + 1, {2 * LENGTH}) AS g FROM (SELECT r, doc_id, x, unnest(range(0, n - {LENGTH - 1})) AS s FROM d)
), hit AS (
    SELECT r, s FROM (SELECT r, s, coalesce(doc_id, 9223372036854775807) AS i, min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY g) AS m FROM w) WHERE m < i
), gone AS (
    SELECT DISTINCT r, unnest(range(s, s + {LENGTH})) AS b FROM hit
), marked AS (
    SELECT a.r, a.b, g.b IS NOT NULL AS gone, substr(x, 2 * a.b + 1, 2) AS h
    FROM (SELECT r, x, unnest(range(0, n)) AS b FROM d WHERE r IN (SELECT r FROM hit)) a LEFT JOIN gone g ON g.r = a.r AND g.b = a.b
), spans AS (
    SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY b), false) AS opens FROM marked
), per AS (
    SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(h, '' ORDER BY b) FILTER (NOT gone), '') AS kept
    FROM spans GROUP BY r
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN per USING (r)
"""
