"""Alignment of two tokenizers over documents, and in how many documents each pair of ids is linked.

A text is cut before single spaces and line breaks between other characters. Both tokenizers end a token there, so pieces
are encoded once, remembered, and a text's tokens are those of its pieces. Documents are written as blocks: the ids of
the block's distinct pieces, and each document as numbers of pieces.

Pairs are counted with minimal perfect hashing. Pairs are dealt to shards by their first id. In each shard a function is
built over the distinct pairs; blocks' counts are added up as dense vectors in the function's order, in a tree; lookups
verify the stored key. A second pass aligns the written blocks again and looks the counts up. No task holds more than one
block or, of one shard, the pairs that the two vocabularies can form.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import texts, worker_store
from tallyspark.session import materialise

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pieces that a worker remembers, and pieces that are encoded in one call.
REMEMBERED, TOGETHER = 300_000, 2_000
#: Pieces of documents, repeats included, after which a block ends, and code points of them.
BLOCK_PIECES, BLOCK_CHARACTERS = 1_000_000, 6_000_000
#: Shards of pairs, and parts that one step of the tree joins.
SHARDS, FAN = 64, 64
#: Keys of a shard's function: slots for each key at each level.
GAMMA = 2
#: Marks behind a word.
MARKS = ".,!?;:"
_MARK = "▁"


# ---- minimal perfect hash ------------------------------------------------------------------------------------------


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    h = keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """Keys to 0 .. n - 1 without gaps: at each level a key that has its slot alone stays there, the rest go on to the next."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # the number in the order of slots, -1 where no key or more than one fell

    @classmethod
    def over(cls, keys: np.ndarray) -> PerfectHash:
        """A function over distinct keys."""
        levels, given = [], 0
        while len(keys):
            size = max(GAMMA * len(keys), 4)
            slot = (_mixed(keys, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(slot, minlength=size) == 1
            number = np.where(alone, given + np.cumsum(alone) - 1, -1)
            given += int(alone.sum())
            levels.append(number.astype(np.int32))
            keys = keys[~alone[slot]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; of a key that the function wasn't built over any number, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, number in enumerate(self.levels):
            found = number[(_mixed(keys[left], level) % np.uint64(len(number))).astype(np.int64)]
            out[left] = found
            left = left[found < 0]
        return out

    def to_bytes(self) -> bytes:
        return packed([np.array(list(map(len, self.levels)), np.int32), *self.levels])

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        return cls(unpacked(data)[1:])


def packed(parts: list[np.ndarray]) -> bytes:
    """Arrays of 32-bit numbers as one compressed value."""
    import zstandard

    head = np.array([len(parts), *map(len, parts)], "<i4")
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *(p.astype("<i4").tobytes() for p in parts)]))


def unpacked(data: bytes) -> list[np.ndarray]:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i4")
    sizes = flat[1 : 1 + flat[0]]
    return np.split(flat[1 + flat[0] :], np.cumsum(sizes)[:-1])


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for size[0] numbers, then those from begin[1], and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(begin, size)


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values, rising."""
    ordered = np.sort(values)
    return ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))] if len(ordered) else ordered


# ---- both tokenizers -----------------------------------------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes are themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both vocabularies with the bytes of each id."""

    def __init__(self, first: str, second: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(_path(first))
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=_path(second))
        of = byte_alphabet()
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for entry, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode("utf-8")
        # where merges go by rising id, the ranks alone give the same ids; tested against the vocabulary's own library
        with open(_path(first), encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        merged = set(ids)
        ranks = {b: i for i, b in enumerate(self.a_bytes) if len(b) == 1 or i in merged}
        self.by_rank = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ids == sorted(ids) else None
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_MARK, " ").encode("utf-8"))
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        # marks that no piece joins to a letter before them, as the first vocabulary's pattern never does: a token begins there
        joined = {y for i in range(self.b.get_piece_size()) for x, y in pairwise(self.b.id_to_piece(i)) if x.isalpha()}
        self.marks = "".join(m for m in MARKS if m not in joined)

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a stretch that stands where both end a token. The second tokenizer puts a space before every text."""
        b = self.b.encode(text[1:] if text[0] == " " else text)
        return self.a.encode(text, add_special_tokens=False).ids, b if text[0] == " " else b[1:]

    def agrees(self, text: str, a: list[int], b: list[int]) -> bool:
        data = text.encode("utf-8")
        return b"".join(map(self.a_bytes.__getitem__, a)) == data and b"".join(map(self.b_bytes.__getitem__, b)) == data


def _path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizers(first: str, second: str) -> Tokenizers:
    return worker_store(f"tokenizers:{first}:{second}", lambda: Tokenizers(first, second))


_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def plain(piece: str) -> bool:
    """A piece behind a single space (left out) or with a single line break in front, other white space at neither end."""
    if not piece or piece[-1].isspace():
        return False
    return not (piece[1:2] if piece[0] == "\n" else piece[0]).isspace()


def whole(piece: str) -> str:
    return piece if piece[0] in " \n" else f" {piece}"


def pieces_of(text: str, known: dict[str, int]) -> tuple[list[str], set[str]]:
    """The pieces of a space and the text, and those not known. Pieces that aren't plain keep their space, so no two stretches share a name."""
    out = text.replace("\n", " \n").split(" ")
    new = set(out).difference(known)
    if all(map(plain, new)):
        return out, new
    out = [c[1:] if c[0] == " " and plain(c[1:]) and c[1] != "\n" else c for c in _CUT.split(f" {text}")]
    return out, set(out).difference(known)


class Pieces:
    """Ids of the pieces seen lately in one worker process."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        # ids as packed numbers; None: the bytes of some token sequence differ from the text
        self.ids: list[tuple[bytes, bytes] | None] = []
        self.marks: dict[str, tuple[bytes, bytes]] = {}

    def _learn(self, new: list[str]) -> None:
        """Ids of pieces not known yet. A word with marks behind it has the word's ids, then those of the marks."""
        marks, slots, behind = self.tokenizers.marks, self.slots, {}
        need = []
        for p in new:
            if p[-1] in marks and p[0] != " " and (stem := p.rstrip(marks)) and stem[-1].isalpha():
                behind[p] = stem
                if stem not in slots:
                    need.append(stem)
            else:
                need.append(p)
        need = list(dict.fromkeys(need))
        for k in range(0, len(need), TOGETHER):
            group = need[k : k + TOGETHER]
            for p, ids in zip(group, self._encoded(group)):
                slots[p] = len(self.ids)
                self.ids.append(ids)
        for p, stem in behind.items():
            ids, after = self.ids[slots[stem]], self._mark_ids(p[len(stem) :])
            slots[p] = len(self.ids)
            self.ids.append(ids and (ids[0] + after[0], ids[1] + after[1]))

    def _mark_ids(self, run: str) -> tuple[bytes, bytes]:
        """Ids of marks behind a letter."""
        if run not in self.marks:
            with_x, x = self.tokenizers.encode(f" x{run}"), self.tokenizers.encode(" x")
            found = tuple(np.array(w[len(o) :], "<i4").tobytes() for w, o in zip(with_x, x))
            if len(run) > 8:  # long runs are rare and not remembered
                return found
            self.marks[run] = found
        return self.marks[run]

    def _encoded(self, group: list[str]) -> list[tuple[bytes, bytes] | None]:
        t = self.tokenizers
        stretches = list(map(whole, group))
        # plain pieces are encoded one behind the other
        joined = [k for k, p in enumerate(group) if p[0] != " " and _MARK not in p]
        out: list = [None] * len(group)
        left = range(len(group))
        found = self._cut_apart([stretches[k] for k in joined])
        if found is not None:
            for k, ids in zip(joined, found):
                out[k] = ids
            left = sorted(set(left).difference(joined))
        for k in left:
            a, b = t.encode(stretches[k])
            if t.agrees(stretches[k], a, b):
                out[k] = np.array(a, "<i4").tobytes(), np.array(b, "<i4").tobytes()
        return out

    def _cut_apart(self, stretches: list[str]) -> list[tuple[bytes, bytes]] | None:
        """Ids of plain pieces by both tokenizers; None if bytes differ or the ends of tokens don't tell the pieces apart."""
        t = self.tokenizers
        text = " x" + "".join(stretches)
        a = t.by_rank.encode_ordinary(text) if t.by_rank else t.a.encode(text, add_special_tokens=False).ids
        b = t.b.encode(text[1:])
        if not t.agrees(text, a, b):
            return None
        ends = np.cumsum([2, *(len(s.encode("utf-8")) for s in stretches)])
        out = []
        for ids, size in ((a, t.a_size), (b, t.b_size)):
            own = np.array(ids, "<i4")
            token_ends = np.cumsum(size[own])
            at = np.searchsorted(token_ends, ends)
            if (token_ends[at] != ends).any():
                return None
            data, cut = own.tobytes(), (4 * (at + 1)).tolist()
            out.append([data[x:y] for x, y in zip(cut, cut[1:])])
        return list(zip(*out))

    def numbers(self, text: str) -> list[int]:
        """Slots of the pieces of a space and the text."""
        found, new = pieces_of(text, self.slots)
        if new:
            self._learn(sorted(new))
        return list(map(self.slots.__getitem__, found))


# ---- blocks --------------------------------------------------------------------------------------------------------


@dataclass
class Aligned:
    """What is known of a block's distinct pieces from their ids alone."""

    pairs: np.ndarray  # distinct codes (first id << 32 | second id), rising
    link_pair: np.ndarray  # for each link, its number among them; links go by piece
    link_begin: np.ndarray  # for each piece, its first link, and the end
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    own_pairs: np.ndarray  # distinct pairs of each piece, one piece after the other
    own_begin: np.ndarray
    group_texts: Callable[[], list[str]]


def align(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> Aligned:
    """Ids of pieces one after the other, where each piece ends in them, and the bytes of each id."""
    count = len(a_ends)
    stop_a, stop_b = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    start_a, start_b = stop_a - a_size[a], stop_b - b_size[b]
    common = stop_a[stop_b[np.minimum(np.searchsorted(stop_b, stop_a), len(stop_b) - 1)] == stop_a] if len(stop_b) else stop_b
    group_a, group_b = np.searchsorted(common, stop_a), np.searchsorted(common, stop_b)
    low, high = np.searchsorted(stop_b, start_a, "right"), np.searchsorted(start_b, stop_a, "left")
    links = high - low
    codes = np.repeat(a.astype(np.int64) << 32, links) | b[ragged(low, links)].astype(np.int64)
    pairs = distinct(codes)
    link_pair = np.searchsorted(pairs, codes)
    link_begin = np.concatenate(([0], np.concatenate(([0], np.cumsum(links)))[a_ends]))
    n_a, n_b = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
    piece = np.repeat(np.arange(count), np.diff(link_begin))
    own = distinct(piece * max(len(pairs), 1) + link_pair)
    own_begin = np.searchsorted(own // max(len(pairs), 1), np.arange(count + 1))
    # pieces end where groups end
    group_end = np.concatenate(([0], group_a + 1))[a_ends]
    group_begin = np.concatenate(([0], group_end))

    def group_texts() -> list[str]:
        # the ids of a group's first tokens stand before those of its second ones; each carries the sign that follows it
        edge_a, edge_b = (np.searchsorted(g, np.arange(len(common) + 1)) for g in (group_a, group_b))
        last_a, last_b = (np.diff(g, append=-1) != 0 for g in (group_a, group_b))
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + edge_b[group_a]] = 3 * a.astype(np.int64) + last_a
        order[np.arange(len(b)) + edge_a[group_b + 1]] = 3 * b.astype(np.int64) + 2 * last_b
        signs, size = _signed_ids(max(len(a_size), len(b_size)))
        text = "".join(map(signs.__getitem__, order.tolist()))
        ends = np.concatenate(([0], np.cumsum(size[order])))[np.concatenate(([0], a_ends + b_ends))].tolist()
        return [text[x:y] for x, y in zip(ends, ends[1:])]

    return Aligned(pairs, link_pair, link_begin, n_a, n_b, np.diff(group_begin), own % max(len(pairs), 1), own_begin, group_texts)


def _signed_ids(n: int) -> tuple[list[str], np.ndarray]:
    """Each id below n with a comma, a bar and a semicolon behind it, and the lengths of these."""

    def make():
        signs = [f"{i}{sign}" for i in range(n) for sign in ",|;"]
        return signs, np.array(list(map(len, signs)))

    return worker_store(f"signed-ids:{n}", make)


def _shard(pairs: np.ndarray) -> np.ndarray:
    """All pairs of a first id are in one shard."""
    return ((pairs >> 32) * 0x9E3779B1 >> 16) % SHARDS


def _shards(pairs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    of = _shard(pairs)
    for shard in np.unique(of).tolist():
        yield shard, np.flatnonzero(of == shard)


BLOCKS = "block long, shard int, ids array<long>, payload binary, pairs binary, counts binary"
_BLOCKS = pa.schema([
    ("block", pa.int64()), ("shard", pa.int32()), ("ids", pa.list_(pa.int64())), ("payload", pa.binary()), ("pairs", pa.binary()), ("counts", pa.binary()),
])


def _align_payload(payload: bytes, t: Tokenizers) -> tuple[Aligned, np.ndarray, np.ndarray, np.ndarray]:
    """The alignment of a block, where each document ends in the pieces, the pieces of documents, and which pieces are usable."""
    document_ends, numbers, usable, a_ends, b_ends, a, b = unpacked(payload)
    return align(a, a_ends, b, b_ends, t.a_size, t.b_size), document_ends, numbers, usable > 0


def blocks(docs: DataFrame, first: str = BYTE_VOCABULARY, second: str = PIECE_VOCABULARY) -> DataFrame:
    """First pass: rows of blocks (shard -1) and, for each block and shard, its distinct pairs and in how many of its documents each is linked."""

    def run(batches):
        from pyspark import TaskContext

        t = _tokenizers(first, second)
        pieces = worker_store(f"pieces:{first}:{second}", lambda: Pieces(t))
        number = TaskContext.get().partitionId() << 32
        ids, documents, held, characters = [], [], 0, 0

        def finished() -> pa.RecordBatch:
            sizes = np.array(list(map(len, documents)), np.int64)
            flat = np.concatenate(documents)
            seen = np.zeros(len(pieces.ids), bool)
            seen[flat] = True
            used = np.flatnonzero(seen)
            place = np.cumsum(seen) - 1
            found = [pieces.ids[k] for k in used.tolist()]
            usable = np.array([x is not None for x in found], np.int32)
            a, b = ([x[side] if x else b"" for x in found] for side in (0, 1))
            ends = [np.cumsum([len(x) // 4 for x in side], dtype=np.int64) for side in (a, b)]
            flat_ids = [np.frombuffer(b"".join(side), "<i4") for side in (a, b)]
            payload = packed([np.cumsum(sizes), place[flat], usable, *ends, *flat_ids])
            made, document_ends, numbers, good = _align_payload(payload, t)
            counts, mark = np.zeros(len(made.pairs), np.int64), np.zeros(len(made.pairs), bool)
            begin = 0
            for end in document_ends.tolist():
                own = distinct(numbers[begin:end])
                begin = end
                if good[own].all():
                    linked = made.own_pairs[ragged(made.own_begin[own], made.own_begin[own + 1] - made.own_begin[own])]
                    mark[linked] = True
                    counts += mark
                    mark[linked] = False
            rows = [{"block": number, "shard": -1, "ids": ids, "payload": payload}]
            for shard, at in _shards(made.pairs):
                rows.append({"block": number, "shard": shard, "pairs": made.pairs[at].tobytes(), "counts": counts[at].astype("<i4").tobytes()})
            return pa.RecordBatch.from_pylist(rows, _BLOCKS)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ids.append(doc_id)
                documents.append(np.array(pieces.numbers(text) if text else [], np.int32))
                held += len(documents[-1])
                characters += len(text)
                if held >= BLOCK_PIECES or characters >= BLOCK_CHARACTERS or len(pieces.slots) > REMEMBERED:
                    yield finished()
                    number += 1
                    ids, documents, held, characters = [], [], 0, 0
                    if len(pieces.slots) > REMEMBERED:
                        pieces.forget()
        if ids:
            yield finished()

    return texts(docs).mapInArrow(run, BLOCKS)


# ---- counts over all blocks ----------------------------------------------------------------------------------------


def _tree(parts: DataFrame, groups: int, join: Callable[[pa.Table], list[dict]], kind: str, schema: pa.Schema) -> DataFrame:
    """Joins the rows of a shard, FAN groups at a time, until one group is left for each shard."""
    while True:
        parts = parts.groupBy("shard", "part").applyInArrow(lambda table: pa.Table.from_pylist(join(table), schema), kind)
        if groups <= 1:
            return parts
        groups = -(-groups // FAN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))


def count_pairs(written: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """From written blocks: the pairs of blocks with their part, a row for each shard (function, keys, counts, best), and the number of parts.

    best marks a pair whose count is the highest of its first id.
    """
    groups = max(1, -(-written.filter("shard = -1").count() // FAN))
    own = written.filter("shard >= 0").select("block", "shard", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("part"), "pairs", "counts")

    def keys(table: pa.Table) -> list[dict]:
        found = distinct(np.frombuffer(b"".join(table["pairs"].to_pylist()), np.int64))
        return [{"shard": table["shard"][0].as_py(), "part": table["part"][0].as_py(), "pairs": found.tobytes()}]

    kind, schema = "shard int, part int, pairs binary", pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("pairs", pa.binary())])
    gathered = _tree(own.select("shard", "part", "pairs"), groups, keys, kind, schema)

    def functions(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                found = np.frombuffer(r["pairs"], np.int64)
                function = PerfectHash.over(found)
                stored = np.empty_like(found)
                stored[function(found)] = found
                out.append({"shard": r["shard"], "function": function.to_bytes(), "keys": stored.tobytes()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("shard", pa.int32()), ("function", pa.binary()), ("keys", pa.binary())]))

    hashed = materialise(gathered.mapInArrow(functions, "shard int, function binary, keys binary"), "pair-functions")

    def in_parts(table: DataFrame) -> DataFrame:
        return table.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def places(function: bytes, keys: bytes, pairs: bytes) -> np.ndarray:
        stored, wanted = np.frombuffer(keys, np.int64), np.frombuffer(pairs, np.int64)
        at = PerfectHash.from_bytes(function)(wanted)
        if (at < 0).any() or (stored[at] != wanted).any():
            raise ValueError("a pair is missing from its shard's function")
        return at

    dense = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("vector", pa.binary())])

    def vectors(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            f = right.to_pylist()[0]
            total = np.zeros(len(f["keys"]) // 8, np.int64)
            for r in left.to_pylist():
                total[places(f["function"], f["keys"], r["pairs"])] += np.frombuffer(r["counts"], "<i4")  # a block has each pair once
            out.append({"shard": f["shard"], "part": f["part"], "vector": total.tobytes()})
        return pa.Table.from_pylist(out, dense)

    def added(table: pa.Table) -> list[dict]:
        total = sum(np.frombuffer(v, np.int64) for v in table["vector"].to_pylist())
        return [{"shard": table["shard"][0].as_py(), "part": table["part"][0].as_py(), "vector": total.tobytes()}]

    kind = "shard int, part int, vector binary"
    parts = own.groupBy("shard", "part").cogroup(in_parts(hashed).groupBy("shard", "part")).applyInArrow(vectors, kind)
    summed = _tree(parts.withColumn("part", F.floor(F.col("part") / FAN).cast("int")), -(-groups // FAN), added, kind, dense)

    def best(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ids, total = np.frombuffer(r["keys"], np.int64) >> 32, np.frombuffer(r["vector"], np.int64)
                _, of = np.unique(ids, return_inverse=True)
                highest = np.zeros(of.max() + 1, np.int64)
                np.maximum.at(highest, of, total)
                out.append((total == highest[of]).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], ["shard", "function", "keys", "vector", "best"])

    kind = "shard int, function binary, keys binary, vector binary, best binary"
    counted = hashed.join(summed.drop("part"), "shard").select("shard", "function", "keys", "vector").mapInArrow(best, kind)
    return own, materialise(counted, "pair-counts"), groups


def looked_up(own: DataFrame, counted: DataFrame, groups: int) -> DataFrame:
    """block, shard, vector, best: counts of a block's pairs of a shard, in their order."""
    schema = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("vector", pa.binary()), ("best", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            f = right.to_pylist()[0]
            function, keys = PerfectHash.from_bytes(f["function"]), np.frombuffer(f["keys"], np.int64)
            total, best = np.frombuffer(f["vector"], np.int64), np.frombuffer(f["best"], np.uint8)
            for r in left.to_pylist():
                wanted = np.frombuffer(r["pairs"], np.int64)
                at = function(wanted)
                if (at < 0).any() or (keys[at] != wanted).any():
                    raise ValueError("a pair is missing from its shard's function")
                out.append({"block": r["block"], "shard": f["shard"], "vector": total[at].tobytes(), "best": best[at].tobytes()})
        return pa.Table.from_pylist(out, schema)

    parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return own.select("block", "shard", "part", "pairs").groupBy("shard", "part").cogroup(parts.groupBy("shard", "part")).applyInArrow(run, "block long, shard int, vector binary, best binary")


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_RESULT = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])


def aligned(docs: DataFrame, first: str = BYTE_VOCABULARY, second: str = PIECE_VOCABULARY) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of `docs`.

    Null and empty texts, and those whose tokens' bytes differ from a space and the text under either tokenizer, have no
    tokens: zeros and an empty string. Repeated rows and rows with a null id count as documents of their own; ties among an
    id's counts are all best; a text of any length is in one block; an empty table gives an empty result.
    """
    written = materialise(blocks(docs, first, second), "alignment-blocks")
    found = looked_up(*count_pairs(written))

    def second_pass(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        t = _tokenizers(first, second)
        for block in left.to_pylist():
            made, document_ends, numbers, good = _align_payload(block["payload"], t)
            count, best = np.zeros(len(made.pairs), np.int64), np.zeros(len(made.pairs), np.int64)
            by_shard = {r["shard"]: r for r in right.to_pylist()}
            for shard, at in _shards(made.pairs):
                count[at] = np.frombuffer(by_shard[shard]["vector"], np.int64)
                best[at] = np.frombuffer(by_shard[shard]["best"], np.uint8)

            def of_pieces(value: np.ndarray) -> np.ndarray:
                running = np.concatenate(([0], np.cumsum(value[made.link_pair])))
                return running[made.link_begin[1:]] - running[made.link_begin[:-1]]

            figures = np.column_stack((made.n_a, made.n_b, made.n_groups, np.diff(made.link_begin), of_pieces(best), of_pieces(count)))
            group_texts, begin = made.group_texts(), 0
            for doc_id, end in zip(block["ids"], document_ends.tolist()):
                own = numbers[begin:end]
                begin = end
                if len(own) and good[own].all():
                    digest = hashlib.sha256("".join(map(group_texts.__getitem__, own.tolist()))[:-1].encode()).hexdigest()
                    out.append((doc_id, *figures[own].sum(0).tolist(), digest))
                else:
                    out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        return pa.Table.from_pylist([dict(zip(_RESULT.names, r)) for r in out], _RESULT)

    payloads = written.filter("shard = -1").select("block", "ids", "payload")
    return payloads.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(second_pass, RESULT)


def pair_counts(docs: DataFrame, first: str = BYTE_VOCABULARY, second: str = PIECE_VOCABULARY) -> DataFrame:
    """a_id, b_id, documents, best for every pair of ids that is linked in some document of `docs`."""
    _, counted, _ = count_pairs(materialise(blocks(docs, first, second), "alignment-blocks"))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                keys = np.frombuffer(r["keys"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(np.frombuffer(r["vector"], np.int64)), pa.array(np.frombuffer(r["best"], np.uint8) > 0)],
                    ["a_id", "b_id", "documents", "best"],
                )

    return counted.select("keys", "vector", "best").mapInArrow(run, "a_id int, b_id int, documents long, best boolean")


def query(docs: DataFrame) -> DataFrame:
    return aligned(docs)
