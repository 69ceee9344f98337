"""Byte-level BPE encoding and decoding over documents.

A text is cut by the tokenizer's pattern and each match is merged on its own. The merge loop keeps a segment tree over
the match's byte positions: a leaf holds the rank of the pair that starts there, an inner node the leftmost smallest
pair below it, so each merge reads the root and makes three logarithmic point updates, and very long matches stay fast.
"""

from __future__ import annotations

import base64
from hashlib import sha256
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyspark.llm.alignment import MARKS, plain
from tallyspark.llm.common import texts, worker_store

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Matches, and pieces of texts, whose ids a worker remembers in each of two generations, and the longest match that it remembers.
REMEMBERED, LONGEST = 100_000, 64
#: Ids after which a part of a batch is handed on.
HAND_ON = 1_000_000
#: Children of a node of the segment tree.
FAN = 16
_NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of one match: the leftmost pair of lowest rank is merged until no pair has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n < 2:
        return [ranks[piece[i : i + 1]] for i in range(n)]
    get = ranks.get
    shift = n.bit_length()
    low = (1 << shift) - 1
    # a leaf is the rank and the place of the pair that starts at its byte, as one number; a node the least of FAN below it
    leaves = [_NONE if (r := get(piece[i : i + 2])) is None else r << shift | i for i in range(n - 1)]
    levels = [leaves]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[k : k + FAN]) for k in range(0, len(below), FAN)])
    top_level, inner = levels[-1], levels[1:]
    end = list(range(1, n + 1))  # of the live token that starts at a byte
    before = list(range(-1, n))  # start of the live token before it
    while (top := min(top_level)) != _NONE:
        i = top & low
        gone = end[i]
        end[i] = stop = end[gone]
        before[stop] = i
        # at most three leaves change: the pair that ended here, the new one here, the one that ends here
        if gone < n - 1:
            leaves[gone] = _NONE
        if stop < n and end[stop] - i <= longest and (r := get(piece[i : end[stop]])) is not None:
            leaves[i] = r << shift | i
        else:
            leaves[i] = _NONE
        j = before[i]
        if j >= 0:
            r = get(piece[j:stop]) if stop - j <= longest else None
            leaves[j] = _NONE if r is None else r << shift | j
        if inner:
            touched, below = {gone, i, max(j, 0)}, leaves
            for level in inner:
                touched = {k // FAN for k in touched}
                for k in touched:
                    if k < len(level):
                        level[k] = min(below[k * FAN : k * FAN + FAN])
                below = level
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Ranks, pattern and the ids of what was seen lately in one worker process.

    The usual pattern ends a match before a single space or line break between other characters. Texts in which all white
    space is of that kind are cut there, and pieces are remembered with their ids; other texts, and other patterns, go match
    by match.
    """

    def __init__(self, path: str, pattern: str, cut: bool = False):
        import regex

        self.ranks = read_ranks(path)
        self.longest = max(map(len, self.ranks))
        self.find = regex.compile(pattern).findall
        self.cut = cut
        # ids of matches as packed numbers: those seen lately, and those seen before them
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # the same for pieces; a piece's space is left out, a text's first piece has one
        self.pieces: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}

    def _match(self, match: str) -> bytes:
        if (ids := self.seen.get(match)) is None:
            if (ids := self.older.get(match)) is None:
                found = merge(match.encode("utf-8"), self.ranks, self.longest)
                ids = pack(f"<{len(found)}i", *found)
            if len(match) <= LONGEST:
                if len(self.seen) > REMEMBERED:
                    self.older, self.seen = self.seen, {}
                self.seen[match] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece: letters alone are one match, marks behind them are another."""
        stem = piece.rstrip(MARKS)
        if stem.isalpha() and max(stem) < "\u0250":
            return self._match(f" {stem}") + (self._match(piece[len(stem) :]) if len(stem) < len(piece) else b"")
        return b"".join(map(self._match, self.find(piece[1:] if piece[0] == " " else piece if piece[0] == "\n" else f" {piece}")))

    def _pieces(self, text: str) -> list[str] | None:
        """The pieces of a text, all of them remembered; None if it can't be cut."""
        out = text.replace("\n", " \n").split(" ")
        out[0] = f" {out[0]}"
        known = self.pieces
        new = set(out).difference(known)
        if new:
            first = out[0] if out[0] in new else None
            if first and len(first) > 1 and first[-1].isspace() or not all(map(plain, new.difference([first]))):
                return None
            if len(known) > REMEMBERED:
                self.older_pieces, self.pieces = known, {}
                known, new = self.pieces, set(out)
            older = self.older_pieces
            for p in new:
                known[p] = ids if (ids := older.get(p)) is not None else self._piece(p)
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        if self.cut and (pieces := self._pieces(text)):
            return b"".join(map(self.pieces.__getitem__, pieces))
        return b"".join(map(self._match, self.find(text)))


def _encoder(vocabulary: str, pattern: str | None) -> Encoder:
    def make():
        import public_tokenizers

        return Encoder(_path(vocabulary), pattern or public_tokenizers.PATTERN, pattern is None)

    return worker_store(f"bpe:{vocabulary}:{pattern}", make)


def _tokens(vocabulary: str) -> tuple[list[bytes], list[bytes]]:
    """The bytes of each id, and the id in decimal with a comma behind it."""

    def make():
        ranks = read_ranks(_path(vocabulary))
        out = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            out[i] = token
        return out, [b"%d," % i for i in range(len(out))]

    return worker_store(f"bpe-tokens:{vocabulary}", make)


def _path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """doc_id, ids array<int> for every row of `docs`.

    Null and empty texts have no ids; repeated rows each get a row; other columns are ignored; an empty table gives an
    empty result. `vocabulary`: a rank file of public_tokenizers, or a path that every executor can read.
    """

    def run(batches):
        made = _encoder(vocabulary, pattern)
        for batch in batches:
            keys, flat, ends, first = batch.column(0), [], [0], 0
            for k, text in enumerate(batch.column(1)):
                flat.append(made.encode(text.as_py()))
                ends.append(ends[-1] + len(flat[-1]) // 4)
                if ends[-1] >= HAND_ON or k == len(keys) - 1:
                    values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(flat))])
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                    yield pa.RecordBatch.from_arrays([keys.slice(first, k + 1 - first), ids], ["doc_id", "ids"])
                    flat, ends, first = [], [0], k + 1

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns of `encoded` with `bytes` binary, what its `ids` stand for (null ids: null). Ids must be in the vocabulary."""
    names = encoded.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields) + ", bytes binary"

    def run(batches):
        tokens, _ = _tokens(vocabulary)
        at = names.index("ids")
        for batch in batches:
            out, held, first = [], 0, 0
            for k, ids in enumerate(batch.column(at)):
                out.append(b"".join(map(tokens.__getitem__, ids.values.to_numpy(zero_copy_only=False).tolist())) if ids.is_valid else None)
                held += len(ids) if ids.is_valid else 0
                if held >= HAND_ON or k == batch.num_rows - 1:
                    rows = batch.slice(first, k + 1 - first)
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.binary())], [*names, "bytes"])
                    out, held, first = [], 0, k + 1

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of what the ids decode to) for every row of `docs`.

    Encodes and decodes as `encode` and `decode` do, with their treatment of rows, but hands on digests alone.
    """
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        made, (tokens, decimals) = _encoder(vocabulary, pattern), _tokens(vocabulary)
        for batch in batches:
            sizes, coded, decoded = [], [], []
            for text in batch.column(1):
                ids = np.frombuffer(made.encode(text.as_py()), "<i4").tolist()
                sizes.append(len(ids))
                coded.append(sha256(b"".join(map(decimals.__getitem__, ids))[:-1]).hexdigest())
                decoded.append(sha256(b"".join(map(tokens.__getitem__, ids))).hexdigest())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, kind)


def query(docs: DataFrame) -> DataFrame:
    return round_trip(docs)
