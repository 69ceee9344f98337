"""Token-id files: a zstandard dictionary shared by all documents, each document compressed on its own.

A file set is two tables. `dictionary` has one row: the dictionary, trained on the serialized ids of a bounded sample,
and its hash. `blocks` has rows of consecutive documents in ascending doc_id order: the hash of the dictionary, the
compressed documents one after another, and an index of offsets, so one short document is read without the others.
Both are written by Spark's own committers, so a lost executor leaves no half file behind.
"""

from __future__ import annotations

import hashlib
import zlib
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import texts, worker_store
from tallyspark.session import materialise, shared_folder

VOCABULARY = "word_bpe_49k.json"
END = 2
#: The dictionary: documents in the sample, bytes of a document's ids in it, in so many stretches, and bytes of the dictionary.
SAMPLE, SAMPLE_BYTES, WINDOWS, DICTIONARY_BYTES = 500, 16_384, 8, 65_536
#: Compressed bytes and documents in a block.
BLOCK_BYTES, BLOCK_DOCUMENTS = 1 << 20, 1000
#: Words whose ids a worker remembers, and the longest that it remembers.
REMEMBERED, LONGEST = 350_000, 64
MARKS = b".,!?;:"
#: Texts whose new words are encoded in one call, and bytes of them.
TOGETHER, TOGETHER_BYTES = 50, 4_000_000


class WordEncoder:
    """The tokenizer of a file; this vocabulary never joins across white space, so words are encoded once and remembered."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model without the steps that leave lower-case words of letters as they are
        self.of_letters = Tokenizer.from_file(path)
        self.of_letters.normalizer = normalizers.Sequence([])
        self.of_letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for entry, i in vocabulary.items() if entry.endswith("</w>")]] = True
        # ids of words as packed numbers: those seen lately, and those seen before them
        self.seen: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _of_letters(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of plain lower-case letters, encoded as one text."""
        ids = np.array(self.of_letters.encode_batch_fast([b" ".join(words).decode("utf-8")], add_special_tokens=False)[0].ids, "<u4")
        edges = [0, *(4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()]
        if len(edges) != len(words) + 1 or edges[-1] != 4 * len(ids):
            return self._by_tokenizer(words)
        data = ids.tobytes()
        return [data[lo:hi] for lo, hi in zip(edges, edges[1:])]

    def _by_tokenizer(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)
        return [pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in found)]

    def _learn(self, words: list[bytes], into: dict[bytes, bytes]) -> None:
        """Ids of words not in `into`; marks behind a letter or digit are a word of their own to the tokenizer."""
        older, letters, rest, behind, asked = self.older.get, [], [], [], set()

        def ask(w: bytes) -> None:
            if w.isalpha():
                letters.append(w)
            elif w.isascii() or not (t := w.decode("utf-8")).isalpha() or not t.islower() or max(t) >= "\u0250":
                rest.append(w)
            else:
                letters.append(w)

        for w in words:
            if (ids := older(w)) is not None:
                into[w] = ids
            elif w.isalpha():  # of bytes: ASCII letters
                letters.append(w)
            elif w[-1] in MARKS and (stem := w.rstrip(MARKS)) and stem[-1:].isalnum():
                behind.append((w, stem, w[len(stem) :]))
            else:
                ask(w)
        asked.update(letters, rest)
        for _, *parts in behind:
            for x in parts:
                if x not in into and x not in asked:
                    asked.add(x)
                    if (ids := older(x)) is not None:
                        into[x] = ids
                    else:
                        ask(x)
        for found, encode in ((letters, self._of_letters), (rest, self._by_tokenizer)):
            for k in range(0, len(found), 2000):
                into.update(zip(part := found[k : k + 2000], encode(part)))
        for w, stem, mark in behind:
            into[w] = into[stem] + into[mark]

    def encode(self, texts_: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        # the vocabulary is lower case; special tokens are looked for before that
        words = [(data if b"<|" in data else data.lower()).split() for data in (t.encode("utf-8") for t in texts_)]
        if len(self.seen) > REMEMBERED:
            self.older, self.seen = self.seen, {}
        seen = self.seen
        new = set().union(*words).difference(seen)
        if new:
            long = [w for w in new if len(w) > LONGEST]
            self._learn([w for w in new if len(w) <= LONGEST], seen)
            if long:
                extra = dict(zip(long, self._by_tokenizer(long)))
                return [b"".join([seen[w] if w in seen else extra[w] for w in own]) for own in words]
        return [b"".join(map(seen.__getitem__, own)) for own in words]


def _encoder(vocabulary: str) -> WordEncoder:
    def make():
        if "/" in vocabulary:
            return WordEncoder(vocabulary)
        import public_tokenizers

        return WordEncoder(public_tokenizers.path(vocabulary))

    return worker_store(f"words:{vocabulary}", make)


def train_dictionary(docs: DataFrame, vocabulary: str = VOCABULARY) -> bytes:
    """A dictionary from a bounded sample of documents; empty if there is too little to learn from.

    At most SAMPLE documents, about as many of each source and language (where `docs` has such columns) as there is room
    for, by hash. They are encoded whole, in tasks; each gives WINDOWS stretches of ids, evenly spread from its beginning to
    its end.
    """
    import zstandard

    strata = [F.col(c).cast("string").alias(f"by_{c}") for c in ("source", "lang") if c in docs.columns]
    rows = docs.select(F.xxhash64("doc_id", "text").alias("h"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *strata)
    names = [c for c in rows.columns if c.startswith("by_")]
    counts = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    groups = max(counts.count(), 1)
    stratum = (F.xxhash64(*names) if names else F.lit(0).cast("long")).alias("stratum")
    # a row's place among those of its stratum, as a share of the room for it; hashes alone are joined and sorted
    rank = F.col("h").bitwiseAND(F.lit((1 << 40) - 1).cast("long")) / float(1 << 40) * F.col("n") * float(groups / SAMPLE)
    ranked = rows.select("h", stratum).join(counts.select(stratum, "n"), "stratum").select("h", rank.alias("rank")).filter("rank < 1")
    first = ranked.groupBy("h").agg(F.min("rank").alias("rank")).orderBy("rank", "h").limit(SAMPLE)
    chosen = rows.select("h", "text").join(F.broadcast(first), "h").select("rank", "h", "text")  # SAMPLE pairs of numbers at most

    def run(batches):
        encoder = _encoder(vocabulary)
        size = SAMPLE_BYTES // WINDOWS // 4 * 4
        for batch in batches:
            parts = []
            for text in batch.column(2):
                ids = encoder.encode([text.as_py()])[0]
                free = max(len(ids) - WINDOWS * size, 0) // 4 / max(WINDOWS - 1, 1)
                parts.append(b"".join(ids[(at := k * size + 4 * int(k * free)) : at + size] for k in range(WINDOWS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.binary())], ["rank", "h", "part"])

    sample = chosen.mapInArrow(run, "rank double, h long, part binary").orderBy("rank", "h", "part").limit(SAMPLE).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r["part"]) for r in sample if r["part"]]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY) -> None:
    """Writes the ids of every row of `docs`, with END behind each document, below `path`.

    Rows go by doc_id (null last), rows of one id by the hash of their compressed ids; null and empty texts have END alone;
    a text of any length is one frame; repeated rows each have theirs; an empty table gives a dictionary and no blocks; other
    columns than source and lang, which spread the dictionary's sample, are ignored.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, vocabulary)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def encode(batches):
        import zstandard

        encoder, shared = _encoder(vocabulary), _codec(dictionary)
        packer = zstandard.ZstdCompressor(level=1, dict_data=shared)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            first, held = 0, 0
            for k, size in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
                held += size
                if k + 1 - first < TOGETHER and held < TOGETHER_BYTES and k + 1 < batch.num_rows:
                    continue
                part = batch.slice(first, k + 1 - first)
                ids = [x + end for x in encoder.encode(part.column(1).to_pylist())]
                columns = [part.column(0), pa.array([packer.compress(x) for x in ids], pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "frame", "n"])
                first, held = k + 1, 0

    def block(batches):
        from pyspark import TaskContext

        ids, frames, sizes = [], [], []
        part, before, held = TaskContext.get().partitionId(), 0, 0

        def packed():
            offsets = np.cumsum([0, *map(len, frames)]).tolist()
            row = {"dict_sha256": digest, "part": part, "before": before, "total": sum(sizes), "first_id": ids[0], "last_id": ids[-1]}
            return pa.RecordBatch.from_pylist([row | {"doc_ids": ids, "n_tokens": sizes, "offsets": offsets, "payload": b"".join(frames)}], SCHEMA)

        for batch in batches:
            for doc_id, frame, n in zip(*(c.to_pylist() for c in batch.columns[:3])):
                ids.append(doc_id)
                frames.append(frame)
                sizes.append(n)
                held += len(frame)
                if held >= BLOCK_BYTES or len(ids) >= BLOCK_DOCUMENTS:
                    yield packed()
                    before += sum(sizes)
                    ids, frames, sizes, held = [], [], [], 0
        if ids:
            yield packed()

    # written first: dealing by range looks at its input twice
    framed = materialise(texts(docs).mapInArrow(encode, "doc_id long, frame binary, n long"), "token-frames")
    order = F.col("doc_id").asc_nulls_last(), F.xxhash64("frame")
    ordered = framed.repartitionByRange(*order).sortWithinPartitions(*order, "frame")
    ordered.mapInArrow(block, BLOCKS).write.parquet(f"{path}/blocks")


#: part: the writing task, in the order of doc_id; before: ids in earlier blocks of the part.
SCHEMA = pa.schema([
    ("dict_sha256", pa.string()), ("part", pa.int32()), ("before", pa.int64()), ("total", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary()),
])
BLOCKS = (
    "dict_sha256 string, part int, before long, total long, first_id long, last_id long, doc_ids array<long>, n_tokens array<long>, "
    "offsets array<long>, payload binary"
)


def read_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(row["dictionary"])
    if hashlib.sha256(dictionary).hexdigest() != row["dict_sha256"]:
        raise ValueError(f"the dictionary below {path} doesn't match its hash")
    return row["dict_sha256"], dictionary


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """Ids of one document (once for each row of that id): only blocks whose range holds the id, only its own frames."""
    import zstandard

    digest, dictionary = read_dictionary(spark, path)
    shared = _codec(dictionary)
    blocks = spark.read.parquet(f"{path}/blocks").filter((F.col("first_id") <= doc_id) & (F.col("last_id").isNull() | (F.col("last_id") >= doc_id)))
    places = blocks.select("dict_sha256", F.posexplode("doc_ids").alias("k", "id"), "offsets", "payload").filter(F.col("id") == doc_id)
    start = F.element_at("offsets", F.col("k") + 1)
    frames = places.select("dict_sha256", F.substring("payload", (start + 1).cast("int"), (F.element_at("offsets", F.col("k") + 2) - start).cast("int")).alias("frame")).collect()
    if any(f["dict_sha256"] != digest for f in frames):
        raise ValueError("a block was written with another dictionary")
    return [np.frombuffer(zstandard.ZstdDecompressor(dict_data=shared).decompress(bytes(f["frame"])), "<u4") for f in frames]


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids binary for every document of a file set."""
    digest, dictionary = read_dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    # one row for each writing task
    parts = blocks.groupBy("part").agg(F.sum("total").alias("own"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = parts.select("part", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("offset"))
    placed = blocks.join(offset, "part").withColumn("start", F.col("offset") + F.col("before"))

    def decode(batches):
        import zstandard

        opener = zstandard.ZstdDecompressor(dict_data=_codec(dictionary))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_sha256"] != digest:
                    raise ValueError("a block was written with another dictionary")
                view, at = row["payload"], row["offsets"]
                ids = [opener.decompress(view[a:b]) for a, b in zip(at, at[1:])]
                sizes = [len(x) // 4 for x in ids]
                begin = (row["start"] + np.cumsum([0, *sizes[:-1]])).tolist()
                columns = [
                    pa.array(row["doc_ids"], pa.int64()), pa.array(begin, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return placed.select("dict_sha256", "doc_ids", "offsets", "payload", "start").mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    )


def query(docs: DataFrame) -> DataFrame:
    path = shared_folder(docs.sparkSession, "token-files")
    write(docs, path)
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", "ids_crc32")
