import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken
from small import documents, rows

from tallyspark.llm import bpe


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.VOCABULARY), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merge_equals_library():
    ref, own, r = reference(), bpe.Encoder(P.path(bpe.VOCABULARY), P.PATTERN), random.Random(1)
    for alphabet in ("ab", "the andio", "éàü東京😀x", "0123 .,!?\n\t", "aaaa"):
        for n in (0, 1, 2, 3, 7, 40, 900):
            text = "".join(r.choice(alphabet) for _ in range(n))
            assert np.frombuffer(own.encode(text), "<i4").tolist() == ref.encode_ordinary(text)


def test_cut_texts_equal_library():
    ref, own, r = reference(), bpe.Encoder(P.path(bpe.VOCABULARY), P.PATTERN, cut=True), random.Random(2)
    odd = ["", " ", "\n", "a", " a", "a ", "a  b", "a\nb", "\na", "a\n", "a \nb", "a\n b", "\n\na\n\nb", "a\tb c", "a\x1c b", "don't we'll 12 345", "x\u00a0 y", "\x85a b", "a b\u2003c d"]
    for text in odd + ["".join(r.choice(x) for _ in range(r.choice((1, 2, 3, 5, 9, 60)))) for x in ("ab ", "a \n", "the 's1.,\n\t ", "é 東 \n", "x \x1c\x85\u3000") for _ in range(300)]:
        want = ref.encode_ordinary(text)
        assert np.frombuffer(own.encode(text), "<i4").tolist() == want


def test_round_trip_equals_encode_and_decode(spark):
    from pyspark.sql import functions as F

    docs = documents(spark)
    done = bpe.decode(bpe.encode(docs)).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("a"), F.sha2("bytes", 256).alias("b")
    )
    assert sorted(map(str, map(tuple, done.collect()))) == sorted(map(str, map(tuple, bpe.round_trip(docs).collect())))


def test_query_on_whole_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    check(bpe.query(docs), docs)


def test_small_documents(spark):
    docs = documents(spark)
    check(bpe.query(docs), docs)
    assert bpe.query(documents(spark, [])).count() == 0
    assert bpe.encode(docs).count() == len(rows())


def check(result, docs):
    ref = reference()
    want = []
    for d in docs.collect():
        text = d["text"] or ""
        ids = ref.encode_ordinary(text)
        want.append((d["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(map(tuple, result.collect()), key=key) == sorted(want, key=key)
