import random
import zlib

import numpy as np
import public_tokenizers as P
from small import documents, rows
from tokenizers import Tokenizer

from tallyspark.llm import token_files


def plain(data):
    """(doc_id, text): the rows that the query gives."""
    t = Tokenizer.from_file(P.path(token_files.VOCABULARY))
    coded = [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")) for i, x in data]
    at, out = 0, []
    for i, ids in sorted(coded, key=lambda r: (r[0] is None, r[0] or 0)):
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def by_start(got):
    return sorted(map(tuple, got), key=lambda r: r[1])


def test_words_equal_whole_texts():
    t, own = Tokenizer.from_file(P.path(token_files.VOCABULARY)), token_files._encoder(token_files.VOCABULARY)
    for text in ("It's  THE end x ΟΔΟΣ ΟΔΟΣ. é ́a", "<|endoftext|> a<|startoftext|>b don't 12 3.5\r\n\x85z\x1cq", "", "東京 😀😀 ｱ", "a" * 500):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_random_texts_equal_library():
    r = random.Random(4)
    t, own = Tokenizer.from_file(P.path(token_files.VOCABULARY)), token_files._encoder(token_files.VOCABULARY)
    alphabets = ("ab,. ", "straße É éa ß.", "x1 'st!?;: ", "ΣΟΔσς ,", "東京 a.\n\t", "İi̇ı ", "µſ ŉ a", "ǅǆ ")
    texts = ["".join(r.choice(a) for _ in range(r.choice((1, 3, 8, 40)))) for a in alphabets for _ in range(150)]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_dictionary_sees_ends_of_texts_and_small_strata(spark):
    data = [(i, "start " * 3000 + f"ending{i % 7} " * 3000, "en", "big", None) for i in range(60)] + [(100 + i, f"rareword{i % 3} " * 4000, "de", "small", None) for i in range(3)]
    docs = spark.createDataFrame([(i, t, lang, source) for i, t, lang, source, _ in data], "doc_id long, text string, lang string, source string")
    dictionary = token_files.train_dictionary(docs)
    t = Tokenizer.from_file(P.path(token_files.VOCABULARY))
    for words in (["start"], [f"ending{i}" for i in range(7)], [f"rareword{i}" for i in range(3)]):
        assert any(np.array(t.encode(w, add_special_tokens=False).ids, "<u4").tobytes() in dictionary for w in words)


def test_whole_tables(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    assert by_start(token_files.query(docs).collect()) == plain([(d["doc_id"], d["text"]) for d in docs.collect()])
    small = [(i, t) for i, t, *_ in rows()]
    assert by_start(token_files.query(documents(spark)).collect()) == plain(small)
    assert token_files.query(documents(spark, [])).count() == 0


def test_blocks_and_one_document(spark, sf_small, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_DOCUMENTS", 7)
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    path = str(tmp_path / "set")
    token_files.write(docs, path)
    t = Tokenizer.from_file(P.path(token_files.VOCABULARY))
    for d in docs.limit(3).collect():
        (ids,) = token_files.read_document(spark, path, d["doc_id"])
        assert ids.tolist() == [*t.encode(d["text"], add_special_tokens=False).ids, 2]
    assert token_files.read_document(spark, path, -5) == []
    digest, dictionary = token_files.read_dictionary(spark, path)
    assert len(dictionary) > 1000 and {r[0] for r in spark.read.parquet(path + "/blocks").select("dict_sha256").collect()} == {digest}
    assert by_start(token_files.read(spark, path).drop("ids").collect()) == plain([(d["doc_id"], d["text"]) for d in docs.collect()])
