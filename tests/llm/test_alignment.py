import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import sentencepiece
from small import documents, rows
from tokenizers import Tokenizer

from tallyspark.llm import alignment

A = Tokenizer.from_file(P.path(alignment.BYTE_VOCABULARY))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=P.path(alignment.PIECE_VOCABULARY))


def gpt_bytes():
    keep = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    table, extra = {}, 0
    for b in range(256):
        table[chr(b) if b in keep else chr(256 + extra)] = b
        extra += b not in keep
    return table


STAND_IN = gpt_bytes()


def a_bytes(i):
    return bytes(STAND_IN[c] for c in A.id_to_token(i))


def b_bytes(i):
    return bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()


def tokens(text):
    """Ids of whole texts by both libraries, or nothing."""
    if not text:
        return [], []
    a, b, data = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text), (" " + text).encode()
    return (a, b) if b"".join(map(a_bytes, a)) == data and b"".join(map(b_bytes, b)) == data else ([], [])


def spans(ids, of):
    out, at = [], 0
    for i in ids:
        out.append((at, at := at + len(of(i))))
    return out


def brute(texts):
    each, counts = [], Counter()
    for text in texts:
        a, b = tokens(text)
        sa, sb = spans(a, a_bytes), spans(b, b_bytes)
        links, j = [], 0
        for i, (lo, hi) in enumerate(sa):
            while j < len(sb) and sb[j][1] <= lo:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < hi:
                links.append((a[i], b[k]))
                k += 1
        common = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, x, y = [], 0, 0
        for end in common:
            ga, gb = [], []
            while x < len(sa) and sa[x][1] <= end:
                ga.append(str(a[x]))
                x += 1
            while y < len(sb) and sb[y][1] <= end:
                gb.append(str(b[y]))
                y += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        counts.update(set(links))
        each.append((len(a), len(b), groups, links))
    top = {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for n_a, n_b, groups, links in each:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        out.append((n_a, n_b, len(groups), len(links), sum(counts[x] == top[x[0]] for x in links), sum(counts[x] for x in links), digest))
    return out, counts, top


ODD = ["", " ", "\n", "a", " a", "a ", "a  b", "a\nb", "a \nb", "a\n b", "\na", "\n\na\n\nb\n", "a\tb", "a b", "x▁y", "<s> </s> <unk> <|endoftext|> <0x41>", "東京都 に\n行く", "\x00\x1c \x85",
       "don't we'll 12 345 é é \U0001f600\U0001f600", "a\r\nb", "foo \x1cbar", "}\r\n\r\n", "ﬁne ½"]


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.query(docs).collect()}
    want, counts, top = brute(texts)
    assert [got[k] for k in range(len(texts))] == want
    return docs, counts, top


def test_pieces_give_the_tokens_of_whole_texts():
    r = random.Random(3)
    own = alignment.Pieces(alignment.Tokenizers(alignment.BYTE_VOCABULARY, alignment.PIECE_VOCABULARY))
    alphabets = [" \n", "ab \n", "the an's 12.,!\n\t", "éà ü東京   \n", "\r\n x", "x \x1c\x85​"]
    for text in ODD[1:] + ["".join(r.choice(a) for _ in range(r.choice((1, 2, 3, 5, 9, 40)))) for a in alphabets for _ in range(150)]:
        found = [own.ids[k] for k in own.numbers(text)]
        want = tokens(text)
        if None in found:
            assert want == ([], [])
        else:
            assert tuple(np.frombuffer(b"".join(x), "<i4").tolist() for x in zip(*found)) == want


def test_against_brute_force(spark, sf_small):
    texts = [r[0] for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("text").collect()]
    docs, counts, top = check(spark, texts[:120] + ODD + [None])
    got = {(r["a_id"], r["b_id"]): (r["documents"], r["best"]) for r in alignment.pair_counts(docs).collect()}
    assert got == {k: (n, n == top[k[0]]) for k, n in counts.items()}


def test_many_blocks_and_levels(spark, sf_small, monkeypatch):
    texts = [r[0][:1500] for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("text").limit(60).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    written = alignment.blocks
    # a block for each document, and a tree of three steps
    monkeypatch.setattr(alignment, "FAN", 3)
    monkeypatch.setattr(alignment, "blocks", lambda *x: written(docs.repartition(40, "doc_id"), *x[1:]))
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.query(docs).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)[0]


def test_small_documents(spark):
    texts = [r[1] for r in rows()]
    want, _, _ = brute(texts)
    got = alignment.query(documents(spark)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(map(tuple, got), key=key) == sorted([(r[0], *w) for r, w in zip(rows(), want)], key=key)
    assert alignment.query(documents(spark, [])).count() == 0


def test_perfect_hash():
    r = np.random.default_rng(5)
    for n in (0, 1, 2, 100, 20_000):
        keys = np.unique(r.integers(0, 1 << 48, n))
        f = alignment.PerfectHash.from_bytes(alignment.PerfectHash.over(keys).to_bytes())
        assert sorted(f(keys).tolist()) == list(range(len(keys)))
        other = np.setdiff1d(r.integers(0, 1 << 48, 1000), keys)
        assert ((f(other) >= -1) & (f(other) < max(len(keys), 1))).all()
