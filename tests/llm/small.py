"""Small documents for the tests of the corpus operators: nulls, empty and long texts, ties, repeated rows, clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, ids string, size string, spans string"
PROSE = "The quick brown fox jumps over the lazy dog while seven wizards box quickly near the old harbour wall. "


def rows():
    base = " ".join(f"word{i % 37}x{i}" for i in range(120))
    texts = [
        (0, base), (1, base), (2, base.replace("word5x5", "other")), (3, None), (4, ""), (5, " \t\n"), (6, PROSE * 40), (7, "x" * 5000),
        (8, "naïve café 東京 \U0001f600 mail a.b@c.de, 10.0.0.1 +49 (30) 123-4567 4111 1111 1111 1111"), (9, "<s>[INST] \\ </s>"),
        (9, "<s>[INST] \\ </s>"), (10, "one\ntwo\none\none two three one two three"), (11, "ab " * 400), (None, PROSE), (13, PROSE + base), (14, base + " tail"),
    ]
    sources = ["a", "b", None, "é", "a", "a"]
    return [(i, t, None if k % 5 == 0 else "en", sources[k % 6], None, "k", None, "s", "p") for k, (i, t) in enumerate(texts)]


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
