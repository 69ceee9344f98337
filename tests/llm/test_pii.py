import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from small import documents, rows

from tallyspark.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19
                and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0,
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "7", "11", "255", "256", ".", "@", "-", "+", " ", "(", ")", "_x", "a@b.c", "1.2.3.4", "+4912345678", "é", "\n", "4111 1111 1111 1111"]), max_size=25))
def test_base_spans_equal_brute_force(parts):
    text = "".join(parts)
    base = [f"{k}:{s}:{e}" for s, e, k, _ in pii.find(text) if k in pii.BASE]
    assert base == brute(text)


def test_added_kinds_and_scores():
    spans = {k: v for _, _, k, v in pii.find("please call 030 1234 5678, iban DE89 3704 0044 0532 0130 00 or DE89 3704 0044 0532 0130 01")}
    assert set(spans) == {"iban", "local_phone"}
    assert pii.find("order 030 1234 5678") == []
    low, high = pii.find("x 4111111111111111")[0][3], pii.find("card 4111111111111111")[0][3]
    assert low < high <= 1


def test_ordinary_ways_of_writing():
    for text, kind, span in (
        ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "iban", "DE89 3704 0044 0532 0130 00"),
        ("DE89370400440532013000 EUR 500", "iban", "DE89370400440532013000"),
        ("GB82WEST12345698765432 BIC DEUTDEFF", "iban", "GB82WEST12345698765432"),
        ("ID AB12 DE89370400440532013000", "iban", "DE89370400440532013000"),
        ("call (555) 123-4567", "local_phone", "(555) 123-4567"),
        ("call (555)123-4567 now", "local_phone", "(555)123-4567"),
        ("call 1 (555) 123-4567", "local_phone", "(555) 123-4567"),
        ("phone: (030) 123 4567", "local_phone", "(030) 123 4567"),
        ("tel: 030 123 4567", "local_phone", "030 123 4567"),
        ("Tel. 030/12345678", "local_phone", "030/12345678"),
        ("mobile: 0171 2345678, or", "local_phone", "0171 2345678"),
        ("tel 01 23 45 67 89", "local_phone", "01 23 45 67 89"),
        ("tel:030 123 4567 12345", "local_phone", "030 123 4567"),
    ):
        assert [(k, text[s:e]) for s, e, k, _ in pii.find(text)] == [(kind, span)], text
    for text in ("IBAN DE89 3704 0044 0532 0130 01 BIC COBADEFFXXX", "DE893704004405320130001", "call 12 345", "tel 4111 1111 1111 1112"):
        assert pii.find(text) == [], text


def test_dates_years_and_times_are_no_numbers():
    for text in (
        "Our hotel opened 12.05.2021.", "He called in 1939-1945 1200 men", "fax 12.05.2021 14:30", "call 2021-05-12", "phone 12/31/2021 10", "tel 14.30-16.00 daily",
        "shipping 030 123 4567", "basically 030 123 4567", "call 1939-1945", "fax 05-12-2021",
    ):
        assert pii.find(text) == [], text
    for text, span in (("call 12.05.2021 030 123 4567", "030 123 4567"), ("tel 01/12/45/67/89", "01/12/45/67/89"), ("telephone 555-123-4567", "555-123-4567"), ("Fax: 2012-3456", "2012-3456")):
        assert [(k, text[s:e]) for s, e, k, _ in pii.find(text)] == [("local_phone", span)], text
    assert pii.context("x" * 200 + "hotel 1", 206 - 0) == {"hotel"} or "tel" not in pii.context("x" * 200 + "hotel 1", 206)


def test_masking():
    text = "mail a@b.de or +49 30 1234567"
    assert pii.masked(text, pii.find(text)) == "mail [EMAIL] or [PHONE]"


def test_long_texts_are_linear():
    for unit in ("a", "1", "1.", "+1(", "@", "a@", "1 ", "AB12", "1-"):
        pii.find(unit * 60_000)


def test_query(spark, sf_small):
    for docs in (documents(spark), spark.read.parquet(f"{sf_small}/documents.parquet")):
        want = {}
        for d in docs.collect():
            want[d["doc_id"]] = brute(d["text"] or "")
        for r in pii.query(docs).collect():
            base = want[r["doc_id"]]
            assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
            assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s.startswith(k + ":") for s in base) for k in pii.BASE]
            assert set(base) <= set(r["spans"].split(","))  if base else True
    assert pii.query(documents(spark, [])).count() == 0
    masked = pii.mask(documents(spark))
    assert masked.columns == documents(spark).columns and masked.count() == len(rows())
