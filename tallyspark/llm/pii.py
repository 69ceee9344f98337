"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust the score.

All scans are linear in the text: every pattern begins at a mark that its own tail cannot contain, or is possessive.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import texts

#: Base kinds in their order, then those that this method adds.
KINDS = ("email", "ip", "card", "phone", "iban", "local_phone")
BASE = KINDS[:4]
#: Score of a span that its pattern proposes, of one that a checksum confirms, what a context word adds, and the least.
PROPOSED, CONFIRMED, CONTEXT, LEAST = 0.4, 0.9, 0.3, 0.6
#: Characters before a span in which context words count (fixed values).
NEAR = 40
CONTEXT_WORDS = {
    "email": ("mail", "contact", "@"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "telephone", "tel", "call", "mobile", "cell", "fax"),
    "iban": ("iban", "account", "bank"),
    "local_phone": ("phone", "telephone", "tel", "call", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono"),
}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOCAL_CHARS = "".join(sorted(LOCAL))
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_IBAN_TAIL = re.compile(r"(?:\x20?[A-Z0-9]){11,30}")
#: Characters of an IBAN by its country (the registry of ISO 13616).
IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 "
    "GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 "
    "NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{2,4}(?:\)[\x20./-]?|[\x20./-])(?:[0-9]{2,4}[\x20./-]){0,3}[0-9]{2,8}(?![0-9])")
#: Where the last group makes a number too long: short groups alone.
_SHORT_GROUPS = re.compile(r"\(?[0-9]{2,4}\)?[\x20./-][0-9]{2,4}(?:[\x20./-][0-9]{2,4}){1,3}(?![0-9])")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of ISO 13616: the first four characters to the end, letters as numbers from 10."""
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str):
    """Leftmost matches, by the @ in each: the local part cannot reach over an earlier @ or match."""
    start, at = 0, text.find("@")
    while at >= 0:
        run = text[start:at]
        kept = len(run) - len(run.rstrip(_LOCAL_CHARS))
        if kept and (m := _DOMAIN.match(text, at + 1)):
            yield at - kept, m.end()
            start = m.end()
        else:
            start = at + 1
        at = text.find("@", start)


def ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            yield m.span()


def cards(text: str):
    for m in _CARD.finditer(text):
        if 12 <= len(m[0]) and len(digits := _DIGITS.sub("", m[0])) in range(12, 20) and luhn(digits):
            yield m.span()


def phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
            yield m.span()


def ibans(text: str):
    """By the length of the country; for other countries the longest end at which the check holds."""
    done = 0
    for head in _IBAN_HEAD.finditer(text):
        start = head.start()
        if start < done or not (tail := _IBAN_TAIL.match(text, head.end())):
            continue
        ends = [*range(start + 1, start + 5), *(k + 1 for k in range(tail.start(), tail.end()) if text[k] != " ")]
        code = text[start : tail.end()].replace(" ", "")
        known = IBAN_LENGTHS.get(head[0][:2])
        for n in [known] if known else range(len(code), 14, -1):
            if n <= len(code) and not re.match("[A-Za-z0-9]", text[ends[n - 1] : ends[n - 1] + 1]) and mod97(code[:n]):
                done = ends[n - 1]
                yield start, done
                break


#: What is no number to call: a date, two years, two times.
_DAY, _MONTH, _YEAR, _TIME = r"(?:0?[1-9]|[12][0-9]|3[01])", r"(?:0?[1-9]|1[0-2])", r"(?:1[0-9]|20)[0-9]{2}", r"(?:[01]?[0-9]|2[0-4])\.[0-5][0-9]"
_NO_NUMBER = re.compile(
    rf"(?:(?:{_DAY}(?P<a>[./-]){_MONTH}|{_MONTH}(?P<b>[./-]){_DAY})(?:(?P=a)|(?P=b))(?:{_YEAR}|[0-9]{{2}})|{_YEAR}(?P<c>[./-]){_MONTH}(?P=c){_DAY}"
    rf"|{_YEAR}\x20?[/-]\x20?{_YEAR}|{_TIME}\x20?-\x20?{_TIME})(?![./-]?[0-9])"
)


def local_phones(text: str):
    """Dates, spans of years and spans of times are passed over; a number may follow them."""
    at = 0
    while m := _LOCAL_PHONE.search(text, at):
        if other := _NO_NUMBER.match(text, m.start()):
            at = other.end()
            continue
        at = m.end()
        for n in (m, _SHORT_GROUPS.match(text, m.start())):
            if n and 7 <= len(_DIGITS.sub("", n[0])) <= 13:
                yield n.span()
                break


_WORDS = re.compile(r"[^\W\d_]+")


def context(text: str, start: int) -> set[str]:
    """Whole words in lower case that end in the characters before a span, without one that begins earlier."""
    begin = max(0, start - NEAR)
    while begin and begin < start and text[begin - 1].isalpha():
        begin += 1
    return set(_WORDS.findall(text[begin:start].lower()))


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones, ibans, local_phones)))
#: Kinds whose spans a checksum or a range has confirmed.
CHECKED = {"card", "iban", "ip", "email"}


def find(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) by start, then kind. Base spans always stay; others need the least score, and no base span there."""
    found: list[tuple[int, int, int, float]] = []
    digits = re.search(r"[0-9]", text) is not None
    for k, kind in enumerate(KINDS):
        if kind != "email" and not digits:
            continue
        taken = sorted((s, e) for s, e, *_ in found) if kind not in BASE else []
        i = 0
        for start, end in FINDERS[kind](text):
            score = min(1.0, (CONFIRMED if kind in CHECKED else PROPOSED) + CONTEXT * (not context(text, start).isdisjoint(CONTEXT_WORDS[kind])))
            if kind not in BASE:
                while i < len(taken) and taken[i][1] <= start:
                    i += 1
                if score < LEAST or i < len(taken) and taken[i][0] < end:
                    continue
            found.append((start, end, k, score))
    found.sort(key=lambda x: (x[0], x[2]))
    return [(s, e, KINDS[k], v) for s, e, k, v in found]


def masked(text: str, spans) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap become one, of the first one's kind."""
    out, done, pending = [], 0, None
    for start, end, kind, _ in spans:
        if pending and start < pending[1]:
            pending = pending[0], max(end, pending[1]), pending[2]
            continue
        if pending:
            out += [text[done : pending[0]], f"[{pending[2].upper()}]"]
            done = pending[1]
        pending = start, end, kind
    if pending:
        out += [text[done : pending[0]], f"[{pending[2].upper()}]"]
        done = pending[1]
    return "".join([*out, text[done:]])


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<start, end, kind, score>> for every row of `docs`; offsets in code points, ends exclusive.

    Null and empty texts have no spans; repeated rows each get a row; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            spans = [[dict(zip(("start", "end", "kind", "score"), s)) for s in find(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPANS)], ["doc_id", "spans"])

    return texts(docs).mapInArrow(run, "doc_id long, spans array<struct<start:long,end:long,kind:string,score:double>>")


def mask(docs: DataFrame, column: str = "text") -> DataFrame:
    """`docs` with personal data in `column` replaced by [KIND]; a null stays null, all other columns stay as they are."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(column)
            out = [t if t is None else masked(t, find(t)) for t in (x.as_py() for x in batch.column(at))]
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def query(docs: DataFrame) -> DataFrame:
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    spans = F.col("spans")
    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return detect(docs).select("doc_id", *map(count, BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"))


