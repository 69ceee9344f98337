"""Chat formatting at token level.

Each segment is encoded on its own, reserved ids are spliced between segments, and the loss mask is the prefix sum of
+1 and -1 marks at the ends of assistant texts. Control strings inside a text are escaped, so neither the ids nor the
decoded string can be mistaken for the template's own marks.

Output is one row for each turn, in order, with its token offset inside the conversation; a conversation is never
gathered, only streamed in order, so one that holds a large share of all rows needs no more memory than a short one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.bpe import VOCABULARY, Encoder, _path, read_ranks
from tallyspark.llm.common import worker_store

#: Control strings in the order of their reserved ids, which follow the vocabulary.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[BOT]", "[ROLE]", "[/ROLE]")
FIRST_RESERVED = 50_256
RESERVED = {c: FIRST_RESERVED + i for i, c in enumerate(CONTROLS)}
#: Role: the controls before and after its text. Any other role is spelled out between [ROLE] and [/ROLE].
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("[BOT]", "</s>")}
OTHER = ("[ROLE]", "</s>")


def escape(text: str) -> str:
    """A backslash doubles; a control string gets one after its first character."""
    text = text.replace("\\", "\\\\")
    for c in CONTROLS:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    out, start = [], 0
    while (at := text.find("\\", start)) >= 0:
        out.append(text[start:at])
        if text[at + 1 : at + 2] == "\\":
            out.append("\\")
            start = at + 2
        else:
            start = at + 1
    out.append(text[start:])
    return "".join(out)


def turn_tokens(encode, role: str, text: str, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of one turn; the first turn of a conversation begins with <s>."""
    body = np.frombuffer(encode(escape(text)), "<i4")
    opening, closing = MARKS.get(role, OTHER)
    lead = [RESERVED["<s>"]] * first + [RESERVED[opening]]
    if role not in MARKS:
        lead += [*np.frombuffer(encode(escape(role)), "<i4").tolist(), RESERVED["[/ROLE]"]]
    ids = np.concatenate((lead, body, [RESERVED[closing]])).astype(np.int32)
    marks = np.zeros(len(ids) + 1, np.int8)
    if role == "assistant":
        marks[len(lead)] += 1
        marks[len(lead) + len(body)] -= 1
    return ids, np.cumsum(marks)[:-1].astype(np.int8)


def format_turns(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """conv_id, turn_no, token_offset, ids array<int>, loss array<tinyint>: one row for each row of `rows`, in order.

    Turns go by `turn` (null first), then role and text. A null role counts as empty and is written like any other
    unknown role; a null text is empty; rows without conv_id form one conversation; repeated rows are turns of their own.
    """
    slim = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # hash partitions of one kind only: a conversation lies in one partition, in order
    ordered = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        import public_tokenizers

        made = worker_store(f"bpe:{vocabulary}:None", lambda: Encoder(_path(vocabulary), public_tokenizers.PATTERN))
        now, turn_no, offset = object(), 0, 0
        for batch in batches:
            out = [], [], [], [], []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != now:
                    now, turn_no, offset = conv, 0, 0
                ids, loss = turn_tokens(made.encode, role, text, turn_no == 0)
                for values, v in zip(out, (conv, turn_no, offset, ids, loss)):
                    values.append(v)
                turn_no, offset = turn_no + 1, offset + len(ids)
            kinds = pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int8())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], ["conv_id", "turn_no", "token_offset", "ids", "loss"])

    return ordered.mapInArrow(run, "conv_id long, turn_no int, token_offset long, ids array<int>, loss array<tinyint>")


def _decode(ids, tokens) -> str:
    return b"".join(map(tokens.__getitem__, ids)).decode("utf-8", "surrogatepass")


def read_turn(ids: np.ndarray, tokens) -> tuple[str, str]:
    """Role and text of one turn, from its ids alone."""
    at = np.flatnonzero(ids >= FIRST_RESERVED)
    if ids[0] == RESERVED["<s>"]:
        at = at[1:]
    body = _decode(ids[at[-2] + 1 : at[-1]].tolist(), tokens)
    opening = CONTROLS[ids[at[0]] - FIRST_RESERVED]
    if opening == "[ROLE]":
        return unescape(_decode(ids[at[0] + 1 : at[1]].tolist(), tokens)), unescape(body)
    return next(r for r, m in MARKS.items() if m[0] == opening), unescape(body)


def digests(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """What reading the formatted turns back gives, one row for each conversation; turns are streamed in order."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")

    def run(batches):
        tokens = worker_store(
            f"chat-tokens:{vocabulary}", lambda: {i: b for b, i in read_ranks(_path(vocabulary)).items()} | {i: c.encode() for c, i in RESERVED.items()}
        )
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()
        now, open_ = None, None

        def closed():
            conv, n, turns, chars, loss, formatted_chars = open_
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted_chars

        for batch in batches:
            done = []
            for conv, ids, loss in zip(batch.column("conv_id").to_pylist(), batch.column("ids"), batch.column("loss")):
                ids, loss = ids.values.to_numpy(), loss.values.to_numpy()
                if open_ is None or conv != now:
                    if open_ is not None:
                        done.append(closed())
                    now, open_ = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_turn(ids, tokens)
                learnt = unescape(_decode(ids[loss == 1].tolist(), tokens))
                open_[1] += 1
                open_[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                open_[3] += len(learnt)
                open_[4].update(learnt.encode("utf-8", "surrogatepass"))
                open_[5] += len(_decode(ids.tolist(), tokens))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done), kinds)], names)
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(closed(), kinds)], names)

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(conversations: DataFrame) -> DataFrame:
    """All conversations, and one more whose texts are control strings."""
    spark = conversations.sparkSession
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return digests(format_turns(conversations.select("conv_id", "turn", "role", "text").unionByName(own)))


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


def _marks_sql() -> str:
    cases = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in MARKS.items())
    return f"CASE role {cases} ELSE {len(OTHER[0]) + len('[/ROLE]') + len(OTHER[1])} + length({_escaped_sql('role')}) END"


SQL = f"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       CAST({len('<s>')} + sum({_marks_sql()} + length({_escaped_sql('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
