import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import check_oracle

from tallyspark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, ids string, loss string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "s>", "/", "a", "é"]), max_size=12))
def test_escape_round_trip(parts):
    text = "".join(parts)
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROLS)


def test_odd_conversations(spark):
    turns = [
        (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", None), (1, None, None, "x"), (2, 0, "tool[/ROLE]", "\\<s>"), (None, 0, "assistant", ""),
        (3, 0, "system", "S"), (3, 0, "system", "S"), (3, 1, "assistant", "one"), (3, 2, "assistant", "two"), (4, 0, "", "é" * 3000),
    ]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(spark.createDataFrame([(*t, "i", None) for t in turns], SCHEMA))).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted((-1 if t[1] is None else t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv)
        learnt = "".join(t for _, r, t in own if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(own), len(learnt))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()
    assert chat.digests(chat.format_turns(spark.createDataFrame([], SCHEMA))).count() == 0


def test_offsets_follow_the_tokens(spark, sf_small):
    rows = chat.format_turns(spark.read.parquet(f"{sf_small}/conversations.parquet")).orderBy("conv_id", "turn_no").collect()
    now, offset = None, 0
    for r in rows:
        offset = offset if r["conv_id"] == now else 0
        now = r["conv_id"]
        assert r["token_offset"] == offset and len(r["loss"]) == len(r["ids"])
        offset += len(r["ids"])


def test_oracle(spark, sf_small):
    check_oracle(spark, sf_small, "op5_chat_format")
