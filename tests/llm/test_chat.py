import hashlib

import pytest
from edge import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from govlens.llm import chat

ANY = st.text(alphabet=st.sampled_from(list("<|>\\im_startend\n ax漢")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(ANY, ANY)
def test_a_turn_reads_back(role, text):
    turn = "".join(x for x, _ in chat.segments(chat.CHATML, role, text))
    assert chat.read_turn(chat.CHATML, turn) == (role, text)
    assert chat.CHATML.open not in chat.escape(text) and chat.CHATML.close not in chat.escape(text)


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        state, ok = chat.START, True
        for *_, r, _x in turns:
            state = chat.CHATML.step(state, r)
            ok = ok and state != chat.BROKEN
        said = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest(),
                  len(said), hashlib.sha256(said.encode()).hexdigest(),
                  sum(len("".join(p for p, _ in chat.segments(chat.CHATML, r, x))) for *_, r, x in turns), ok)
    return out


ROWS = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "<\\|im_start|> ok"), (2, 0, "assistant", "first"),
        (2, 1, None, None), (3, 0, "system", ""), (3, 1, "user", None), (3, 1, "user", None), (None, None, "user", "x"),
        (None, 0, "odd\nrole", "y"), (4, 0, "user", "q" * 100_000), (4, 1, "assistant", "漢" * 1000), (4, 2, "tool", "t"),
        (4, 3, "assistant", "")]


def test_digests(spark):
    df = spark.createDataFrame([(*r, "z") for r in ROWS], "conv_id long, turn long, role string, text string, place string")
    got = {r["conv_id"]: tuple(r.values())[1:] for r in rows_of(chat.conversation_digests(chat.format_turns(df)))}
    assert got == brute(ROWS)
    none = spark.createDataFrame([], df.schema)
    assert chat.conversation_digests(chat.format_turns(none)).count() == 0


def test_stored_turns_read_back(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    chat.format_turns(df).write.parquet(str(tmp_path / "turns"))
    got = {r["conv_id"]: tuple(r.values())[1:] for r in rows_of(
        chat.conversation_digests(spark.read.parquet(str(tmp_path / "turns")).repartition(7)))}
    assert got == brute([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


def test_segments_carry_loss_flags(spark):
    df = spark.createDataFrame(ROWS[:2], "conv_id long, turn long, role string, text string")
    user, assistant = sorted(rows_of(chat.format_turns(df)), key=lambda r: r["place"])
    assert user["loss"] == [False] * 3 and assistant["loss"] == [False, True, False]
    a, b = assistant["ends"][0], assistant["ends"][1]
    assert chat.unescape(assistant["formatted"][a:b]) == "<\\|im_start|> ok"


def test_other_text_is_no_turn():
    for bad in ("", "user\nx", "<|im_start|>user<|im_end|>\n", "<|im_start|>a\nx<|im_end|>\n<|im_start|>b\ny<|im_end|>\n"):
        with pytest.raises(ValueError):
            chat.read_turn(chat.CHATML, bad)
