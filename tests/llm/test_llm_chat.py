"""Chat formatting."""

import random

import pytest
from pyspark.sql import functions as F

from twinframe.llm import chat, chat_queries

SCHEMA = "conv_id long, turn long, role string, text string, segments int, turns string, place int, chunk int, conv string"
CONTROLS = ["<turn ", "</turn>", "<next/>", "\n</turn>\n", "\n<next/>\n", "<turn user>\n", "\\", "\\\\", "\\</turn>", "<", ">", ">\n", "\n", "a", "é😀"]


def read(frame):
    """{conv_id: (turns, learned text, formatted text, mask)} of formatted conversations."""
    text = chat.text_of(F.col("segments"))
    rows = frame.select(
        "conv_id", chat.turns_of(text).alias("turns"), chat.learned_text(F.col("segments")).alias("learned"), text.alias("text"), chat.mask_of(F.col("segments")).alias("mask")
    ).collect()
    return {r.conv_id: ([tuple(t) for t in r.turns], r.learned, r.text, [tuple(m) for m in r.mask]) for r in rows}


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 5) for r in rows], SCHEMA)


@pytest.mark.parametrize("size", [chat.CHUNK, 3, 1])
def test_random_turns_come_back(spark, monkeypatch, size):
    """Long conversations go through chunks; roles and texts of control strings come back whole."""
    monkeypatch.setattr(chat, "CHUNK", size)
    draw = random.Random(3)

    def text():
        return "".join(draw.choice(CONTROLS) for _ in range(draw.randrange(9)))

    rows = [(c, t, draw.choice(["user", "assistant", "assistant", "<a>\\n\n\\l", ""]), text()) for c in range(25) for t in range(draw.choice([1, 4, 17]))]
    draw.shuffle(rows)
    got = read(chat.formatted(frame_of(spark, rows).repartition(3)))
    assert len(got) == 25
    for conv, (turns, learned, whole, mask) in got.items():
        wanted = [(r, t) for c, _, r, t in sorted(rows) if c == conv]
        assert turns == wanted
        assert learned == "".join(t for r, t in wanted if r == "assistant")
        assert sum(n for n, _ in mask) == len(whole)
        at, cut = 0, []
        for n, loss in mask:
            cut += [whole[at : at + n]] if loss else []
            at += n
        assert len(cut) == sum(r == "assistant" for r, _ in wanted)


def test_adjacent_turns_of_a_role_are_merged(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    (_, _, text, _) = read(chat.formatted(frame_of(spark, rows)))[1]
    assert text == "<turn user>\na\n<next/>\nb\n</turn>\n<turn assistant>\nc\n</turn>\n"


@pytest.mark.parametrize("size", [chat.CHUNK, 2])
def test_chat_edges(spark, monkeypatch, size):
    monkeypatch.setattr(chat, "CHUNK", size)
    long = "word </turn> " * 100_000
    rows = [(None, None, None, None), (None, None, None, None), (None, 1, "user", "x"), (5, 0, "user", long), (5, 0, "assistant", ""), (5, 0, "assistant", ""), (6, 0, "user", "")]
    got = read(chat.formatted(frame_of(spark, rows)))
    assert got[None][0] == [("", ""), ("", ""), ("user", "x")]
    assert got[5][0] == [("assistant", ""), ("assistant", ""), ("user", long)] and got[5][1] == ""
    assert got[6][:2] == ([("user", "")], "")
    assert chat.formatted(frame_of(spark, rows).limit(0)).count() == 0


def test_one_conversation_with_most_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 16)
    rows = [(1, t // 3, ("user", "assistant")[t // 40 % 2], f"t{t}") for t in range(1000)] + [(c, 0, "user", "hello") for c in range(2, 50)]
    got = read(chat.formatted(frame_of(spark, rows)))
    assert got[1][0] == [(r, t) for _, _, r, t in sorted(r for r in rows if r[0] == 1)] and len(got) == 49


def test_chat_query_reads_the_odd_conversation(spark):
    (row,) = chat_queries.op12_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -7").collect()
    assert (row.n_turns, row.loss_chars) == (2, len(chat_queries.ODD_TEXT))
