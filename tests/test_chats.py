"""Conversations rendered in segments, against a plain loop over their turns."""

import random
from collections import Counter
from hashlib import md5

import pytest

from verdikt.operators.chats import chat_segments

TURNS = "conv_id long, turn int, role string, text string"


def plain(turns, size):
    chats = {}
    for conv, turn, role, text in turns:
        role = role or ""
        piece = f"<|{role}|>\n{text or ''}</s>\n"
        chats.setdefault(conv, []).append((turn is not None, turn or 0, role, md5((text or "").encode()).hexdigest(), piece))
    out = []
    for conv, rows in chats.items():
        rows.sort()
        passed, segments = 0, {}
        for k, (_, _, role, _, piece) in enumerate(rows):
            follows = rows[k + 1][2] if k + 1 < len(rows) else ""
            own = segments.setdefault(passed // size, ["", 0, 0, 0])
            own[0] += piece
            own[1] += 1
            own[2] += role == "user"
            own[3] += role == "user" and follows != "assistant"
            passed += len(piece.encode())
        out += [(conv, segment, *own) for segment, own in segments.items()]
    return Counter(out)


def found(df):
    return Counter((r.conv_id, r.segment, r.text, r.n_turns, r.n_user, r.n_open) for r in df.collect())


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_a_hot_conversation(spark, size):
    """A third of all turns in one conversation, over all partitions."""
    rng, turns = random.Random(3), []
    for conv, n in [(7, 600), *((100 + k, rng.randint(1, 12)) for k in range(150))]:
        turns += [(conv, t, rng.choice(["user", "assistant", "user", "system"]), f"tür {rng.random()}" * rng.randint(0, 3)) for t in range(n)]
    rng.shuffle(turns)
    df = spark.createDataFrame(turns, TURNS).repartition(6)
    assert found(chat_segments(df, size=size)) == plain(turns, size)


def test_odd_turns(spark):
    turns = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (1, None, "user", "first"), (None, 1, "assistant", "x"), (None, 0, "user", "y")]
    turns += [(2, 0, "user", "long " * 40_000), (2, 1, "assistant", ""), (3, 5, "user", None)]
    df = spark.createDataFrame([(*t, 9, "z") for t in turns], TURNS + ", segment int, piece string")
    assert found(chat_segments(df, size=100)) == plain(turns, 100)
    assert chat_segments(df.limit(0)).collect() == []


def test_every_user_turn_is_there(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = chat_segments(turns, size=2000).collect()
    assert sum(r.n_user for r in rows) == turns.where("role = 'user'").count()
    assert sum(r.n_turns for r in rows) == turns.count()
    assert {r.conv_id for r in rows} == {r.conv_id for r in turns.select("conv_id").distinct().collect()}
