"""Transcripts (A6), snapshots (W6), transcript parsing round trip (X15, Q3)."""
from pyspark.sql import functions as F

from learnlog.operators import chat as C

EDGE_CHAT = [
    (1, 0, "user", "hello\nsecond line"),
    (1, 1, "assistant", "hi there"),
    (1, 2, "user", "user: fake prefix"),
    (1, 3, "system", "sys"),
    (1, 4, "assistant", "  spaced  "),
    (2, 0, "assistant", "alone"),
    (3, 1, "assistant", "b"),
    (3, 0, "user", "a"),
]


def _msgs(spark):
    return C.messages(spark.createDataFrame(EDGE_CHAT, "conv_id long, turn long, role string, text string"),
                      F.lit("angielski"))


def test_transcript_orders_by_turn(spark):
    t = {r.conv_id: r for r in C.transcript(_msgs(spark)).collect()}
    assert t[3].chat_text == "user: a\nassistant: b" and t[3].message_count == 2
    assert t[1].chat_text.split("\n")[0] == "user: hello"


def test_snapshots_after_each_assistant_turn(spark):
    s = sorted((r.conv_id, r.turn, r.message_count) for r in C.snapshots(_msgs(spark)).collect())
    # conversation 2 has a single message: no snapshot
    assert s == [(1, 1, 2), (1, 4, 5), (3, 1, 2)]
    last = C.snapshots(_msgs(spark), last_only=True).collect()
    assert sorted((r.conv_id, r.turn) for r in last) == [(1, 4), (3, 1)]


def test_parse_is_lossy_like_the_reference(spark):
    t = C.transcript(_msgs(spark))
    p = sorted((r.conv_id, r.line, r.role, r.content) for r in C.parse_transcript(t).collect())
    conv1 = [x for x in p if x[0] == 1]
    # continuation line vanishes, "user: fake prefix" stays one user message, system vanishes
    assert [(x[2], x[3]) for x in conv1] == [("user", "hello"), ("assistant", "hi there"),
                                            ("user", "user: fake prefix"), ("assistant", "spaced")]
