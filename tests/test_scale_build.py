"""The build of the history deals out references: no passage, and of a conversation no text per session."""
import datetime as dt
import string
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from learnlog.operators import chat as C
from learnlog.operators import history as H
from learnlog.sources import fixtures as FX
from learnlog.sources.store import HistoryStore, history_rows, history_table

PASSAGE = "satz eins\n" * 200
KINDS = ["view", "click", "purchase", "signup", "error"]
#: A missing role, text, turn and conversation; a message that comes twice; two messages of one turn.
MESSAGES = [(7, 0, "user", "hi"), (7, 1, "assistant", "ho\nhe"), (7, 2, None, "x"), (7, 3, "user", None), (7, 4, "assistant", "é€😀"),
            (8, None, "user", "a"), (8, 1, "assistant", "b"), (9, 0, "user", "u"), (9, 0, "user", "u"), (9, 1, "assistant", "v"),
            (9, 1, "assistant", "v"), (None, 0, "user", "n"), (None, 1, "assistant", "m"), (10, 0, "assistant", "alone"),
            (11, 0, "user", "b"), (11, 0, "user", "a"), (11, 1, "assistant", "c"), (12, 0, None, None), (12, 1, "assistant", None)]


@pytest.fixture()
def tables(tmp_path):
    """Thirty events over two documents and four passages: one item comes twice, one has no text."""
    put = lambda name, **cols: pq.write_table(pa.table(cols), str(tmp_path / f"{name}.parquet"))
    n = 30
    put("events", event_id=list(range(n)), ts=[dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) for i in range(n)],
        user_id=[1] * n, event_type=[KINDS[(i * 7 + i // 5) % 5] for i in range(n)])
    put("documents", doc_id=[0, 1], lang=["en", "de"], text=["a b", "c\nd"])
    put("benchmark", item_id=[0, 1, 1, 2], text=[PASSAGE, "p", "q", None])
    long = [(20, i, ("user", "assistant")[i % 2], f"{i} " + string.ascii_letters) for i in range(300)]
    c = [*zip(*(MESSAGES + long), strict=True)]
    put("conversations", conv_id=c[0], turn=c[1], role=c[2], text=c[3])
    return str(tmp_path)


def test_only_references_are_shuffled(spark, tables, monkeypatch):
    dealt, write = [], HistoryStore._write
    monkeypatch.setattr(HistoryStore, "_write", lambda self, df, *more: (dealt.append(df), write(self, df, *more))[1])
    history_rows(spark, tables)
    assert len(dealt) == 1 and not {"output_text", "passage", "tips_text", "chat_text"} & set(dealt[0].columns)
    assert max(len(v) for r in dealt[0].collect() for v in r if isinstance(v, str)) < 40


def test_stored_sessions_grow_with_their_conversation_only(spark, tables):
    sizes = lambda df: sum(len(v) for r in df.where("id LIKE '20:%'").collect() for v in r if isinstance(v, str))
    rows, whole = history_rows(spark, tables), history_table(spark, tables)
    assert rows.where("id LIKE '20:%'").count() == 150
    assert sizes(rows) < 300 * 60 < sizes(whole) / 50


def test_sessions_have_the_texts_of_the_snapshots(spark, tables):
    msgs = C.messages(spark.read.parquet(f"{tables}/conversations.parquet"), FX.conversation_language())
    row = lambda r: (r.id, r.ts, r.language, r.message_count, r.chat_text)
    h = [r for r in history_table(spark, tables).collect() if r.mode == "chat_session"]
    # of the messages of one turn any may come first in a snapshot, in a record the smaller line does
    want = Counter(row(r) for r in C.session_records(C.snapshots(msgs.where("NOT conv_id <=> 11"))).collect())
    assert Counter(row(r) for r in h if not r.id.startswith("11:")) == want
    assert [(r.id, r.chat_text) for r in h if r.id.startswith("11:")] == [("11:1", "user: a\nuser: b\nassistant: c")]
    n = {r["mode"]: (r["n"], r["n_with_text"]) for r in H.history_union(history_table(spark, tables)).collect()}
    assert n["chat_session"] == (len(h), sum(bool(r.chat_text) for r in h)) and n["chat_session"][1] < len(h)
    plain = history_table(spark, tables).drop("chat_chars")
    assert {r["mode"]: (r["n"], r["n_with_text"]) for r in H.history_union(plain).collect()} == n


def test_records_have_their_own_passage(spark, tables):
    items = {0: [PASSAGE], 1: ["p", "q"], 2: [None], 3: []}
    kinds = {**FX.EVENT_TYPE_TO_MODE, "error": FX.OTHER_EVENTS_MODE}
    events = spark.read.parquet(f"{tables}/events.parquet").collect()
    want = Counter()
    for e in events:
        for p in items[e.event_id % 4]:
            m = kinds[e.event_type]
            audio = m == "translation" and e.event_id % 3 == 0 and bool(p)
            want[(str(e.event_id), m, "" if m in ("analysis", "exercise") else None if m == "learning_tips" else p,
                  ("" if e.event_id % 7 == 0 else p) if m == "correction" else None, audio,
                  p if m == "learning_tips" else None)] += 1
    got = Counter((r.id, r.mode, r.output_text, r.explanation, bool(r.has_audio), r.tips_text)
                  for r in history_table(spark, tables).collect() if r.mode != "chat_session")
    assert got == want


def test_texts_are_joined_only_where_used(spark, tables):
    h = history_table(spark, tables)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(h.select("id", "mode", "output_text", "chat_chars"))
    assert plan(h.select("id", "input_text")).count("Join") == 1 and plan(h.select("id", "chat_text")).count("Join") == 1
