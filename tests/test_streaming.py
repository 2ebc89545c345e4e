"""Stream = batch (M1 vs A1-style counts, M2 vs W6)."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from learnlog.operators import chat as C
from learnlog.sources.fixtures import conversation_language
from learnlog.sources.store import HistoryStore, history_store, history_table
from learnlog.sources.tables import table_path
from learnlog.streaming.chat import current_snapshots, run_chat_snapshots, start_chat_snapshots
from learnlog.streaming.counts import current_counts, run_language_counts, start_language_counts

from conftest import SF_SMALL

MESSAGES = "conv_id long, turn long, role string, text string"


def _counts(df):
    return sorted((r.language or "", r.mode, r.n) for r in df.collect())


def test_language_counts_stream_equals_batch(spark, scratch):
    h = history_table(spark, SF_SMALL)
    got = run_language_counts(history_store(spark, SF_SMALL), f"{scratch}/o", f"{scratch}/c")
    assert _counts(got) == _counts(h.groupBy("language", "mode").agg(F.count(F.lit(1)).alias("n")))


def test_edits_show_up_in_the_counts(spark, scratch):
    store = HistoryStore(spark, f"{scratch}/h")
    rows = lambda *r: spark.createDataFrame([(i, dt.datetime(2024, 1, 1), m, lang) for i, m, lang in r],
                                            "id string, ts timestamp_ntz, mode string, language string")
    run = lambda: _counts(run_language_counts(store, f"{scratch}/o", f"{scratch}/c"))
    store.append(rows(("a", "translation", "x"), ("b", "translation", "x"), ("c", "correction", "y")))
    assert run() == [("x", "translation", 2), ("y", "correction", 1)]
    assert run() == [("x", "translation", 2), ("y", "correction", 1)]      # nothing new
    store.upsert(rows(("b", "translation", "y"), ("d", "analysis", "x")))
    assert run() == [("x", "analysis", 1), ("x", "translation", 1), ("y", "correction", 1), ("y", "translation", 1)]
    store.delete(spark.createDataFrame([("a",)], "id string"))
    assert run() == [("x", "analysis", 1), ("y", "correction", 1), ("y", "translation", 1)]


def test_counts_read_changes_only_and_see_removals(spark, scratch):
    store = HistoryStore(spark, f"{scratch}/h")
    rows = lambda *r: spark.createDataFrame([(i, dt.datetime(2024, 1, 1), m, lang) for i, m, lang in r],
                                            "id string, ts timestamp_ntz, mode string, language string")

    def trigger():
        q = start_language_counts(store, f"{scratch}/o", f"{scratch}/c")
        q.awaitTermination()
        return sum(p["numInputRows"] for p in q.recentProgress), _counts(current_counts(store, f"{scratch}/o"))

    assert trigger() == (0, [])
    store.append(rows(("a", "translation", "x"), ("b", "correction", "x"), ("c", "correction", None)))
    assert trigger() == (3, [("", "correction", 1), ("x", "correction", 1), ("x", "translation", 1)])
    store.delete(spark.createDataFrame([("a",)], "id string"))      # empties a kind: no file is added
    assert trigger() == (1, [("", "correction", 1), ("x", "correction", 1)])
    store.upsert(rows(("b", "analysis", "x")))
    store.compact(most=0)
    assert trigger() == (2, [("", "correction", 1), ("x", "analysis", 1)])
    store.clear_all()
    assert trigger() == (2, [])
    store.append(rows(("a", "translation", "x")))
    assert trigger() == (1, [("x", "translation", 1)])


def test_an_unfinished_result_is_not_read(spark, scratch):
    store = HistoryStore(spark, f"{scratch}/h")
    store.append(spark.createDataFrame([("a", "translation", "x")], "id string, mode string, language string"))
    want = _counts(run_language_counts(store, f"{scratch}/o", f"{scratch}/c"))
    (spark.createDataFrame([("y", "correction", 9)], "language string, mode string, n long")
     .write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{scratch}/o/batch=000000099"))
    assert _counts(current_counts(store, f"{scratch}/o")) == want


def _snapshots(df):
    return sorted((r.conv_id, r.turn, r.message_count, r.chat_text) for r in df.collect())


def test_chat_snapshot_stream_equals_batch(spark, scratch):
    path = table_path(SF_SMALL, "conversations")
    rows = spark.read.parquet(path)
    got = run_chat_snapshots(spark, path, rows.schema, conversation_language(), f"{scratch}/o", f"{scratch}/c")
    assert _snapshots(got) == _snapshots(C.snapshots(C.messages(rows, conversation_language())))


def test_chat_snapshots_with_gaps_late_rows_and_more_files(spark, scratch):
    files = [
        [(1, 0, "user", "a"), (1, 2, "user", "c"), (2, 0, "user", "x"), (2, 1, "assistant", "y"),
         (3, 1, "user", "from one"), (3, 2, "assistant", "on"), (4, 0, "user", "gap"), (4, 7, "assistant", "later")],
        [(1, 1, "assistant", "b"), (1, 3, "assistant", "d")],       # late, and in order
        [(3, 0, "system", "before"), (5, 0, "assistant", "alone")],  # shifts conversation 3's counts
    ]
    schema, seen = spark.createDataFrame([], MESSAGES).schema, []
    for part in files:
        seen += part
        spark.createDataFrame(part, MESSAGES).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
        got = run_chat_snapshots(spark, f"{scratch}/in", schema, F.lit("x"), f"{scratch}/out", f"{scratch}/ckpt")
        assert _snapshots(got) == _snapshots(C.snapshots(C.messages(spark.createDataFrame(seen, MESSAGES), F.lit("x"))))


def test_chat_stream_reads_new_rows_and_ignores_repeats(spark, scratch):
    files = [
        [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 5, "assistant", "early")],
        [(1, 1, "assistant", "b"), (1, 3, "assistant", "d")],                  # delivered again; a gap
        [(1, 2, "user", None), (2, 4, "user", "late"), (None, 0, "user", "x"), (3, None, "user", "x")],
    ]
    schema, seen = spark.createDataFrame([], MESSAGES).schema, set()
    for n, part in enumerate(files):
        seen |= {r for r in part if r[0] is not None and r[1] is not None}
        spark.createDataFrame(part, MESSAGES).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
        q = start_chat_snapshots(spark, f"{scratch}/in", schema, F.lit("x"), f"{scratch}/out", f"{scratch}/ckpt")
        q.awaitTermination()
        assert sum(p["numInputRows"] for p in q.recentProgress) == len(part)
        got = current_snapshots(spark, f"{scratch}/out")
        assert _snapshots(got) == _snapshots(C.snapshots(C.messages(spark.createDataFrame(sorted(seen, key=repr), MESSAGES), F.lit("x")))), n
    # the second trigger gave out the one snapshot that it changed
    assert spark.read.parquet(f"{scratch}/out/batch=000000001").count() == 1


def test_quiet_conversations_give_their_state_up(spark, scratch):
    import time
    schema = spark.createDataFrame([], MESSAGES).schema
    parts = [[(1, 0, "user", "a"), (1, 1, "assistant", "b")], [(2, 0, "user", "c")], [(1, 2, "user", "d"), (1, 3, "assistant", "e")]]
    put = lambda part: spark.createDataFrame(part, MESSAGES).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
    args = (spark, f"{scratch}/in", schema, F.lit("x"), f"{scratch}/out", f"{scratch}/ckpt")
    put(parts[0])
    with pytest.raises(ValueError):
        start_chat_snapshots(*args, idle_seconds=1)
    q = start_chat_snapshots(*args, available_now=False, interval_seconds=1, idle_seconds=0.05)
    try:
        def wait(rows):
            for _ in range(120):
                if sum(p["numInputRows"] for p in q.recentProgress) >= rows:
                    return
                time.sleep(0.5)
            raise AssertionError(q.recentProgress)

        wait(2)
        put(parts[1])
        wait(3)
        time.sleep(4)      # triggers without rows let the timers fire
        put(parts[2])
        wait(5)
    finally:
        q.stop()
    rows = spark.createDataFrame(sum(parts, []), MESSAGES)
    want = _snapshots(C.snapshots(C.messages(rows, F.lit("x"))))
    assert len(want) == 2
    assert _snapshots(current_snapshots(spark, f"{scratch}/out")) == want[:1]
    assert _snapshots(current_snapshots(spark, f"{scratch}/out", C.messages(rows, F.lit("x")))) == want
