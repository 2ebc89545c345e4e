"""History table: upsert / delete / clear / append (S8-S11), ordinals (W1), latest per key
(W4), paging (T1/T2)."""
import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from learnlog.operators import history as H
from learnlog.operators.ranking import position_in_group
from learnlog.sources.store import HistoryStore

T0 = dt.datetime(2024, 1, 1)


def _hist(spark, rows):
    return spark.createDataFrame(rows, "id string, ts timestamp_ntz, mode string, language string, "
                                       "input_text string")


def test_upsert_replaces_whatever_the_times(spark):
    old = _hist(spark, [("a", T0, "translation", "angielski", "v1"),
                        ("b", T0, "translation", "angielski", "b1"), ("d", T0, "translation", "angielski", "d1")])
    new = _hist(spark, [("a", T0 + dt.timedelta(seconds=5), "translation", "angielski", "v2"),
                        ("b", T0 - dt.timedelta(days=9), "translation", "angielski", "b2"),
                        ("c", T0, "correction", "niemiecki", "c1")])
    got = {r.id: r.input_text for r in H.upsert(old, new).collect()}
    assert got == {"a": "v2", "b": "b2", "c": "c1", "d": "d1"}


def test_latest_per_key_is_partial_aggregate(spark):
    df = spark.createDataFrame([(1, T0, 10), (1, T0 + dt.timedelta(1), 11), (1, T0 + dt.timedelta(1), 12),
                                (2, T0, 20)], "k long, ts timestamp_ntz, e long")
    out = H.latest_per_key(df, "k", "ts", "e", [])
    assert {r.k: r.e for r in out.collect()} == {1: 12, 2: 20}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan or "HashAggregate" in plan


def test_store_append_upsert_delete_clear(spark, scratch):
    store = HistoryStore(spark, f"{scratch}/history")
    base = _hist(spark, [(str(i), T0 + dt.timedelta(minutes=i), "translation" if i % 2 else "correction",
                          "angielski", f"t{i}") for i in range(10)])
    store.create_if_missing(base)
    assert store.read().count() == 0
    store.append(base)
    assert store.read().count() == 10
    store.upsert(_hist(spark, [("3", T0 + dt.timedelta(days=1), "translation", "angielski", "new")]))
    r = store.read()
    assert r.count() == 10 and r.where("id = '3'").first().input_text == "new"
    store.delete(spark.createDataFrame([("1",), ("2",)], "id string"))
    assert sorted(x.id for x in store.read().collect()) == ["0", "3", "4", "5", "6", "7", "8", "9"]
    # partition pruning on mode
    plan = store.read().where(F.col("mode") == "translation")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "translation" in plan
    store.clear_all()
    assert store.read().count() == 0 and store.read().columns == r.columns
    store.append(base)
    assert store.read().count() == 10


def _texts(store):
    return sorted((r.id, r.mode, r.input_text) for r in store.read().collect())


def test_store_edits(spark, scratch):
    store = HistoryStore(spark, f"{scratch}/h")
    store.append(_hist(spark, [("a", T0, "translation", "angielski", "a1"), ("b", T0, "translation", "angielski", "b1"),
                               ("c", T0, "correction", "angielski", "c1"), ("e", T0, "analysis", "angielski", "e1")]))
    analyses = lambda: {f for f in store.read().inputFiles() if "mode=analysis" in f}
    untouched = analyses()
    # an older time replaces; a record may move to another kind; a kind may lose its last record
    store.upsert(_hist(spark, [("a", T0 - dt.timedelta(days=1), "translation", "angielski", "a0"),
                               ("c", T0, "exercise", "angielski", "c2"), ("n", T0, "exercise", "angielski", "n1"),
                               ("n", T0 + dt.timedelta(1), "exercise", "angielski", "n2")]))
    assert _texts(store) == [("a", "translation", "a0"), ("b", "translation", "b1"), ("c", "exercise", "c2"),
                             ("e", "analysis", "e1"), ("n", "exercise", "n2")]
    store.delete(spark.createDataFrame([("a",), ("b",), ("none",)], "id string"))
    assert _texts(store) == [("c", "exercise", "c2"), ("e", "analysis", "e1"), ("n", "exercise", "n2")]
    assert untouched and untouched == analyses()  # not written again


def test_interleaved_edits_lose_nothing(spark, scratch):
    """A second writer waits until the first has written, then works on what that wrote."""
    import threading
    a, b = HistoryStore(spark, f"{scratch}/h"), HistoryStore(spark, f"{scratch}/h")
    a.append(_hist(spark, [("a", T0, "translation", "angielski", "a1"), ("b", T0, "translation", "angielski", "b1")]))
    started, done = threading.Event(), []
    plain = a._replace

    def slow(*args):
        started.set()
        threading.Event().wait(1.0)
        assert not done  # the other writer is still waiting
        plain(*args)

    a._replace = slow
    first = threading.Thread(target=lambda: a.upsert(_hist(spark, [("a", T0, "translation", "angielski", "A")])))
    first.start()
    assert started.wait(60)
    b.upsert(_hist(spark, [("b", T0, "translation", "angielski", "B")]))
    done.append(1)
    first.join()
    assert _texts(b) == [("a", "translation", "A"), ("b", "translation", "B")]
    blocked = HistoryStore(spark, f"{scratch}/h", lock_seconds=0.3)
    with a.locked(), pytest.raises(RuntimeError):
        blocked.delete(spark.createDataFrame([("a",)], "id string"))


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_position_in_group_equals_row_number(spark, parts):
    rows = [(("hot" if i % 3 else f"g{i % 7}"), T0 + dt.timedelta(seconds=(i * 7919) % 1000), i)
            for i in range(600)]
    df = spark.createDataFrame(rows, "g string, ts timestamp_ntz, id long")
    got = position_in_group(df, "g", ["ts", "id"], out="pos", total="n", num_partitions=parts)
    w = Window.partitionBy("g").orderBy("ts", "id")
    exp = df.withColumn("pos", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("g")))
    assert sorted(map(tuple, got.select("g", "id", "pos", "n").collect())) == \
        sorted(map(tuple, exp.select("g", "id", "pos", "n").collect()))


def test_positions_do_not_depend_on_exchange_reuse(spark):
    df = spark.createDataFrame([(f"g{i % 3}", (i * 7919) % 100_003, i) for i in range(30_000)], "g string, k long, id long")
    w = Window.partitionBy("g").orderBy("k", "id")
    want = {(r.id, r.pos) for r in df.withColumn("pos", F.row_number().over(w)).collect()}
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        try:
            got = {(r.id, r.pos) for r in position_in_group(df, "g", ["k", "id"]).collect()}
        finally:
            spark.conf.unset("spark.sql.exchange.reuse")
        assert got == want


def test_ordinals_are_permutations(spark):
    rows = [(str(i), T0 + dt.timedelta(minutes=i), m, "angielski", "x")
            for i, m in enumerate(["translation", "correction", "analysis"] * 20)]
    o = H.history_ordinal(_hist(spark, rows), num_partitions=4).collect()
    for mode in ("translation", "correction", "analysis"):
        ords = sorted(r.ordinal for r in o if r.mode == mode)
        assert ords == list(range(1, 21))
    # translations: oldest = 1; others: newest = 1
    by = {(r.mode, r.id): r.ordinal for r in o}
    assert by[("translation", "0")] == 1 and by[("correction", "1")] == 20


def test_page(spark):
    rows = [(f"{i:03d}", T0 + dt.timedelta(minutes=(i * 37) % 200), "translation" if i % 4 else "correction",
             "angielski", "x") for i in range(200)]
    h = _hist(spark, rows)
    page = H.page(h.where("mode = 'translation'"), 5).collect()
    exp = sorted([r for r in rows if r[2] == "translation"], key=lambda r: (-r[1].timestamp(), r[0]))[:5]
    assert [r.id for r in page] == [r[0] for r in exp]
    assert H.page(h, 0).count() == 200            # 0 / None keeps all


def test_stamp_gives_uuid_and_utc_time(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "input_text string")
    before = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rows = H.stamp(df).collect()
    after = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    assert len({r.id for r in rows}) == 3 and all(len(r.id) == 36 for r in rows)
    for r in rows:
        assert before - dt.timedelta(seconds=5) <= r.ts <= after + dt.timedelta(seconds=5)


def test_summary_counts_sum_to_kind_counts(spark):
    from learnlog.plans.queries import QUERIES
    from conftest import SF_SMALL
    from learnlog.sources.store import history_table
    h = history_table(spark, SF_SMALL)
    kinds = {r.mode: r["count"] for r in h.groupBy("mode").count().collect()}
    s = QUERIES["language_summary"](spark, SF_SMALL).agg(
        F.sum("translations").alias("t"), F.sum("corrections").alias("c"), F.sum("analyses").alias("a")).first()
    assert (s.t, s.c, s.a) == (kinds["translation"], kinds["correction"], kinds["analysis"])
    snaps = QUERIES["chat_snapshots"](spark, SF_SMALL).count()
    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    w = Window.partitionBy("conv_id").orderBy("turn")
    expected = conv.withColumn("n", F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))) \
        .where("role = 'assistant' AND n >= 2").count()
    assert snaps == expected


def test_derived_table_follows_every_write(spark, scratch):
    from learnlog.sources.store import derived_table
    store = HistoryStore(spark, f"{scratch}/h")
    base = _hist(spark, [(str(i), T0, "translation", "angielski", "x") for i in range(5)])
    count = lambda h: h.groupBy("language").count()
    now = lambda: sorted((r.language, r["count"]) for r in derived_table(spark, store, "counts", count).collect())
    store.append(base)
    assert now() == [("angielski", 5)]
    store.append(_hist(spark, [("8", T0, "correction", "niemiecki", "y")]))
    assert now() == [("angielski", 5), ("niemiecki", 1)]
    store.upsert(_hist(spark, [("9", T0, "translation", "niemiecki", "y")]))
    assert now() == [("angielski", 5), ("niemiecki", 2)]
    store.delete(spark.createDataFrame([("8",)], "id string"))
    assert now() == [("angielski", 5), ("niemiecki", 1)]
    assert store.read().count() == 6


def test_all_six_kinds_are_stored_and_read_back(spark, scratch):
    from learnlog.operators import chat as C
    store = HistoryStore(spark, f"{scratch}/six")
    t = spark.createDataFrame([("in", "out", "angielski", "alloy", bytearray(b"sound"))],
                              "input_text string, output_text string, language string, voice string, audio binary")
    store.append(H.stamp(H.translation_records(t, "audio")))
    c = spark.createDataFrame([("i", "o", "angielski", m, "why", '{"vocabulary_items": [{"word": "w"}]}', '{"type": "grammar"}')
                               for m in ("correction", "analysis", "exercise")],
                              "input_text string, output_text string, language string, mode string, explanation string, "
                              "analysis_data string, exercise_data string")
    store.append(H.stamp(H.correction_records(c)))
    tips = spark.createDataFrame([("tip-1", "angielski", ["a", "b"])], "id string, language string, tips array<string>")
    store.append(H.stamp(H.tips_records(tips)))            # keeps the id it has
    msgs = C.messages(spark.createDataFrame([(7, 0, "user", "hi"), (7, 1, "assistant", "ho")],
                                            "conv_id long, turn long, role string, text string"), F.lit("angielski"))
    store.append(C.session_records(C.snapshots(msgs)))
    h = store.read()
    assert {r.mode for r in h.collect()} == {"translation", "correction", "analysis", "exercise", "learning_tips", "chat_session"}
    assert bytes(H.get_translations(h).first().audio_data) == b"sound"
    chat = H.get_chat_sessions(h).first()
    assert (chat.id, chat.chat_text, chat.message_count, chat.context) == ("7:1", "user: hi\nassistant: ho", 2, "")
    assert [(r.id, r.tips_text, r.tips_count) for r in H.get_tips_history(h).collect()] == [("tip-1", "a\nb", 2)]
    assert {r.mode: r.n_vocabulary for r in h.collect()}["analysis"] == 1
    assert {r.mode: r.n_with_text for r in H.history_union(h).collect()} == {
        "translation": 1, "correction": 1, "analysis": 1, "exercise": 1, "learning_tips": 1, "chat_session": 1}


def test_append_conforms_records_to_the_wide_schema(spark, scratch):
    from learnlog.operators import analysis as A
    store = HistoryStore(spark, f"{scratch}/wide")
    df = spark.createDataFrame([("in", "out", "angielski", "alloy")],
                               "input_text string, output_text string, language string, voice string")
    store.append(H.stamp(H.translation_records(df)))
    store.append(H.stamp(H.translation_records(df)))
    h = store.read()
    assert h.count() == 2 and "analysis_data" in h.columns and "target_language" not in h.columns
    assert h.where("language = 'angielski' AND mode = 'translation'").count() == 2
    assert A.summary_text(h).count() == 1 and H.get_translations(h).count() == 2
