"""The stored history refers to its source texts; results of a stream keep the state's partitions."""
import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from learnlog.sources import fixtures as FX
from learnlog.sources.store import HistoryStore, _fs, history_rows, history_table
from learnlog.streaming.counts import run_language_counts

LONG = "Satz mit Wort " * 50


@pytest.fixture()
def tables(tmp_path):
    """Twelve events over four documents, of which one comes twice and one has no text."""
    put = lambda name, **cols: pq.write_table(pa.table(cols), str(tmp_path / f"{name}.parquet"))
    kinds = ["view", "click", "purchase", "signup", "error", "view"] * 2
    put("events", event_id=list(range(12)), ts=[dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) for i in range(12)],
        user_id=[1] * 12, event_type=kinds)
    put("documents", doc_id=[0, 1, 1, 2, 3], lang=["en", "de", "de", "fr", None],
        text=[LONG, "a b\nc d", "e", None, LONG + "\n" + LONG])
    put("benchmark", item_id=[0], text=["p q\nr"])
    put("labels", doc_id=[0, 3], toxic=[1, 0])
    put("conversations", conv_id=[7, 7], turn=[0, 1], role=["user", "assistant"], text=["hi", "ho"])
    return str(tmp_path)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_whole_records_come_back_once(spark, tables):
    """As the derivation with the texts joined by ``doc_id`` gives them."""
    events = spark.read.parquet(f"{tables}/events.parquet").where("event_id % 5 < 4")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    joined = events.selectExpr("event_id", "event_type", "event_id % 5 AS doc_id").join(docs, "doc_id").collect()
    h = [r for r in history_table(spark, tables).collect() if r.mode != "chat_session"]
    texts = lambda kind, mode: (
        sorted((str(r.event_id), r.text or "") for r in joined if r.event_type == kind),
        sorted((r.id, r.input_text or "") for r in h if r.mode == mode))
    assert len(h) == len(joined)
    for kind, mode in (("view", "translation"), ("click", "correction"), ("purchase", "analysis")):
        want, got = texts(kind, mode)
        assert got == want, mode
    assert {r.input_text for r in h if r.mode == "exercise"} <= {""}
    for r in h:
        assert (r.analysis_data is not None) == (r.mode == "analysis")
        assert (r.exercise_data is not None) == (r.mode == "exercise")


def test_the_stored_table_holds_no_source_text(spark, tables):
    rows = history_rows(spark, tables)
    assert not {"input_text", "analysis_data", "exercise_data"} & set(rows.columns)
    assert not [v for r in rows.collect() for v in r if isinstance(v, str) and LONG in v]
    assert sum(LONG in (r.input_text or "") for r in history_table(spark, tables).collect()) > 0


def test_texts_are_read_only_where_they_are_used(spark, tables):
    h = history_table(spark, tables)
    assert "Join" not in _plan(h.groupBy("language", "mode").count())
    assert "Join" not in _plan(h.where("mode = 'analysis'").select("id", "n_vocabulary"))
    assert "Join" in _plan(h.select("id", "input_text"))


def test_every_state_partition_writes_its_counts(spark, scratch):
    store = HistoryStore(spark, f"{scratch}/h")
    store.append(spark.createDataFrame([(str(i), dt.datetime(2024, 1, 1), "translation", f"l{i}") for i in range(200)],
                                       "id string, ts timestamp_ntz, mode string, language string"))
    assert run_language_counts(store, f"{scratch}/o", f"{scratch}/c").count() == 200
    fs, p = _fs(spark, f"{scratch}/o/batch=000000000")
    assert len([s for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")]) > 1


def test_a_prompt_is_made_once_per_distinct_word(spark, tables):
    from learnlog.plans.queries import QUERIES
    df = QUERIES["model_word"](spark, tables)
    assert "Generate" not in _plan(df)
    got = sorted((r.language or "", r.word) for r in df.collect())
    assert got == sorted({("angielski", w) for w in LONG.split(" ")} | {("niemiecki", w) for w in ("a", "b\nc", "d", "e")}
                         | {("", w) for w in (LONG + "\n" + LONG).split(" ")})


def test_exercise_prompts_are_made_once_per_kind(spark, tables):
    from learnlog.plans.queries import QUERIES
    df = QUERIES["model_exercise"](spark, tables)
    assert _plan(df).count("from_json(") == 2      # a stored exercise and its reply, not the kinds once more
    assert {r.error for r in df.collect()} == {None}
