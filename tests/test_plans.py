"""Physical-plan assertions: pushdown / pruning, top-N, per-group limit, broadcast of
constant lookups, no Python outside the model / file / stream-state operators."""
from learnlog.plans.queries import QUERIES

from conftest import SF_SMALL

PYTHON_NODES = ("MapInPandas", "PythonMapInArrow", "ArrowEvalPython", "BatchEvalPython",
                "FlatMapGroupsInPandas", "FlatMapGroupsInPandasWithState")
PYTHON_OK = set()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_history_read_prunes_partitions_and_uses_top_n(spark):
    p = _plan(QUERIES["get_translations"](spark, SF_SMALL))
    assert "PartitionFilters: [isnotnull(mode" in p and "translation" in p
    assert "TakeOrderedAndProject" in p
    assert "analysis_data" not in p.split("ReadSchema")[1].split("\n")[0]


def test_every_page_is_a_top_n(spark):
    for key in ("get_translations", "get_corrections", "get_tips_history", "get_chat_sessions"):
        p = _plan(QUERIES[key](spark, SF_SMALL))
        assert "TakeOrderedAndProject" in p and "rangepartitioning" not in p, key


def test_the_cut_of_a_page_filters_the_scan(spark):
    p = _plan(QUERIES["get_translations"](spark, SF_SMALL))
    assert "GreaterThanOrEqual(ts" in p or "ts#" in p.split("DataFilters")[1].split("]")[0]


def test_summary_parses_each_body_once(spark):
    df = QUERIES["summary_text"](spark, SF_SMALL)
    df.collect()
    p = df._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("from_json(") == 1 and "Join" not in p


def test_no_join_and_no_collected_texts(spark):
    assert "Join" not in _plan(QUERIES["tips_context"](spark, SF_SMALL))
    assert "collect_list" not in _plan(QUERIES["history_union"](spark, SF_SMALL))
    for key in ("build_prompts", "validate_language"):
        assert _plan(QUERIES[key](spark, SF_SMALL)).count("FileScan") == 1


def test_per_group_top_n_is_limited_before_shuffle(spark):
    for key in ("vocabulary_top20", "recent_errors", "history_dashboard"):
        df = QUERIES[key](spark, SF_SMALL)
        df.collect()
        p = df._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in p, key


def test_constant_lookups_are_broadcast(spark):
    df = QUERIES["voice_lookup"](spark, SF_SMALL)
    df.collect()
    assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_no_python_outside_python_operators(spark):
    for key, fn in QUERIES.items():
        if key in PYTHON_OK or key.startswith("stream_"):
            continue
        p = _plan(fn(spark, SF_SMALL))
        assert not any(n in p for n in PYTHON_NODES), key


def test_latest_per_key_has_no_window(spark):
    p = _plan(QUERIES["upsert_latest"](spark, SF_SMALL))
    # max of a struct: partial (map-side) then final aggregate, no per-key window
    assert "Window [" not in p and "partial_max" in p


def test_language_filter_is_pushed_into_the_scan(spark):
    p = _plan(QUERIES["history_by_language"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(language), EqualTo(language," in p


def test_voice_lookup_defaults_to_alloy(spark):
    from learnlog.operators import analysis as A
    df = spark.createDataFrame([(1, "angielski"), (2, "polski"), (3, "klingoński"), (4, None)],
                               "id long, language string")
    got = {r.id: (r.voice, r.voice_label) for r in A.voice_lookup(df).collect()}
    assert got[1][0] == "alloy" and got[2][0] == "shimmer"
    assert got[3] == ("alloy", "Alloy - neutralny") and got[4][0] == "alloy"
