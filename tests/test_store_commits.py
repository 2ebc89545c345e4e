"""Commits, edits in proportion to the change, the maintained summary, the as-of join."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from learnlog.operators import analysis as A
from learnlog.operators.asof import asof_join
from learnlog.operators.maintained import MaintainedSummary
from learnlog.sources.store import HistoryStore

T0 = dt.datetime(2024, 1, 1)
DDL = "id string, ts timestamp_ntz, mode string, language string, explanation string, analysis_data string, input_text string"


def _records(spark, rows):
    return spark.createDataFrame([(i, ts, m, lang, e, a, "t") for i, ts, m, lang, e, a in rows], DDL)


def _ids(store):
    return sorted(r.id for r in store.read().select("id").collect())


def _ids_df(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_one_id_writes_one_bucket(spark, scratch):
    store = HistoryStore(spark, f"{scratch}/h", buckets=16)
    store.append(_records(spark, [(str(i), T0, "translation" if i % 2 else "correction", "x", None, None) for i in range(400)]))
    before = set(store.folders())
    assert len(before) == 32
    store.upsert(_records(spark, [("7", T0, "translation", "y", None, None)]))
    after = set(store.folders())
    assert len(before - after) == 1 and len(after - before) == 1
    assert {f.split("/", 1)[1] for f in before - after} == {f.split("/", 1)[1] for f in after - before}
    store.delete(_ids_df(spark, "8"))
    assert len(after - set(store.folders())) == 1
    assert len(_ids(store)) == 399
    # ids that are not there write nothing; an older commit still reads as it was
    now = store.folders()
    store.delete(_ids_df(spark, "none"))
    assert store.folders() == now
    assert store.read(1).count() == 400


def test_a_crash_before_or_after_the_commit(spark, scratch, monkeypatch):
    store = HistoryStore(spark, f"{scratch}/h")
    store.append(_records(spark, [("a", T0, "translation", "x", None, None)]))
    with monkeypatch.context() as m:      # dies after the data, before the commit
        m.setattr(HistoryStore, "_commit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            store.delete(_ids_df(spark, "a"))
    assert _ids(store) == ["a"]
    with monkeypatch.context() as m:      # dies after the commit, before its changes are in the log
        plain = HistoryStore._publish_changes
        calls = []
        m.setattr(HistoryStore, "_publish_changes", lambda s: calls.append(1) if calls else (calls.append(1), plain(s)))
        store.append(_records(spark, [("b", T0, "translation", "x", None, None)]))
    assert _ids(store) == ["a", "b"] and store.changes().count() == 1
    store.append(_records(spark, [("c", T0, "translation", "x", None, None)]))
    assert sorted((r.version, r.sign, r.id) for r in store.changes().collect()) == [(1, 1, "a"), (2, 1, "b"), (3, 1, "c")]


def test_compact_and_vacuum_keep_the_rows(spark, scratch):
    store = HistoryStore(spark, f"{scratch}/h", buckets=2)
    for n in range(6):
        store.append(_records(spark, [(f"{n}-{i}", T0, None if i == 0 else "translation", "x", None, None) for i in range(5)]))
    store.delete(_ids_df(spark, "3-0", "3-1"))
    want = _ids(store)
    assert len(want) == 28
    spread = len(store.folders())
    store.compact(most=1)
    assert len(store.folders()) < spread and _ids(store) == want
    store.vacuum(keep=1)
    assert _ids(store) == want
    assert store.changes().agg(F.sum("sign")).first()[0] == 28


def _analysis(words):
    import json
    return json.dumps({"vocabulary_items": [{"word": w, "translation": "t", "part_of_speech": "p", "difficulty_level": "d",
                                             "example_sentence": "e"} for w in words], "grammar_rules": [], "learning_tips": []})


@pytest.mark.parametrize("seed", range(2))
def test_maintained_summary_equals_the_batch_after_random_edits(spark, scratch, seed):
    rng, store, at = random.Random(seed), HistoryStore(spark, f"{scratch}/h", buckets=3), 0
    maintained, live = MaintainedSummary(store), []

    def some(n):
        nonlocal at
        out = []
        for _ in range(n):
            at += 1
            m = rng.choice(["translation", "correction", "analysis", "exercise"])
            out.append((str(at), T0 + dt.timedelta(minutes=rng.randrange(60)), m, rng.choice(["x", "y", "z", None]),
                        rng.choice(["", f"why {at} " * 30, None]) if m == "correction" else None,
                        _analysis([f"w{at}-{i}" for i in range(rng.randrange(9))]) if m == "analysis" else None))
        return out

    for step in ["append", "append", "edit", "append", "delete", "vacuum", "append", "clear", "append"]:
        if step == "append":
            new = some(25)
            live += [r[0] for r in new]
            store.append(_records(spark, new))
        elif step == "edit":
            store.upsert(_records(spark, [(rng.choice(live), *r[1:]) for r in some(2)]))
        elif step == "delete":
            store.delete(_ids_df(spark, *rng.sample(live, 6)))
        elif step == "vacuum":
            store.append(_records(spark, some(5)))
            store.compact(most=0)
            store.vacuum(keep=1)
        else:
            store.clear_all()
        got = sorted((r.language or "", r.summary or "") for r in maintained.documents().collect())
        want = sorted((r.language or "", r.summary or "") for r in A.summary_text(store.read()).collect())
        assert got == want, step


def test_an_append_is_merged_from_its_own_rows(spark, scratch, monkeypatch):
    store = HistoryStore(spark, f"{scratch}/h")
    store.append(_records(spark, [(str(i), T0, "translation", "x", None, None) for i in range(50)]))
    maintained = MaintainedSummary(store)
    maintained.state().count()
    store.append(_records(spark, [("new", T0, "correction", "x", "why", None)]))
    added, edits = maintained.changed_since(1, 2)
    assert not edits and len(added) == 1 and store.rows_of(added).count() == 1
    assert sorted({f.split("/")[-4] for f in maintained._updated(1, 2).inputFiles() if "/data/" in f}) == [added[0].split("/")[0]]


def test_as_of_join_against_a_loop(spark):
    rng = random.Random(4)
    when = lambda: T0 + dt.timedelta(seconds=rng.randrange(3000))
    keys = ["hot"] * 6 + ["a", "b", None]
    reads = [(i, rng.choice(keys), when(), "r") for i in range(300)] + [(300, "hot", None, "r"), (301, "nobody", T0, "r")]
    writes = [(1000 + i, rng.choice(keys), when(), f"v{i}") for i in range(200)] + [(1200, "hot", None, "v")]
    ddl = "n long, k string, at timestamp_ntz, _side string"
    l, r = spark.createDataFrame(reads, ddl), spark.createDataFrame(writes, ddl)
    for seconds in (1, 60, 100_000):
        got = {x.n: x.matched and x.matched.n for x in asof_join(l, r, "k", "at", "n", seconds).collect()}
        want = {}
        for n, k, at, _ in reads:
            fit = [(w[2], w[0]) for w in writes if k is not None and at is not None and w[1] == k and w[2] is not None and w[2] <= at]
            want[n] = max(fit)[1] if fit else None
        assert got == want
    assert asof_join(l.where("false"), r, "k", "at", "n").count() == 0
    assert asof_join(l, r.where("false"), "k", "at", "n").where("matched IS NOT NULL").count() == 0
