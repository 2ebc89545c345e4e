"""JSON strictness (N3, N4, N6, Q4) and timestamps / freshness (D1, D3, D4, W5)."""
import datetime as dt

from pyspark.sql import functions as F

from learnlog import constants as K
from learnlog.functions import json as J
from learnlog.functions import time as TM
from learnlog.operators import model as M

EDGE_JSON = [None, "{}", '{"learning_tips": ["a"]}', '{"vocabulary_items": "oops"}', "not json",
             '{"learning_tips": ["a"]} trailing', ' {"learning_tips": []}\n',
             '{"vocabulary_items": [{"word": "w", "extra": 1}], "grammar_rules": [], "learning_tips": [], "x": 2}']


def test_analysis_parse_is_whole_value_or_null(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(EDGE_JSON)], "id int, a string")
    got = {r.id: r.p for r in df.select("id", J.parse_analysis("a").alias("p")).collect()}
    assert got[0] is None                     # missing
    assert got[1].vocabulary_items == [] and got[1].learning_tips == []   # missing lists -> empty
    assert got[2].learning_tips == ["a"] and got[2].grammar_rules == []
    assert got[3] is None                     # wrong type: the whole record is rejected
    assert got[4] is None                     # bad text -> null, not a struct of nulls
    assert got[5] is None                     # trailing text after the object
    assert got[6].learning_tips == []         # surrounding whitespace is fine
    assert got[7].vocabulary_items[0].word == "w"   # unknown keys ignored


def test_exercise_reply_pipeline(spark):
    replies = ['{"type": "grammar", "title": "T"}', '```json\n{"type": "vocabulary", "options": ["a","b"]}\n```',
               "Oto ćwiczenie", '{"type": ', '[1]']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(replies)], "id int, r string")
    got = {r.id: r.p for r in df.select("id", M.parse_exercise_reply("r").alias("p")).collect()}
    assert got[0].error is None and got[0].exercise.title == "T"
    assert got[1].error is None and got[1].exercise.options == ["a", "b"]
    assert got[2].error == K.MSG_AI_NOT_JSON and got[2].exercise is None
    assert got[3].error == K.MSG_AI_NOT_JSON
    assert got[4].error == K.MSG_AI_NOT_JSON


def test_word_reply_default_record(spark):
    df = spark.createDataFrame([(0, "w", '{"word": "w", "translation": "t"}'), (1, "z", "nope")],
                               "id int, word string, r string")
    got = {r.id: r.p for r in df.select("id", J.parse_word_reply("r", F.col("word")).alias("p")).collect()}
    assert got[0].translation == "t"
    assert got[1].word == "z" and got[1].translation == K.MSG_WORD_PARSE_ERROR and got[1].examples == []


def test_parse_iso_keeps_wall_clock(spark):
    vals = ["2024-01-02T03:04:05", "2024-01-02T03:04:05.123456", "2024-01-02T03:04:05Z",
            "2024-01-02T03:04:05+02:00", "garbage"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, t string")
    got = {r.id: r.ts for r in df.select("id", TM.parse_iso_local("t").alias("ts")).collect()}
    for i, v in enumerate(vals[:4]):
        assert got[i] == dt.datetime.fromisoformat(v.replace("Z", "+00:00")).replace(tzinfo=None)
    assert got[4] is None


def test_formats(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 9, 7, 5, 1),)], "ts timestamp_ntz")
    r = df.select(TM.clock("ts"), TM.day_minute("ts"), TM.file_stamp("ts")).first()
    assert tuple(r) == ("07:05:01", "09.03.2024 07:05", "20240309_070501")


def test_ttl_expiry_boundaries(spark):
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    rows = [("at_expiry", t0, 600, t0 + dt.timedelta(seconds=600)),
            ("past", t0, 600, t0 + dt.timedelta(seconds=601)),
            ("zero_ttl", t0, 0, t0 + dt.timedelta(seconds=300)),
            ("null_ttl", t0, None, t0 + dt.timedelta(seconds=301))]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, ttl int, as_of timestamp_ntz")
    got = {r.key: r.e for r in df.select("key", TM.is_expired("ts", "ttl", "as_of").alias("e")).collect()}
    assert got == {"at_expiry": False, "past": True, "zero_ttl": False, "null_ttl": True}


def test_stepwise_reply_parse_equals_column_form(spark):
    replies = ['{"type": "grammar", "title": "T"}', '```json\n{"type": "vocabulary", "options": ["a"]}\n```',
               "Oto ćwiczenie", '{"type": ', '[1]', '{"a": 1} trailing', None, '  ```{"hint": "h"}```  ']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(replies)], "id int, r string")
    col_form = {r.id: (r.p.error, r.p.exercise) for r in df.select("id", M.parse_exercise_reply("r").alias("p")).collect()}
    step_form = {r.id: (r.error, r.exercise) for r in M.with_exercise_reply(df, "r").collect()}
    assert col_form == step_form
