"""Batch model inference over a table, and the parsing of model replies.

The task pipelines below build prompts, get replies through a ``Caller`` and parse them; all of
that but the call itself is native Spark. There are two callers:

* ``calling(client_factory, store_path)`` asks a model. ``model_map`` is a ``mapInPandas`` whose
  Arrow batches carry only the key columns and the two prompts; the client is built once per
  Python worker, each row gets a bounded number of attempts, and a failure becomes an ``error``
  value on that row, so one bad row cannot make Spark retry a whole partition of (paid) calls.
  ``client_factory`` is any picklable zero-argument callable returning an object with
  ``complete(system, user, max_tokens, temperature, task=...) -> str | bytes``. With a
  ``store_path`` replies are kept in a table, and no prompt is paid for twice.
* ``recorded(replies)`` takes replies from a table of earlier ones, joined by the prompt.
"""

from __future__ import annotations

import re
import time
from typing import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from learnlog import constants as K
from learnlog.session import ship_package
from learnlog import prompts as P
from learnlog.functions import json as J
from learnlog.functions import text as TX

#: (df, keys, system, user, task, binary=False) -> keys, reply, error
Caller = Callable[..., DataFrame]
NO_RECORDED_REPLY = "no recorded reply"

_CLIENTS: dict = {}


def _client(factory: Callable):
    c = _CLIENTS.get(factory)
    if c is None:
        c = _CLIENTS[factory] = factory()
    return c


def model_map(df: DataFrame, keys: list[str], system: Column, user: Column, task: str,
              client_factory: Callable, attempts: int = 2,
              backoff_seconds: float = 0.0, binary: bool = False,
              concurrency: int | None = None) -> DataFrame:
    """Call the model once per row; returns ``keys + reply + error``.

    Rows whose ``user`` prompt is null are not sent (reply and error null); tasks that
    have only a system prompt pass ``user = ""``. ``binary`` replies (speech) are bytes.
    ``concurrency`` caps the number of tasks calling the model at the same time."""
    max_tokens, temperature = P.TASK_PARAMS[task]
    key_fields = [df.schema[k] for k in keys]
    reply_type = T.BinaryType() if binary else T.StringType()
    out_schema = T.StructType(key_fields + [T.StructField("reply", reply_type),
                                            T.StructField("error", T.StringType())])

    def run(batches: Iterator) -> Iterator:
        client = _client(client_factory)
        for pdf in batches:
            replies, errors = [], []
            for s, u in zip(pdf["_system"], pdf["_user"]):
                if u is None:
                    replies.append(None)
                    errors.append(None)
                    continue
                reply, err = None, None
                for i in range(attempts):
                    try:
                        reply = client.complete(s, u, max_tokens, temperature, task=task)
                        err = None
                        break
                    except Exception as e:  # noqa: BLE001 - failures are data
                        err = str(e) or type(e).__name__
                        if backoff_seconds and i + 1 < attempts:
                            time.sleep(backoff_seconds * (2 ** i))
                replies.append(reply)
                errors.append(err)
            out = pdf[keys].copy()
            out["reply"] = replies
            out["error"] = errors
            yield out

    ship_package(df.sparkSession)
    batch = with_concurrency(df.select(*keys, system.alias("_system"), user.alias("_user")), concurrency)
    return batch.mapInPandas(run, out_schema)


def prompt_hash(task: str, system: Column, user: Column) -> Column:
    """Identity of a model request: task, its parameters, system prompt, user prompt."""
    return F.sha2(F.concat_ws("\u0001", F.lit(task), F.lit(str(P.TASK_PARAMS[task])),
                              F.coalesce(system, F.lit("")), F.coalesce(user, F.lit(""))), 256)


def calling(client_factory: Callable, store_path: str | None = None, **options) -> Caller:
    """Ask the model, through the reply table below ``store_path`` if one is given (binary replies in
    a table of their own). ``options`` go to ``model_map``."""
    def call(df, keys, system, user, task, binary=False):
        if store_path is None:
            return model_map(df, keys, system, user, task, client_factory, binary=binary, **options)
        return model_map_stored(df, keys, system, user, task, f"{store_path}/{'binary' if binary else 'text'}",
                                client_factory, binary=binary, **options)
    return call


def recorded(replies: DataFrame) -> Caller:
    """Take replies from a table (prompt = ``prompt_hash``, reply), of a prompt's replies the
    greatest. A prompt without one is an error; a null user prompt asks nothing."""
    best = replies.groupBy(F.col("prompt").alias("_h")).agg(F.max("reply").alias("reply"))

    def call(df, keys, system, user, task, binary=False):
        asked = df.select(*keys, F.when(user.isNotNull(), prompt_hash(task, system, user)).alias("_h"))
        out = asked.join(best, "_h", "left")
        missing = F.col("_h").isNotNull() & F.col("reply").isNull()
        return out.select(*keys, "reply", F.when(missing, F.lit(NO_RECORDED_REPLY)).alias("error"))
    return call


def model_map_stored(df: DataFrame, keys: list[str], system: Column, user: Column, task: str,
                     store_path: str, client_factory: Callable,
                     **kw) -> DataFrame:
    """``model_map`` with a reply table: each distinct prompt (by hash) is sent at most once
    per successful reply. New replies are appended to ``store_path`` (a folder in shared
    storage) before anything is parsed, so a failed or re-run job, or a retried stage, does
    not pay for the same prompt again; failed replies are retried on the next run."""
    from learnlog.sources.store import path_exists

    spark = df.sparkSession
    prompts = (df.select(*keys, system.alias("_system"), user.alias("_user"))
               .withColumn("_h", prompt_hash(task, F.col("_system"), F.col("_user"))))
    todo = prompts.where(F.col("_user").isNotNull()).select("_h", "_system", "_user") \
        .dropDuplicates(["_h"])
    if path_exists(spark, store_path):
        done = spark.read.parquet(store_path).where(F.col("error").isNull()).select("_h")
        todo = todo.join(done, "_h", "left_anti")
    model_map(todo, ["_h"], F.col("_system"), F.col("_user"), task, client_factory, **kw) \
        .write.mode("append").parquet(store_path)
    stored = spark.read.parquet(store_path)
    # one reply per prompt, a success before a failure (max of the struct, partial aggregate)
    best = stored.groupBy("_h").agg(
        F.max(F.struct(F.col("error").isNull().alias("ok"), "reply", "error")).alias("_b"))
    out = prompts.join(best, "_h", "left")
    return out.select(*keys, F.col("_b.reply").alias("reply"), F.col("_b.error").alias("error"))


def with_concurrency(df: DataFrame, n: int | None) -> DataFrame:
    """Bound the number of tasks calling the model at once (rate limits) by repartitioning."""
    return df.repartition(n) if n else df


def fill(template: str, **values: Column) -> Column:
    """Fill ``{name}`` placeholders column-wise (null as empty). The template is split once, so
    braces inside a filled-in value are text like any other."""
    parts = re.split(r"\{(\w+)\}", template)
    cols = []
    for i, part in enumerate(parts):
        if i % 2 and part in values:
            cols.append(F.coalesce(values[part], F.lit("")))
        elif i % 2 or part:
            cols.append(F.lit("{" + part + "}" if i % 2 else part))
    return F.concat(*cols) if cols else F.lit("")


_TEMPLATES = {
    "translate": (P.TRANSLATE_SYSTEM, P.TRANSLATE_USER),
    "correct": (P.CORRECT_SYSTEM, P.CORRECT_USER),
    "explain_correction": (P.EXPLAIN_CORRECTION_SYSTEM, P.EXPLAIN_CORRECTION_USER),
    "analyze": (P.ANALYZE_SYSTEM, P.ANALYZE_USER),
    "explain_word": (P.WORD_SYSTEM, P.WORD_USER),
    "tips": (P.TIPS_SYSTEM, ""),
}


def prompts(task: str, **values: Column) -> tuple[Column, Column]:
    """System and user prompt of a task."""
    system, user = _TEMPLATES[task]
    return fill(system, **values), fill(user, **values)


# --- task pipelines ----------------------------------------------------------------------

def translate(df: DataFrame, key: str, text: str, language: str, call: Caller) -> DataFrame:
    """Validate -> sanitise -> prompt -> model -> stripped reply. Invalid input is not sent
    and reports its validation message as the error."""
    reason = TX.text_reason(text)
    prepared = df.select(key, F.col(language).alias("_lang"), reason.alias("_reason"),
                         F.when(reason == "", TX.sanitize(text)).alias("_clean"))
    system, user = prompts("translate", language=F.col("_lang"), text=F.col("_clean"))
    calls = call(prepared, [key, "_reason"], system, F.when(F.col("_clean").isNotNull(), user), "translate")
    return calls.select(
        key,
        F.when(F.col("error").isNull() & F.col("reply").isNotNull(), TX.py_strip("reply")).alias("output"),
        F.when(F.col("_reason") != "", F.col("_reason")).otherwise(F.col("error")).alias("error"))


def correct(df: DataFrame, key: str, text: str, language: str, call: Caller) -> DataFrame:
    """Correct (input sent as is) then explain the correction; a failed correction is an
    error value, not a corrected text, and is not explained. ``key`` is unique; only it goes
    with the prompts, the texts are joined back."""
    src = df.select(key, F.col(text).alias("_text"), F.col(language).alias("_lang"))
    first = call(src, [key], *prompts("correct", language=F.col("_lang"), text=F.col("_text")), "correct")
    corrected = src.join(first.select(
        key, F.when(F.col("error").isNull(), TX.py_strip("reply")).alias("output"), F.col("error").alias("_err1")), key)
    system, user = prompts("explain_correction", language=F.col("_lang"), original=F.col("_text"),
                           corrected=F.col("output"))
    second = call(corrected, [key], system, F.when(F.col("output").isNotNull(), user), "explain_correction")
    return corrected.select(key, "output", "_err1").join(second, key).select(
        key, "output",
        F.when(F.col("error").isNull() & F.col("reply").isNotNull(), TX.py_strip("reply")).alias("explanation"),
        F.coalesce("_err1", "error").alias("error"))


def analyze(df: DataFrame, key: str, text: str, language: str, call: Caller) -> DataFrame:
    """Analysis reply -> nested record; a failed call or unparseable reply gives empty lists
    and one tip carrying the error."""
    calls = call(df, [key], *prompts("analyze", language=F.col(language), text=F.col(text)), "analyze")
    calls = J.with_analysis(calls, "reply", "_parsed")
    parsed = F.col("_parsed")
    calls = calls.withColumn(
        "_err", F.coalesce(F.col("error"), F.when(parsed.isNull(), F.lit(K.MSG_AI_PARSE_ERROR))))
    err = F.col("_err")
    fallback = F.struct(
        F.array().cast(f"array<{J.VOCABULARY_ITEM}>").alias("vocabulary_items"),
        F.array().cast(f"array<{J.GRAMMAR_RULE}>").alias("grammar_rules"),
        F.array(F.concat(F.lit(P.ANALYZE_FAILURE_TIP), err)).alias("learning_tips"))
    return calls.select(key, F.when(err.isNull(), parsed).otherwise(fallback).alias("analysis"),
                        F.col("reply").alias("analysis_data"), err.alias("error"))


def parse_exercise_reply(reply) -> Column:
    """Reply -> (error, exercise): strip fences, require ``{...}``, parse strictly.
    (Column form; operators use ``with_exercise_reply``, which evaluates each step once.)"""
    body = TX.strip_code_fences(reply)
    parsed = J.strict_from_json(body, J.EXERCISE_DDL)
    error = (F.when(~TX.looks_like_json_object(body), F.lit(K.MSG_AI_NOT_JSON))
             .when(parsed.isNull(), F.lit(K.MSG_AI_PARSE_ERROR)))
    return F.struct(error.alias("error"), F.when(error.isNull(), parsed).alias("exercise"))


def with_exercise_reply(df: DataFrame, reply: str, error: str = "error",
                        exercise: str = "exercise") -> DataFrame:
    d = TX.in_steps(df, reply, "_reply_body", TX.FENCE_STEPS)
    d = J.with_json(d, "_reply_body", J.EXERCISE_DDL, "_reply_parsed")
    err = (F.when(~TX.looks_like_json_object("_reply_body"), F.lit(K.MSG_AI_NOT_JSON))
           .when(F.col("_reply_parsed").isNull(), F.lit(K.MSG_AI_PARSE_ERROR)))
    d = d.withColumn(error, err)
    d = d.withColumn(exercise, F.when(F.col(error).isNull(), F.col("_reply_parsed")))
    return d.drop("_reply_body", "_reply_parsed")


def exercise_prompt(language, summary, exercise_type) -> Column:
    """System prompt for an exercise type; null for an unknown type (no call is made)."""
    t = F.col(exercise_type) if isinstance(exercise_type, str) else exercise_type
    expr = None
    for name, tpl in P.EXERCISE_SYSTEM.items():
        filled = fill(tpl, language=language, summary=summary)
        expr = F.when(t == name, filled) if expr is None else expr.when(t == name, filled)
    return expr


def tips_from_reply(reply) -> Column:
    return TX.bullet_tips(reply)


def answer_prompts(route: Column, context: Column, routed: bool) -> tuple[Column, Column]:
    """Prompts for ``language, question, summary`` rows; a refused question has no user prompt."""
    lang, summary = F.col("language"), F.col("summary")
    if not routed:
        return fill(P.ANSWER_SYSTEM, language=lang, summary=summary), F.col("question")
    conv = fill(P.CHAT_CONVERSATION_SYSTEM, language=lang, context=context, summary=summary)
    expl = fill(P.CHAT_EXPLAIN_SYSTEM, language=lang, context=context, summary=summary)
    return F.when(route == "conversation", conv).otherwise(expl), F.when(route != "refuse", F.col("question"))


def answer(questions: DataFrame, key: list[str], call: Caller, routed: bool = True,
           context: Column | None = None) -> DataFrame:
    """Tutor answers for ``questions`` (``language, question, summary``).

    Routed (with context): off-topic questions get the refusal text and no call; the others
    get the conversation or the explanation prompt. Unrouted: one prompt for all. ``ok``
    is the app's acceptance test of a reply (non-empty, no ``error``)."""
    route = TX.route_question("question") if routed else F.lit("explain")
    system, user = answer_prompts(route, context if context is not None else F.lit(""), routed)
    prepared = questions.select(*key, "language", route.alias("route"), system.alias("_s"), user.alias("_u"))
    calls = call(prepared, [*key, "language", "route"], F.col("_s"), F.col("_u"),
                 "answer_with_context" if routed else "answer")
    text = (F.when(F.col("route") == "refuse", TX.refusal_text("language"))
            .when(F.col("error").isNull(), TX.py_strip("reply")))
    return calls.select(*key, "route", text.alias("answer"), TX.response_ok(text).alias("ok"), "error")


def tips(summaries: DataFrame, call: Caller) -> DataFrame:
    """Tips per language from its history summary: prompt -> model -> bullet lines."""
    system, user = prompts("tips", language=F.col("language"), summary=F.col("summary"))
    calls = call(summaries, ["language"], system, user, "tips")
    return calls.select("language", F.when(F.col("error").isNull(), tips_from_reply("reply"))
                        .otherwise(F.array(F.col("error"))).alias("tips"), "error")


def exercises(requests: DataFrame, key: str, call: Caller) -> DataFrame:
    """Exercise generation for requests (``language, exercise_type, summary``): prompt by
    type (an unknown type is an error, no call) -> model -> fences / brace check / strict
    parse -> exercise record with the generation time."""
    system = exercise_prompt(F.col("language"), F.col("summary"), F.col("exercise_type"))
    prepared = requests.select(key, "exercise_type", system.alias("_s"))
    calls = call(prepared, [key, "exercise_type"], F.col("_s"), F.when(F.col("_s").isNotNull(), F.lit("")), "exercise")
    parsed = with_exercise_reply(calls.withColumnRenamed("error", "_call_error"), "reply",
                                 "_parse_error", "_ex")
    err = (F.when(~F.col("exercise_type").isin(*K.EXERCISE_TYPES), F.lit(K.MSG_UNKNOWN_EXERCISE_TYPE))
           .when(F.col("_call_error").isNotNull(), F.col("_call_error"))
           .otherwise(F.col("_parse_error")))
    ex = F.when(err.isNull(), F.struct(F.col("_ex").alias("body"),
                                       F.date_format(F.current_timestamp(),
                                                     "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")))
    return parsed.select(key, "exercise_type", err.alias("error"), ex.alias("exercise"))


def explain_words(words: DataFrame, call: Caller) -> DataFrame:
    """Word explanations (``language, word``): prompt -> model -> JSON record, or the default
    record when the reply is not JSON (failed calls keep their error)."""
    calls = call(words, ["language", "word"], *prompts("explain_word", language=F.col("language"), word=F.col("word")),
                 "explain_word")
    return J.with_word_reply(calls, "reply", "word", "explanation").select("language", "word", "explanation", "error")


def speech(texts: DataFrame, key: str, text: str, language: str, call: Caller) -> DataFrame:
    """Speech for texts: input cut to 4000 chars (+ "..."), voice by language, model call,
    audio kept only when it has at least the minimum size."""
    from learnlog.sources.fixtures import voice_for
    prepared = texts.select(key, voice_for(F.col(language)).alias("voice"),
                            TX.tts_input(text).alias("_u"))
    calls = call(prepared, [key, "voice"], F.col("voice"), F.col("_u"), "speech", binary=True)
    ok = TX.audio_ok("reply")
    return calls.select(key, "voice", F.when(ok, F.col("reply")).alias("audio"),
                        F.when(F.col("error").isNull() & ~ok, F.lit("audio too small"))
                        .otherwise(F.col("error")).alias("error"))


# --- from replies to stored records ---------------------------------------------------------
# Rows whose call or check failed are no records: they stay in the frame the task returned.

def translation_records(texts: DataFrame, key: str, text: str, language: str, call: Caller,
                        speech_call: Caller | None = None) -> DataFrame:
    """Translate, pick a voice, speak the translation, and make history records of what succeeded;
    speech that failed leaves a record without audio."""
    from learnlog.operators import history as H
    from learnlog.sources.fixtures import voice_for
    done = (translate(texts, key, text, language, call).where("error IS NULL AND output IS NOT NULL")
            .join(texts.select(key, F.col(text).alias("input_text"), F.col(language).alias("language")), key)
            .withColumn("output_text", F.col("output")).withColumn("voice", voice_for(F.col("language"))))
    if speech_call is not None:
        spoken = speech(done.select(key, "output_text", "language"), key, "output_text", "language", speech_call)
        done = done.join(spoken.select(key, "audio"), key, "left")
    return H.stamp(H.translation_records(done, "audio" if speech_call is not None else None))


def correction_records(texts: DataFrame, key: str, text: str, language: str, call: Caller) -> DataFrame:
    """Correct, explain, and make history records of the corrected texts; an explanation that
    failed is null."""
    from learnlog.operators import history as H
    done = (correct(texts, key, text, language, call).where("output IS NOT NULL")
            .join(texts.select(key, F.col(text).alias("input_text"), F.col(language).alias("language")), key))
    none = F.lit(None).cast("string")
    return H.stamp(H.correction_records(done.select(
        "input_text", F.col("output").alias("output_text"), "language", F.lit("correction").alias("mode"),
        "explanation", none.alias("analysis_data"), none.alias("exercise_data"))))


def analysis_records(texts: DataFrame, key: str, text: str, language: str, call: Caller) -> DataFrame:
    """Analyse, and make history records of the replies that are analyses."""
    from learnlog.operators import history as H
    done = (analyze(texts, key, text, language, call).where("error IS NULL")
            .join(texts.select(key, F.col(text).alias("input_text"), F.col(language).alias("language")), key))
    none = F.lit(None).cast("string")
    return H.stamp(H.correction_records(done.select(
        "input_text", F.lit("").alias("output_text"), "language", F.lit("analysis").alias("mode"),
        none.alias("explanation"), "analysis_data", none.alias("exercise_data"))))
