"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator key.

Every query reads the driver tables (or the history table Spark derives from them) in
full; limits appear only where the limit is the feature (a page, a top-N).
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlog import constants as K
from learnlog import prompts as P
from learnlog.functions import json as J
from learnlog.functions import text as T
from learnlog.functions import time as TM
from learnlog.operators import analysis as A
from learnlog.operators import chat as C
from learnlog.operators import history as H
from learnlog.operators import model as M
from learnlog.operators import neighbours as N
from learnlog.operators.asof import asof_join
from learnlog.operators.maintained import MaintainedSummary
from learnlog.operators import vector as V
from learnlog.session import checkpoint_dir, written
from learnlog.sources import store as S
from learnlog.sources import files as FS
from learnlog.sources.fixtures import LANG_CODE_TO_NAME, analysis_struct, conversation_language, voice_for
from learnlog.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# FIXED VALUES (test data): the language used by history_by_language; the event type ->
# cache kind used for freshness; the event type -> exercise type used for validation.
FILTER_LANGUAGE = "niemiecki"
EVENT_TTL_KIND = {
    "view": "translations",
    "click": "corrections",
    "signup": "chat_sessions",
    "purchase": "tips_history",
}
EVENT_EXERCISE_TYPE = {
    "view": "vocabulary",
    "click": "grammar",
    "purchase": "translation",
}
EVENT_MODE = {
    "view": "translation",
    "click": "correction",
    "purchase": "analysis",
    "signup": "exercise",
}
UPLOAD_LIMIT_MB = 0.002
VECTOR_QUERY_ID = 0
VECTOR_K = 10
VECTOR_QUERY_STEP = 50


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _h(spark, sf):
    return S.history_table(spark, sf)


def _rows(spark, sf):
    """The history with its texts by reference."""
    return S.history_rows(spark, sf)


def _docs(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", "text", "lang")


def _msgs(spark, sf):
    return C.messages(read_table(spark, sf, "conversations"), conversation_language())


def _case(col, mapping: dict, default=None):
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(default if default is not None else F.lit(None))


# --- 1. history reads and edits ---------------------------------------------------------------

@query("history_scan")
def q_history_scan(spark, sf):
    return H.scan(_h(spark, sf))


@query("history_union")
def q_history_union(spark, sf):
    return H.history_union(_h(spark, sf))


@query("history_stats")
def q_history_stats(spark, sf):
    return H.history_stats(_h(spark, sf))


@query("history_dashboard")
def q_history_dashboard(spark, sf):
    return H.history_dashboard(_h(spark, sf))


@query("history_ordinal")
def q_history_ordinal(spark, sf):
    return H.history_ordinal(_h(spark, sf))


@query("history_by_language")
def q_history_by_language(spark, sf):
    return H.history_by_language(_h(spark, sf), FILTER_LANGUAGE)


@query("get_translations")
def q_get_translations(spark, sf):
    t = H.get_translations(_h(spark, sf))
    return t.withColumn("audio_text", F.decode("audio_data", "UTF-8")).drop("audio_data")


@query("get_corrections")
def q_get_corrections(spark, sf):
    c = H.get_corrections(_h(spark, sf))
    return c.select("id", "ts", "input", "output", "language", "mode", "explanation",
                    T.n_items("analysis.vocabulary_items").alias("n_vocabulary"),
                    F.col("exercise.type").alias("exercise_type"))


@query("get_tips_history")
def q_get_tips_history(spark, sf):
    return H.get_tips_history(_h(spark, sf))


@query("get_chat_sessions")
def q_get_chat_sessions(spark, sf):
    return H.get_chat_sessions(_h(spark, sf))


@query("archive_by_mode")
def q_archive_by_mode(spark, sf):
    return H.archive_by_mode(_h(spark, sf))


@query("build_translation_rows")
def q_build_translation_rows(spark, sf):
    """Records built again from stored translations, their audio decoded first."""
    h = _h(spark, sf).where(F.col("mode") == "translation").withColumn("audio", F.unbase64("audio_data"))
    return H.translation_records(h, "audio")


@query("build_correction_rows")
def q_build_correction_rows(spark, sf):
    h = _h(spark, sf).where(F.col("mode").isin(*K.CORRECTION_LIST_MODES))
    r = H.correction_records(h)
    return r.select("input_text", "output_text", "language", "mode", "explanation",
                    F.col("analysis_data").isNotNull().alias("has_analysis"),
                    F.col("exercise_data").isNotNull().alias("has_exercise"))


@query("tips_rows")
def q_tips_rows(spark, sf):
    h = _h(spark, sf).where(F.col("mode") == "learning_tips")
    tips = h.select("id", "language", F.split("tips_text", "\n").alias("tips"))
    return H.tips_records(tips).select("id", "tips_text", "tips_count")


@query("upsert_latest")
def q_upsert_latest(spark, sf):
    ev = read_table(spark, sf, "events").select("user_id", "event_id", "ts")
    return H.latest_per_key(ev, "user_id", "ts", "event_id", [])


@query("delete_items")
def q_delete_items(spark, sf):
    """Delete every history record whose source document is labelled toxic."""
    h = _h(spark, sf)
    toxic = read_table(spark, sf, "labels").where(F.col("toxic") == 1).select("doc_id")
    ids = h.select("id", "doc_id").join(toxic, "doc_id", "left_semi").select("id")
    return H.delete_items(h.select("id", "mode"), ids)


# --- 2. text on documents ---------------------------------------------------------------------

@query("validate_text")
def q_validate_text(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", T.text_is_valid("text").alias("is_valid"),
                    T.text_reason("text").alias("reason"),
                    T.accepted_by_gate("text").alias("accepted_by_gate"))


@query("validate_language")
def q_validate_language(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", F.explode(F.array(
        _case(F.col("lang"), LANG_CODE_TO_NAME), F.col("lang"))).alias("value"))
    r = T.language_reason("value")
    return d.select("doc_id", "value", (r == "").alias("is_valid"), r.alias("reason"))


@query("validate_exercise_type")
def q_validate_exercise_type(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "event_type")
    v = _case(F.col("event_type"), EVENT_EXERCISE_TYPE, F.col("event_type"))
    r = T.exercise_type_reason(v)
    return ev.select("event_id", v.alias("value"), (r == "").alias("is_valid"), r.alias("reason"))


@query("sanitize_text")
def q_sanitize_text(spark, sf):
    return _docs(spark, sf).select("doc_id", T.sanitize("text").alias("clean"))


@query("text_preview")
def q_text_preview(spark, sf):
    return _docs(spark, sf).select("doc_id", F.length("text").cast("bigint").alias("n"),
                                   T.preview("text").alias("preview"))


@query("tts_input")
def q_tts_input(spark, sf):
    return _docs(spark, sf).select("doc_id", F.length("text").cast("bigint").alias("n"),
                                   T.tts_input("text").alias("tts_text"))


def prefixed_replies(d: DataFrame) -> DataFrame:
    """Fixture: a model answer that starts with one of the known prefixes (by document)."""
    k = F.col("doc_id") % 7
    prefixes = K.TRANSLATION_PREFIXES
    with_prefix = F.concat(F.element_at(F.array(*[F.lit(p) for p in prefixes]),
                                        (k + 1).cast("int")), F.lit(" "), F.col("text"))
    both = F.concat(F.lit(prefixes[0] + " " + prefixes[1] + " "), F.col("text"))
    reply = F.when(k < 6, with_prefix).otherwise(both)
    return d.select("doc_id", reply.alias("reply"))


@query("clean_prefixes")
def q_clean_prefixes(spark, sf):
    r = prefixed_replies(_docs(spark, sf))
    return r.select("doc_id", T.strip_prefixes("reply", K.TRANSLATION_PREFIXES).alias("cleaned"),
                    T.strip_prefixes("reply", K.CORRECTION_PREFIXES).alias("cleaned_correction"))


def fenced_replies(d: DataFrame) -> DataFrame:
    k = F.col("doc_id") % 4
    t = F.col("text")
    reply = (F.when(k == 0, F.concat(F.lit("```json\n"), t, F.lit("\n```")))
             .when(k == 1, F.concat(F.lit("```\n"), t, F.lit("\n```")))
             .when(k == 2, F.concat(F.lit("  ```"), t))
             .otherwise(t))
    return d.select("doc_id", reply.alias("reply"))


@query("strip_fences")
def q_strip_fences(spark, sf):
    r = fenced_replies(_docs(spark, sf))
    return r.select("doc_id", T.strip_code_fences("reply").alias("body"))


def bulleted_replies(d: DataFrame) -> DataFrame:
    lines = F.split(F.col("text"), "\n")
    marked = F.transform(lines, lambda line, i: F.when(i % 2 == 0, F.concat(F.lit(K.TIP_BULLET), line))
                         .otherwise(line))
    return d.select("doc_id", F.array_join(marked, "\n").alias("reply"))


@query("tips_parse")
def q_tips_parse(spark, sf):
    r = bulleted_replies(_docs(spark, sf))
    return r.select("doc_id", F.posexplode(M.tips_from_reply("reply")).alias("pos", "tip"))


@query("tips_lines")
def q_tips_lines(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", F.posexplode(T.nonblank_lines("text")).alias("pos", "line"))


# FIXED VALUES (test data): markers put in front of a document to simulate failures
ERROR_MARKERS = ["Error: quota exceeded. ", "Invalid request format. ", "Rate limit reached. ",
                 "Billing problem. ", ""]


def marked_replies(d: DataFrame) -> DataFrame:
    k = (F.col("doc_id") % len(ERROR_MARKERS) + 1).cast("int")
    marker = F.element_at(F.array(*[F.lit(m) for m in ERROR_MARKERS]), k)
    return d.select("doc_id", F.concat(marker, F.col("text")).alias("reply"))


@query("response_ok")
def q_response_ok(spark, sf):
    r = marked_replies(_docs(spark, sf))
    return r.select("doc_id", T.response_ok("reply").alias("ok"))


@query("error_class")
def q_error_class(spark, sf):
    r = marked_replies(_docs(spark, sf))
    return r.select("doc_id", T.error_class("reply").alias("class"))


def iso_events(spark, sf) -> DataFrame:
    ev = read_table(spark, sf, "events").select("event_id", "ts", "event_type")
    suffix = (F.when(F.col("event_type") == "view", F.lit("+02:00"))
              .when(F.col("event_type") == "click", F.lit("Z")).otherwise(F.lit("")))
    return ev.select("event_id", F.concat(TM.iso_text("ts"), suffix).alias("ts_text"))


@query("parse_timestamp")
def q_parse_timestamp(spark, sf):
    return iso_events(spark, sf).select("event_id", TM.parse_iso_local("ts_text").alias("ts"))


@query("format_timestamps")
def q_format_timestamps(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "ts")
    return ev.select("event_id", TM.clock("ts").alias("clock"), TM.day_minute("ts").alias("day_minute"),
                     TM.file_stamp("ts").alias("file_stamp"))


# --- 3. nested / JSON -------------------------------------------------------------------------

@query("analysis_roundtrip")
def q_analysis_roundtrip(spark, sf):
    """Counts of each list, and the texts put together again from the parsed body."""
    a = A.parsed_analyses(_h(spark, sf))
    an = F.col("analysis")
    join = lambda items, part, sep="\n": F.array_join(F.transform(items, part), sep)
    return a.select("id",
                    T.n_items(an.vocabulary_items).alias("n_vocabulary"),
                    T.n_items(an.grammar_rules).alias("n_rules"),
                    T.n_items(an.learning_tips).alias("n_tips"),
                    F.try_element_at(an.grammar_rules, F.lit(1)).rule_name.alias("first_rule"),
                    join(an.vocabulary_items, lambda v: v.example_sentence).alias("sentences"),
                    join(an.grammar_rules, lambda r: F.array_join(r.examples, " ")).alias("examples"),
                    F.array_join(an.learning_tips, "\n").alias("tips"))


@query("vocabulary")
def q_vocabulary(spark, sf):
    v = A.vocabulary(_h(spark, sf))
    return v.select("id", F.col("pos").cast("bigint").alias("pos"), "word", "translation", "difficulty")


@query("exercise_roundtrip")
def q_exercise_roundtrip(spark, sf):
    e = A.parsed_exercises(_h(spark, sf))
    ex = F.col("exercise")
    return e.select("id", ex.type.alias("type"), ex.title.alias("title"), ex.question.alias("question"),
                    ex.correct_answer.alias("correct_answer"),
                    T.n_items(ex.options).alias("n_options"),
                    ex.difficulty.alias("difficulty"), ex.hint.alias("hint"))


@query("lossless_bodies")
def q_lossless_bodies(spark, sf):
    """Documents as exercise bodies with keys that no schema lists, every third cut short: parsed
    whole or not at all, the unlisted keys read back from the stored value."""
    body = F.to_json(F.struct(F.lit("grammar").alias("type"), F.col("text").alias("question"),
                              F.struct(F.col("lang").alias("from"), F.array(F.col("doc_id"), F.length("text")).alias("sizes")).alias("x-source"),
                              F.lit(True).alias("x-checked")), {"ignoreNullFields": "false"})
    body = F.when(F.col("doc_id") % 3 == 2, F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    d = J.with_body(_docs(spark, sf).withColumn("body", body), "body", "v")
    field = lambda path, kind: J.body_field("v", path, kind)
    return d.select(
        "doc_id", F.col("v").isNotNull().alias("valid"), field("$.question", "string").alias("question"),
        field("$['x-source'].from", "string").alias("source_lang"), field("$['x-source'].sizes[1]", "bigint").alias("size"),
        field("$['x-checked']", "boolean").alias("checked"), F.size(F.json_object_keys(J.body_text("v"))).cast("bigint").alias("n_keys"))


@query("exercise_options")
def q_exercise_options(spark, sf):
    return A.exercise_options(_h(spark, sf))


@query("exercise_context")
def q_exercise_context(spark, sf):
    return A.exercise_context(_h(spark, sf))


@query("grammar_rules")
def q_grammar_rules(spark, sf):
    g = A.grammar_rules(_h(spark, sf))
    return g.select("id", F.col("rule_pos").cast("bigint").alias("rule_pos"), "rule",
                    F.col("example_pos").cast("bigint").alias("example_pos"), "example")


@query("analysis_digest")
def q_analysis_digest(spark, sf):
    return A.analysis_digest(_h(spark, sf))


def exercise_replies(d: DataFrame) -> DataFrame:
    """Fixture: exercise replies of four shapes - plain JSON, fenced JSON, prose around JSON,
    cut-off JSON (closing brace kept) - over the whole text."""
    body = F.to_json(F.struct(
        F.lit("vocabulary").alias("type"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("question"),
        F.split("text", "\n").alias("options"),
        F.lit("Podpowiedź").alias("hint")))
    d = d.select("doc_id", body.alias("body"))
    body, k = F.col("body"), F.col("doc_id") % 4
    reply = (F.when(k == 0, body)
             .when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
             .when(k == 2, F.concat(F.lit("Oto ćwiczenie: "), body))
             .otherwise(F.concat(F.left(body, F.length(body) - 5), F.lit("}"))))
    return d.select("doc_id", reply.alias("reply"))


@query("exercise_parse")
def q_exercise_parse(spark, sf):
    r = M.with_exercise_reply(exercise_replies(_docs(spark, sf)), "reply")
    return r.select("doc_id", "error", F.col("exercise.type").alias("type"),
                    F.col("exercise.title").alias("title"), F.col("exercise.question").alias("question"),
                    F.array_join("exercise.options", "\n").alias("options"))


def word_replies(d: DataFrame) -> DataFrame:
    """Fixture: replies about a document's first word whose definition and examples are the whole
    text; every third is not JSON."""
    w = F.substring_index("text", " ", 1)
    body = F.to_json(F.struct(w.alias("word"), F.concat(F.lit("pl:"), w).alias("translation"),
                              F.lit("noun").alias("part_of_speech"), F.col("text").alias("definition"),
                              F.split("text", "\n").alias("examples")))
    reply = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Słowo: "), F.col("text"))).otherwise(body)
    return d.select("doc_id", w.alias("word"), reply.alias("reply"))


@query("word_parse")
def q_word_parse(spark, sf):
    p = J.with_word_reply(word_replies(_docs(spark, sf)), "reply", "word", "p")
    return p.select("doc_id", F.col("p.word").alias("word"), F.col("p.translation").alias("translation"),
                    F.col("p.part_of_speech").alias("part_of_speech"), F.col("p.definition").alias("definition"),
                    F.array_join("p.examples", "\n").alias("examples"))


# --- 4. analytics -----------------------------------------------------------------------------

@query("vocabulary_counts")
def q_vocabulary_counts(spark, sf):
    return A.vocabulary_counts(_h(spark, sf))


@query("vocabulary_top20")
def q_vocabulary_top20(spark, sf):
    return A.vocabulary_top(_rows(spark, sf), bodies=S.history_bodies(spark, sf)).select("language", "rn", "word")


@query("language_summary")
def q_language_summary(spark, sf):
    return A.language_summary(_h(spark, sf))


@query("summary_full_outer")
def q_summary_full_outer(spark, sf):
    return A.summary_full_outer(_h(spark, sf))


@query("recent_errors")
def q_recent_errors(spark, sf):
    return A.recent_errors(_h(spark, sf))


@query("summary_text")
def q_summary_text(spark, sf):
    return A.summary_text(_rows(spark, sf), S.history_bodies(spark, sf))


@query("voice_lookup")
def q_voice_lookup(spark, sf):
    t = _h(spark, sf).where(F.col("mode") == "translation").select("id", "language")
    return A.voice_lookup(t).select("id", "language", "voice", "voice_label")


@query("label_lookup")
def q_label_lookup(spark, sf):
    return A.label_lookup(A.parsed_exercises(_h(spark, sf)))


def tutor_summaries(spark, sf):
    """Per-language summaries of the current history, maintained beside it."""
    _rows(spark, sf)
    return MaintainedSummary(S.history_store(spark, sf), S.history_bodies(spark, sf)).documents()


def _questions_with_summary(spark, sf):
    qs = C.user_questions(_msgs(spark, sf))
    return A.attach_summary(qs, tutor_summaries(spark, sf))


@query("question_prompt")
def q_question_prompt(spark, sf):
    q = _questions_with_summary(spark, sf)
    route = T.route_question("question")
    ctx = C.chat_context(F.lit(""))
    conv = M.fill(P.CHAT_CONVERSATION_SYSTEM, language=F.col("language"), context=ctx,
                  summary=F.col("summary"))
    expl = M.fill(P.CHAT_EXPLAIN_SYSTEM, language=F.col("language"), context=ctx,
                  summary=F.col("summary"))
    system = F.when(route == "conversation", conv).when(route == "explain", expl)
    return q.select("conv_id", "turn", route.alias("route"), system.alias("system"),
                    F.when(route != "refuse", F.col("question")).alias("user"),
                    F.when(route == "refuse", T.refusal_text("language")).alias("refusal"))


@query("tips_context")
def q_tips_context(spark, sf):
    h = _h(spark, sf).where(F.col("mode") == "learning_tips")
    return h.select("id", A.tips_context_text(F.split("tips_text", "\n")).alias("context_fresh"),
                    A.tips_context_text(F.col("tips_text"), fresh=False).alias("context_archive"))


@query("build_prompts")
def q_build_prompts(spark, sf):
    d = _docs_lang(spark, sf)
    lang, text = F.col("language"), F.col("text")
    tasks = F.array(*[
        F.struct(F.lit(task).alias("task"), M.fill(sys_t, language=lang).alias("system"),
                 M.fill(user_t, language=lang, text=text).alias("user"))
        for task, sys_t, user_t in [("translate", P.TRANSLATE_SYSTEM, P.TRANSLATE_USER),
                                    ("correct", P.CORRECT_SYSTEM, P.CORRECT_USER),
                                    ("analyze", P.ANALYZE_SYSTEM, P.ANALYZE_USER)]])
    return d.select("doc_id", F.explode(tasks).alias("p")).select("doc_id", "p.*")


# --- 5. chat ----------------------------------------------------------------------------------

@query("question_routing")
def q_question_routing(spark, sf):
    return C.route_questions(C.user_questions(_msgs(spark, sf)))


@query("chat_transcript")
def q_chat_transcript(spark, sf):
    return C.transcript(_msgs(spark, sf))


@query("chat_snapshots")
def q_chat_snapshots(spark, sf):
    s = C.snapshots(_msgs(spark, sf))
    return s.select("conv_id", "turn", "message_count", "chat_text")


@query("chat_parse")
def q_chat_parse(spark, sf):
    t = C.transcript(_msgs(spark, sf))
    return C.parse_transcript(t).select("conv_id", F.col("line").cast("bigint").alias("line"),
                                        "role", "content")


# --- 6. audio ---------------------------------------------------------------------------------

@query("audio_base64")
def q_audio_base64(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.encode("text", "UTF-8").alias("audio"))
    b = d.select("doc_id", "audio", T.b64("audio").alias("b64"))
    return b.select("doc_id", "b64", (F.unbase64("b64") == F.col("audio")).alias("decodes"))


@query("audio_valid")
def q_audio_valid(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.encode(T.tts_input("text"), "UTF-8").alias("audio"))
    return d.select("doc_id", T.audio_ok("audio").alias("valid"),
                    F.coalesce(F.octet_length("audio") > 0, F.lit(False)).alias("has_audio"))


# --- 7. model tasks over recorded replies -------------------------------------------------------
# The prompts of a task are answered from a table of recorded replies (derived from the same tables,
# by the prompt), joined by the prompt's hash; a reply is a function of the whole input.

def _docs_lang(spark, sf):
    return _docs(spark, sf).select("doc_id", "text",
                                   _case(F.col("lang"), LANG_CODE_TO_NAME).alias("language"))


def _replies(task, df, system, user, reply):
    return df.where(user.isNotNull()).select(M.prompt_hash(task, system, user).alias("prompt"), reply.alias("reply"))


def _recorded(task, df, system, user, reply):
    return M.recorded(_replies(task, df, system, user, reply))


@query("model_translate")
def q_model_translate(spark, sf):
    d = _docs_lang(spark, sf)
    ok = d.select("language", F.when(T.text_reason("text") == "", T.sanitize("text")).alias("clean"))
    ok = ok.where("clean IS NOT NULL")
    call = _recorded("translate", ok, *M.prompts("translate", language=F.col("language"), text=F.col("clean")),
                     F.concat(F.lit("  "), F.col("clean"), F.lit(" [pl]\n")))
    return M.translate(d, "doc_id", "text", "language", call)


@query("model_correct")
def q_model_correct(spark, sf):
    """Every reply corrects by a suffix; the second task's prompts hold the first one's replies."""
    d = _docs_lang(spark, sf)
    lang, text = F.col("language"), F.col("text")
    better = T.py_strip(F.concat(text, F.lit(" (ok)")))
    first = _replies("correct", d, *M.prompts("correct", language=lang, text=text), F.concat(text, F.lit(" (ok)")))
    second = _replies("explain_correction", d,
                      *M.prompts("explain_correction", language=lang, original=text, corrected=better),
                      F.concat(F.lit("Poprawiono: "), better))
    return M.correct(d, "doc_id", "text", "language", M.recorded(first.unionByName(second)))


@query("model_analyze")
def q_model_analyze(spark, sf):
    """Replies are analyses of the whole text; texts of a length divisible by 5 got no JSON."""
    d = _docs_lang(spark, sf)
    reply = F.when(F.length("text") % 5 == 0, F.col("text")).otherwise(
        F.to_json(analysis_struct(F.col("text"), F.col("text"))))
    call = _recorded("analyze", d, *M.prompts("analyze", language=F.col("language"), text=F.col("text")), reply)
    a = M.analyze(d, "doc_id", "text", "language", call)
    items = F.col("analysis.vocabulary_items")
    return a.select("doc_id", T.n_items(items).alias("n_vocabulary"),
                    F.array_join(F.transform(items, lambda v: v.example_sentence), "\n").alias("sentences"),
                    F.array_join("analysis.learning_tips", "\n").alias("tips"), "error")


def _answers(spark, sf, routed):
    q = _questions_with_summary(spark, sf)
    route = T.route_question("question") if routed else F.lit("explain")
    reply = F.concat(F.when(F.length("question") % 4 == 0, F.lit("Error: ")).otherwise(F.lit("")),
                     F.col("question"), F.lit(" !\n"))
    call = _recorded("answer_with_context" if routed else "answer", q,
                     *M.answer_prompts(route, F.lit(""), routed), reply)
    return M.answer(q, ["conv_id", "turn"], call, routed=routed)


@query("model_answer")
def q_model_answer(spark, sf):
    """Tutor chat (routed, with context): refusal without a call, or an answer."""
    return _answers(spark, sf, True).select("conv_id", "turn", "route", "answer", "ok", "error")


@query("model_answer_plain")
def q_model_answer_plain(spark, sf):
    return _answers(spark, sf, False).select("conv_id", "turn", "answer", "ok", "error")


@query("model_tips")
def q_model_tips(spark, sf):
    """A tip per line of the learning summary."""
    s = tutor_summaries(spark, sf)
    bullets = F.array_join(F.transform(F.split("summary", "\n"), lambda x: F.concat(F.lit(K.TIP_BULLET), x)), "\n")
    call = _recorded("tips", s, *M.prompts("tips", language=F.col("language"), summary=F.col("summary")), bullets)
    t = M.tips(s, call)
    return t.select("language", F.posexplode("tips").alias("pos", "tip"), "error") \
        .select("language", F.col("pos").cast("bigint").alias("pos"), "tip", "error")


@query("model_exercise")
def q_model_exercise(spark, sf):
    """Regenerate an exercise like each stored one (same language and type) from the summary."""
    req = A.parsed_exercises(_h(spark, sf)).select(
        "id", "language", F.col("exercise.type").alias("exercise_type"))
    req = A.attach_summary(req, tutor_summaries(spark, sf))
    kinds = written(req.select("language", "exercise_type", "summary").distinct(), "exercise-kinds")  # as in model_word
    body = F.to_json(F.struct(F.col("exercise_type").alias("type"), F.col("language").alias("title"),
                              F.col("summary").alias("question"), F.split("summary", "\n").alias("options")))
    call = _recorded("exercise", kinds, M.exercise_prompt(F.col("language"), F.col("summary"), F.col("exercise_type")),
                     F.lit(""), F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    e = M.exercises(req, "id", call)
    body = F.col("exercise.body")
    return e.select("id", "exercise_type", "error", body.type.alias("type"), body.title.alias("title"),
                    body.question.alias("question"), T.n_items(body.options).alias("n_options"))


@query("model_word")
def q_model_word(spark, sf):
    """Explain every distinct word of every document; words of a length divisible by 3 got no JSON.

    The distinct words are written once: both sides of the join need them, and the optimizer drops a
    ``distinct`` below the maximum per prompt, which then hashes a prompt for every word that occurs."""
    w = written(_docs_lang(spark, sf).select("language", F.explode(F.split("text", " ")).alias("word")).distinct(),
                "words")
    word = F.col("word")
    body = F.to_json(F.struct(word.alias("word"), F.concat(F.lit("pl:"), word).alias("translation"),
                              F.array(word, F.reverse(word)).alias("examples")))
    reply = F.when(F.length("word") % 3 == 0, F.concat(F.lit("Słowo: "), word)).otherwise(body)
    call = _recorded("explain_word", w, *M.prompts("explain_word", language=F.col("language"), word=word), reply)
    x = F.col("explanation")
    return M.explain_words(w, call).select("language", "word", x.translation.alias("translation"),
                                           T.n_items(x.examples).alias("n_examples"), "error")


@query("model_speech")
def q_model_speech(spark, sf):
    """The recorded sound of a text is its bytes, twice where the text's length is even."""
    d = _docs_lang(spark, sf)
    spoken = d.select(voice_for(F.col("language")).alias("voice"), T.tts_input("text").alias("u"))
    sound = F.encode(F.when(F.length("u") % 2 == 0, F.concat("u", "u")).otherwise(F.col("u")), "UTF-8")
    call = _recorded("speech", spoken, F.col("voice"), F.col("u"), sound)
    s = M.speech(d, "doc_id", "text", "language", call)
    return s.select("doc_id", "voice", F.octet_length("audio").cast("bigint").alias("n_bytes"), "error")


# --- uploads, ingest stamp, clear -----------------------------------------------------------------

@query("file_gate")
def q_file_gate(spark, sf):
    """Pages as uploads: extension of the address, size in MB, gate with a limit of 2 KB."""
    name = F.substring_index("url", "/", -1)
    pages = read_table(spark, sf, "pages").select(
        F.col("page_id"), F.col("url").alias("path"), name.alias("name"), T.file_extension(name).alias("ext"),
        F.octet_length("html").cast("bigint").alias("length"))
    return FS.gate(pages, max_mb=UPLOAD_LIMIT_MB, keep=["page_id"]).select(
        "page_id", "ext", FS.megabytes("length").alias("mb"), "ok", "reason")


@query("decode_txt")
def q_decode_txt(spark, sf):
    """Documents as uploaded bytes: UTF-8 as it is, or (odd ids) after a byte that makes it invalid, so
    that a single-byte encoding must read all of it."""
    utf8 = F.encode("text", "UTF-8")
    content = F.when(F.col("doc_id") % 2 == 0, utf8).otherwise(F.concat(F.unhex(F.lit("E6")), utf8))
    up = _docs(spark, sf).select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
                                 F.octet_length(content).cast("bigint").alias("length"), content.alias("content"))
    return FS.extract_txt(up)


@query("stamp_records")
def q_stamp_records(spark, sf):
    """New records for all documents: how many, how many ids, how many stamped within the hour."""
    s = H.stamp(_docs(spark, sf).select(F.col("text").alias("input_text")))
    now = TM.utc_now(spark.conf.get("spark.sql.session.timeZone"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"),
                 F.count_if(F.length("id") == 36).alias("uuids"),
                 F.count_if(F.abs(F.timestamp_diff("MINUTE", "ts", now)) <= 60).alias("recent"))


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/learnlog-streams/{name}-{uuid.uuid4().hex[:12]}"


def _event_records(spark, sf):
    """Events as history records, their kind by their type."""
    ev = read_table(spark, sf, "events")
    return ev.select("event_id", F.col("event_id").cast("string").alias("id"), "ts",
                     _case(F.col("event_type"), EVENT_MODE, F.lit("learning_tips")).alias("mode"),
                     F.col("user_id").cast("string").alias("language"))


@query("clear_items")
def q_clear_items(spark, sf):
    """Stored records before and after everything is removed."""
    store = S.HistoryStore(spark, _scratch(spark, "clear"))
    store.append(_h(spark, sf).select("id", "ts", "mode", "language"))
    before = store.read()
    store.clear_all()
    counted = lambda df, state: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(state).alias("state"), "n")
    return counted(before, "before").unionByName(counted(store.read(), "after"))


def edited_events(spark, sf, between=lambda store: None):
    """A store of events after two appends, an upsert that lets every tenth replace an earlier one (and
    maybe change its kind), and a delete of the ids that label toxic documents. ``between`` is
    called after each step."""
    rows = _event_records(spark, sf)
    store = S.HistoryStore(spark, _scratch(spark, "edits"))
    store.create_if_missing()
    for part in (rows.where("event_id % 10 < 5"), rows.where("event_id % 10 BETWEEN 5 AND 8")):
        store.append(part)
        between(store)
    store.upsert(rows.where("event_id % 10 = 9").withColumn("id", F.expr("CAST(event_id - event_id % 20 AS STRING)")))
    between(store)
    store.delete(read_table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("id")))
    between(store)
    return store


@query("edited_items")
def q_edited_items(spark, sf):
    """What the store holds after the edits."""
    return edited_events(spark, sf).read().select("id", "ts", "mode", "language")


@query("stream_edited_counts")
def q_stream_edited_counts(spark, sf):
    """The running counts after the edits, each of which a trigger has seen as changes."""
    from learnlog.streaming.counts import current_counts, run_language_counts
    base = _scratch(spark, "edited-counts")
    store = edited_events(spark, sf, lambda s: run_language_counts(s, f"{base}/out", f"{base}/checkpoint"))
    return current_counts(store, f"{base}/out")


# --- 8. freshness and streams -----------------------------------------------------------------

def _latest_with_ttl(spark, sf):
    ev = read_table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    latest = H.latest_per_key(ev, "user_id", "ts", "event_id", ["event_type"])
    ttl_map = F.create_map(*[F.lit(x) for kv in EVENT_TTL_KIND.items()
                             for x in (kv[0], K.TTL_BY_KIND[kv[1]])])
    as_of = ev.select(F.max("ts")).scalar()
    return latest.select("user_id", "event_id", "ts",
                         F.element_at(ttl_map, F.col("event_type")).alias("ttl"),
                         as_of.alias("as_of"))


@query("fresh_latest")
def q_fresh_latest(spark, sf):
    l = _latest_with_ttl(spark, sf)
    return l.select("user_id", "event_id", "ts", TM.expires_at("ts", "ttl").alias("expires_at"),
                    (~TM.is_expired("ts", "ttl", "as_of")).alias("active"))


@query("freshness_stats")
def q_freshness_stats(spark, sf):
    l = _latest_with_ttl(spark, sf)
    expired = TM.is_expired("ts", "ttl", "as_of")
    return l.agg(F.count(F.lit(1)).alias("total"), F.count_if(~expired).alias("active"),
                 F.count_if(expired).alias("expired"))


@query("cache_reads")
def q_cache_reads(spark, sf):
    """Views as reads of a user's cached value, all other events as writes of it: whether the newest
    earlier write was still alive (hit), had expired or was never made (miss)."""
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    ttl_map = F.create_map(*[F.lit(x) for kv in EVENT_TTL_KIND.items() for x in (kv[0], K.TTL_BY_KIND[kv[1]])])
    writes = ev.where("event_type <> 'view'").withColumn("ttl", F.element_at(ttl_map, F.col("event_type")))
    reads = ev.where("event_type = 'view'").select("event_id", "user_id", "ts")
    found = asof_join(reads, writes, "user_id", "ts", "event_id", bucket_seconds=6 * 3600)
    m = F.col("matched")
    return found.select(
        "event_id", "user_id", "ts", m["event_id"].alias("written_id"), m["ts"].alias("written_at"),
        F.when(m.isNull(), "miss").when(TM.is_expired(m["ts"], m["ttl"], F.col("ts")), "expired").otherwise("hit").alias("state"))


@query("stream_language_counts")
def q_stream_language_counts(spark, sf):
    from learnlog.streaming.counts import run_language_counts
    _rows(spark, sf)
    base = _scratch(spark, "language-counts")
    return run_language_counts(S.history_store(spark, sf), f"{base}/out", f"{base}/checkpoint")


@query("stream_chat_snapshots")
def q_stream_chat_snapshots(spark, sf):
    from learnlog.sources.tables import table_path
    from learnlog.streaming.chat import run_chat_snapshots
    path = table_path(sf, "conversations")
    schema = spark.read.parquet(path).schema
    base = _scratch(spark, "chat-snapshots")
    s = run_chat_snapshots(spark, path, schema, conversation_language(), f"{base}/out", f"{base}/checkpoint")
    return s.select("conv_id", "turn", "message_count", "chat_text")


# --- 9. vectors -------------------------------------------------------------------------------

@query("vector_topk")
def q_vector_topk(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    return V.topk(e, VECTOR_QUERY_ID, VECTOR_K)



@query("vector_neighbours")
def q_vector_neighbours(spark, sf):
    """Every row whose id is divisible by 50 against all rows, through the inverted file."""
    e = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    return N.search(N.build(e, k=VECTOR_K), e.where(F.col("vec_id") % VECTOR_QUERY_STEP == 0), VECTOR_K, exact=True)
