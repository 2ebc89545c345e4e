"""History reads and edits as DataFrame operators.

Every read is filter (pushed to the scan / partition-pruned on ``mode``) -> projection ->
ordered top-N. Top-N is ``orderBy(...).limit(n)`` which plans as TakeOrderedAndProject: each
task keeps n rows, so nothing unbounded reaches one task or the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from learnlog import constants as K
from learnlog.functions import json as J
from learnlog.functions import text as T
from learnlog.functions import time as TM
from learnlog.operators.ranking import position_in_group


def newest_first():
    return [F.col("ts").desc(), F.col("id").asc()]


def page(df: DataFrame, limit: int | None) -> DataFrame:
    """Newest first (ties by id), the first ``limit`` rows; 0/None keeps all.

    The time of the last row that fits is found on ``ts`` alone; as a scalar it then filters the
    scan, so that texts are only read where a row group can hold such rows (files sorted by
    ``ts``), and each task keeps ``limit`` rows."""
    ordered = df.orderBy(*newest_first())
    if not limit:
        return ordered
    oldest = F.lit("0001-01-01").cast("timestamp_ntz")
    cut = df.select("ts").orderBy(F.col("ts").desc()).limit(limit).agg(
        F.coalesce(F.when(F.count("ts") == limit, F.min("ts").cast("timestamp_ntz")), oldest)).scalar()
    return df.where((F.col("ts") >= cut) | F.col("ts").isNull()).orderBy(*newest_first()).limit(limit)


def scan(history: DataFrame) -> DataFrame:
    """Payload-only scan: the placeholder vector is never read (column pruning)."""
    return history.select("id", "ts", "mode", "language")


def get_translations(history: DataFrame, limit: int | None = K.TRANSLATIONS_PAGE) -> DataFrame:
    rows = history.where(F.col("mode") == "translation").select(
        "id", "ts",
        F.col("input_text").alias("input"),
        F.col("output_text").alias("output"),
        F.col("language").alias("target_language"),
        F.lit("translation").alias("mode"),
        F.when(F.col("has_audio"), F.unbase64("audio_data")).alias("audio_data"),
        "voice",
    )
    return page(rows, limit)


def get_corrections(history: DataFrame, limit: int | None = K.CORRECTIONS_PAGE) -> DataFrame:
    """Corrections, analyses and exercises; mode-specific fields are null for other kinds."""
    mode = F.col("mode")
    rows = history.where(mode.isin(*K.CORRECTION_LIST_MODES)).select(
        "id", "ts",
        F.col("input_text").alias("input"),
        F.col("output_text").alias("output"),
        "language", "mode",
        F.when(mode == "correction", F.col("explanation")).alias("explanation"),
        F.when(mode == "analysis", F.col("analysis_data")).alias("analysis_data"),
        F.when(mode == "exercise", F.col("exercise_data")).alias("exercise_data"),
    )
    # One projection over the ordered page keeps the plan a TakeOrderedAndProject (each task
    # keeps `limit` rows); the JSON bodies are then parsed for the page rows only.
    top = page(rows, limit)
    return top.select("id", "ts", "input", "output", "language", "mode", "explanation",
                      J.parse_analysis("analysis_data").alias("analysis"),
                      J.parse_exercise("exercise_data").alias("exercise"))


def get_tips_history(history: DataFrame, limit: int | None = K.TIPS_PAGE) -> DataFrame:
    rows = history.where(F.col("mode") == "learning_tips").select(
        "id", "ts", "language", "tips_text", F.col("tips_count").cast("bigint").alias("tips_count"),
        F.lit("learning_tips").alias("mode"))
    return page(rows, limit)


def get_chat_sessions(history: DataFrame, limit: int | None = K.CHAT_PAGE) -> DataFrame:
    """Chat-session records, ``context`` defaulting to ``""``."""
    rows = history.where(F.col("mode") == "chat_session").select(
        "id", "ts", "language", F.coalesce("context", F.lit("")).alias("context"), "chat_text",
        F.col("message_count").cast("bigint").alias("message_count"), "mode")
    return page(rows, limit)


def archive_by_mode(history: DataFrame, mode: str | None = None) -> DataFrame:
    """Sub-kind filter over the correction list (exercise / correction / analysis archives)."""
    rows = history.where(F.col("mode").isin(*K.CORRECTION_LIST_MODES))
    if mode:
        rows = rows.where(F.col("mode") == mode)
    return rows.select("mode", "id", F.col("input_text").alias("input"))


def history_by_language(history: DataFrame, language: str) -> DataFrame:
    """Language filter on the unified ``language`` field (target language of translations,
    language of the other kinds)."""
    return history.where(F.col("language") == language).select("language", "mode", "id")


def history_ordinal(history: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Display numbers: translations count oldest = 1; corrections and analyses count
    newest = 1 (oldest = N). Computed without a single-task window per kind."""
    rows = history.where(F.col("mode").isin("translation", "correction", "analysis")) \
        .select("mode", "ts", "id")
    pos = position_in_group(rows, "mode", ["ts", "id"], out="_asc", total="_n",
                            num_partitions=num_partitions, max_groups=len(K.MODES))
    return pos.select(
        "mode", "id",
        F.when(F.col("mode") == "translation", F.col("_asc"))
        .otherwise(F.col("_n") - F.col("_asc") + 1).alias("ordinal"))


def kind_group():
    return (F.when(F.col("mode") == "translation", F.lit("translations"))
            .when(F.col("mode").isin(*K.CORRECTION_LIST_MODES), F.lit("corrections"))
            .when(F.col("mode") == "learning_tips", F.lit("tips"))
            .when(F.col("mode") == "chat_session", F.lit("chat_sessions")))


def history_dashboard(history: DataFrame, limit: int = K.DEFAULT_HISTORY_LIMIT) -> DataFrame:
    """The four lists of the main screen in one pass: newest ``limit`` per kind group.

    ``row_number() <= limit`` over a group plans as WindowGroupLimit, which keeps ``limit``
    rows per group inside each task before the shuffle, so a huge group stays cheap."""
    w = Window.partitionBy("kind_group").orderBy(*newest_first())
    return (history.select(kind_group().alias("kind_group"), "id", "ts")
            .withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)
            .select("kind_group", "id", "rn"))


def history_stats(history: DataFrame) -> DataFrame:
    return history.agg(F.count(F.lit(1)).alias("total_points"))


def history_union(history: DataFrame) -> DataFrame:
    """The kinds as tables of their own fields in one table (missing fields null), counted per kind."""
    # the length of a session's text, stored with the record or else of its text
    history = history if "chat_chars" in history.columns else history.withColumn("chat_chars", F.length("chat_text"))
    fields = {"chat_session": "chat_chars", "learning_tips": "tips_text"}
    parts = [history.where(F.col("mode") == kind).select("id", "mode", fields.get(kind, "input_text"))
             for kind in K.MODES]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return u.groupBy("mode").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(F.length("input_text"), "chat_chars", F.length("tips_text")) > 0).alias("n_with_text"))


# --- record builders (the append path) -------------------------------------------------------

def stamp(records: DataFrame) -> DataFrame:
    """Give new records their identity at ingest: a random UUID string id and the UTC time, each
    unless the record has one. (Spark's ``uuid()`` is seeded per partition, so a retried task
    produces the same ids.)"""
    tz = records.sparkSession.conf.get("spark.sql.session.timeZone", "UTC")
    new = {"id": F.expr("uuid()"), "ts": TM.utc_now(tz)}
    return records.withColumns({n: F.coalesce(F.col(n).cast("string" if n == "id" else "timestamp_ntz"), c)
                                if n in records.columns else c for n, c in new.items()})


def translation_records(df: DataFrame, audio: str | None = None) -> DataFrame:
    """Translation payload: input, output, target language, voice, audio flag + base64 audio.

    ``has_audio`` is true only for non-empty audio (an empty byte string stores nothing)."""
    audio_col = F.col(audio) if audio else F.lit(None).cast("binary")
    return df.select(
        "input_text", "output_text",
        F.col("language").alias("target_language"),
        F.lit("translation").alias("mode"),
        "voice",
        F.coalesce(F.octet_length(audio_col) > 0, F.lit(False)).alias("has_audio"),
        F.when(F.octet_length(audio_col) > 0, T.b64(audio_col)).alias("audio_data"),
    )


def correction_records(df: DataFrame) -> DataFrame:
    """Correction / analysis / exercise payload: explanation only for corrections, JSON body
    only for analyses / exercises (null when there is none)."""
    mode = F.col("mode")
    return df.select(
        "input_text", "output_text", "language", "mode",
        F.when(mode == "correction", F.col("explanation")).alias("explanation"),
        F.when(mode == "analysis", F.col("analysis_data")).alias("analysis_data"),
        F.when(mode == "exercise", F.col("exercise_data")).alias("exercise_data"),
    )


def tips_records(df: DataFrame, tips_col: str = "tips") -> DataFrame:
    return df.select(
        *[c for c in ("id", "ts") if c in df.columns], "language",
        F.array_join(tips_col, "\n").alias("tips_text"),
        T.n_items(tips_col).alias("tips_count"),
        F.lit("learning_tips").alias("mode"))


def latest_per_key(df: DataFrame, key: str, ts: str, tie: str, cols: list[str]) -> DataFrame:
    """Last write wins per key (ties by ``tie``), as a partial+final aggregate: the max of a
    struct is combined map-side, so a hot key never gathers its rows in one task."""
    best = F.max(F.struct(F.col(ts), F.col(tie), *[F.col(c) for c in cols])).alias("_best")
    return df.groupBy(key).agg(best).select(key, "_best.*")


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Incoming records replace the existing ones of the same key, whatever their times; columns
    that incoming lacks are null."""
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def delete_items(history: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Bulk delete: anti join against a DataFrame of ids (shuffle join unless ids is small)."""
    return history.join(ids.select(key), key, "left_anti")


def clear_all(history: DataFrame) -> DataFrame:
    """Same schema, no rows."""
    return history.limit(0)
