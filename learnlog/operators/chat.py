"""Chat analytics: transcripts, cumulative session snapshots, transcript parsing, routing.

Conversation-keyed work is partitioned by ``conv_id``; a transcript is one value per
conversation by definition, so a conversation's lines meet in one task (bounded by the
conversation, not by the table). Everything else is row-wise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from learnlog import constants as K
from learnlog.functions import text as T

USER_PREFIX = "user:"
ASSISTANT_PREFIX = "assistant:"
# FIXED VALUES (test data): question prefixes that make user turns reach each route
QUESTION_PREFIXES = ["", "grammar ", "practice ", "explain "]


def line_of(role, text):
    return F.concat(F.col(role) if isinstance(role, str) else role, F.lit(": "),
                    F.col(text) if isinstance(text, str) else text)


def messages(conversations: DataFrame, language) -> DataFrame:
    return conversations.select("conv_id", "turn", "role", "text", language.alias("language"))


def transcript(msgs: DataFrame) -> DataFrame:
    """One record per conversation: ``role: content`` lines in turn order + message count."""
    agg = msgs.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", line_of("role", "text").alias("line")))).alias("_l"),
        F.count(F.lit(1)).alias("message_count"))
    return agg.select("conv_id", F.array_join(F.transform("_l", lambda s: s.line), "\n").alias("chat_text"),
                      "message_count")


def snapshots(msgs: DataFrame, last_only: bool = False) -> DataFrame:
    """After every assistant answer the whole conversation so far is saved as a session
    record (only when it holds at least two messages). The prefix text grows with the
    conversation (quadratic in its length); ``last_only`` keeps just the final snapshot."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = msgs.select(
        "conv_id", "turn", "role", "language",
        F.count(F.lit(1)).over(run).alias("message_count"),
        F.array_join(F.collect_list(line_of("role", "text")).over(run), "\n").alias("chat_text"))
    s = s.where((F.col("role") == "assistant") & (F.col("message_count") >= 2))
    if last_only:
        lw = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
        s = s.withColumn("_rn", F.row_number().over(lw)).where("_rn = 1").drop("_rn")
    return s.select("conv_id", "turn", "language", "message_count", "chat_text")


def snapshot_points(msgs: DataFrame) -> DataFrame:
    """The snapshots without their texts: ``chat_chars`` is how much of the conversation's ``transcript`` is
    the text of a snapshot. Messages of one turn stand in the transcript's order."""
    line = line_of("role", "text")
    run = Window.partitionBy("conv_id").orderBy("turn", line).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = msgs.select(
        "conv_id", "turn", "role", "language",
        F.count(F.lit(1)).over(run).alias("message_count"),
        F.greatest(F.coalesce(F.sum(F.length(line)).over(run), F.lit(0)) + F.count(line).over(run) - 1, F.lit(0))
        .cast("int").alias("chat_chars"))
    return s.where((F.col("role") == "assistant") & (F.col("message_count") >= 2)).drop("role")


# FIXED VALUE (test data): conversations carry no time, so a session is saved this long after
# the turns began, plus a second per turn
SESSION_EPOCH = "2024-01-01 00:00:00"


def session_records(snaps: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Snapshots as chat-session history records, ready to be stored; the time is derived from
    the turn unless the snapshots carry a ``ts``. ``keep``: columns to take instead of the text."""
    saved = (F.col("ts") if "ts" in snaps.columns else
             F.expr(f"timestamp_ntz'{SESSION_EPOCH}' + make_dt_interval(0, 0, 0, turn)"))
    return snaps.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        saved.cast("timestamp_ntz").alias("ts"), F.lit("chat_session").alias("mode"), "language",
        F.lit(None).cast("string").alias("context"), *(["chat_text"] if keep is None else keep),
        F.col("message_count").cast("int").alias("message_count"))


def parse_transcript(sessions: DataFrame, key: str = "conv_id") -> DataFrame:
    """Transcript text back to messages: lines that start with ``user:`` / ``assistant:``
    (tested on the unstripped line) become messages with the rest, stripped, as content;
    blank lines, continuation lines and other roles are dropped."""
    lines = sessions.select(key, F.posexplode(F.split("chat_text", "\n")).alias("line", "raw"))
    raw = F.col("raw")
    role = (F.when(raw.startswith(USER_PREFIX), F.lit("user"))
            .when(raw.startswith(ASSISTANT_PREFIX), F.lit("assistant")))
    content = (F.when(raw.startswith(USER_PREFIX), T.py_strip(F.substring(raw, len(USER_PREFIX) + 1, 1 << 30)))
               .otherwise(T.py_strip(F.substring(raw, len(ASSISTANT_PREFIX) + 1, 1 << 30))))
    return (lines.where((T.py_strip(raw) != "") & role.isNotNull())
            .select(key, "line", role.alias("role"), content.alias("content")))


def user_questions(msgs: DataFrame) -> DataFrame:
    """User turns as tutor questions (fixture: a topic word is put in front by conversation)."""
    prefix = F.element_at(F.array(*[F.lit(p) for p in QUESTION_PREFIXES]),
                          (F.col("conv_id") % len(QUESTION_PREFIXES) + 1).cast("int"))
    return msgs.where(F.col("role") == "user").select(
        "conv_id", "turn", "language", F.concat(prefix, F.col("text")).alias("question"))


def route_questions(questions: DataFrame) -> DataFrame:
    return questions.select("conv_id", "turn", T.route_question("question").alias("route"))


def chat_context(info) -> F.Column:
    """Context passed to the tutor: ``KONTEKST: <info>`` + blank line, or empty."""
    c = F.col(info) if isinstance(info, str) else info
    return F.when(F.length(c) > 0, F.concat(F.lit(K.CHAT_CONTEXT_PREFIX), c, F.lit("\n\n"))) \
        .otherwise(F.lit(""))
