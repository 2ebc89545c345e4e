"""Chat formatting: a finite-state machine over the roles, text segments with loss flags from a
declarative template, and the way back from the formatted text. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlog.sources.tables import read_table


@dataclass(frozen=True)
class Template:
    """How a turn is written: ``open`` role ``says`` text ``close``.

    ``reserved``: further strings that must not appear raw inside a text, such as the control
    strings of other chat formats. ``trained``: roles whose text is under the loss mask.
    ``follows``: for each state (the role just spoken; "" before the first turn) the roles that
    may speak next. ``final``: roles a conversation may end with."""

    open: str = "<|im_start|>"
    says: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
    trained: tuple[str, ...] = ("assistant",)
    follows: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("", ("system", "user")), ("system", ("user",)), ("user", ("assistant",)), ("assistant", ("user",)))
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for c in self.controls:
            if len(c) < 2 or "\\" in c or c[0] in c[1:]:
                raise ValueError(f"a control string has two characters or more, no backslash, and "
                                 f"its first character once: {c!r}")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.says, self.close, *self.reserved)


CHAT = Template()


def escape(text: Column, template: Template = CHAT) -> Column:
    """Double every backslash, then put one after the first character of every control string.
    Afterwards a lone backslash stands only inside a broken control string."""
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}")), template.controls,
                  F.replace(text, F.lit("\\"), F.lit("\\\\")))


def unescape(text: Column, template: Template = CHAT) -> Column:
    """The inverse of ``escape``."""
    return F.replace(reduce(lambda c, s: F.replace(c, F.lit(f"{s[0]}\\{s[1:]}"), F.lit(s)),
                            template.controls, text), F.lit("\\\\"), F.lit("\\"))


def format_conversations(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text).

    Columns: conv_id; formatted, the whole text; segments, an array of (text, loss) whose texts
    joined give ``formatted``; valid, whether the roles follow the template's state machine and
    end in a final one; bad_turn, the 0-based position of the first turn out of order (null if
    none). Turns out of order are formatted all the same. Null role or text counts as empty, a
    null turn comes first, equal turn numbers are ordered by role and text, repeated rows are
    turns of their own, rows with null conv_id form one conversation; other columns are ignored;
    an empty table gives no rows. A conversation is one value, so its turns meet in one task;
    texts are escaped before that, row by row."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.select(
        "conv_id", F.struct(
            F.col("turn").alias("turn"), role.alias("role"), escape(text, template).alias("body"),
            F.concat(F.lit(template.open), escape(role, template), F.lit(template.says)).alias("head"),
            role.isin(*template.trained).alias("loss")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    steps = F.array(*[F.lit(f"{state}>{role_}") for state, roles in template.follows for role_ in roles])
    # state: the last role, the position, the first position out of order
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad"))
    walk = F.aggregate("turns", start, lambda s, t: F.struct(
        t["role"].alias("state"), (s["at"] + 1).alias("at"),
        F.when((s["bad"] < 0) & ~F.array_contains(steps, F.concat(s["state"], F.lit(">"), t["role"])), s["at"])
        .otherwise(s["bad"]).alias("bad")))
    segment = lambda c, loss: F.struct(c.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        segment(t["head"], no), segment(t["body"], t["loss"]), segment(F.lit(template.close), no))))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(template.close))), "")
    return (grouped.select("conv_id", formatted.alias("formatted"), segments.alias("segments"), walk.alias("w"))
            .select("conv_id", "formatted", "segments",
                    ((F.col("w.bad") < 0) & F.col("w.state").isin(*template.final)).alias("valid"),
                    F.when(F.col("w.bad") >= 0, F.col("w.bad")).alias("bad_turn")))


def segment_rows(formatted: DataFrame) -> DataFrame:
    """The segments as rows (conv_id, segment, text, loss), in order."""
    return formatted.select("conv_id", F.posexplode("segments").alias("segment", "s")).select(
        "conv_id", "segment", "s.text", "s.loss")


def read_back(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """What the output of ``format_conversations`` says: conv_id, n_turns, turns_text (role,
    newline, text, newline per turn), loss_text (the texts under the loss mask, joined)."""
    f = F.col("formatted")
    opened = F.length(f) - F.length(F.replace(f, F.lit(template.open), F.lit("")))
    plain = F.replace(F.replace(F.replace(f, F.lit(template.open), F.lit("")), F.lit(template.says), F.lit("\n")),
                      F.lit(template.close), F.lit("\n"))
    masked = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")
    return formatted.select(
        "conv_id", "formatted", "valid", "bad_turn",
        (opened / len(template.open)).cast("long").alias("n_turns"),
        unescape(plain, template).alias("turns_text"), unescape(masked, template).alias("loss_text"))


_PLANTED = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings, formatted and read back."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_PLANTED).alias("text"))
    back = read_back(format_conversations(turns.unionByName(extra)))
    return back.select(
        "conv_id", "n_turns", F.sha2("turns_text", 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid", "bad_turn")


def _escaped_sql(col: str) -> str:
    out = f"replace({col}, '\\', '\\\\')"
    for s in CHAT.controls:
        out = f"replace({out}, '{s}', '{s[0]}\\{s[1:]}')"
    return out


_ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{_PLANTED}'),
s AS (
  SELECT *, row_number() OVER w - 1 AS pos, coalesce(lag(role) OVER w, '') AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS is_last
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
j AS (
  SELECT *, (before || '>' || role) IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') AS ok
  FROM s)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({sum(len(x) for x in (CHAT.open, CHAT.says, CHAT.close))} + length({_escaped_sql('role')})
    + length({_escaped_sql('text')}))::BIGINT AS formatted_chars,
  bool_and(ok) AND bool_or(is_last AND role = 'assistant') AS valid,
  CAST(min(pos) FILTER (WHERE NOT ok) AS INTEGER) AS bad_turn
FROM j GROUP BY conv_id"""

QUERIES = {"op4_chat_format": op4_chat_format}
ORACLE = {"op4_chat_format": _ORACLE}
