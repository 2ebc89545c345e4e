"""Schemas of the JSON bodies kept in history records, and their parse / serialise columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnlog import constants as K
from learnlog.functions.text import WS_CHARS

VOCABULARY_ITEM = ("struct<word:string,translation:string,part_of_speech:string,"
                   "example_sentence:string,difficulty_level:string>")
GRAMMAR_RULE = "struct<rule_name:string,explanation:string,examples:array<string>,difficulty_level:string>"
ANALYSIS_DDL = (f"vocabulary_items array<{VOCABULARY_ITEM}>, grammar_rules array<{GRAMMAR_RULE}>, "
                "learning_tips array<string>")
EXERCISE_DDL = ("type string, title string, description string, question string, "
                "correct_answer string, options array<string>, explanation string, "
                "grammar_rule string, key_vocabulary array<string>, difficulty string, "
                "hint string, timestamp string")
WORD_DDL = ("word string, translation string, part_of_speech string, definition string, "
            "examples array<string>, synonyms array<string>, antonyms array<string>")

_CORRUPT = "_corrupt_record"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


_OPTS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}


def _raw(x, ddl: str) -> Column:
    return F.from_json(_c(x), f"{ddl}, {_CORRUPT} string", _OPTS)


def _object_text(x) -> Column:
    """The (stripped) text is one JSON object: Spark's parser would accept trailing text
    after the closing brace, a strict parser does not."""
    t = F.trim(_c(x), F.lit(WS_CHARS))
    return t.startswith("{") & t.endswith("}")


def _whole_or_null(raw: Column, is_object: Column) -> Column:
    return F.when(raw.isNull() | raw.getField(_CORRUPT).isNotNull() | ~is_object, F.lit(None)) \
        .otherwise(raw.dropFields(_CORRUPT))


def strict_from_json(x, ddl: str) -> Column:
    """Whole value or null: ``from_json`` yields a struct of nulls for bad text, so the
    corrupt-record column is used to turn those into a real null. (Inside one expression
    the parse is evaluated twice; operators use ``with_json``, which parses once.)"""
    return _whole_or_null(_raw(x, ddl), _object_text(x))


def with_json(df: DataFrame, src: str, ddl: str, out: str) -> DataFrame:
    """Add ``out`` = strict parse of column ``src``; the text is parsed once."""
    raw = f"_{out}_raw"
    d = df.withColumn(raw, _raw(src, ddl))
    return d.withColumn(out, _whole_or_null(F.col(raw), _object_text(src))).drop(raw)


def with_body(df: DataFrame, src: str, out: str) -> DataFrame:
    """Add ``out`` = the whole body as VARIANT: keys that no schema lists are kept, nested values
    too. Text that is not one JSON object, or gives a key twice, is null."""
    return df.withColumn(out, F.when(_object_text(src), F.try_parse_json(_c(src))))


def body_field(body, path: str, kind: str) -> Column:
    """A field of a VARIANT body by path; null where it is missing or of another type."""
    return F.try_variant_get(_c(body), path, kind)


def body_text(body) -> Column:
    """The whole body as JSON text, keys in alphabetical order."""
    return F.to_json(_c(body))


def _analysis_defaults(p: Column) -> Column:
    empty = F.array()
    return F.when(p.isNull(), F.lit(None)).otherwise(F.struct(
        F.coalesce(p.vocabulary_items, empty.cast(f"array<{VOCABULARY_ITEM}>")).alias("vocabulary_items"),
        F.coalesce(p.grammar_rules, empty.cast(f"array<{GRAMMAR_RULE}>")).alias("grammar_rules"),
        F.coalesce(p.learning_tips, empty.cast("array<string>")).alias("learning_tips"),
    ))


def parse_analysis(x) -> Column:
    """Analysis JSON -> nested record; missing lists become empty lists; bad text -> null."""
    return _analysis_defaults(strict_from_json(x, ANALYSIS_DDL))


def with_analysis(df: DataFrame, src: str, out: str) -> DataFrame:
    d = with_json(df, src, ANALYSIS_DDL, f"_{out}_p")
    return d.withColumn(out, _analysis_defaults(F.col(f"_{out}_p"))).drop(f"_{out}_p")


def vocabulary_size(x) -> Column:
    """Vocabulary items of an analysis body; null where there is none or the text is not one."""
    items = parse_analysis(x).vocabulary_items
    return F.when(items.isNotNull(), F.size(items))


def parse_exercise(x) -> Column:
    return strict_from_json(x, EXERCISE_DDL)


def _word_default(word) -> Column:
    empty = F.array().cast("array<string>")
    default = F.struct(
        _c(word).alias("word"),
        F.lit(K.MSG_WORD_PARSE_ERROR).alias("translation"),
        F.lit("").alias("part_of_speech"),
        F.lit("").alias("definition"),
        empty.alias("examples"),
        empty.alias("synonyms"),
        empty.alias("antonyms"),
    )
    return default


def parse_word_reply(reply, word) -> Column:
    """Word explanation reply -> record; a reply that is not JSON gives the default record."""
    return F.coalesce(strict_from_json(reply, WORD_DDL), _word_default(word))


def with_word_reply(df: DataFrame, reply: str, word: str, out: str) -> DataFrame:
    d = with_json(df, reply, WORD_DDL, f"_{out}_p")
    return d.withColumn(out, F.coalesce(F.col(f"_{out}_p"), _word_default(word))).drop(f"_{out}_p")
