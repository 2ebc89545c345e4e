"""History analytics: unpack analysis / exercise JSON, per-language summaries, lookups.

Aggregations are keyed by ``language`` (a handful of values, so heavily skewed); they are
written as partial + final aggregates (counts, sums, max-of-struct) or as per-group top-N
(WindowGroupLimit keeps N rows per group inside each task before the shuffle), so no task
ever gathers all rows of a language.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learnlog import constants as K
from learnlog.functions import json as J
from learnlog.functions import text as T
from learnlog.operators.joins import join_lookup, lookup_table

#: Puts their bodies to a bounded number of records (``store.history_bodies``).
Bodies = Callable[[DataFrame], DataFrame]


def newest_first():
    return [F.col("ts").desc(), F.col("id").asc()]


def parsed_analyses(history: DataFrame) -> DataFrame:
    a = history.where(F.col("mode") == "analysis").select("id", "ts", "language", "analysis_data")
    return J.with_analysis(a, "analysis_data", "analysis").drop("analysis_data")


def parsed_exercises(history: DataFrame) -> DataFrame:
    e = history.where(F.col("mode") == "exercise").select("id", "ts", "language", "exercise_data")
    return J.with_json(e, "exercise_data", J.EXERCISE_DDL, "exercise").drop("exercise_data")


def _exploded(df: DataFrame, keep: list[str], items: str, pos: str, item: str) -> DataFrame:
    """posexplode of an array. The outer form with a filter on the position keeps Catalyst from
    testing the array's size first, which would evaluate the array (and its parse) again."""
    return df.select(*keep, F.posexplode_outer(items).alias(pos, item)).where(F.col(pos).isNotNull())


def _vocabulary_of(analyses: DataFrame) -> DataFrame:
    v = _exploded(analyses, ["id", "ts", "language"], "analysis.vocabulary_items", "pos", "v")
    return v.select("id", "ts", "language", "pos",
                    F.col("v.word").alias("word"),
                    F.col("v.translation").alias("translation"),
                    F.col("v.part_of_speech").alias("part_of_speech"),
                    F.col("v.difficulty_level").alias("difficulty"))


def vocabulary(history: DataFrame) -> DataFrame:
    """One row per vocabulary item: word, translation, part of speech, difficulty."""
    return _vocabulary_of(parsed_analyses(history))


def _sized(history: DataFrame) -> DataFrame:
    """History with ``n_vocabulary``: stored with the record, else read from its body."""
    return history if "n_vocabulary" in history.columns else history.withColumn(
        "n_vocabulary", F.when(F.col("mode") == "analysis", J.vocabulary_size("analysis_data")))


def vocabulary_counts(history: DataFrame) -> DataFrame:
    """Number of vocabulary items per language (before any display cap), from the stored sizes."""
    return (_sized(history).where(F.col("mode") == "analysis").groupBy("language")
            .agg(F.coalesce(F.sum("n_vocabulary"), F.lit(0)).cast("bigint").alias("n")))


def vocabulary_top(history: DataFrame, n: int = K.SUMMARY_VOCABULARY_ITEMS, bodies: Bodies | None = None) -> DataFrame:
    """First ``n`` vocabulary items per language: newest analysis first, then list order.

    The ``n`` newest analyses that have an item hold at least ``n`` items, so only their bodies
    are parsed (a WindowGroupLimit on each task before the shuffle). ``bodies`` fetches these for
    records that refer to their texts."""
    w = Window.partitionBy("language").orderBy(*newest_first())
    newest = _sized(history).where((F.col("mode") == "analysis") & (F.col("n_vocabulary") > 0))
    if bodies is None:
        newest = newest.select("id", "ts", "language", "analysis_data")
    newest = newest.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n).drop("_nth")
    if bodies is not None:
        newest = bodies(newest).select("id", "ts", "language", "analysis_data")
    v = _vocabulary_of(J.with_analysis(newest, "analysis_data", "analysis"))
    w = Window.partitionBy("language").orderBy(F.col("ts").desc(), F.col("id").asc(), F.col("pos").asc())
    return v.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def grammar_rules(history: DataFrame) -> DataFrame:
    r = _exploded(parsed_analyses(history), ["id"], "analysis.grammar_rules", "rule_pos", "r")
    r = r.select("id", "rule_pos", F.col("r.rule_name").alias("rule"), F.col("r.examples").alias("examples"))
    return _exploded(r, ["id", "rule_pos", "rule"], "examples", "example_pos", "example")


def analysis_digest(history: DataFrame) -> DataFrame:
    """Display heads: 3 words, 2 rules, 2 examples of the first rule (latest view) or 3
    (archive view), 3 tips — joined as text."""
    a = parsed_analyses(history)
    an = F.col("analysis")
    first_rule_examples = F.coalesce(F.try_element_at(an.grammar_rules, F.lit(1)).examples,
                                     F.array().cast("array<string>"))
    return a.select(
        "id",
        F.array_join(F.transform(F.slice(an.vocabulary_items, 1, 3), lambda v: v.word), "|")
        .alias("vocab_head"),
        F.array_join(F.transform(F.slice(an.grammar_rules, 1, 2), lambda r: r.rule_name), "|")
        .alias("rules_head"),
        F.array_join(F.slice(first_rule_examples, 1, 2), "|").alias("examples_latest"),
        F.array_join(F.slice(first_rule_examples, 1, 3), "|").alias("examples_archive"),
        F.array_join(F.slice(an.learning_tips, 1, 3), "|").alias("tips_head"),
    )


def exercise_options(history: DataFrame) -> DataFrame:
    """Numbered options, only for vocabulary exercises that carry options."""
    e = parsed_exercises(history)
    ex = F.col("exercise")
    numbered = F.transform(ex.options, lambda o, i: F.concat((i + 1).cast("string"), F.lit(". "), o))
    return e.select("id", F.when((ex.type == "vocabulary") & ex.options.isNotNull(),
                                 F.array_join(numbered, "\n")).alias("options_text"))


def exercise_context(history: DataFrame) -> DataFrame:
    """Chat context texts from an exercise: title (default) - question - answer, once with the
    prefix of the latest exercise and once with that of an archived one."""
    e = parsed_exercises(history)
    ex = F.col("exercise")
    rest = F.concat(F.coalesce(ex.title, F.lit(K.DEFAULT_EXERCISE_TITLE)),
                    F.lit(" - "), F.coalesce(ex.question, F.lit("")),
                    F.lit(" - Odpowiedź: "), F.coalesce(ex.correct_answer, F.lit("")))
    both = F.array(*[F.struct(F.lit(archive).alias("archive"), F.concat(F.lit(prefix), rest).alias("context"))
                     for archive, prefix in ((False, K.EXERCISE_CONTEXT_PREFIX_LATEST),
                                             (True, K.EXERCISE_CONTEXT_PREFIX_ARCHIVE))])
    return e.select("id", F.explode(both).alias("c")).select("id", "c.*")


def tips_context_text(tips, fresh: bool = True):
    """Chat context from tips: fresh tips (an array) joined by a space, archived tips (a text) as
    they are."""
    return F.concat(F.lit(K.TIPS_CONTEXT_PREFIX), F.array_join(tips, " ") if fresh else tips)


def language_summary(history: DataFrame) -> DataFrame:
    """Per-language counts of translations, corrections and analyses (exercises not counted)."""
    m = F.col("mode")
    return (history.where(m.isin("translation", "correction", "analysis"))
            .groupBy("language").agg(
                F.count_if(m == "translation").alias("translations"),
                F.count_if(m == "correction").alias("corrections"),
                F.count_if(m == "analysis").alias("analyses")))


def summary_full_outer(history: DataFrame) -> DataFrame:
    """The same counts as two sides (translations; the correction list) joined full outer."""
    m = F.col("mode")
    t = (history.where(m == "translation").groupBy("language")
         .agg(F.count(F.lit(1)).alias("translations")))
    c = (history.where(m.isin(*K.CORRECTION_LIST_MODES)).groupBy("language")
         .agg(F.count_if(m == "correction").alias("corrections"),
              F.count_if(m == "analysis").alias("analyses")))
    j = t.join(c, "language", "full_outer")
    return j.select("language",
                    F.coalesce("translations", F.lit(0)).alias("translations"),
                    F.coalesce("corrections", F.lit(0)).alias("corrections"),
                    F.coalesce("analyses", F.lit(0)).alias("analyses"))


def recent_errors(history: DataFrame, n: int = K.SUMMARY_ERRORS) -> DataFrame:
    """Newest ``n`` non-empty correction explanations per language, as 100-char snippets."""
    c = history.where((F.col("mode") == "correction") & (F.length("explanation") > 0))
    w = Window.partitionBy("language").orderBy(*newest_first())
    return (c.select("language", "id", "ts", "explanation")
            .withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
            .select("language", "rn", T.error_snippet("explanation").alias("snippet")))


def summary_text(history: DataFrame, bodies: Bodies | None = None) -> DataFrame:
    """Learning-history summary document per language: counts, vocabulary count, the first
    20 words, the newest 5 errors (white space between the parts is normalised).

    The counts (one row per language), the words and the errors (20 and 5 rows per language at
    most, because the top-N runs first) are put into one table and aggregated once."""
    line = "struct<rn:int,line:string>"
    counts = summary_counts(history).withColumns({k: F.lit(None).cast(line) for k in ("word", "error")})
    words = vocabulary_top(history, bodies=bodies).select("language", F.struct("rn", word_line().alias("line")).alias("word"))
    errors = recent_errors(history).select(
        "language", F.struct("rn", F.concat(F.lit("- "), "snippet").alias("line")).alias("error"))
    return summary_document(counts.unionByName(words, allowMissingColumns=True)
                            .unionByName(errors, allowMissingColumns=True))


def summary_counts(history: DataFrame) -> DataFrame:
    """Per language: translations, corrections, analyses, and n, the vocabulary items of the latter."""
    m = F.col("mode")
    return (_sized(history).where(m.isin("translation", "correction", "analysis")).groupBy("language").agg(
        F.count_if(m == "translation").alias("translations"), F.count_if(m == "correction").alias("corrections"),
        F.count_if(m == "analysis").alias("analyses"), F.sum("n_vocabulary").cast("bigint").alias("n")))


def word_line() -> Column:
    """A vocabulary item as a line of the summary."""
    return F.concat(F.lit("- "), F.coalesce("word", F.lit("")), F.lit(" ("), F.coalesce("translation", F.lit("")),
                    F.lit(") - "), F.coalesce("part_of_speech", F.lit("")), F.lit(K.SUMMARY_LEVEL),
                    F.coalesce("difficulty", F.lit("")))


def summary_document(facts: DataFrame) -> DataFrame:
    """(language, summary) of rows that hold a language's totals, or a ``word`` or ``error`` (rn, line)."""
    totals = ["translations", "corrections", "analyses", "n"]
    j = facts.groupBy("language").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("string").alias(c) for c in totals],
        F.array_sort(F.collect_list("word")).alias("words"), F.array_sort(F.collect_list("error")).alias("errors"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["line"]), "\n")
    summary = F.concat(
        F.lit(K.SUMMARY_HEADER), F.upper("language"), F.lit(":\n"),
        F.lit(K.SUMMARY_TRANSLATIONS), "translations", F.lit("\n"),
        F.lit(K.SUMMARY_CORRECTIONS), "corrections", F.lit("\n"),
        F.lit(K.SUMMARY_ANALYSES), "analyses", F.lit("\n"),
        F.lit(K.SUMMARY_WORDS + "("), "n", F.lit("):\n"), joined("words"), F.lit("\n"),
        F.lit(K.SUMMARY_ERRORS_HEADER + "\n"), joined("errors"))
    return j.select("language", summary.alias("summary"))


# --- lookups ---------------------------------------------------------------------------------

def voice_table(spark: SparkSession) -> DataFrame:
    return lookup_table(spark, list(K.LANGUAGE_VOICE_MAPPING.items()), "language string, voice string")


def voice_catalogue(spark: SparkSession) -> DataFrame:
    return lookup_table(spark, K.AVAILABLE_VOICES, "voice string, voice_label string")


def voice_lookup(df: DataFrame) -> DataFrame:
    """Voice per row's language (default ``alloy``) and its catalogue label; both tables are
    constants, so broadcasting them is safe."""
    spark = df.sparkSession
    v = join_lookup(df, voice_table(spark), "language", "left")
    v = v.withColumn("voice", F.coalesce("voice", F.lit(K.DEFAULT_VOICE)))
    return join_lookup(v, voice_catalogue(spark), "voice", "inner")


def language_of_label(label) -> F.Column:
    """Flagged display name (as picked in the language selector) -> language name."""
    m = F.create_map(*[F.lit(x) for kv in K.FLAGGED_LANGUAGE_NAMES.items() for x in kv])
    return F.element_at(m, F.col(label) if isinstance(label, str) else label)


def label_lookup(exercises: DataFrame) -> DataFrame:
    """Exercise type -> label; language -> its flagged display name and back (literal maps)."""
    type_map = F.create_map(*[F.lit(x) for kv in K.EXERCISE_TYPE_LABELS.items() for x in kv])
    flag_map = F.create_map(*[F.lit(x) for kv in K.FLAGGED_LANGUAGE_NAMES.items() for x in kv[::-1]])
    labelled = exercises.select(
        "id",
        F.col("exercise.type").alias("exercise_type"),
        F.element_at(type_map, F.col("exercise.type")).alias("type_label"),
        F.element_at(flag_map, F.col("language")).alias("language_label"))
    return labelled.withColumn("language_back", language_of_label("language_label"))


def attach_summary(questions: DataFrame, summaries: DataFrame) -> DataFrame:
    """Left join of the per-language summary to each question. The summary has one row per
    language but is derived from the whole history, so it is not counted up front (that
    would compute it twice): AQE materialises it as a query stage, measures it and turns
    the join into a broadcast join when it is small, a shuffle join otherwise."""
    return questions.join(summaries, "language", "left")
