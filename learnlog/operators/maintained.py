"""The per-language learning summary, kept up to date as the history changes.

The state is small and mergeable: per language the counts, the first 20 words and the newest 5
errors, each with what orders it. An append is merged from its own records; languages of which an
edit removed or replaced records are computed anew, the others are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from learnlog import constants as K
from learnlog.functions import text as T
from learnlog.operators import analysis as A
from learnlog.sources.store import HistoryStore, list_dirs, path_exists

#: Bump when the state's columns or the logic behind them change.
STATE_VERSION = "1"
_ORDER = {"word": (["ts DESC", "id", "pos"], K.SUMMARY_VOCABULARY_ITEMS), "error": (["ts DESC", "id"], K.SUMMARY_ERRORS)}
_TOTALS = ["translations", "corrections", "analyses", "n"]


def facts(history: DataFrame, bodies: A.Bodies | None = None) -> DataFrame:
    """The state of a set of records: kind (count, word, error), language, the totals; ts, id, pos, line."""
    counts = A.summary_counts(history).withColumn("kind", F.lit("count"))
    words = A.vocabulary_top(history, bodies=bodies).select(
        F.lit("word").alias("kind"), "language", "ts", "id", "pos", A.word_line().alias("line"))
    newest = Window.partitionBy("language").orderBy(*A.newest_first())
    errors = (history.where((F.col("mode") == "correction") & (F.length("explanation") > 0))
              .withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= K.SUMMARY_ERRORS)
              .select(F.lit("error").alias("kind"), "language", "ts", "id", F.lit(0).alias("pos"),
                      F.concat(F.lit("- "), T.error_snippet("explanation")).alias("line")))
    return counts.unionByName(words, allowMissingColumns=True).unionByName(errors, allowMissingColumns=True)


def merged(states: DataFrame) -> DataFrame:
    """The state of the union of sets of records whose states are given one below the other."""
    counts = (states.where("kind = 'count'").groupBy("language").agg(*[F.sum(c).alias(c) for c in _TOTALS])
              .withColumn("kind", F.lit("count")))
    out = counts
    for kind, (order, n) in _ORDER.items():
        w = Window.partitionBy("language").orderBy(*[F.expr(c.split(" ")[0]).desc() if " DESC" in c else F.col(c) for c in order])
        top = (states.where(F.col("kind") == kind).select("kind", "language", "ts", "id", "pos", "line")
               .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn"))
        out = out.unionByName(top, allowMissingColumns=True)
    return out


def summaries(state: DataFrame) -> DataFrame:
    """(language, summary): the documents of ``analysis.summary_text``."""
    def ranked(kind: str, order: list) -> DataFrame:
        w = Window.partitionBy("language").orderBy(*order)
        return state.where(F.col("kind") == kind).select(
            "language", F.struct(F.row_number().over(w).alias("rn"), "line").alias(kind))

    line = "struct<rn:int,line:string>"
    counts = state.where("kind = 'count'").select("language", *_TOTALS, *[F.lit(None).cast(line).alias(k) for k in _ORDER])
    return A.summary_document(
        counts.unionByName(ranked("word", [F.desc("ts"), F.col("id"), F.col("pos")]), allowMissingColumns=True)
        .unionByName(ranked("error", [F.desc("ts"), F.col("id")]), allowMissingColumns=True))


class MaintainedSummary:
    """The state of a store's history as of one of its commits, below ``<root>/derived``. ``bodies``: for a
    store whose records refer to their texts."""

    def __init__(self, store: HistoryStore, bodies: A.Bodies | None = None):
        self.store, self.spark, self.bodies = store, store.spark, bodies
        self.path = f"{store.root}/derived/summary-state-{STATE_VERSION}"

    def _newest(self) -> int:
        return max([int(d) for d in list_dirs(self.spark, self.path)
                    if path_exists(self.spark, f"{self.path}/{d}/_SUCCESS")], default=0)

    def changed_since(self, have: int, now: int) -> tuple[list[str], list[int]]:
        """The folders that appends after commit ``have`` added, and the commits that were edits."""
        added, edits = [], []
        before = set(self.store.folders(have))
        for v in range(have + 1, now + 1):
            after = set(self.store.folders(v))
            if before <= after:
                added += sorted(after - before)
            else:
                edits.append(v)
            before = after
        return added, edits

    def state(self) -> DataFrame:
        """The state as of the store's newest commit, brought up to date and written if need be."""
        now, have = self.store.version(), self._newest()
        target = f"{self.path}/{now:012d}"
        if have < now or not now:
            self._updated(have, now).write.mode("overwrite").parquet(target)
        return self.spark.read.parquet(target)

    def _updated(self, have: int, now: int) -> DataFrame:
        rows = self.store.read(now)
        if not have:
            return facts(rows, self.bodies)
        added, edits = self.changed_since(have, now)
        if not all(path_exists(self.spark, f"{self.store.path}/{f}") for f in added):
            return facts(rows, self.bodies)  # an append's folders were replaced and have been removed since
        old = self.spark.read.parquet(f"{self.path}/{have:012d}")
        new = facts(self.store.rows_of(added), self.bodies)
        if not edits:
            return merged(old.unionByName(new))
        dirty = (self.store.changes().where(F.col("version").isin(edits)).select(F.col("language").alias("_dirty")).distinct())
        clean = lambda df: df.join(dirty, F.col("language").eqNullSafe(F.col("_dirty")), "left_anti")
        again = rows.join(dirty, F.col("language").eqNullSafe(F.col("_dirty")), "left_semi")
        return merged(clean(old).unionByName(clean(new))).unionByName(facts(again, self.bodies))

    def documents(self) -> DataFrame:
        return summaries(self.state())
