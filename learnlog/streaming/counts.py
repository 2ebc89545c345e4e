"""Running per-language, per-kind record counts of the history table (Structured Streaming).

The history view refresh of the app becomes a stream over the table's change log: signed rows
(+1 added, -1 removed) that every commit leaves, be it an append, an upsert, a delete or the clearing of
the table. A trigger reads the changes since the last one, never the table; the state is one sum per
(language, kind). Each trigger writes its result to a folder of its own; readers take the newest complete one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from learnlog import constants as K
from learnlog.sources.store import CHANGES_DDL, HistoryStore
from learnlog.streaming.results import complete_results, drop_results, start, with_state_store, write_result

COUNTS_DDL = "language string, mode string, n long"


def start_language_counts(store: HistoryStore, out_path: str, checkpoint: str, available_now: bool = True,
                          interval_seconds: int = K.REFRESH_INTERVAL_SECONDS) -> StreamingQuery:
    """The running query. An existing table is counted from the first commit of its change log on."""
    spark = with_state_store(store.spark)
    store.create_if_missing()
    counts = (spark.readStream.schema(CHANGES_DDL).parquet(store.changes_path)
              .groupBy("language", "mode").agg(F.sum("sign").alias("n")))

    def publish(batch: DataFrame, batch_id: int) -> None:
        # one task per state partition: fewer would hold the aggregation of several at once
        write_result(batch.where("n > 0"), out_path, batch_id)
        drop_results(spark, out_path)

    return start(counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
                 .foreachBatch(publish), available_now, interval_seconds)


def current_counts(store: HistoryStore, out_path: str) -> DataFrame:
    """The counts as the last finished trigger left them: language, mode, n."""
    done = complete_results(store.spark, out_path)
    if not done:
        return store.spark.createDataFrame([], COUNTS_DDL)
    return store.spark.read.schema(COUNTS_DDL).parquet(f"{out_path}/{done[-1]}")


def run_language_counts(store: HistoryStore, out_path: str, checkpoint: str) -> DataFrame:
    """The counts after all changes that are there now."""
    start_language_counts(store, out_path, checkpoint).awaitTermination()
    return current_counts(store, out_path)
