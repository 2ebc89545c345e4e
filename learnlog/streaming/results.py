"""Result folders of streams: one per trigger, complete once Spark's marker is in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from learnlog.sources.store import _fs, list_dirs, path_exists


def complete_results(spark: SparkSession, out_path: str) -> list[str]:
    """The finished ``batch=`` folders, oldest first; one that is being written is not among them."""
    return [d for d in list_dirs(spark, out_path)
            if d.startswith("batch=") and path_exists(spark, f"{out_path}/{d}/_SUCCESS")]


def drop_results(spark: SparkSession, out_path: str, keep: int = 2) -> None:
    """Remove all but the newest ``keep`` finished results, where each one holds everything."""
    for d in complete_results(spark, out_path)[:-keep]:
        fs, p = _fs(spark, f"{out_path}/{d}")
        fs.delete(p, True)


def write_result(df: DataFrame, out_path: str, batch_id: int) -> None:
    """A trigger's result; a trigger that is run again after a failure writes its folder again."""
    df.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id:09d}")


def with_state_store(spark: SparkSession) -> SparkSession:
    """State in RocksDB with changelog checkpoints, unless the session names a store of its own."""
    for key, value in (("spark.sql.streaming.stateStore.providerClass",
                        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"),
                       ("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")):
        if spark.sparkContext.getConf().get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def start(writer: DataStreamWriter, available_now: bool, interval_seconds: int):
    """The running query: what is there now, or a trigger every ``interval_seconds``."""
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{interval_seconds} seconds").start()
