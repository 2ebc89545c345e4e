"""As-of join: each row with the latest earlier row of its key on another table.

Both sides are put into one table and cut into time buckets per key. Inside a bucket the last value is
carried from row to row; what a bucket starts with is the newest right row of the key's
earlier buckets, of which a small table holds one per (key, bucket). So a hot key is dealt out by its
buckets, and no task orders all of its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, tie: str, bucket_seconds: int = 3600) -> DataFrame:
    """All rows of ``left`` (its columns as they are) with the column ``matched``: the newest row of
    ``right`` (a struct of its columns) with the same ``key`` and a ``time`` that is not later; of
    several at that time the one with the largest ``tie``. ``matched`` is null where there is none,
    and where the left key or time is null.

    ``bucket_seconds`` should hold as many rows of the hottest key as one task can sort."""
    # whole buckets of wall-clock time, whatever the session's zone
    since = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', CAST(`{time}` AS timestamp_ntz))")
    bucket = F.floor(since / F.lit(bucket_seconds * 1_000_000)).cast("long")
    keyed = lambda df: df.withColumn("_bucket", bucket).select(
        F.col(key).alias("_key"), F.col(time).alias("_time"), "_bucket")
    writes = right.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    w = writes.withColumn("_bucket", bucket).select(
        F.col(key).alias("_key"), F.col(time).alias("_time"), F.col(tie).alias("_tie"), "_bucket",
        F.struct(*[F.col(c) for c in right.columns]).alias("_write"))
    r = left.withColumn("_bucket", bucket).select(
        F.col(key).alias("_key"), F.col(time).alias("_time"), "_bucket",
        F.struct(*[F.col(c) for c in left.columns]).alias("_read"))
    # one row per (key, bucket) of either side; the newest write of all earlier buckets
    newest = (w.groupBy("_key", "_bucket").agg(F.max(F.struct("_time", "_tie", "_write")).alias("_last"))
              .unionByName(keyed(left).select("_key", "_bucket").distinct(), allowMissingColumns=True)
              .groupBy("_key", "_bucket").agg(F.max("_last").alias("_last")))
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.select("_key", "_bucket", F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    both = r.withColumn("_side", F.lit(1)).unionByName(w.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    inside = (Window.partitionBy("_key", "_bucket").orderBy("_time", "_side", "_tie")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = both.withColumn("_seen", F.last("_write", ignorenulls=True).over(inside)).where("_side = 1")
    return (rows.join(carried, ["_key", "_bucket"], "left")
            .select("_read.*", F.coalesce("_seen", F.col("_carry._write")).alias("matched")))
