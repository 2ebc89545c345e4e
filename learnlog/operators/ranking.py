"""Row numbering within a group that stays distributed when one group is huge.

``row_number().over(Window.partitionBy(g).orderBy(...))`` sends every row of a group to one
task; with a handful of record kinds one task would hold a third of the table. Here the rows
are range-partitioned on ``(group, order...)`` (the sample-based range partitioner splits a
hot group across many tasks), numbered locally after a sort within each partition, written
once with their partition (sampled bounds may differ from run to run, so both uses must read
the same rows), and shifted by the sizes of the preceding ranges. The only extra data moved is a table of
``partitions x groups`` counts, which is broadcast (its size is bounded by the partition
count and the number of groups, not by the data) - the intended case is few, large groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from learnlog.session import written


def _num_partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    conf = df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")
    return max(int(conf), 1)


def position_in_group(df: DataFrame, group: str, order_cols: list[str],
                      out: str = "pos", total: str | None = None,
                      num_partitions: int | None = None,
                      max_groups: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based ascending position of each row within ``group`` ordered by
    ``order_cols`` (which must be unique within a group), and optionally ``total`` = the
    group size.

    ``max_groups`` is the caller's bound on the number of distinct groups (e.g. the fixed
    set of record kinds); with it the offsets table (at most ``partitions + max_groups``
    rows) is broadcast. Without it the join is left to AQE, which broadcasts it from its
    measured size."""
    p = _num_partitions(df, num_partitions)
    keys = [group, *order_cols]
    ranged = written(df.repartitionByRange(p, *keys)
                     .sortWithinPartitions(*keys)
                     .withColumn("_pid", F.spark_partition_id())
                     .withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    counts = ranged.groupBy("_pid", group).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_pid", group, "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        *( [F.sum("_n").over(Window.partitionBy(group)).alias(total)] if total else [] ),
    )
    # each range partition holds a contiguous run of groups, so offsets has at most
    # (partitions + groups) rows
    if max_groups is not None:
        out_df = ranged.join(F.broadcast(offsets), ["_pid", group])
    else:
        out_df = ranged.join(offsets, ["_pid", group])
    out_df = out_df.withColumn(out, F.col("_off") + (F.col("_mid") - F.col("_first")) + 1)
    return out_df.drop("_pid", "_mid", "_first", "_off")
