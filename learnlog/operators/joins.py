"""Joins with constant lookup tables. Other joins are left to AQE, which broadcasts a side from its
measured bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def lookup_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A constant lookup table. Its size is fixed by the code, so broadcasting it is safe."""
    return spark.createDataFrame(rows, ddl)


def join_lookup(df: DataFrame, table: DataFrame, on, how: str = "left") -> DataFrame:
    return df.join(F.broadcast(table), on, how)
