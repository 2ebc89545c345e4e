"""Proportional stratified interleaving: every shard gets the mixture of the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learnlog.llm.common import materialize
from learnlog.sources.tables import read_table

SEED = "shuffle-1"
_HASH_SPACE = 1 << 60


def seeded_order(seed: str, *cols: str) -> Column:
    """A uniform number below 2^60 per row: the first 15 hex digits of an MD5."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _with_rank(df: DataFrame, group: list[str], slot: str, order: list[str], name: str) -> DataFrame:
    """0-based position within ``group`` by (slot, order), without a task per group: rows are
    numbered inside each (group, slot), and the sizes of the group's earlier slots, a table of
    one row per (group, slot), are added."""
    sizes = df.groupBy(*group, slot).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.partitionBy(*(group or [F.lit(0)])).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*group, slot).orderBy(*order)) - 1
    return (df.withColumn("_within", within).join(before, [*group, slot])
            .withColumn(name, F.col("_before") + F.col("_within")).drop("_within", "_before"))


def interleave(docs: DataFrame, shards: int, id_col: str = "doc_id", source_col: str = "source",
               text_col: str = "text", seed: str = SEED, slots: int | None = None) -> DataFrame:
    """Put every row into a shard so that each shard holds each source in proportion.

    Rows are shuffled within their source (by a seeded hash of the id), ranked, and ordered by
    the fractional rank (rank + 1/2) / size of the source; the order is cut into ``shards`` runs
    whose sizes differ by one at most. Columns: id, size (UTF-8 bytes + 1), text_crc32, shard,
    slot (position in the shard, from 0). ``slots``: into how many ranges of the hash, and of
    the fractional rank, the work is dealt (default: the session's shuffle partitions); a hot
    source spreads over all of them. Null source is a source of its own, null text has size 1
    and the checksum of an empty text, equal ids are told apart by checksum and size and else
    interchangeable; an empty table gives no rows."""
    spark = docs.sparkSession
    slots = slots or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # one number stands for the source, so that null is a group like any other
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("src"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), seeded_order(seed, id_col).alias("h"))
    rows = materialize(rows, "shard-rows")
    rows = rows.withColumn("bin", F.floor(F.col("h") / F.lit(_HASH_SPACE // slots)).cast("int"))
    tie = ["h", "id", "text_crc32", "size"]
    ranked = _with_rank(rows, ["src"], "bin", tie, "rank")
    total = rows.groupBy("src").agg(F.count(F.lit(1)).alias("src_n"))
    # integers below: floor((2 rank + 1) * slots / (2 n)) is the range of the fractional rank
    ranked = (ranked.join(total, "src")
              .withColumn("part", F.expr(f"int((2 * rank + 1) * {slots} div (2 * src_n))"))
              .withColumn("frac", F.expr("double(2 * rank + 1) / double(2 * src_n)")))
    placed = _with_rank(ranked, [], "part", ["frac", "src", *tie], "pos")
    n = max(1, rows.count())
    return (placed.withColumn("shard", F.expr(f"int(pos * {shards} div {n})"))
            .withColumn("slot", F.expr(f"pos - (shard * {n}L + {shards - 1}) div {shards}"))
            .select(F.col("id").alias(id_col), "size", "text_crc32", "shard", F.col("slot").cast("long")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law `rows`."""
    return (interleave(read_table(spark, sf_dir, "documents"), 8)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))


_ORACLE = f"""
WITH bits AS (SELECT CAST(range AS BIGINT) AS i FROM range(256)),
tbl AS (  -- the table of CRC-32, polynomial 0xEDB88320
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM bits)),
d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text,
        CAST('0x' || substr(md5('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
hx AS (SELECT text, hex(encode(text)) AS x, octet_length(encode(text)) AS n
       FROM (SELECT DISTINCT text FROM d)),
crc AS (SELECT text, n, CASE WHEN n = 0 THEN 0 ELSE xor(4294967295, list_reduce(
      list_prepend(4294967295, list_transform(range(n),
        lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) END AS crc FROM hx, tbl),
r AS (SELECT d.doc_id, d.source, d.h, crc.n + 1 AS size, crc.crc,
        row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1 AS rank,
        count(*) OVER (PARTITION BY source) AS src_n, count(*) OVER () AS n
      FROM d JOIN crc USING (text)),
p AS (SELECT *, row_number() OVER (
        ORDER BY CAST(2 * rank + 1 AS DOUBLE) / CAST(2 * src_n AS DOUBLE), source, h, doc_id) - 1 AS pos FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law,
  CAST(pos * 8 // n AS INTEGER) AS shard,
  CAST(pos - ((pos * 8 // n) * n + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p"""

QUERIES = {"op8_sharding": op8_sharding}
ORACLE = {"op8_sharding": _ORACLE}
