"""Hard negatives: pair scores under (anchor, descending score, id) keys, brought into order by the
shuffle itself, streamed past windows that the positives open."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learnlog.llm.common import group_starts, materialize, prepared
from learnlog.sources.tables import read_table

#: Components are counted in units of 1 / SCALE.
SCALE = 256
#: Positives per anchor, negatives per positive, and a negative's score in percent of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
#: Rows that meet the stream of anchors in one task at a time, and anchors per product of matrices.
BLOCK_ROWS, ANCHOR_ROWS = 4096, 256
_EXACT = float(1 << 53)
_MOST = (1 << 63) - 1


# ------------------------------------------------------------------------- scores

def _vectors(col: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows by vector length: {length: (rows, floor(SCALE * component) as float64)}."""
    values = np.floor(SCALE * col.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    offsets = col.offsets.to_numpy() - col.offsets[0].as_py()
    length = np.diff(offsets)
    out = {}
    for n in np.unique(length).tolist():
        rows = np.flatnonzero(length == n)
        out[n] = rows, values[offsets[rows][:, None] + np.arange(n)]
    return out


def _scores(anchors: dict, rows: dict, n_anchors: int, n_rows: int) -> np.ndarray:
    """Exact inner products, at most 64 bits; components that one of two vectors does not have count
    as zero. The result holds int64, or Python integers where sums or multiples could overflow."""
    most = 1.0
    for n, (_, a) in anchors.items():
        for m, (_, r) in rows.items():
            if min(n, m):
                most = max(most, np.abs(a).max() * np.abs(r).max() * min(n, m))
    out = np.zeros((n_anchors, n_rows), np.int64 if most < _EXACT else object)
    for n, (i, a) in anchors.items():
        for m, (j, r) in rows.items():
            d = min(n, m)
            if out.dtype == object:
                whole = np.vectorize(int, otypes=[object])
                s = whole(a[:, :d]) @ whole(r[:, :d]).T if d else np.zeros((len(i), len(j)), object)
            else:
                s = (a[:, :d] @ r[:, :d].T).astype(np.int64)
            out[i[:, None], j] = s
    return np.clip(out, -_MOST, _MOST) if out.dtype == object else out


def _best(scores: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) of the k highest wanted scores per anchor; among equal scores the rows that come
    first."""
    if scores.dtype == object:
        at = [(i, j) for i in range(len(scores)) for j in sorted(
            np.flatnonzero(wanted[i]).tolist(), key=lambda j: (-scores[i, j], j))[:k]]
        return tuple(np.array(at, np.int64).reshape(-1, 2).T)
    kept = wanted
    if scores.shape[1] > k:
        low = np.where(wanted, -scores, np.iinfo(np.int64).max)
        kept = wanted & (low <= np.partition(low, k - 1, axis=1)[:, k - 1:k])
    i, j = np.nonzero(kept)
    order = np.lexsort((j, -scores[i, j], i))
    i, j = i[order], j[order]
    start = group_starts(i)
    rank = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
    return i[rank < k], j[rank < k]


def _met(rows: DataFrame, anchors: DataFrame, blocks: int, pick) -> DataFrame:
    """(anchor, score, id) of the pairs that ``pick`` keeps of every block of rows and every anchor.

    Rows are dealt into blocks by a hash of their id, which is unique, so that none is much larger than
    BLOCK_ROWS. A task holds one block and streams all anchors past it; ``pick`` gets the scores, which
    pairs have equal labels, which are an anchor and itself, and the anchors' windows."""
    cols = ["block", "side", "id", "label", "vec", "windows"]
    none = F.lit(None).cast("array<bigint>")
    left = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("side", F.lit(0))
    right = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("side", F.lit(1))
    if "windows" not in anchors.columns:
        right = right.withColumn("windows", none)
    both = left.withColumn("windows", none).select(*cols).unionByName(right.select(*cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts, block = None, [], None
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("block", "side")]
            bounds = [*group_starts(*keys).tolist(), batch.num_rows]
            for lo, hi in zip(bounds, bounds[1:]):
                if keys[0][lo] != block:
                    block, parts, own = keys[0][lo], [], None
                if keys[1][lo] == 0:
                    parts.append(batch.slice(lo, hi - lo))
                    continue
                if not parts:
                    continue  # a block without rows
                if own is None:
                    t = pa.Table.from_batches(parts).combine_chunks()
                    own = (t.column("id").to_numpy(), t.column("label").to_numpy(),
                           _vectors(t.column("vec").combine_chunks()))
                for at in range(lo, hi, ANCHOR_ROWS):
                    some = batch.slice(at, min(ANCHOR_ROWS, hi - at))
                    ids = some.column("id").to_numpy()
                    scores = _scores(_vectors(some.column("vec")), own[2], len(ids), len(own[0]))
                    i, j = pick(scores, some.column("label").to_numpy()[:, None] == own[1],
                                ids[:, None] == own[0], some.column("windows"))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[i]), pa.array(scores[i, j].astype(np.int64)), pa.array(own[0][j])],
                        ["anchor", "score", "id"])

    return (both.repartition(blocks, "block").sortWithinPartitions("block", "side", "id")
            .mapInArrow(run, "anchor long, score long, id long"))


def _windows_streamed(keyed: DataFrame, negatives: int, low: int, high: int) -> DataFrame:
    """The rows of (anchor, below, kind, id), which come by anchor and descending score, streamed: a
    positive (kind 0) opens a window, a negative (kind 1) goes to every open window whose range it
    is in, a window closes when it is full or the scores have fallen below it. Nothing but the open
    windows of one anchor is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows = None, []  # a window: positive id, its score, negatives so far
        for batch in batches:
            out = []
            for a, below, kind, i in zip(*[batch.column(c).to_pylist() for c in ("anchor", "below", "kind", "id")]):
                if a != anchor:
                    anchor, windows = a, []
                if kind == 0:
                    windows.append([i, -below, 0])
                    continue
                over = False
                for w in windows:
                    if 100 * -below < low * w[1] or w[2] == negatives:
                        over = True
                    elif 100 * -below <= high * w[1]:
                        w[2] += 1
                        out.append((a, w[0], w[2], i, w[1], -below))
                if over:
                    windows = [w for w in windows if 100 * -below >= low * w[1] and w[2] < negatives]
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if n == 2 else pa.int64()) for n, c in enumerate(cols)],
                ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return keyed.mapInArrow(run, "anchor_id long, positive_id long, rank int, negative_id long, "
                                 "positive_score long, negative_score long")


# -------------------------------------------------------------------- the operator

def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding",
                   label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH) -> DataFrame:
    """Per anchor and positive the first ``negatives`` rows of another label whose score is
    ``low`` to ``high`` percent of the positive's: anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score.

    A score is the integer inner product of vectors whose components x are floor(256 x); higher scores
    come first, ties by the smaller id. An anchor's positives are its first ``positives`` other rows
    of its label. ``is_anchor`` is a condition on the id column.

    The pairs of all rows and anchors are scored in blocks. Before the shuffle each block keeps what can be in the result
    of the anchor: its best rows of the same label in a first pass, which settles the positives, and in a
    second its best rows inside each positive's range. These and the positives are shuffled by anchor and
    sorted by (anchor, descending score, positives first, id) in the same exchange, and streamed.

    Rows with a null id, label or vector, or a null or non-finite component take no part. Components that
    one of two vectors does not have count as zero. Rows that repeat an id count once, those that differ
    as the smallest (label, vector) among them. Scores beyond 64 bits count as the largest or smallest
    number of 64 bits. Vectors of any length are used whole. Other columns are ignored whatever their
    names; an empty table, anchors without positives and positives without negatives give no rows."""
    if not 0 <= low <= high <= 100:
        raise ValueError("windows open when their positive is streamed: 0 <= low <= high <= 100")
    spark = vectors.sparkSession
    prepared(spark)
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.where(finite).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
        F.col(f"`{vec_col}`").alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    rows = (rows.where("id IS NOT NULL AND label IS NOT NULL").groupBy("id")
            .agg(F.min(F.struct("label", "vec", "is_anchor")).alias("r")).select("id", "r.*"))
    rows = materialize(rows, "vectors")
    blocks = max(-(-rows.count() // BLOCK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    anchors = rows.where("is_anchor").select("id", "label", "vec")
    rows = rows.select("id", "label", "vec")

    def same_label(scores: np.ndarray, same: np.ndarray, own: np.ndarray, _: pa.Array):
        return _best(scores, same & ~own, positives)

    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    chosen = materialize(_met(rows, anchors, blocks, same_label).withColumn("n", F.row_number().over(first))
                         .where(F.col("n") <= positives).drop("n"), "positives")
    opened = anchors.join(chosen.groupBy(F.col("anchor").alias("id")).agg(F.collect_set("score").alias("windows")), "id")

    def in_windows(scores: np.ndarray, same: np.ndarray, own: np.ndarray, windows: pa.Array):
        width = scores.shape[1]
        opens = windows.to_pylist()
        found = [np.zeros(0, np.int64)]
        for k in range(max(len(w) for w in opens)):
            who = np.array([i for i, w in enumerate(opens) if len(w) > k])
            top = np.array([opens[i][k] for i in who], scores.dtype)[:, None]
            s = scores[who]
            i, j = _best(s, ~same[who] & (100 * s >= low * top) & (100 * s <= high * top), negatives)
            found.append(who[i] * width + j)
        return np.divmod(np.unique(np.concatenate(found)), width)

    pairs = _met(rows, opened, blocks, in_windows)
    keyed = (chosen.withColumn("kind", F.lit(0)).unionByName(pairs.withColumn("kind", F.lit(1)))
             .select("anchor", (-F.col("score")).alias("below"), "kind", "id"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = keyed.repartition(parts, "anchor").sortWithinPartitions("anchor", "below", "kind", "id")
    return _windows_streamed(keyed, negatives, low, high)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``embeddings``; every hundredth id is an anchor, every seventh has its label moved
    on by one."""
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


_ORACLE = """
WITH r AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
    CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM r a JOIN r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score,
        s.score AS negative_score,
        CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
        AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT * FROM n WHERE rank <= 5"""

QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLE = {"op12_hard_negatives": _ORACLE}
