"""Near-duplicate documents: SetSketch registers in bands find candidates, a joint likelihood
estimate over all registers refines them, the full shingle sets confirm the links."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlog.llm.common import (connected_components, gram_hashes, group_starts, materialize, mix, packed_texts,
                                 prepared, slices, text_bytes, unpacked_slices, word_hashes)
from learnlog.sources.tables import read_table

WORDS = 5
#: 52 bands of 5 registers: two sets of similarity 0.75 share none with probability 8e-7.
BANDS, ROWS = 52, 5
REGISTERS = BANDS * ROWS
#: Register base, rate and limit: values grow by one when the minimum shrinks by 0.1 %.
BASE, RATE, LIMIT = 1.001, 20.0, 65_535
#: Likelihood ratio (natural log) against similarity 0.75 beyond which a pair is ruled out: 6 sigma.
RULED_OUT = 18.0
#: Rows and data bytes of one block of a cluster.
BLOCK_ROWS, BLOCK_BYTES = 1000, 4 << 20

_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each row, and the n + 1 bounds of the rows.

    A-Z in lower case, words are runs of other bytes than space and 0x09 to 0x0D; a text of
    fewer words than a shingle is one shingle, a text without words has none."""
    h, row = word_hashes(_LOWER[data], offsets, _SPACE)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    grams = gram_hashes(h, words)
    inside = row[:len(grams)] == row[words - 1:] if len(grams) else np.zeros(0, bool)
    value, owner = mix(grams[inside]), row[:len(grams)][inside]
    first = np.r_[0, np.cumsum(count)]
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        extra = [mix(gram_hashes(h[first[i]:first[i + 1]], int(count[i])) + np.uint64(count[i]))[0] for i in short]
        value, owner = np.r_[value, np.array(extra, np.uint64)], np.r_[owner, short]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = group_starts(owner, value)
    value, owner = value[keep], owner[keep]
    return value, np.searchsorted(owner, np.arange(n + 1))


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(31)
    return (rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64))


def registers(values: np.ndarray) -> np.ndarray:
    """SetSketch of one set: per hash function the smallest of exponentially distributed values,
    on a logarithmic scale, truncated to 0 .. LIMIT. Merging is the maximum."""
    mult, add = _functions()
    low = np.full(REGISTERS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(values), 2048):
        v = values[at:at + 2048, None]
        np.minimum(low, ((v ^ add) * mult).min(axis=0), out=low)
    u = (low.astype(np.float64) + 0.5) / 2.0 ** 64
    least = -np.log1p(-np.minimum(u, 1 - 2.0 ** -53)) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, LIMIT).astype("<u2")


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band for every row of registers."""
    parts = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64)


def joint_likelihood(size_a: np.ndarray, size_b: np.ndarray, above: np.ndarray, below: np.ndarray,
                     equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood similarity of pairs of sets from how many registers of the first are
    above, below and equal to those of the second, and the log ratio of the likelihoods there
    and at 0.75."""
    a, b = size_a / (size_a + size_b), size_b / (size_a + size_b)
    most = np.minimum(a / b, b / a)

    def log_p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def value(j: np.ndarray) -> np.ndarray:
        up, down = log_p(a - b * j), log_p(b - a * j)
        tiny = 1e-9
        return (above * np.log(np.maximum(up, tiny)) + below * np.log(np.maximum(down, tiny))
                + equal * np.log(np.maximum(1 - up - down, tiny)))

    best_j, best = np.zeros(len(a)), np.full(len(a), -np.inf)
    for g in np.linspace(0.005, 1, 200):
        j = most * g
        v = value(j)
        better = v > best
        best_j, best = np.where(better, j, best_j), np.where(better, v, best)
    return best_j, best - value(np.minimum(0.75, most))


# ----------------------------------------------------------------- clusters in blocks

def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links a - b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def likely_pairs(size: np.ndarray, data: list[bytes], own: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of the first ``own`` rows, any row) that the registers don't rule out."""
    regs = np.stack([np.frombuffer(d, "<u2") for d in data])
    floor = REGISTERS * 0.75 - 6 * np.sqrt(REGISTERS * 0.75 * 0.25)
    left, right = [], []
    for i in range(own):
        rest = regs[i + 1:]
        equal = (rest == regs[i]).sum(axis=1)
        j = np.flatnonzero((equal >= floor) & (4 * np.minimum(size[i + 1:], size[i]) >= 3 * np.maximum(size[i + 1:], size[i])))
        if len(j):
            above = (regs[i] > rest[j]).sum(axis=1)
            sim, ratio = joint_likelihood(np.full(len(j), float(size[i])), size[i + 1:][j].astype(float), above,
                                          REGISTERS - above - equal[j], equal[j])
            j = j[(sim >= 0.75) | (ratio <= RULED_OUT)]
            left.append(np.full(len(j), i))
            right.append(j + i + 1)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def true_pairs(size: np.ndarray, data: list[bytes], own: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of the first ``own`` rows, any row) with 100 |A n B| >= 75 |A u B|."""
    n = len(data)
    value = np.frombuffer(b"".join(data), np.uint64)
    doc = np.repeat(np.arange(n), [len(d) // 8 for d in data])
    order = np.argsort(value, kind="stable")
    value, doc = value[order], doc[order]
    start = group_starts(value)
    count = np.diff(np.r_[start, len(value)])
    column = np.repeat(np.arange(len(start)), count)
    shared = np.repeat(count > 1, count)
    column, doc = column[shared], doc[shared]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    common = np.zeros((own, n), np.float32)
    width = 2048
    for at in range(0, int(column.max()) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        x = np.zeros((n, width), np.float32)
        x[doc[lo:hi], column[lo:hi] - at] = 1
        common += x[:own] @ x.T
    both = common.astype(np.int64)
    i, j = np.nonzero(7 * both >= 3 * (size[:own, None] + size[None, :]))
    keep = i < j
    return i[keep], j[keep]


def linked_pairs(size: np.ndarray, registers_: list[bytes], data: list[bytes], own: int) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs (one of the first ``own`` rows, any row): the registers say which rows may be
    near each other, the full sets of each such group decide."""
    root = _spanning(len(size), *likely_pairs(size, registers_, own))
    order = np.argsort(root, kind="stable")
    bound = [*group_starts(root[order]).tolist(), len(order)]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in zip(bound, bound[1:]):
        rows = order[lo:hi]  # ascending, so the own rows come first
        if hi - lo > 1:
            a, b = true_pairs(size[rows], [data[r] for r in rows], int(np.count_nonzero(rows < own)))
            left.append(rows[a])
            right.append(rows[b])
    return np.concatenate(left), np.concatenate(right)


def _compared(t: pa.Table, key: tuple) -> list[tuple]:
    """(a, b) of links that connect what is linked in one task, and (id, null) of loose rows."""
    side, ids = t.column("side").to_numpy(), t.column("id").to_numpy()
    own, n = int(np.count_nonzero(side == 0)), len(ids)
    if not own or n < 2:
        return []
    # where a cluster has more blocks, a block's rows are held against the main component of block 0
    marks = key[2] == 0 and key[1] > 0 and t.column("blocks")[0].as_py() > 2
    a, b = linked_pairs(t.column("size").to_numpy(), t.column("registers").to_pylist(),
                        t.column("data").to_pylist(), n if marks else own)
    root = _spanning(n, a, b)
    out = [(int(x), int(y)) for x, y in zip(ids, ids[root]) if x != y]
    if marks:
        first = (a >= own) & (b >= own)
        inside = _spanning(n, a[first], b[first])[own:]
        main = inside[0] if not len(inside) else np.bincount(inside).argmax()
        out += [(int(x), None) for x in ids[:own][root[:own] != root[main]]]
    return out


def _in_tasks(rows: DataFrame) -> DataFrame:
    """``_compared`` of each (cluster, left_block, right_block): side 0 rows are compared with each other
    and with side 1 rows. Repeated rows of a set count once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, key, last, out = [], None, None, []
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("cluster", "left_block", "right_block")]
            mine = [*keys, *[batch.column(c).to_numpy() for c in ("side", "id", "k1", "k2")]]
            starts = group_starts(*mine)
            if len(starts) and last is not None and all(int(c[0]) == x for c, x in zip(mine, last)):
                starts = starts[1:]
            last = tuple(int(c[-1]) for c in mine) if batch.num_rows else last
            batch, keys = batch.take(pa.array(starts)), [k[starts] for k in keys]
            bounds = [*group_starts(*keys).tolist(), batch.num_rows]
            for lo, hi in zip(bounds, bounds[1:]):
                this = tuple(int(k[lo]) for k in keys)
                if waiting and this != key:
                    out += _compared(pa.Table.from_batches(waiting), key)
                    waiting = []
                key = this
                waiting.append(batch.slice(lo, hi - lo))
            if out:
                yield _links_batch(out)
                out = []
        if waiting:
            yield _links_batch(_compared(pa.Table.from_batches(waiting), key))

    # a number of its own: few bytes can be much work, and must not be put into fewer tasks
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = ["cluster", "left_block", "right_block", "side", "id", "k1", "k2", "blocks", "size", "registers", "data"]
    return (rows.select(*cols).repartition(parts, "cluster", "left_block", "right_block")
            .sortWithinPartitions(*cols[:7]).mapInArrow(run, "a long, b long"))


def _links_batch(found: list[tuple]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def in_blocks(rows: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """``rows`` (cluster, id, size, k1, ...) with their ``block`` in the cluster and its number of ``blocks``.

    Only clusters of more than one block are joined to, by a salted key: the rows of a large cluster don't meet."""
    salts = 64
    size = rows.groupBy("cluster").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / block_rows), F.ceil(F.sum(8 * F.col("size")) / block_bytes)).cast("int").alias("blocks"))
    large = materialize(size.where("blocks > 1"), "large-clusters", tidy=False)
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = F.xxhash64("id", "k1")
    return (rows.withColumn("salt", F.pmod(spread, F.lit(salts)).cast("int")).join(large, ["cluster", "salt"], "left")
            .drop("salt").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            .withColumn("block", F.pmod(F.shiftright(spread, 8), F.col("blocks")).cast("int")))


def cluster_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect whatever is linked inside each cluster of ``sets`` (cluster, blocks,
    block, id, k1, k2, size, registers, data).

    First every block is compared within itself and with block 0. Where a cluster has more blocks,
    this also tells which rows are connected to the largest component inside block 0: in a group of
    copies nearly all. Any two of these are connected. The others, the loose rows, are compared with
    the remaining blocks. So no linked pair stays both uncompared and unconnected, and no task holds
    more than two blocks."""
    here = F.array(F.struct(F.col("block").alias("left_block"), F.lit(0).alias("right_block"), F.lit(0).alias("side")))
    other = F.when((F.col("block") == 0) & (F.col("blocks") > 1), F.transform(
        F.sequence(F.lit(1), F.greatest(F.col("blocks") - 1, F.lit(1))),
        lambda j: F.struct(j.alias("left_block"), F.lit(0).alias("right_block"), F.lit(1).alias("side"))))
    first = sets.select("*", F.explode(F.concat(here, F.coalesce(other, F.slice(here, 1, 0)))).alias("t"))
    found = materialize(_in_tasks(first.select("*", "t.*")), "links")
    loose = found.where("b IS NULL").select(F.col("a").alias("id")).distinct()
    links = found.where("b IS NOT NULL")
    if loose.isEmpty():
        return links
    # a loose row of block i meets block j in the task (i, j): it as side 0, all of block j as side 1
    rest = sets.where("blocks > 2 AND block > 0")
    left = rest.join(loose.hint("merge"), "id", "left_semi").withColumn("left_block", F.col("block"))
    wanted = materialize(left.select("cluster", "left_block").distinct(), "loose-blocks", tidy=False)
    others = F.filter(F.sequence(F.lit(1), F.col("blocks") - 1), lambda j: j != F.col("block"))
    left = left.withColumn("right_block", F.explode(others)).withColumn("side", F.lit(0))
    right = (rest.join(wanted.hint("merge"), "cluster").where("block <> left_block")
             .withColumn("right_block", F.col("block")).withColumn("side", F.lit(1)))
    more = _in_tasks(left.unionByName(right.select(*left.columns)))
    return links.unionByName(materialize(more, "more-links").where("b IS NOT NULL"))


# ---------------------------------------------------------------------- the operator

def _sketches(docs: DataFrame) -> DataFrame:
    """id, size (distinct shingles), two 64-bit sums that identify the set, registers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                value, bound = shingle_sets(*text_bytes(part.column("text")))
                regs = [registers(value[lo:hi]).tobytes() if hi - lo > 2 else b"" for lo, hi in zip(bound, bound[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(bound)),
                     *[pa.array(k) for k in _key_sums(value, bound)],
                     pa.array(regs, pa.binary())], ["id", "size", "k1", "k2", "registers"])

    return docs.mapInArrow(run, "id long, size long, k1 long, k2 long, registers binary")


def _bands(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = np.stack([np.frombuffer(r, "<u2") for r in batch.column("registers").to_pylist()]) \
                if batch.num_rows else np.zeros((0, REGISTERS), "<u2")
            ids = batch.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(band_keys(regs).ravel()), pa.array(np.repeat(ids, BANDS))], ["key", "id"])

    return reps.select("id", "registers").mapInArrow(run, "key long, id long")


def _key_sums(value: np.ndarray, bound: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums per set, which identify it."""
    total = [np.r_[np.uint64(0), np.cumsum(mix(value ^ np.uint64(s)))] for s in (0x5A5A, 0xC3C3C3)]
    return [(t[bound[1:]] - t[bound[:-1]]).view(np.int64) for t in total]


def _sets(texts: DataFrame) -> DataFrame:
    """The full sets of the packed texts whose key is the wanted one (an id may have other texts too)."""
    kept = ["cluster", "blocks", "block", "id", "k1", "k2", "size", "registers"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in unpacked_slices(batch):
                value, bound = shingle_sets(np.frombuffer(b"".join(raw), np.uint8),
                                            np.r_[0, np.cumsum([len(r) for r in raw])])
                k1, k2 = _key_sums(value, bound)
                same = np.flatnonzero((k1 == part.column("k1").to_numpy()) & (k2 == part.column("k2").to_numpy())
                                      & (np.diff(bound) == part.column("size").to_numpy()))
                part = part.take(pa.array(same))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept],
                     pa.array([value[bound[i]:bound[i + 1]].tobytes() for i in same], pa.binary())], [*kept, "data"])

    return texts.select(*kept, "packed").mapInArrow(
        run, "cluster long, blocks int, block int, id long, k1 long, k2 long, size long, registers binary, data binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Two documents are linked if their sets of five-word shingles have 100 |A n B| >= 75 |A u B|;
    component_id is the smallest id reachable over links, kept whether it is the row's own.
    Equal sets are grouped first and the smallest id stands for them. Of these, documents that
    share a band of registers with a common leader form a candidate cluster, which is compared in blocks: the likelihood
    over all registers says which rows may be near, their full sets decide. Components are found once more,
    over the confirmed links. Sets of one or two shingles can only be linked when equal. Null or empty texts (and
    texts without words) have no shingles and are linked with nothing; a row with null id too, its
    component_id is null and it is kept. Rows with equal ids are one node: whatever one of their texts is
    linked with, all of them that have words are. Ids are whole numbers (others become null). Very long texts are read whole; a set is one value. Other columns
    are ignored whatever their names; an empty table gives no rows."""
    spark = docs.sparkSession
    prepared(spark)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    key = ["size", "k1", "k2"]
    sketch = materialize(_sketches(src), "sketches")
    named = sketch.where("size > 0 AND id IS NOT NULL")
    same = materialize(named.groupBy(*key).agg(F.min("id").alias("rep")), "equal-sets", tidy=False)
    members = materialize(sketch.select("id", *key).join(same.hint("merge"), key, "left").select("id", *key, "rep"), "members")
    reps = materialize(named.where("size > 2").join(same.withColumnRenamed("rep", "id").hint("merge"), [*key, "id"])
                       .dropDuplicates(["id", *key]).select("id", *key, "registers"), "representatives")
    bands = _bands(reps)
    leaders = materialize(bands.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last"))
                          .where("leader < last").drop("last"), "leaders")
    # "merge": the same plan at every size, never a broadcast of what grows with the documents
    stars = bands.join(leaders.hint("merge"), "key").where("id <> leader").select(
        F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    clusters = connected_components(stars)
    rows = materialize(in_blocks(clusters.withColumnRenamed("comp", "cluster").hint("merge").join(reps, "id"),
                                 BLOCK_ROWS, BLOCK_BYTES), "clusters")
    sets = materialize(_sets(packed_texts(src).join(rows.hint("merge"), "id")), "sets")
    # an id with texts of different sets stands for all of these
    joined = members.where("rep IS NOT NULL").groupBy("id").agg(
        F.min("rep").alias("b"), F.max("rep").alias("a")).where("a <> b")
    shared = members.where("rep IS NOT NULL").join(joined.select("id", "b").hint("merge"), "id").select(
        F.col("rep").alias("a"), "b").distinct()
    links = connected_components(cluster_links(sets).unionByName(shared))
    return (members.join(links.select(F.col("id").alias("rep"), "comp").hint("merge"), "rep", "left")
            .select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"),
                    F.when(F.col("id").isNotNull(), F.coalesce("comp", "rep", "id")).alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


_ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM (
  SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
        JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
      GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a"""


QUERIES = {"op5_near_duplicates": op5_near_duplicates}
ORACLE = {"op5_near_duplicates": _ORACLE}
