"""Helpers shared by the training-data operators: bounded slices of Arrow text batches,
64-bit hashing in numpy, written intermediate tables, connected components."""

from __future__ import annotations

import gc
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlog.session import checkpoint_dir, ship_package

#: Bytes of text that one numpy pass handles (its arrays then fit a core's cache); a longer single
#: text is a slice of its own.
SLICE_BYTES = 1 << 18

_MULT = 0x9E3779B97F4A7C15
_BYTE_CODES = np.random.default_rng(20240501).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) \
    + np.uint64(1)


def prepared(spark: SparkSession) -> None:
    """Settings every Python-backed operator needs: the checkpoint folder and the code."""
    checkpoint_dir(spark)
    ship_package(spark)


# --------------------------------------------------------------------------- Arrow text

def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES,
           rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive pieces of at most ``limit`` text bytes (or one row) and ``rows``."""
    _, offsets = text_bytes(batch.column(text))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        end = min(end, at + rows, n)
        yield batch.slice(at, end - at)
        at = end


# ------------------------------------------------------------------------------ hashing

def power(n: int, base: int = _MULT) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def coded(data: np.ndarray) -> np.ndarray:
    """A fixed random odd 64-bit code per byte value."""
    return _BYTE_CODES[data]


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every run of k codes, built by doubling (log2 k passes)."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, size, out, have = codes, 1, None, 0
    while True:
        if k & size:
            out = level[:n].copy() if out is None else out * power(size) + level[have:have + n]
            have += size
        if size * 2 > k:
            return out
        level = level[:len(level) - size] * power(size) + level[size:]
        size *= 2


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        _POWERS[:] = []
        for base in (_MULT, pow(_MULT, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p))
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and row of every word (run of bytes not marked in ``separator``), in order.
    Rows are the ranges between consecutive offsets; no word crosses them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] |= inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(coded(data) * up, out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(offsets, start, side="right") - 1


def window_reduce(a: np.ndarray, width: int, op) -> np.ndarray:
    """op (minimum or maximum) over every run of ``width`` values, by doubling."""
    if len(a) < width:
        return a[:0]
    size = 1
    while 2 * size <= width:
        a = op(a[:len(a) - size], a[size:])
        size *= 2
    rest = width - size
    return op(a[:len(a) - rest], a[rest:]) if rest else a


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """First row of every run of equal (sorted) keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


# ------------------------------------------------------------------- texts on the move

def packed_texts(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text, ...) with crc (of the text's UTF-8 bytes; null as empty) and the
    compressed text in place of the text: what a shuffle then moves is smaller."""
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                raw = [data[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(f.name) for f in kept], pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                     pa.array([z.compress(r) for r in raw], pa.binary())], [*[f.name for f in kept], "crc", "packed"])

    return docs.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
                           + ", crc long, packed binary")


def unpacked_slices(batch: pa.RecordBatch, limit: int = 1 << 16) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of at most ``limit`` compressed bytes (or one row), each with its texts' bytes."""
    z = zstandard.ZstdDecompressor()
    packed = batch.column("packed").to_pylist()
    ends = np.cumsum([len(r) for r in packed])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, end - at), [z.decompress(r) for r in packed[at:end]]
        at = end


# ------------------------------------------------------------------ intermediate tables

def materialize(df: DataFrame, name: str, tidy: bool = True) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: the lineage ends
    there, and a lost executor costs only the reading of a file again. The shuffle files of
    finished steps are no longer referenced afterwards; with ``tidy`` a collection lets Spark's cleaner
    remove them (not worth its time after a small step)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/learnlog-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    del df
    out = spark.read.parquet(path)
    if tidy:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return out


def _are_stars(edges: DataFrame) -> bool:
    """Whether no u has two v and no v is a u: one aggregate per node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("n"), F.lit(0).alias("low")),
                                          F.struct(F.col("v").alias("x"), F.lit(0).alias("n"), F.lit(1).alias("low")))).alias("e"))
    return ends.select("e.*").groupBy("x").agg(F.sum("n").alias("n"), F.max("low").alias("low")).where("n + low > 1").isEmpty()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(id, comp)`` for every id of ``edges`` (long columns a, b): comp is the smallest id
    reachable. Edges (u, v) lead to smaller ids. A round moves each edge's lower end to that end's own
    smallest neighbour, then all lower ends of a node to the smallest of them (large and small star),
    until the edges are stars. Nothing larger than the edge list is moved; a node with very many
    neighbours is one key of joins whose other side has a row per key, which AQE splits."""
    e = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("u"),
                                                 F.least("a", "b").alias("v")).distinct(), "edges", tidy=False)
    for _ in range(rounds):
        if _are_stars(e):
            break
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        large = e.join(low.select(F.col("u").alias("v"), "m").hint("merge"), "v", "left").select(
            "u", F.coalesce("m", "v").alias("v"))
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2.hint("merge"), "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = materialize(small.where("u != v").distinct(), "edges", tidy=False)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(roots)
