"""Removal of byte strings that repeat across documents: every window gets the smallest hash of its
16-byte strings as rank, ranks are sorted and those of one document drop out, windows of the others are compared
byte by byte. This is not prefix doubling: no pair of ranks at an offset is formed (see README)."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlog.llm.common import (coded, gram_hashes, group_starts, materialize, mix, packed_texts, prepared,
                                 slices, text_bytes, unpacked_slices, window_reduce)
from learnlog.sources.tables import read_table

LEAST = 50
#: Length of the strings ranked first.
GRAM = 16
#: Strings of one rank that a task keeps in memory before it leaves them to a further sort.
KEPT_STRINGS = 1_000_000
_LOW = (1 << 32) - 1


def window_ranks(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive ``least``-byte windows of the same rank: (row, start, windows, rank).

    The rank of a window is the smallest hash of its 16-byte strings, so equal windows have
    equal ranks wherever they stand, and neighbouring windows mostly share one."""
    n = len(data) - least + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    rank = window_reduce(mix(gram_hashes(coded(data), GRAM)), least - GRAM + 1, np.minimum)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.flatnonzero(row[:n] == row[least - 1:])
    rank, row = rank[inside], row[inside]
    head = group_starts(row, rank)
    return row[head], inside[head], np.diff(np.r_[head, len(inside)]), rank[head]


def _first_ranks(docs: DataFrame, least: int) -> DataFrame:
    """(rank, id), each once per row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, _, _, rank = window_ranks(*text_bytes(part.column("text")), least)
                order = np.lexsort((rank, row))
                row, rank = row[order], rank[order]
                keep = group_starts(row, rank)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rank[keep].view(np.int64)), part.column("id").take(pa.array(row[keep]))], ["rank", "id"])

    return docs.mapInArrow(run, "rank long, id long")


def _shared(ranks: DataFrame) -> DataFrame:
    """The rows whose rank is held by more than one id: sorted by rank, neighbours are compared
    as they stream by, so a very common rank needs no memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, doc, known = None, None, True  # the last row, and whether it was passed on
        for batch in batches:
            r, d = (batch.column(c).to_numpy() for c in ("rank", "id"))
            if not len(r):
                continue
            before = np.r_[False, (r[1:] == r[:-1]) & (d[1:] != d[:-1])]
            head = group_starts(r)
            lead = rank is not None and r[0] == rank
            multi = np.logical_or.reduceat(before, head)
            if lead and (known or d[0] != doc or multi[0]):
                multi[0] = True
            size = np.diff(np.r_[head, len(r)])
            out = np.repeat(multi, size)
            ids, ranks_ = d[out], r[out]
            if lead and multi[0] and not known:
                ids, ranks_ = np.r_[doc, ids], np.r_[rank, ranks_]
            rank, doc, known = r[-1], d[-1], bool(multi[-1])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ranks_)], ["id", "rank"])

    return (ranks.repartition("rank").sortWithinPartitions("rank", "id")
            .mapInArrow(run, "id long, rank long"))


def _runs(docs: DataFrame, least: int) -> DataFrame:
    """(rank, id, place, bytes) of every run of windows whose rank is among the row's shared
    ranks. place: checksum of the text (high half) and first byte of the run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in unpacked_slices(batch):
                data = np.frombuffer(b"".join(raw), np.uint8)
                offsets = np.r_[0, np.cumsum([len(r) for r in raw])]
                row, start, windows, rank = window_ranks(data, offsets, least)
                shared = part.column("ranks")
                owner = np.repeat(np.arange(part.num_rows), np.diff(shared.offsets.to_numpy()))
                flat = shared.flatten().to_numpy().view(np.uint64)
                salt = np.uint64(0x9E3779B97F4A7C15)
                keep = np.isin(rank + row.astype(np.uint64) * salt, flat + owner.astype(np.uint64) * salt)
                row, start, windows, rank = row[keep], start[keep], windows[keep], rank[keep]
                size = windows + least - 1
                bounds = np.r_[0, np.cumsum(size)]
                pick = np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])
                place = (part.column("crc").to_numpy()[row] << 32) | (start - offsets[row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rank.view(np.int64)), part.column("id").take(pa.array(row)), pa.array(place),
                     pa.Array.from_buffers(pa.large_binary(), len(size), [
                         None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[pick])]).cast(pa.binary())],
                    ["rank", "id", "place", "bytes"])

    return docs.mapInArrow(run, "rank long, id long, place long, bytes binary")


class RankGroup:
    """The runs of one rank, fed by rising id: which of their windows an earlier id holds."""

    def __init__(self, least: int, keep: int = KEPT_STRINGS):
        self.least, self.keep = least, keep
        self.runs: dict[bytes, int] = {}      # whole runs, by first id
        self.lazy: list[tuple[bytes, int]] = []  # runs whose windows are not spread yet
        self.windows: dict[bytes, int] = {}   # windows, by first id
        self.full = False

    def add(self, doc: int, run: bytes) -> list[tuple[int, int]] | None:
        """Byte ranges of ``run`` to be removed; None if memory is full (see ``rest``)."""
        first = self.runs.get(run)
        if first is not None and first < doc:
            return [(0, len(run))]
        if self.full:
            return None
        if first is None:
            self.runs[run] = doc
            if not self.lazy and not self.windows:
                self.lazy.append((run, doc))
                return []
        elif len(self.runs) == 1:
            return []
        n, seen = self.least, self.windows
        for other, of in self.lazy:
            for i in range(len(other) - n + 1):
                seen.setdefault(other[i:i + n], of)
        self.lazy = []
        out: list[tuple[int, int]] = []
        for i in range(len(run) - n + 1):
            if seen.setdefault(run[i:i + n], doc) < doc:
                if out and out[-1][1] >= i:
                    out[-1] = (out[-1][0], i + n)
                else:
                    out.append((i, i + n))
        self.full = len(seen) > self.keep
        return out


def _found(runs: DataFrame, least: int, keep: int) -> DataFrame:
    """(id, place, size, window): byte ranges to remove; or, where a rank had more strings than
    a task keeps, its windows (size 0: one that the task knew already), left to be ranked as a whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, group = None, None
        for batch in batches:
            out: list[tuple] = []
            for r, doc, place, piece in zip(*[batch.column(c).to_pylist() for c in ("rank", "id", "place", "bytes")]):
                if r != rank:
                    rank, group = r, RankGroup(least, keep)
                was_full = group.full
                spans = group.add(doc, piece)
                if spans is None:
                    out.extend((doc, place + i, least, piece[i:i + least]) for i in range(len(piece) - least + 1))
                else:
                    out.extend((doc, place + a, b - a, None) for a, b in spans)
                    if group.full and not was_full:
                        out.extend((d, 0, 0, w) for w, d in group.windows.items())
            cols = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary())],
                ["id", "place", "size", "window"])

    return (runs.repartition("rank").sortWithinPartitions("rank", "id", "place")
            .mapInArrow(run, "id long, place long, size long, window binary"))


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, non-touching ranges covering the same bytes, in order."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate(stops[order])
    head = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
    return a[head], b[np.r_[head[1:] - 1, len(a) - 1]]


def _whole_copies(docs: DataFrame, least: int) -> DataFrame:
    """(id, crc, size, copy) per row: whether a row with a smaller id has the same text, of ``least``
    bytes or more. Such a text goes as a whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                raw = [data[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(np.diff(offsets)),
                     pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary())],
                    ["id", "crc", "size", "digest"])

    texts = materialize(docs.mapInArrow(run, "id long, crc long, size long, digest binary"), "digests")
    first = materialize(texts.groupBy("digest").agg(F.min("id").alias("first")), "first-texts")
    return materialize(texts.join(first, "digest").select(
        "id", "crc", "size", ((F.col("id") > F.col("first")) & (F.col("size") >= least)).alias("copy")), "copies")


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                    kept_strings: int = KEPT_STRINGS) -> DataFrame:
    """(id, crc, spans): for every row with something to remove, its ranges (place, size), not merged yet.

    A text that a row with a smaller id has too is settled as a whole: it need not take part, since
    whatever it holds is in that row. Round 1 ranks every ``least``-byte window by the smallest hash of its 16-byte strings (about one
    rank per 17 windows) and sorts (rank, id): ranks that one id holds are dropped. Round 2
    sorts what is left by (rank, id) with the bytes of its windows: runs of windows equal as
    a whole are settled at once, others window by window. Round 3 is for ranks with more
    different windows than a task keeps: these are grouped by the windows themselves."""
    src = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prepared(docs.sparkSession)
    shared = materialize(_shared(_first_ranks(src, least)), "shared-ranks")
    texts = _whole_copies(src, least)
    settled = texts.groupBy("id").agg(F.bool_and("copy").alias("settled")).where("settled").select("id")
    ranks = shared.groupBy("id").agg(F.collect_list("rank").alias("ranks")).join(settled, "id", "left_anti")
    found = materialize(_found(_runs(packed_texts(src).join(ranks, "id"), least), least, kept_strings), "repeats")
    left = found.where("window IS NOT NULL")
    first = materialize(left.groupBy("window").agg(F.min("id").alias("first")), "first-windows")
    late = left.where("size > 0").join(first, "window").where("id > first").select("id", "place", "size")
    whole = texts.where("copy").select("id", F.shiftleft("crc", 32).alias("place"), "size")
    spans = found.where("window IS NULL").select("id", "place", "size").unionByName(late).unionByName(whole)
    return spans.groupBy("id", F.shiftright("place", 32).bitwiseAND(_LOW).alias("crc")).agg(
        F.collect_list(F.struct(F.col("place").bitwiseAND(_LOW).alias("start"), "size")).alias("spans"))


_RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                   kept_col: str | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, then the row's
    ``columns``, and the remaining text as ``kept_col`` if that is given.

    Every byte is removed that is covered by a string of ``least`` bytes (UTF-8) which also
    starts in a row with a smaller id; strings are judged on the input, overlaps count, nothing
    crosses rows. n_spans counts maximal removed runs; in the remaining text a character that lost some
    of its bytes is left out. Null text counts as empty; rows with equal ids are not smaller
    than each other and keep what they share; rows with null id lose nothing and remove
    nothing; an empty table gives no rows."""
    carried = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *carried)
    joined = packed_texts(src).join(repeated_ranges(docs, id_col, text_col, least), ["id", "crc"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in unpacked_slices(batch):
                out = []
                for raw, spans in zip(texts, part.column("spans")):
                    keep, n_spans = raw, 0
                    if spans.is_valid:
                        a, size = (x.to_numpy() for x in spans.values.flatten())
                        a, b = merged(a, a + size)
                        n_spans = len(a)
                        keep = b"".join(raw[s:e] for s, e in zip(np.r_[0, b], np.r_[a, len(raw)]))
                    out.append((len(raw), len(raw) - len(keep), n_spans, hashlib.sha256(keep).hexdigest(),
                                keep.decode("utf-8", "ignore") if kept_col else None))
                cols = list(zip(*out)) if out else [()] * 5
                arrays = [part.column("id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string()),
                          *[part.column(f"c{i}") for i in range(len(columns))]]
                names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *[f"c{i}" for i in range(len(columns))]]
                if kept_col:
                    arrays, names = [*arrays, pa.array(cols[4], pa.string())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = _RESULT + "".join(f", c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))
    out = joined.select("id", "crc", "packed", *[f"c{i}" for i in range(len(columns))], "spans").mapInArrow(
        run, schema + (", kept string" if kept_col else ""))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256",
                      *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)],
                      *([F.col("kept").alias(kept_col)] if kept_col else []))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings that a smaller doc_id has too."""
    return remove_repeats(read_table(spark, sf_dir, "documents"))


_ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, {2 * LEAST}) AS s
      FROM (SELECT doc_id, x, unnest(range(greatest(0, n - {LEAST - 1}))) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM w) WHERE first < doc_id),
g AS (SELECT doc_id, i, sum(CASE WHEN i > before + {LEAST} OR before IS NULL THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY i) AS g
      FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r)),
p AS (SELECT doc_id, min(i) AS a, max(i) + {LEAST} AS b FROM g GROUP BY doc_id, g),
q AS (SELECT p.doc_id, p.a, p.b, d.x, d.n, lag(p.b, 1, 0) OVER (PARTITION BY p.doc_id ORDER BY p.a) AS from_,
        row_number() OVER (PARTITION BY p.doc_id ORDER BY p.a DESC) = 1 AS is_last
      FROM p JOIN d USING (doc_id)),
k AS (SELECT doc_id, count(*) AS spans, sum(b - a) AS removed, any_value(n) AS n,
        string_agg(substr(x, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a)
          || max(substr(x, 2 * b + 1)) FILTER (WHERE is_last) AS kept FROM q GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(k.removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(k.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.kept, d.x))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""

QUERIES = {"op6_repeats": op6_repeats}
ORACLE = {"op6_repeats": _ORACLE}
