"""Quartile bucket digests: a short locality-sensitive fingerprint of a document's bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlog.llm.common import prepared, slices
from learnlog.sources.tables import read_table

BUCKETS = 256
_HASH = 2654435761
#: Two unrelated digests differ by about 1.25 per bucket; from there on likeness is 0.
BOUND = 320
_NULL_ID = -(1 << 63)


def digest(data: bytes) -> str:
    """Fingerprint of a byte string, 132 hex digits.

    Every run of three bytes is hashed into one of 256 buckets. Two digits give the length (four
    steps per doubling), two the first and second quartile of the bucket counts relative to the
    third, the rest two bits per bucket: how many quartiles its count exceeds. Fewer than three
    bytes leave all buckets empty."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(b) >= 3:
        triplet = (b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]
        count = np.bincount(((triplet * np.uint64(_HASH)) & np.uint64(0xFFFFFFFF)) >> np.uint64(24),
                            minlength=BUCKETS)
    else:
        count = np.zeros(BUCKETS, np.int64)
    q1, q2, q3 = np.partition(count, (63, 127, 191))[[63, 127, 191]]
    code = (count > q1).astype(np.uint8) + (count > q2) + (count > q3)
    packed = (code[0::4] << 6) | (code[1::4] << 4) | (code[2::4] << 2) | code[3::4]
    bits = format(len(data) + 1, "b")
    steps = 4 * (len(bits) - 1) + int((bits + "00")[1:3], 2)
    return f"{steps:02x}{q1 * 16 // (q3 + 1):x}{q2 * 16 // (q3 + 1):x}" + packed.tobytes().hex()


def _codes(fp: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(fp[4:]), np.uint8)
    head = np.array([2 * int(fp[:2], 16), int(fp[2], 16), int(fp[3], 16)], np.int64)
    return head, np.stack([raw >> 6, (raw >> 4) & 3, (raw >> 2) & 3, raw & 3], axis=1).astype(np.int64)


def likeness(a: str, b: str) -> float:
    """1 for equal digests, falling with the summed differences of the bucket codes, quartile
    digits and (twice) length steps, 0 from ``BOUND`` on."""
    if a == b:
        return 1.0
    (ha, ca), (hb, cb) = _codes(a), _codes(b)
    diff = int(np.abs(ca - cb).sum() + np.abs(ha - hb).sum())
    return (BOUND - min(BOUND, diff)) / BOUND


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id and fingerprint for every row. Null text counts as empty; rows with the same
    id or text are kept; other columns are ignored; an empty table gives no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fps = [digest((t or "").encode()) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fps, pa.string())],
                                                 ["id", "fingerprint"])

    prepared(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col))


_PAIR_SCHEMA = ("id long, n_chars long, edited_sha256 string, fingerprint string, "
                "edited_fingerprint string, near_edited double, near_next double")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of an edited form of it, with their likeness and that of
    the next row by id (after the last: the first).

    The edited text keeps the first half and continues with the next text's first
    floor(n_chars / 2) code points. Rows are dealt into ranges of the id (as many as the session's
    shuffle partitions) whose lower ends are ids of the table; a row at a lower end also goes to
    the range before, which so sees every row's successor without a global window. Null ids come
    first, null text counts as empty, rows with equal ids are ordered by text, a single row is
    its own next, an empty table gives no rows."""
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID))
    src = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    found = src.agg(F.min("key"), F.percentile_approx("key", [i / ranges for i in range(ranges)], 10_000)).first()
    low = np.array(sorted({found[0], *found[1]}) if found[0] is not None else [], np.int64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["range", "again", "key", "text"]
        for batch in batches:
            for part in slices(batch, "text"):
                k = part.column("key").to_numpy(zero_copy_only=False)
                at = np.searchsorted(low, k, side="right") - 1
                n = len(k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int32()), pa.array(np.zeros(n, np.int32)), *part.columns], names)
                first = np.flatnonzero(low[at] == k)
                if len(first):
                    part = part.take(pa.array(first))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((at[first] - 1) % len(low), pa.int32()),
                         pa.array(np.ones(len(first), np.int32)), *part.columns], names)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for r, again, k, text in zip(*[part.column(c).to_pylist()
                                               for c in ("range", "again", "key", "text")]):
                    if again and (waiting is None or waiting[0] != r):
                        continue  # the successor is known already
                    text = text or ""
                    fp = digest(text.encode())
                    if waiting is not None and waiting[0] == r:
                        _, key_, own, own_fp = waiting
                        n = len(own)
                        edited = (own[:n - n // 2] + text[:n // 2]).encode()
                        efp = digest(edited)
                        out.append((None if key_ == _NULL_ID else key_, n, hashlib.sha256(edited).hexdigest(),
                                    own_fp, efp, likeness(own_fp, efp), likeness(own_fp, fp)))
                    waiting = None if again else (r, k, text, fp)
                if out:
                    cols = list(zip(*out))
                    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(),
                             pa.float64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(cols, types)],
                        ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                         "near_edited", "near_next"])

    prepared(spark)
    return (src.mapInArrow(dealt, "range int, again int, key long, text string")
            .repartition(ranges, "range").sortWithinPartitions("range", "again", "key", "text")
            .mapInArrow(compared, _PAIR_SCHEMA).withColumnRenamed("id", id_col))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, their edited texts and the likeness of both and the next."""
    return compare_with_next(read_table(spark, sf_dir, "documents"))


_ORACLE = """
WITH n AS (
  SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nx,
    coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS nid
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
v AS (SELECT doc_id, 0 AS kind, t AS s FROM n UNION ALL
      SELECT doc_id, 1, left(t, length(t) - length(t) // 2) || left(nx, length(t) // 2) FROM n),
b AS (SELECT doc_id, kind, octet_length(encode(s)) AS bytes, hex(encode(s)) AS x FROM v),
tri AS (
  SELECT doc_id, kind, bucket, count(*) AS c FROM (
    SELECT doc_id, kind, unnest(list_transform(range(greatest(0, bytes - 2)), lambda i:
      ((CAST('0x' || substr(x, 2 * i + 1, 6) AS BIGINT) * 2654435761) % 4294967296) >> 24)) AS bucket FROM b)
  GROUP BY ALL),
cnt AS (
  SELECT b.doc_id, b.kind, list(coalesce(tri.c, 0) ORDER BY r.bucket) AS cs,
    list_sort(list(coalesce(tri.c, 0))) AS ss
  FROM b CROSS JOIN (SELECT range AS bucket FROM range(256)) r LEFT JOIN tri
    ON tri.doc_id = b.doc_id AND tri.kind = b.kind AND tri.bucket = r.bucket
  GROUP BY b.doc_id, b.kind),
c AS (
  SELECT doc_id, kind, bytes, ss[64] * 16 // (ss[192] + 1) AS r1, ss[128] * 16 // (ss[192] + 1) AS r2,
    list_transform(cs, lambda z: CAST(z > ss[64] AS INT) + CAST(z > ss[128] AS INT) + CAST(z > ss[192] AS INT)) AS code,
    4 * (length(bin(bytes + 1)) - 1) + 2 * CAST(substr(bin(bytes + 1) || '00', 2, 1) AS INT)
      + CAST(substr(bin(bytes + 1) || '00', 3, 1) AS INT) AS steps
  FROM cnt JOIN b USING (doc_id, kind)),
f AS (SELECT *, printf('%02x%x%x', steps, r1, r2) || array_to_string(list_transform(range(128),
    lambda i: printf('%x', code[2 * i + 1] * 4 + code[2 * i + 2])), '') AS fp FROM c),
near AS (
  SELECT n.doc_id, n.t, n.nx, a.fp AS fingerprint, e.fp AS edited_fingerprint,
    2 * abs(a.steps - e.steps) + abs(a.r1 - e.r1) + abs(a.r2 - e.r2) + list_sum(list_transform(range(1, 257),
      lambda i: abs(a.code[i] - e.code[i]))) AS de,
    2 * abs(a.steps - x.steps) + abs(a.r1 - x.r1) + abs(a.r2 - x.r2) + list_sum(list_transform(range(1, 257),
      lambda i: abs(a.code[i] - x.code[i]))) AS dn
  FROM n JOIN f a ON a.doc_id = n.doc_id AND a.kind = 0 JOIN f e ON e.doc_id = n.doc_id AND e.kind = 1
    JOIN f x ON x.doc_id = n.nid AND x.kind = 0)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars,
  sha256(left(t, length(t) - length(t) // 2) || left(nx, length(t) // 2)) AS edited_sha256,
  fingerprint, edited_fingerprint, CAST(320 - least(320, de) AS DOUBLE) / 320 AS near_edited,
  CAST(320 - least(320, dn) AS DOUBLE) / 320 AS near_next
FROM near"""

QUERIES = {"op1_fingerprints": op1_fingerprints}
ORACLE = {"op1_fingerprints": _ORACLE}
