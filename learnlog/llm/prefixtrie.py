"""Prefix trie of conversations: ternary search trees over dictionary-encoded turns, one per range
shard, whose boundary nodes are merged."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learnlog.llm.common import materialize, prepared
from learnlog.sources.tables import read_table

#: Bytes of a digest, which stands for a turn, a sequence of turns or a node.
DIGEST = 16
#: Sequences and turns of one tree; a longer sequence is a tree of its own.
SHARD_SEQUENCES, SHARD_TURNS = 20_000, 200_000
#: Bytes of joined ids that one row carries to the hash of a node's ends.
PIECE_BYTES = 1 << 16
_EMPTY = sha256(b"").hexdigest()


# ------------------------------------------------------------------- sequences of turns

def _digest(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, DIGEST)


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """conv, ids (a digest of role and text per turn), chars (code points of the text per turn), in
    the order of the turns (null first; equal ones by digest). Texts don't leave their scan."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    t = turns.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
        _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("id"),
        F.length(text).cast("long").alias("chars"))
    own = t.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "chars"))).alias("s"))
    return own.select("conv", F.col("s.id").alias("ids"), F.col("s.chars").alias("chars"))


def rebuilt(own: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """Each conversation c begins with the first h turns of conversation c - c % group (all if there
    are fewer, none if it is absent) and goes on with its own after its first h; h is crc32(c) % heads."""
    h = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(heads)).cast("int")
    base = own.where(F.col("conv") % group == 0).select(
        F.col("conv").alias("base"), *[F.slice(c, 1, heads - 1).alias(f"base_{c}") for c in ("ids", "chars")])
    both = own.withColumn("base", F.col("conv") - F.col("conv") % group).join(base, "base", "left").withColumn("h", h)

    def joined(c: str) -> Column:
        rest = F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0)))
        return F.concat(F.coalesce(F.slice(f"base_{c}", F.lit(1), F.col("h")), F.slice(c, 1, 0)), rest).alias(c)

    return both.select("conv", joined("ids"), joined("chars"))


# ------------------------------------------------------------------------ hash of ends

def _hashed_ends(members: DataFrame) -> DataFrame:
    """(key, ends) for the rows (key, conv): the hash of the key's decimal conv, ascending and joined
    by commas.

    The sort is dealt by ranges of (key, conv), so that the members of one key spread over tasks, which
    join them into pieces. Only these pieces, a row per 64 KB, meet in the one task that a
    sequential hash needs, and are fed to it one after the other."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, piece, size = None, None, [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _, _ in done], pa.binary()), pa.array([f for _, f, _ in done], pa.int64()),
                 pa.array([p for _, _, p in done], pa.binary())], ["key", "first", "piece"])

        done = []
        for batch in batches:
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv").to_pylist()):
                if k != key or size >= PIECE_BYTES:
                    if piece:
                        done.append((key, first, b",".join(piece)))
                    key, first, piece, size = k, c, [], 0
                text = b"%d" % c
                piece.append(text)
                size += len(text) + 1
            yield row()
            done = []
        if piece:
            done.append((key, first, b",".join(piece)))
            yield row()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for batch in batches:
            done = []
            for k, p in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist()):
                if k != key:
                    if h is not None:
                        done.append((key, h.hexdigest()))
                    key, h = k, sha256(p)
                else:
                    h.update(b",")
                    h.update(p)
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()),
                                              pa.array([d[1] for d in done], pa.string())], ["key", "ends"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], ["key", "ends"])

    pieces = (members.repartitionByRange(parts, "key", "conv").sortWithinPartitions("key", "conv")
              .mapInArrow(join, "key binary, first long, piece binary"))
    return (pieces.repartition(parts, "key").sortWithinPartitions("key", "first")
            .mapInArrow(hashed, "key binary, ends string"))


# ------------------------------------------------------------------------------- trees

class Tree:
    """A ternary search tree of sequences of small numbers. A node stands for a prefix: ``low`` and
    ``high`` lead to its siblings, ``down`` to the middle of its children. Node 0 is the root."""

    def __init__(self) -> None:
        self.value, self.low, self.high, self.down, self.parent = [-1], [0], [0], [0], [0]

    def _new(self, value: int, parent: int) -> int:
        for column, x in ((self.value, value), (self.low, 0), (self.high, 0), (self.down, 0), (self.parent, parent)):
            column.append(x)
        return len(self.value) - 1

    def insert(self, sequence: list[int]) -> list[int]:
        """The nodes of all prefixes of ``sequence``, from the root on."""
        value, low, high, down = self.value, self.low, self.high, self.down
        at, path = 0, [0]
        for v in sequence:
            node = down[at]
            if not node:
                node = down[at] = self._new(v, at)
            while value[node] != v:
                side = low if v < value[node] else high
                if not side[node]:
                    side[node] = self._new(v, at)
                node = side[node]
            path.append(node)
            at = node
        return path


def median_order(n: int) -> list[int]:
    """0 .. n - 1, each range's middle before its halves: sorted keys inserted so give balanced trees."""
    out, ranges = [], [(0, n)]
    while ranges:
        lo, hi = ranges.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            out.append(mid)
            ranges += [(mid + 1, hi), (lo, mid)]
    return out


def node_keys(ids: list[bytes]) -> list[bytes]:
    """A digest per prefix, the empty one first: equal prefixes have equal keys in every shard."""
    out = [b""]
    for i in ids:
        out.append(sha256(out[-1] + i).digest()[:DIGEST])
    return out


def _seam(before: tuple, after: tuple) -> list[tuple]:
    """What the sums over two neighbouring shards count wrongly at the nodes that both have: the
    prefixes common to the last sequence of one and the first of the next. Rows (key, depth, children, leaves,
    saved) to be added: a child in both shards counted twice; a leaf of the first shard that
    the next extends; and one ``- 1`` too many per node in each node's sum of (n - 1) chars."""
    common = 0
    for a, b in zip(before[0], after[0]):
        if a != b:
            break
        common += 1
    extended = common == len(before[0])  # sequences differ, so the next one is longer
    keys, out, saved = node_keys(before[0][:common]), [], 0
    for d in range(common, -1, -1):
        saved += before[1][d - 1] if d else 0
        out.append((keys[d], d, -int(d < common), -int(extended), saved))
    return out


_SCHEMA = ("kind int, shard long, key binary, parent_key binary, conv long, depth long, parent_conv long, n long, "
           "children long, leaves long, saved long, ends string, first_ids array<binary>, first_chars array<bigint>, "
           "last_ids array<binary>, last_chars array<bigint>")
_ARROW = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()),
                    *[(c, pa.int64()) for c in ("conv", "depth", "parent_conv", "n", "children", "leaves", "saved")],
                    ("ends", pa.string()), ("first_ids", pa.list_(pa.binary())), ("first_chars", pa.list_(pa.int64())),
                    ("last_ids", pa.list_(pa.binary())), ("last_chars", pa.list_(pa.int64()))])
#: Kinds of rows: a node that only one shard has, a shard's part of a boundary node, a seam's correction,
#: the first and last sequence of a task.
_NODE, _PART, _SEAM, _EDGE = range(4)


def _row(kind: int, shard: int, key=None, parent_key=None, conv=None, depth=None, parent_conv=None, n=None, children=None,
         leaves=None, saved=None, ends=None, edge=(None, None, None, None)) -> tuple:
    return kind, shard, key, parent_key, conv, depth, parent_conv, n, children, leaves, saved, ends, *edge


def shard_rows(shard: int, seqs: list[tuple]) -> list[tuple]:
    """Rows of ``_SCHEMA`` for one shard: sorted, distinct sequences (ids, chars, n, conv, ends).

    The members of a node are neighbours in the sorted order, so only prefixes of the shard's first and
    last sequence can have members elsewhere; their sums are parts (of kind _PART)."""
    code = {d: i for i, d in enumerate(sorted({d for s in seqs for d in s[0]}))}
    tree = Tree()
    coded = [[code[d] for d in s[0]] for s in seqs]
    n, conv, chars, ends, depth = [0], [None], [0], [None], [0]
    for k in median_order(len(seqs)):
        ids, length, count, first, end = seqs[k]
        path = tree.insert(coded[k])
        for d in range(len(path) - (len(tree.value) - len(n)), len(path)):  # the new nodes end the path
            n.append(0)
            conv.append(None)
            chars.append(length[d - 1])
            ends.append(None)
            depth.append(d)
        n[path[-1]], conv[path[-1]], ends[path[-1]] = count, first, end
    size = len(tree.value)
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for node in range(size - 1, -1, -1):  # a node is made after its parent: all below it are done
        leaves[node] = leaves[node] or 1
        saved[node] += (n[node] - 1) * chars[node]
        up = tree.parent[node]
        if node:
            n[up] += n[node]
            conv[up] = conv[node] if conv[up] is None else min(conv[up], conv[node])
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    shared = {}
    for k in (0, len(seqs) - 1):
        shared |= dict(zip(tree.insert(coded[k]), node_keys(seqs[k][0])))
    out = []
    for node in range(size):
        up = tree.parent[node]
        sums = dict(conv=conv[node], depth=depth[node], n=n[node], children=children[node], leaves=leaves[node],
                    saved=saved[node], ends=ends[node])
        if node in shared:
            out.append(_row(_PART, shard, shared[node], shared[up] if node else None, **sums))
        elif up in shared:
            out.append(_row(_NODE, shard, None, shared[up], **sums))
        else:
            out.append(_row(_NODE, shard, parent_conv=conv[up], **sums))
    return out


def _built(batches: Iterator[pa.RecordBatch], most_seqs: int, most_turns: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    shard, seqs, turns, first, last = task << 32, [], 0, None, None

    def done() -> pa.RecordBatch:
        nonlocal shard, seqs, turns, first, last
        rows = shard_rows(shard, seqs)
        if last is not None:
            rows += [_row(_SEAM, shard, key, depth=d, children=c, leaves=leaf, saved=s, n=0)
                     for key, d, c, leaf, s in _seam(last, seqs[0])]
        first, last = first or seqs[0], seqs[-1]
        shard, seqs, turns = shard + 1, [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    for batch in batches:
        for s in zip(*[batch.column(c).to_pylist() for c in ("ids", "chars", "n", "conv", "ends")]):
            if seqs and (len(seqs) >= most_seqs or turns + len(s[0]) > most_turns):
                yield done()
            seqs.append(s)
            turns += len(s[0])
    if seqs:
        yield done()
    if first is not None:
        edge = _row(_EDGE, task, edge=(first[0], first[1], last[0], last[1]))
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(edge, _ARROW)], schema=_ARROW)


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [r for a in zip(*[batch.column(c).to_pylist() for c in ("last_ids", "last_chars", "first_ids", "first_chars")])
                for r in _seam((a[0], a[1]), (a[2], a[3]))]
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                                         ["key", "depth", "children", "leaves", "saved"])


# -------------------------------------------------------------------------- the operator

def prefix_trie(convs: DataFrame, shard_sequences: int = SHARD_SEQUENCES, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of ``convs`` (conv, ids, chars; see ``sequences``): conv_id (the smallest
    member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Equal sequences are one before anything is dealt out, so that copies cost a count. Distinct sequences are range
    partitioned and sorted; each task cuts its range into shards of bounded size. A node that two shards
    may share is given out in parts, which a sum per node merges; what these sums count twice at the seam between
    neighbours is known from the prefix that the two sequences there have in common.

    One conversation is one value (16 bytes a turn), wherever its texts are. An empty table gives no rows;
    conversations without turns are members of the root."""
    spark = convs.sparkSession
    prepared(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = _digest(F.array_join(F.transform("ids", lambda i: F.hex(i)), ""))
    rows = materialize(convs.select("conv", "ids", "chars", key.alias("key")), "sequences")
    distinct = rows.groupBy("key", "ids", "chars").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"))
    seqs = materialize(distinct.join(_hashed_ends(rows.select("key", "conv")).hint("merge"), "key").drop("key"), "distinct")
    built = materialize(seqs.repartitionByRange(parts, "ids").sortWithinPartitions("ids")
                        .select("ids", "chars", "n", "conv", "ends")
                        .mapInArrow(lambda b: _built(b, shard_sequences, shard_turns), _SCHEMA), "shards")
    edges = built.where(F.col("kind") == _EDGE)
    # a number per task that had rows; the sequences themselves are joined, not gathered
    before = edges.select("shard", F.lag("shard").over(Window.orderBy("shard")).alias("before"))
    pairs = (edges.select("shard", "first_ids", "first_chars").join(before, "shard")
             .join(edges.select(F.col("shard").alias("before"), "last_ids", "last_chars"), "before"))
    seams = pairs.select("last_ids", "last_chars", "first_ids", "first_chars").mapInArrow(
        _seams, "key binary, depth long, children long, leaves long, saved long")
    sums = ["depth", "children", "leaves", "saved"]
    shares = (built.where(F.col("kind").isin(_PART, _SEAM)).select("key", "parent_key", "conv", "n", "ends", *sums)
              .unionByName(seams, allowMissingColumns=True))
    merged = materialize(shares.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv").alias("conv"), F.max("depth").alias("depth"),
        F.sum("n").alias("n"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"), F.max("ends").alias("ends")), "boundary")
    up = merged.select(F.col("key").alias("parent_key"), F.col("conv").alias("up_conv"))
    boundary = merged.join(up.hint("merge"), "parent_key", "left").withColumn("parent_conv", F.col("up_conv"))
    nodes = built.where(F.col("kind") == _NODE)
    # by (shard, parent): no more rows have one key than a shard has nodes, whatever the parent
    here = (built.where(F.col("kind") == _PART).select("shard", F.col("key").alias("parent_key"))
            .join(up.hint("merge"), "parent_key"))
    below = (nodes.where("parent_key IS NOT NULL").join(here.hint("merge"), ["shard", "parent_key"])
             .withColumn("parent_conv", F.col("up_conv")))
    out = [F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"),
           F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
           F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256")]
    return (nodes.where("parent_key IS NULL").select(*out).unionByName(below.select(*out))
            .unionByName(boundary.select(*out)))


def conversation_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text") -> DataFrame:
    """The prefix trie of conversations given as one row per turn, as they stand. Null roles and texts
    are empty; turns without a conversation id are in none; repeated rows are turns of their own."""
    return prefix_trie(sequences(turns, conv_col, turn_col, role_col, text_col))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt upon the head of its hundred's first."""
    own = materialize(sequences(read_table(spark, sf_dir, "conversations")), "conversations")
    return prefix_trie(rebuilt(own))


_ORACLE = """
WITH bits AS (SELECT CAST(range AS BIGINT) AS i FROM range(256)),
tbl AS (  -- the table of CRC-32, polynomial 0xEDB88320
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM bits)),
t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, substr(sha256(length(coalesce(role, '')) || ':' ||
        coalesce(role, '') || coalesce(text, '')), 1, 32) AS d FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(d ORDER BY turn NULLS FIRST, d) AS ds, list(n ORDER BY turn NULLS FIRST, d) AS ns
      FROM t GROUP BY conv_id),
h AS (SELECT o.*, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
          range(length(CAST(conv_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i + 1, 1)) AS BIGINT))),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 6 AS h FROM o, tbl),
r AS (SELECT h.conv_id, list_concat(coalesce(b.ds[1:h.h], []), h.ds[h.h + 1:]) AS ds,
        list_concat(coalesce(b.ns[1:h.h], []), h.ns[h.h + 1:]) AS ns
      FROM h LEFT JOIN o b ON b.conv_id = h.base),
m AS (SELECT conv_id, unnest(range(len(ds) + 1)) AS depth, ds, ns FROM r),
k AS (SELECT conv_id, depth, len(ds) = depth AS is_end, CASE WHEN depth = 0 THEN 0 ELSE ns[depth] END AS n,
        array_to_string(ds[1:depth], '') AS key FROM m),
nodes AS (SELECT key, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(n) AS saved,
            sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends
          FROM k GROUP BY key),
c AS (SELECT p.key, count(x.key) AS n_children FROM nodes p LEFT JOIN nodes x
        ON x.depth = p.depth + 1 AND x.key[1:32 * p.depth] = p.key GROUP BY p.key),
s AS (SELECT p.key, sum(x.saved) AS saved, count(*) FILTER (WHERE c.n_children = 0) AS n_leaves
      FROM nodes p JOIN nodes x ON starts_with(x.key, p.key) JOIN c ON c.key = x.key GROUP BY p.key)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
  c.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN c USING (key) JOIN s USING (key)
LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.key = n.key[1:32 * (n.depth - 1)]"""

QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLE = {"op13_prefix_trie": _ORACLE}
