"""Sum-of-squares online packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlog.llm.common import prepared, slices
from learnlog.sources.tables import read_table

TOKENIZER = "byte_bpe_50k.json"
_PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


#: Texts of these characters (Latin letters, punctuation) go the fast way: on them all versions of
#: Unicode agree about what is a letter.
_BEYOND_LATIN = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e]")
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """The tokens of a ``tokenizers`` file as bytes with their ids, if it is a byte-level BPE of the
    common kind whose ids rise in the order of its merges; else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" \
            or pre.get("add_prefix_space") or not pre.get("use_regex", True) \
            or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
        return None
    # the printable stand-in of every byte, as byte-level tokenizers write them
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    stand_in = {chr(b): b for b in plain}
    stand_in |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocab, special = model["vocab"], {t["content"] for t in spec.get("added_tokens", ())}
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if None in merged or merged != sorted(merged) or len(set(merged)) != len(merged):
        return None
    return {bytes(stand_in[c] for c in t): i for t, i in vocab.items() if t not in special}


class Encoder:
    """Ids of a ``tokenizers`` file, as ``encode(text, add_special_tokens=False)`` gives them.

    Where the file is a byte-level BPE of the common kind, texts of Latin characters without a
    special token are merged by tiktoken with the ranks of that file, which gives the same ids several
    times faster; all other texts are encoded by the library itself."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        ranks = merge_ranks(path)
        self.fast = ranks and tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """Little-endian unsigned 32-bit ids of the whole text."""
        if self.fast and not any(s in text for s in self.special) and not _BEYOND_LATIN.search(text):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=2)
def _encoder(path: str | None) -> Encoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return Encoder(path)


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 max_tokens: int = 1024, step: int = 256, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: the document's ids plus a final 0, cut every ``max_tokens`` ids; what
    remains is cut once more at its last multiple of ``step``, so that most pieces have sizes
    which fill a sequence exactly together and the others are small.

    Columns: the id, start, length, ids_crc32 (unsigned, of the ids as little-endian unsigned
    32-bit integers), doc_tokens. Null text counts as empty (the single id 0); repeated rows
    are documents of their own; other columns are ignored. ``tokenizer``: path of a
    ``tokenizers`` file every executor can read, by default the public byte-level BPE."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                row, start, length, crc, total = [], [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = enc.encode(text or "").tobytes() + b"\0\0\0\0"
                    n = len(ids) // 4
                    cuts = [*range(0, n, max_tokens), n]
                    if 0 < (n - cuts[-2]) // step * step < n - cuts[-2]:
                        cuts.insert(-1, n - (n - cuts[-2]) % step)
                    for s, e in zip(cuts, cuts[1:]):
                        row.append(i)
                        start.append(s)
                        length.append(e - s)
                        crc.append(zlib.crc32(ids[4 * s:4 * e]))
                        total.append(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(row, pa.int64())),
                     *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]],
                    ["id", "start", "length", "ids_crc32", "doc_tokens"])

    prepared(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(pieces, f"id {kind}, {_PIECES}").withColumnRenamed("id", id_col))


class SumOfSquares:
    """Open sequences counted by fill level; an item goes where the sum of squared counts of
    partially filled sequences grows least (ties: the fullest level). State is one array of
    counts and one stack of open sequences per level."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> tuple[int, int]:
        """(sequence id, offset) of an item of 1 to ``capacity`` units."""
        cap, count = self.capacity, self.count
        level = 0
        if size < cap:
            # change of the sum of squares, less what all choices share: opening a sequence
            # adds one at level `size`; using level h takes one there and adds one at h + size
            best = 2 * int(count[size]) + 1
            h = cap - size
            if count[h] and 1 - 2 * int(count[h]) <= best:
                best, level = 1 - 2 * int(count[h]), h
            here = count[1:h]
            cost = np.where(here > 0, 2 * (count[1 + size:h + size] - here) + 2, best + 1)
            if len(cost):
                k = len(cost) - 1 - int(np.argmin(cost[::-1]))
                if cost[k] < best:
                    level = k + 1
        if level:
            seq = self.open[level].pop()
            count[level] -= 1
        else:
            seq = self.next_id
            self.next_id += 1
        if level + size < cap:
            self.open[level + size].append(seq)
            count[level + size] += 1
        return seq, level


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 1024,
         step: int = 256, tokenizer: str | None = None, docs_per_task: int = 20_000) -> DataFrame:
    """Place every piece of every document into sequences of at most ``max_tokens`` ids.

    A document is cut as in ``token_pieces``, and the pieces are placed online by the
    sum-of-squares rule. Packing runs per bucket of about ``docs_per_task`` documents
    (a hash of the piece, so one hot id or source spreads); within a bucket rows are ordered,
    so a repeated task gives the same sequences. A bucket's memory is the level array and its
    open sequences, not its rows. Columns: those of ``token_pieces``, sequence_id (unique, not
    gapless), offset. An empty table gives an empty result; two rows with the same id are two
    documents."""
    buckets = max(1, -(-docs.count() // docs_per_task))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, packer = None, None
        for batch in batches:
            seqs, offs = [], []
            for b, size in zip(batch.column("bucket").to_pylist(), batch.column("length").to_pylist()):
                if b != current:
                    current, packer = b, SumOfSquares(max_tokens, b << 40)
                seq, off = packer.place(size)
                seqs.append(seq)
                offs.append(off)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(seqs, pa.int64()), pa.array(offs, pa.int64())],
                [*batch.schema.names[1:], "sequence_id", "offset"])

    p = token_pieces(docs, id_col, text_col, max_tokens, step, tokenizer)
    kind = docs.schema[id_col].dataType.simpleString()
    bucket = F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(buckets)).alias("bucket")
    return (p.select(bucket, F.col(id_col).alias("id"), "start", "length", "ids_crc32", "doc_tokens")
            .repartition(buckets, "bucket")
            .sortWithinPartitions("bucket", "id", "start", "ids_crc32", "doc_tokens")
            .mapInArrow(placed, f"id {kind}, {_PIECES}, sequence_id long, offset long")
            .withColumnRenamed("id", id_col))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 1024 tokens."""
    return pack(read_table(spark, sf_dir, "documents"))


QUERIES = {"op10_packing": op10_packing}
ORACLE: dict[str, str] = {}
