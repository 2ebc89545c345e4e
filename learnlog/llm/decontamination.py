"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlog.llm.common import gram_hashes, group_starts, mix, prepared, slices
from learnlog.sources.tables import read_table

#: Characters per gram, per segment of a benchmark text, from one segment to the next, and edits
#: allowed per character.
Q = 8
SEGMENT = 64
STRIDE = 6
ERROR = 0.1
#: Shorter benchmark texts are searched for exactly, between word boundaries.
LEAST_CHARS = 24
#: Characters of benchmark text that one pass over the documents searches for.
BLOCK_CHARS = 1_000_000
#: Pairs of equal q-grams (one in a document, one in the benchmark) that are looked at together.
MOST_PAIRS = 2_000_000
_FILTER_BITS = 22
_GAP = np.uint32(0x110000)  # no character has this code


def normalized(text: str | None) -> str:
    """White space collapsed to single spaces and trimmed, letters in lower case."""
    return " ".join((text or "").split()).lower()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class SegmentIndex:
    """Segments of a block of benchmark texts and where the texts' q-grams stand."""

    item: list            # item id per segment
    chars: np.ndarray     # segments x SEGMENT, padded with 0
    length: np.ndarray
    budget: np.ndarray    # edits allowed per segment
    first: np.ndarray     # per text: its first segment,
    size: np.ndarray      # its characters,
    span: np.ndarray      # places of a segment's q-grams,
    width: np.ndarray     # edits allowed per segment + 1,
    need: np.ndarray      # shared q-grams that the lemma asks for
    gram: np.ndarray      # sorted gram hashes ...
    text: np.ndarray      # ... the text and the place in it
    at: np.ndarray
    present: np.ndarray   # bitmap over the first bits of a gram hash
    exact: dict           # characters of a short text -> (sorted hashes, segments)

    @classmethod
    def build(cls, items: list[tuple], segment: int, q: int, error: float, least: int = LEAST_CHARS) -> SegmentIndex:
        ids, parts, texts, first, short = [], [], [], [], {}
        for item, text in items:
            c = _codes(text)
            if len(c) < least:
                h = _gram_hashes(c, len(c))[0]
                short.setdefault(len(c), []).append((h, len(parts)))
                starts = [0]
            else:
                first.append(len(parts))
                texts.append(c)
                starts = sorted({*range(0, max(1, len(c) - segment + 1), STRIDE), max(0, len(c) - segment)})
            for s in starts:
                ids.append(item)
                parts.append(c[s:s + segment])
        length = np.array([len(p) for p in parts], np.int64)
        # an edit destroys q grams at most, so length + 1 - q (k + 1) are left with k edits
        budget = np.where(length < least, 0, np.minimum((length * error).astype(np.int64), (length - q) // q))
        chars = np.zeros((len(parts), segment), np.uint32)
        for i, p in enumerate(parts):
            chars[i, :len(p)] = p
        first = np.array(first, np.int64)
        grams = [_gram_hashes(c, q) for c in texts]
        gram = np.concatenate([*grams, np.zeros(0, np.uint64)])
        text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(g) for g in grams])
        at = np.concatenate([*[np.arange(len(g), dtype=np.int32) for g in grams], np.zeros(0, np.int32)])
        order = np.lexsort((at, text, gram))
        present = np.zeros(1 << _FILTER_BITS, bool)
        present[gram >> np.uint64(64 - _FILTER_BITS)] = True
        exact = {n: tuple(np.array(x) for x in zip(*sorted(rows))) for n, rows in short.items()}
        return cls(ids, chars, length, budget, first, np.array([len(c) for c in texts], np.int64),
                   length[first] - q + 1, budget[first] + 1, length[first] + 1 - q * (budget[first] + 1),
                   gram[order], text[order], at[order], present, exact)


def _gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    return mix(gram_hashes(codes.astype(np.uint64) + np.uint64(1), q))


def _found(known: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in g, place in the sorted ``known``) of every equal pair."""
    lo = np.searchsorted(known, g, side="left")
    n = np.searchsorted(known, g, side="right") - lo
    pos = np.flatnonzero(n)
    lo, n = lo[pos], n[pos]
    return np.repeat(pos, n), np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


def _windows(index: SegmentIndex, joined: np.ndarray, q: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the text, places in the index) of equal q-grams, in windows of the text with about
    MOST_PAIRS pairs. Grams that a text and the benchmark repeat thousands of times give the product of
    both; a window holds part of it only. Neighbouring windows share the characters that one
    region can span, so every region lies wholly in a window."""
    if not len(index.gram):
        return
    g = _gram_hashes(joined, q)
    likely = np.flatnonzero(index.present[g >> np.uint64(64 - _FILTER_BITS)])
    lo = np.searchsorted(index.gram, g[likely], side="left")
    n = np.searchsorted(index.gram, g[likely], side="right") - lo
    likely, lo, n = likely[n > 0], lo[n > 0], n[n > 0]
    overlap = int((index.span + 2 * index.width).max()) + 2
    ends, at = np.cumsum(n), 0
    while at < len(likely):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_PAIRS, side="right"))
        # at least two overlaps wide, so that a window always gets ahead
        stop = max(stop, int(np.searchsorted(likely, likely[at] + 2 * overlap)))
        m, first = n[at:stop], lo[at:stop]
        yield (np.repeat(likely[at:stop], m),
               np.repeat(first - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum()))
        if stop >= len(likely):
            return
        at = max(at + 1, int(np.searchsorted(likely, likely[stop] - overlap)))


def _bands(index: SegmentIndex, joined: np.ndarray, pos: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, first diagonal) of the bands of 2k + 2 diagonals, one beginning every k + 1,
    that share as many q-grams with the segment as the lemma asks for. Any alignment with k
    edits drifts over k + 1 diagonals at most, and so lies wholly in one of them.

    q-grams stand once per benchmark text. Sorted by (text, band, place), ``need`` of them in a row
    that lie within the places of one segment make all segments around them candidates; those
    segments are a range that only moves up along a band, so each is given out once."""
    none, q = np.zeros(0, np.int64), Q
    if not len(pos):
        return none, none
    text, at = index.text[which].astype(np.int64), index.at[which].astype(np.int64)
    most = int(index.size.max()) + 1
    bands = len(joined) + 2 * most + 4
    b = (pos - at) // index.width[text] + most + 2
    key = np.sort(np.concatenate([((text * bands + b) * most) + at, ((text * bands + b - 1) * most) + at]))
    del pos, which, text, at, b
    group, at = key // most, key % most
    text = group // bands
    i = np.arange(len(key))
    j = i + index.need[text] - 1
    i, j = i[j < len(key)], j[j < len(key)]
    ok = (group[j] == group[i]) & (at[j] - at[i] < index.span[text[i]])
    i, j = i[ok], j[ok]
    if not len(i):
        return none, none
    text, group, a, z = text[i], group[i], at[i], at[j]
    last = np.maximum(index.size[text] - (index.span[text] + q - 1), 0)  # start of the last segment
    lo = np.maximum(-(-(z - index.span[text] + 1) // STRIDE), 0)
    hi = np.minimum(a, last) // STRIDE
    same = np.r_[False, group[1:] == group[:-1]]
    lo = np.maximum(lo, np.where(same, np.r_[0, hi[:-1]] + 1, 0))
    n = np.maximum(hi - lo + 1, 0)
    k = np.repeat(np.arange(len(n)), n)
    number = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    # the last segment, where it stands off the grid
    end = np.flatnonzero((last % STRIDE > 0) & (z - index.span[text] < last) & (last <= a))
    end = end[np.unique(group[end], return_index=True)[1]]
    start = np.r_[number * STRIDE, last[end]]
    k, number = np.r_[k, end], np.r_[number, last[end] // STRIDE + 1]
    band = group[k] % bands - most - 2
    return index.first[text[k]] + number, band * index.width[text[k]] + start


def _words(codes: np.ndarray) -> np.ndarray:
    """Which characters are letters or digits."""
    kinds, of = np.unique(codes, return_inverse=True)
    return np.array([c < _GAP and chr(c).isalnum() for c in kinds.tolist()], bool)[of]


def _exact(index: SegmentIndex, joined: np.ndarray) -> list[tuple[int, int]]:
    """(segment, first character) of every place of a short text that no letter or digit continues."""
    if not index.exact or not len(joined):
        return []
    word = np.r_[False, _words(joined), False]
    inner = word[1:] & word[:-1]  # whether a word goes on over the place before character i
    out = []
    for n, (known, segment) in index.exact.items():
        free = np.flatnonzero(~inner[:max(0, len(joined) - n + 1)] & ~inner[n:][:max(0, len(joined) - n + 1)])
        pos, which = _found(known, _gram_hashes(joined, n)[free])
        for p, s in zip(free[pos].tolist(), segment[which].tolist()):
            if (joined[p:p + n] == index.chars[s, :n]).all():
                out.append((s, p))
    return out


def banded_distance(pattern: np.ndarray, length: np.ndarray, text: np.ndarray, first: np.ndarray,
                    budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits between each pattern and any run of ``text`` whose alignment begins on the
    diagonals first .. first + 2 budget + 1, and where the best run ends (exclusive). The band
    is widened by ``budget`` on both sides for the drift."""
    n, w = len(first), 4 * budget + 2
    off = np.arange(w)
    base = first - budget
    cost = np.zeros((n, w), np.int64)
    out, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    padded = np.concatenate([text, [_GAP]])
    for i in range(int(length.max()) if n else 0):
        at = base[:, None] + off + i
        here = padded[np.where((at >= 0) & (at < len(text)), at, len(text))]
        swap = cost + (here != pattern[:, i:i + 1])
        skip = np.concatenate([cost[:, 1:], np.full((n, 1), 1 << 30)], axis=1) + 1
        now = np.minimum(swap, skip)
        cost = np.minimum.accumulate(now - off, axis=1) + off  # a character of the text left out
        done = length == i + 1
        if done.any():
            best = cost[done].argmin(axis=1)
            out[done] = cost[done, best]
            end[done] = base[done] + best + i + 1
    return out, end


def search(index: SegmentIndex, texts: list[str], q: int = Q) -> list[tuple[int, int, int, int, int]]:
    """(text, segment, edits, start, end) of every text and segment with a verified region: the fewest
    edits, and from the first to the last region; positions are in the normalised text, start up to
    the edit budget."""
    codes = [_codes(t) for t in texts]
    gap = np.full(SEGMENT + q, _GAP, np.uint32)
    joined = np.concatenate([x for c in codes for x in (c, gap)]) if codes else gap[:0]
    begin = np.cumsum([0, *[len(c) + len(gap) for c in codes]])
    found = [np.zeros((0, 5), np.int64)]
    exact = _exact(index, joined)
    if exact:
        s, p = np.array(exact, np.int64).T
        t = np.searchsorted(begin, p, side="right") - 1
        found.append(np.stack([t, s, np.zeros(len(s), np.int64), p - begin[t], p + index.length[s] - begin[t]], axis=1))
    def align(seg: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Edits of each candidate; the verified ones become rows of ``found``."""
        out = np.zeros(len(seg), np.int64)
        for k in np.unique(index.budget[seg]):
            own = np.flatnonzero(index.budget[seg] == k)
            for part in np.array_split(own, -(-len(own) // 4096)):
                edits, end = banded_distance(index.chars[seg[part]], index.length[seg[part]], joined, first[part], int(k))
                out[part] = edits
                s, end, edits = seg[part][edits <= k], end[edits <= k], edits[edits <= k]
                t = np.searchsorted(begin, end - 1, side="right") - 1
                found.append(np.stack([t, s, edits, np.maximum(0, end - index.length[s] - begin[t]), end - begin[t]], axis=1))
        return out

    for pos, which in _windows(index, joined, q):
        seg, first = _bands(index, joined, pos, which)
        # the candidates of a segment in a text (a region begins within 3 k + 1 of its band's first diagonal, texts are
        # farther apart): where the outermost two match without an edit, those between them add nothing
        text = np.searchsorted(begin, first + 3 * index.budget[seg] + 1, side="right") - 1
        order = np.lexsort((first, seg, text))
        seg, first = seg[order], first[order]
        start = group_starts(text[order], seg)
        size = np.diff(np.r_[start, len(seg)])
        outer = np.zeros(len(seg), bool)
        outer[start] = outer[start + size - 1] = True
        edits = np.zeros(len(seg), np.int64)
        edits[outer] = align(seg[outer], first[outer])
        settled = np.repeat((edits[start] == 0) & (edits[start + size - 1] == 0), size)
        align(seg[~outer & ~settled], first[~outer & ~settled])
        found = [_reduced(np.concatenate(found))]  # a row per text and segment, however many windows
    return [tuple(r) for r in _reduced(np.concatenate(found)).tolist()]


def _reduced(rows: np.ndarray) -> np.ndarray:
    """Rows (text, segment, edits, start, end) merged by text and segment."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    start = group_starts(rows[:, 0], rows[:, 1])
    if not len(start):
        return rows
    return np.stack([rows[start, 0], rows[start, 1], np.minimum.reduceat(rows[:, 2], start),
                     np.minimum.reduceat(rows[:, 3], start), np.maximum.reduceat(rows[:, 4], start)], axis=1)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple]]:
    """The benchmark's texts, streamed and gathered into lists of at most ``limit`` characters
    (or one text); equal texts are searched for once per item id."""
    out, size = [], 0
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    for r in rows.distinct().orderBy("i", "t").toLocalIterator():
        text = normalized(r["t"])
        if not text:
            continue
        if out and size + len(text) > limit:
            yield out
            out, size = [], 0
        out.append((r["i"], text))
        size += len(text)
    if out:
        yield out


def _find(docs: DataFrame, items: list[tuple], error: float) -> DataFrame:
    index = docs.sparkSession.sparkContext.broadcast(SegmentIndex.build(items, SEGMENT, Q, error))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = search(index.value, [normalized(t) for t in part.column("text").to_pylist()])
                cols = list(zip(*found)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(cols[0], pa.int64())),
                     pa.array([index.value.item[s] for s in cols[1]], pa.int64()),
                     *[pa.array(c, pa.int64()) for c in (cols[1], cols[2], cols[3], cols[4])]],
                    ["id", "item_id", "segment", "edits", "start", "stop"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, item_id long, segment long, "
                                "edits long, start long, stop long")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text", error: float = ERROR,
          block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Passages of benchmark texts inside documents: one row per (document id, item id).

    Benchmark texts are cut into segments of 64 characters, one beginning every 6 (a shorter text
    is one segment). A segment with at most floor(0.1 length) edits in a document's normalised
    text is found for certain: such a region shares length + 1 - q (k + 1) q-grams or more in one
    band of diagonals. So is every excerpt of 64 characters or more with up to 3 edits, as a
    segment begins within 3 characters of it, and of 69 or more with up to 6. A text
    under 24 characters is found where it stands exactly, not continued by a letter or
    digit. Columns: id, item_id, n_segments (different segments found), edits
    (fewest of a region), start and stop (characters of the normalised text from the first to the
    last region).
    Documents without a leak give no row. Null texts hold nothing, null and empty
    benchmark texts are not searched for, documents with the same id are reported as
    one, item ids are whole numbers, empty tables give no rows. The benchmark is searched in
    blocks of bounded size, each one pass over the documents."""
    prepared(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t"))
    found = [_find(rows, b, error) for b in blocks(items, "i", "t", block_chars)]
    if not found:
        kind = rows.schema["id"].dataType.simpleString()
        found = [docs.sparkSession.createDataFrame([], f"id {kind}, item_id long, segment long, edits long, "
                                                       "start long, stop long")]
    all_found = found[0]
    for f in found[1:]:
        all_found = all_found.unionByName(f)
    return (all_found.groupBy("id", "item_id").agg(
        F.count_distinct("segment").alias("n_segments"), F.min("edits").alias("edits"), F.min("start").alias("start"), F.max("stop").alias("stop"))
        .withColumnRenamed("id", id_col))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", error: float = ERROR, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no passage of a benchmark text, as ``leaks`` finds them, with
    all their columns. Row by row, so rows with null or equal ids are judged by their own text."""
    prepared(docs.sparkSession)
    cols = docs.columns
    fields = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(cols))
    out = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    text = f"c{cols.index(text_col)}"
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t"))
    for block in blocks(items, "i", "t", block_chars):
        index = docs.sparkSession.sparkContext.broadcast(SegmentIndex.build(block, SEGMENT, Q, error))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text):
                    clean = np.ones(part.num_rows, bool)
                    clean[[f[0] for f in search(index.value, [normalized(t) for t in part.column(text).to_pylist()])]] = False
                    yield part.filter(pa.array(clean))

        out = out.mapInArrow(run, fields)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of a benchmark text, with the item."""
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLE: dict[str, str] = {}
