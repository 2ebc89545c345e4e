"""Language ID: nearest centroid among several per language, over TF-IDF byte n-gram vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlog.llm.common import prepared, slices, text_bytes
from learnlog.sources.tables import read_table

#: Hashed dimensions: half for pairs, half for triples of bytes.
DIMS = 8192
UNKNOWN = "und"
#: Rows whose dense count vectors are held at once.
ROWS = 64
#: Length classes (log2 of a text's n-grams), steps that cosines are counted in, and the fewest
#: rows that give a class of a language its own bound.
CLASSES, STEPS, LEAST_ROWS = 32, 1000, 20
_LETTER = regex.compile(r"\p{L}")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ngram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts (rows x DIMS) of hashed byte pairs and triples, ASCII letters in lower case."""
    n, half = len(offsets) - 1, DIMS // 2
    b = _LOWER[data].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    out = np.zeros(n * DIMS, np.int64)
    for k, base in ((2, 0), (3, half)):
        if len(b) < k:
            continue
        gram = b[:len(b) - k + 1].copy()
        for j in range(1, k):
            gram = (gram << np.uint32(8)) | b[j:len(b) - k + 1 + j]
        inside = row[:len(gram)] == row[k - 1:]
        dim = (gram * np.uint32(2654435761)) >> np.uint32(32 - half.bit_length() + 1)
        out += np.bincount(row[:len(gram)][inside] * DIMS + base + dim[inside], minlength=n * DIMS)
    return out.reshape(n, DIMS)


def length_class(counts: np.ndarray) -> np.ndarray:
    """Whole part of log2 of the number of n-grams per row."""
    return np.minimum(np.log2(np.maximum(counts.sum(axis=1), 1)).astype(np.int64), CLASSES - 1)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length 1 (a row without n-grams stays 0)."""
    x = np.log1p(counts.astype(np.float32)) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


@dataclass
class LanguageModel:
    idf: np.ndarray          # DIMS
    centroids: np.ndarray    # k x DIMS, length 1
    names: list[str]         # language per centroid
    floor: np.ndarray        # least cosine that counts, per centroid (its language's) and length class

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest centroid, its cosine) per row."""
        cos = np.clip(weighted(counts, self.idf) @ self.centroids.T, 0, 1)
        best = cos.argmax(axis=1)
        return best, cos[np.arange(len(cos)), best].astype(np.float64)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest centroid, its cosine, whether it is too far) per row."""
        best, top = self.nearest(counts)
        return best, top, top < self.floor[best, length_class(counts)]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Up to k centroids of length 1 of rows of length 1; starts from rows far apart."""
    pick = [0]
    near = x @ x[0]
    while len(pick) < min(k, len(x)):
        far = int(near.argmin())
        pick.append(far)
        near = np.maximum(near, x @ x[far])
    c = x[pick]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def _counted(docs: DataFrame, schema: str, make) -> DataFrame:
    """mapInArrow over (id, text, ...) in slices: ``make(part, counts)`` gives a record batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", rows=ROWS):
                yield make(part, ngram_counts(*text_bytes(part.column("text"))))

    prepared(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all rows each dimension occurs, and the number of rows. Every task sums
    its own rows; what is gathered is one number per dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for part in slices(batch, "text", rows=ROWS):
                df += (ngram_counts(*text_bytes(part.column("text"))) > 0).sum(axis=0)
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(np.append(df, n))], ["dim", "n"])

    prepared(docs.sparkSession)
    got = (docs.select(F.col(text_col).alias("text")).mapInArrow(run, "dim long, n long")
           .groupBy("dim").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(DIMS + 1, np.int64)
    for r in got:
        out[r["dim"]] = r["n"]
    return out[:DIMS], int(out[DIMS])


def rejection_bounds(learn: DataFrame, model: LanguageModel, share: float, slack: float) -> np.ndarray:
    """Per language of ``model.names`` and length class: ``slack`` times the cosine that a
    ``share`` of the rows of ``learn`` (id, text, lang) stays below, over all rows whose nearest
    centroid is of their own language. With few rows the quantile is hardly below their mean, so
    the factor falls to 1/2 as ``share`` of them falls from one row to none.

    A class of fewer than LEAST_ROWS rows takes the bound of the next shorter one that has
    them, if none is shorter the next longer one's, times the square root of the ratio of lengths (the
    cosine of a few n-grams with a centroid grows so). A language without such a class takes the
    least bound of the others, without any all texts pass."""
    langs = sorted(set(model.names))
    code = {lang: i for i, lang in enumerate(langs)}
    of = np.array([code[lang] for lang in model.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text", rows=ROWS):
                counts = ngram_counts(*text_bytes(part.column("text")))
                best, top = model.nearest(counts)
                label = np.array([code.get(lang, -1) for lang in part.column("lang").to_pylist()])
                own = (of[best] == label) & counts.any(axis=1)
                key = (label * CLASSES + length_class(counts)) * (STEPS + 1) + (top * STEPS).astype(np.int64)
                seen.update(key[own].tolist())
        key = np.array(sorted(seen), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key // (STEPS + 1)), pa.array(key % (STEPS + 1)), pa.array([seen[k] for k in key.tolist()], pa.int64())],
            ["cell", "step", "n"])

    prepared(learn.sparkSession)
    got = (learn.mapInArrow(run, "cell long, step long, n long").groupBy("cell", "step").agg(F.sum("n").alias("n"))
           .groupBy("cell").agg(F.percentile("step", share, F.col("n")).alias("low"), F.sum("n").alias("n"))
           .where(F.col("n") >= LEAST_ROWS).collect())  # one row per language and length class
    known = {divmod(r["cell"], CLASSES): (0.5 + (slack - 0.5) * min(1.0, share * r["n"])) * float(r["low"]) / STEPS
             for r in got}
    out = np.zeros((len(langs), CLASSES))
    lost = []
    for i in range(len(langs)):
        have = [c for c in range(CLASSES) if (i, c) in known]
        if not have:
            lost.append(i)
            continue
        for c in range(CLASSES):
            at = max((x for x in have if x <= c), default=have[0])
            out[i, c] = known[i, at] * min(1.0, 2.0 ** ((c - at) / 2))
    told = np.setdiff1d(np.arange(len(langs)), lost)
    out[lost] = out[told].min(axis=0) if len(told) else 0.0
    return out[of]


def train(learn: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          clusters: int = 4, max_sample: int = 2000, share: float = 0.005, slack: float = 0.9) -> LanguageModel | None:
    """Fit centroids on ``learn`` (null languages are left out); None if nothing is labelled.

    Document frequencies come from all rows of ``learn``. The centroids are fitted on a sample of
    about ``max_sample`` rows in all, spread evenly over the languages and chosen by a hash of the id; the row
    of the smallest hash of every language is in it, so none is left out. The model has up to
    ``clusters`` centroids per language. A language's rows are clustered into ``clusters`` centroids; a text is
    rejected if its cosine with the nearest centroid is below the bound of that centroid's language
    for texts of its length, which ``rejection_bounds`` takes from all rows of ``learn``."""
    learn = learn.where(F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    chance = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_003)) / 1_000_003.0
    sizes = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(chance).alias("least")).collect()
    if not sizes:
        return None
    each = max(1, max_sample // len(sizes))
    # the row of the smallest hash is always in
    shares = learn.sparkSession.createDataFrame(
        [(r["lang"], min(1.0, max(each / r["n"], r["least"] + 1e-7))) for r in sizes], "lang string, share double")

    def make(part: pa.RecordBatch, counts: np.ndarray) -> pa.RecordBatch:
        packed = []
        for row in counts:
            dims = np.flatnonzero(row)
            packed.append(dims.astype("<u2").tobytes() + row[dims].astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays([part.column("lang"), part.column("id"), pa.array(packed, pa.binary())],
                                          ["lang", "id", "counts"])

    kind = learn.schema["id"].dataType.simpleString()
    # a row per language, as the model has: broadcast like it
    sample = learn.join(F.broadcast(shares), "lang").where(chance < F.col("share")).drop("share")
    rows = _counted(sample, f"lang string, id {kind}, counts binary", make).collect()
    df, n = document_frequencies(learn)
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)
    centroids, names = [], []
    for lang in sorted({r["lang"] for r in rows}):
        own = sorted((r["id"] is None, r["id"], bytes(r["counts"])) for r in rows if r["lang"] == lang)
        counts = np.zeros((len(own), DIMS), np.int64)
        for i, (_, _, raw) in enumerate(own):
            k = len(raw) // 6
            counts[i, np.frombuffer(raw[:2 * k], "<u2")] = np.frombuffer(raw[2 * k:], "<u4")
        x = weighted(counts[counts.any(axis=1)], idf)
        if not len(x):
            continue
        c = spherical_kmeans(x, clusters)
        centroids.extend(c)
        names.extend([lang] * len(c))
    if not names:
        return None
    model = LanguageModel(idf, np.stack(centroids).astype(np.float32), names, np.zeros((len(names), CLASSES)))
    model.floor = rejection_bounds(learn, model, share, slack)
    return model


_OUT = "lang_pred string, score double, rejected boolean"


def identify(docs: DataFrame, model: LanguageModel | None, text_col: str = "text",
             columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (default: all) with lang_pred, score and rejected added (columns of
    these names are replaced).

    lang_pred: the language of the nearest centroid, or ``und`` where the text is null or has
    no letter (score 0), or where there is no model. score: cosine with that centroid, 0 to 1. rejected:
    ``und``, or farther from the nearest centroid than the model's bound. Whole texts count;
    rows are kept as they are, repeated ones too; an empty table gives no rows."""
    keep = [c for c in columns or docs.columns if c not in ("lang_pred", "score", "rejected")]

    def make(part: pa.RecordBatch, counts: np.ndarray) -> pa.RecordBatch:
        letters = [t is not None and _LETTER.search(t) is not None for t in part.column("text").to_pylist()]
        if model is None:
            best, top, far = None, np.zeros(len(counts)), np.ones(len(counts), bool)
        else:
            best, top, far = model.predict(counts)
        lang = [model.names[b] if ok and model else UNKNOWN for ok, b in
                zip(letters, best if best is not None else letters)]
        ok = np.array(letters, bool)
        return pa.RecordBatch.from_arrays(
            [*[part.column(c) for c in range(len(keep))], pa.array(lang, pa.string()),
             pa.array(np.where(ok, top, 0.0)), pa.array(far | ~ok)],
            [*[f"c{i}" for i in range(len(keep))], "lang_pred", "score", "rejected"])

    # positional names inside, so that no column of the table clashes with another
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)],
                        F.col(text_col).alias("text"))
    fields = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = _counted(inner, f"{fields}, {_OUT}", make)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "rejected")


def id_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")), F.lit(folds))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; rows of fold 2 of 4 are held out from learning."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(id_fold("doc_id", 4) != 2))
    return identify(docs, model, columns=["doc_id"]).select(
        "doc_id", (id_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op7_language": op7_language}
ORACLE: dict[str, str] = {}
