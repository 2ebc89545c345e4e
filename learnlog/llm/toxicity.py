"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlog.llm.common import materialize, prepared, slices, text_bytes, word_hashes
from learnlog.llm.language import id_fold
from learnlog.sources.tables import read_table

#: Words are runs of ASCII letters and digits and of bytes above 127, ASCII in lower case.
_SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PROFILE = 1 << 14
#: Steps of one logit that calibration counts in, and the largest logit told apart.
STEPS, MOST = 50, 100
#: Words that one pass of the filters handles: a text of any length takes bounded memory.
WORDS = 1 << 16
#: Bits of the filter by which documents without a label are passed over before they are scored.
FILTER_BITS = 1 << 24


def words_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(part.column("text"))
    return word_hashes(_LOWER[data], offsets, _SEPARATOR)


@dataclass
class ConvNet:
    """Word vectors from two hashed tables (a word is the sum of its two rows), filters of
    several widths over consecutive words, the largest response of each filter in a text, and a
    logistic output. ``profile``: log-probabilities of hashed words per language, by which a
    text picks the threshold that its logit is measured against."""

    buckets: int = 1 << 17
    dim: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 6
    tables: np.ndarray = None          # 2 x buckets x dim
    weight: list[np.ndarray] = field(default_factory=list)   # per width: width*dim x filters
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray = None
    out_bias: float = 0.0
    profile: np.ndarray = None         # languages x _PROFILE
    threshold: np.ndarray = None       # per language
    names: list[str] = field(default_factory=list)           # languages

    def rows(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = np.uint64(self.buckets - 1)
        return (h & m).astype(np.int64), ((h >> np.uint64(32)) & m).astype(np.int64)

    def pooled(self, h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Largest response (n x all filters; 0 where no filter fires) and the first word of
        the run that gave it (-1: none). ``WORDS`` runs at a time, the largest so far is kept."""
        best = np.zeros((n, len(self.widths) * self.filters), np.float32)
        where = np.full(best.shape, -1, np.int64)
        wide = max(self.widths)
        for at in range(0, len(h), WORDS):
            a, b = self.rows(h[at:at + WORDS + wide - 1])
            x = self.tables[0][a] + self.tables[1][b]
            for i, k in enumerate(self.widths):
                m = min(len(x) - k + 1, WORDS)
                if m <= 0:
                    continue
                z = np.concatenate([x[j:m + j] for j in range(k)], axis=1) @ self.weight[i] + self.bias[i]
                own = row[at:at + m]
                z[own != row[at + k - 1:at + k - 1 + m]] = 0
                start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                top = np.maximum.reduceat(z, start, axis=0)
                size = np.diff(np.r_[start, m])
                for f in range(self.filters):
                    c = i * self.filters + f
                    more = top[:, f] > best[own[start], c]
                    hit = np.flatnonzero((z[:, f] >= np.repeat(top[:, f], size)) & np.repeat(more, size))
                    where[own[hit[::-1]], c] = hit[::-1] + at
                    best[own[start[more]], c] = top[more, f]
        return best, where

    def logits(self, h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        best, _ = self.pooled(h, row, n)
        return best @ self.out + self.out_bias

    def language(self, h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        slot = ((h >> np.uint64(17)) % np.uint64(_PROFILE)).astype(np.int64)
        return np.stack([np.bincount(row, weights=p[slot], minlength=n) for p in self.profile]).argmax(axis=0)

    def scores(self, h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        z = self.logits(h, row, n) - self.threshold[self.language(h, row, n)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))

    def step(self, h: np.ndarray, row: np.ndarray, y: np.ndarray, w: np.ndarray, rate: float) -> None:
        """One gradient step of the weighted log loss on a batch of texts."""
        n = len(y)
        best, where = self.pooled(h, row, n)
        p = 1 / (1 + np.exp(-np.clip(best @ self.out + self.out_bias, -30, 30)))
        g = (w * (p - y) / w.sum()).astype(np.float32)
        back = g[:, None] * self.out[None, :]
        self.out -= rate * (best.T @ g)
        self.out_bias -= rate * float(g.sum())
        a, b = self.rows(h)
        for i, k in enumerate(self.widths):
            for f in range(self.filters):
                c = i * self.filters + f
                t = np.flatnonzero(where[:, c] >= 0)
                if not len(t):
                    continue
                at = where[t, c][:, None] + np.arange(k)
                x = (self.tables[0][a[at]] + self.tables[1][b[at]]).reshape(len(t), -1)
                grad = back[t, c][:, None]
                dx = (grad * self.weight[i][:, f]).reshape(-1, self.dim)
                self.weight[i][:, f] -= rate * (x * grad).sum(axis=0)
                self.bias[i][f] -= rate * float(grad.sum())
                np.subtract.at(self.tables[0], a[at].ravel(), rate * dx)
                np.subtract.at(self.tables[1], b[at].ravel(), rate * dx)


def held_out(n: int) -> np.ndarray:
    """Which of n texts calibrate instead of being learned from."""
    return np.arange(n) % 5 == 4


def widest_cut(z: np.ndarray, y: np.ndarray, weight: np.ndarray, least: float, slip: float) -> float | None:
    """Of the thresholds for z that come within 3 % of the positive weight, or ``slip``, of the
    best weighted accuracy, the one in the widest gap; None where either label has fewer than
    ``least`` of the weight."""
    if (weight * y).sum() < least or (weight * (1 - y)).sum() < least:
        return None
    order = np.argsort(-z, kind="stable")
    gain = np.cumsum(weight[order] * (2 * y[order] - 1))
    near = np.flatnonzero(gain >= gain.max() - max(slip, 0.03 * (weight * y).sum()))
    near = near[near + 1 < len(order)]
    if not len(near):
        return None
    k = int(near[(z[order[near]] - z[order[near + 1]]).argmax()])
    return float((z[order[k]] + z[order[k + 1]]) / 2)


def binned_cut(z: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> float:
    """The same over counts of either label per ascending value of z (two values at least)."""
    gain = np.cumsum((pos - neg)[::-1])[:-1]   # cut below the i-th highest value
    near = np.flatnonzero(gain >= max(gain.max(), 0) - max(1, 0.03 * pos.sum()))
    if not len(near):
        near = np.array([gain.argmax()])
    down = z[::-1]
    k = int(near[(down[near] - down[near + 1]).argmax()])
    return float((down[k] + down[k + 1]) / 2)


def fit(texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, lang: list[str], epochs: int = 12,
        rate: float = 1.0, seed: int = 7) -> ConvNet:
    """Train on word hashes per text; one text in five (``held_out``) calibrates the thresholds.

    The first coordinate of a table row starts at the shrunken log-odds of the label among texts
    with a word of that row, the others at small random values. ``weight``: how many rows of
    the whole a text stands for. Of the thresholds that come within 3 % of the
    positive weight of the best weighted accuracy, the one in the widest gap is taken, for a
    language over its calibration texts, or over all where it has few of either label
    (``train`` replaces these by thresholds over all labelled documents)."""
    rng = np.random.default_rng(seed)
    net = ConvNet()
    n = len(texts)
    row = np.repeat(np.arange(n), [len(t) for t in texts])
    h = np.concatenate(texts) if n else np.zeros(0, np.uint64)
    held = held_out(n)
    net.tables = rng.normal(0, 0.1, (2, net.buckets, net.dim)).astype(np.float32)
    prior = min(max(float((weight * y).sum() / max(weight.sum(), 1e-9)), 0.01), 0.99)
    learn = ~held[row]
    for t, slot in enumerate(net.rows(h)):
        word, text = np.divmod(np.unique(slot[learn] * n + row[learn]), max(n, 1))
        of = np.bincount(word, weights=weight[text] * y[text], minlength=net.buckets)
        al = np.bincount(word, weights=weight[text], minlength=net.buckets)
        m = 20 * weight.mean() if n else 1.0
        odds = np.log((of + m * prior) / (al - of + m * (1 - prior))) - np.log(prior / (1 - prior))
        net.tables[t, :, 0] += odds / 2
    net.weight = [rng.normal(0, 0.3 / np.sqrt(k), (k * net.dim, net.filters)).astype(np.float32) for k in net.widths]
    for i, k in enumerate(net.widths):
        for j in range(k):
            net.weight[i][j * net.dim] += rng.uniform(0.5, 1.0, net.filters) / k
    net.bias = [np.zeros(net.filters, np.float32) for _ in net.widths]
    net.out = np.full(len(net.widths) * net.filters, 0.2, np.float32)
    net.out_bias = -2.0
    ends = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    ids = np.flatnonzero(~held)
    for epoch in range(epochs if len(ids) else 0):
        for batch in np.array_split(rng.permutation(ids), -(-len(ids) // 64)):
            take = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in batch])
            if not len(take):
                continue
            local = np.repeat(np.arange(len(batch)), np.diff(ends)[batch])
            net.step(h[take], local, y[batch], weight[batch], rate / (1 + epoch / 4))
    names = sorted(set(lang)) or [""]
    code = np.array([names.index(x) for x in lang], np.int64)
    slot = ((h >> np.uint64(17)) % np.uint64(_PROFILE)).astype(np.int64)
    net.profile = np.stack([np.log((np.bincount(slot[code[row] == c], minlength=_PROFILE) + 0.1)
                                   / ((code[row] == c).sum() + 0.1 * _PROFILE)) for c in range(len(names))])
    z = net.logits(h, row, n) if n else np.zeros(0)

    def best_cut(of: np.ndarray) -> float | None:
        if y[of].sum() < 10 or (1 - y[of]).sum() < 10:
            return None
        return widest_cut(z[of], y[of], weight[of], 0, weight.max())

    calibrate = np.flatnonzero(held)
    overall = best_cut(calibrate)
    overall = overall if overall is not None else best_cut(np.arange(n))
    overall = overall if overall is not None else 0.0
    cuts = [best_cut(calibrate[code[calibrate] == c]) for c in range(len(names))]
    net.threshold = np.array([overall if c is None else c for c in cuts])
    net.names = names
    return net


def labelled(docs: DataFrame, known: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` that may have an id in ``known``, and surely all that have one: the ids set one of ``bits``
    bits each, a table of ``bits`` / 64 words at most, which is broadcast whatever the tables' sizes."""
    slot = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = known.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(63).cast("int"))).alias("set"))
    at = F.call_function("getbit", F.col("set"), slot.bitwiseAND(63).cast("int"))
    return (docs.withColumn("word", F.shiftright(slot, 6)).join(F.broadcast(words), "word")
            .where(at == 1).select(*docs.columns))


def calibrated(docs: DataFrame, known: DataFrame, trained: list, net: ConvNet) -> np.ndarray:
    """The threshold of each of ``net.names`` from the logits of all documents (id, text, lang) in
    ``known`` (id, y, whatever their length), counted by language, step of the logit and label.

    Documents whose id is in ``trained`` count only where the others of a language have fewer
    than ten of either label; a language that has too few even so gets the threshold of all."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)  # a size fixed by ConvNet

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                z = shared.value.logits(*words_of(part), part.num_rows)
                step = np.floor(np.clip(z, -MOST, MOST) * STEPS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("lang"), pa.array(step)],
                                                 ["id", "lang", "step"])

    kind = docs.schema["id"].dataType.simpleString()
    # texts are scored where they are read: only ids, languages and steps meet the labels
    logits = labelled(docs.select("id", "text", "lang"), known).mapInArrow(run, f"id {kind}, lang string, step long")
    seen = spark.createDataFrame([(i,) for i in sorted(set(trained))], f"id {kind}").withColumn("used", F.lit(1))
    got = (logits.join(known, "id").join(F.broadcast(seen), "id", "left")
           .groupBy(F.coalesce("lang", F.lit("")).alias("lang"), F.col("used").isNotNull().alias("used"), "step",
                    F.col("y").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect())
    lang = np.array([r["lang"] for r in got], object)
    used = np.array([r["used"] for r in got], bool)
    z = (np.array([r["step"] for r in got], np.float64) + 0.5) / STEPS
    y = np.array([r["y"] for r in got], np.float64)
    n = np.array([r["n"] for r in got], np.float64)

    def cut(of: np.ndarray) -> float | None:
        for rows in (of & ~used, of):
            steps, at = np.unique(z[rows], return_inverse=True)
            pos = np.bincount(at, weights=n[rows] * y[rows], minlength=len(steps))
            neg = np.bincount(at, weights=n[rows] * (1 - y[rows]), minlength=len(steps))
            if pos.sum() >= 10 and neg.sum() >= 10 and len(steps) > 1:
                return binned_cut(steps, pos, neg)
        return None

    overall = cut(np.ones(len(got), bool))
    own = [cut(lang == name) for name in net.names]
    return np.array([c if c is not None else overall if overall is not None else t
                     for c, t in zip(own, net.threshold)])


def within(picked: list, max_bytes: int) -> list:
    """Of ``picked`` (id, y, lang, size, u) by rising u, which does not depend on the size: rows up to the one with
    which the texts come to ``max_bytes``, and the first of either label."""
    picked = sorted(picked, key=lambda r: (r["u"], r["id"]))
    before = np.cumsum([0, *[r["size"] for r in picked]])[:-1]
    first = {v: next((i for i, r in enumerate(picked) if r["y"] == v), -1) for v in (0, 1)}
    return [r for i, r in enumerate(picked) if before[i] < max_bytes or i in first.values()]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, max_bytes: int = 32 << 20,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          label_col: str = "toxic") -> ConvNet | None:
    """Fit on a bounded sample of labelled documents; None without labels of both kinds. The
    thresholds come from all labelled documents (``calibrated``).

    About ``max_rows`` labelled ids, half of either label where there are as many, chosen by
    a hash of the id; half of them in proportion to the languages and half evenly over them. Texts are
    learned from whole; where they come to more than ``max_bytes`` together, fewer ids are taken, by the
    same hash whatever their length (the last may pass the bound, so memory is that and one text).
    Labels given twice count as the larger; null labels and ids are left out. ``lang_col`` is read
    here only, to learn which words tell the languages apart and for the thresholds; an id with several
    languages counts with the first."""
    spark = docs.sparkSession
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y")))
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sized = docs.select("id", "lang", F.octet_length("text").cast("long").alias("size"))
    cells = materialize(sized.join(known, "id").groupBy("id", "y").agg(
        F.coalesce(F.min("lang"), F.lit("")).alias("lang"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")),
        "labelled", tidy=False)
    sizes = {(r["y"], r["lang"]): r["n"]
             for r in cells.groupBy("y", "lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language and label
    total = {v: sum(n for (w, _), n in sizes.items() if w == v) for v in (0, 1)}
    if not total[0] or not total[1]:
        return None
    each = {v: min(total[v], max(max_rows // 2, max_rows - total[1 - v])) for v in (0, 1)}
    kinds = {v: sum(w == v for w, _ in sizes) for v in (0, 1)}
    share = [(v, lang, 1.0 if each[v] == total[v] else (each[v] / total[v] + each[v] / kinds[v] / n) / 2)
             for (v, lang), n in sizes.items() if v in (0, 1)]
    shares = spark.createDataFrame(share, f"y {known.schema['y'].dataType.simpleString()}, lang string, share double")
    chance = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_003)) / 1_000_003.0
    picked = within(cells.join(F.broadcast(shares), ["y", "lang"]).where(chance < F.col("share"))
                    .select("id", "y", "lang", "size", (chance / F.col("share")).alias("u")).collect(), max_bytes)
    kind = known.schema["id"].dataType.simpleString()
    ids = spark.createDataFrame([(r["id"], r["y"], r["lang"]) for r in picked],
                                f"id {kind}, y {known.schema['y'].dataType.simpleString()}, lang string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, row = words_of(part)
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                raw = [h[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("lang"), part.column("y"), pa.array(raw, pa.binary())],
                    ["id", "lang", "y", "words"])

    prepared(spark)
    # about max_rows ids and max_bytes of text: bounded by the parameters
    rows = (docs.select("id", "text").join(F.broadcast(ids), "id")
            .select("id", "text", "lang", F.col("y").cast("int").alias("y"))
            .mapInArrow(run, f"id {kind}, lang string, y int, words binary").collect())
    rows = sorted(rows, key=lambda r: (r["id"], bytes(r["words"])))
    y = np.array([r["y"] for r in rows], np.float64)
    there = Counter((r["y"], r["lang"]) for r in rows)
    weight = np.array([sizes[r["y"], r["lang"]] / there[r["y"], r["lang"]] for r in rows])
    net = fit([np.frombuffer(r["words"], np.uint64) for r in rows], y, weight / weight.mean(),
              [r["lang"] for r in rows])
    learned = np.flatnonzero(~held_out(len(rows)))
    net.threshold = calibrated(docs, known, [rows[i]["id"] for i in learned], net)
    return net


def score(docs: DataFrame, net: ConvNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, score (0 to 1), predicted (score >= 0.5) for every row, from its text alone.

    Null text counts as empty and gets the score of a text without words; without a model every
    score is 0. Repeated rows are kept, other columns ignored, an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a size fixed by ConvNet

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                s = model.scores(*words_of(part), n) if model else np.zeros(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                    ["id", "score", "predicted"])

    prepared(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of fold 0 of 5 are held out from learning."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = read_table(spark, sf_dir, "labels").where(id_fold("doc_id", 5) != 0)
    net = train(docs, labels)
    return score(docs, net).select("doc_id", (id_fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE: dict[str, str] = {}
