"""Nearest neighbours by cosine for many query rows: an inverted file.

Centroids come from a bounded sample; every row is assigned to the list of its nearest centroid. A
search scores the rows of the lists nearest to each query exactly, block against block: a hot list is
dealt out by its blocks and no task holds more than two of them. With ``exact`` the lists that
could still hold a better row (by their radius) are scored too, so the result is that of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from learnlog.session import ship_package, written

#: Scores are rounded, so near-ties rank deterministically (ties by id).
DIGITS = 6


@dataclass
class InvertedFile:
    centroids: np.ndarray      # lists x dim, unit length; empty without a usable row
    rows: DataFrame            # id, unit (vector of unit length), list
    sizes: dict[int, int]      # rows per list that has any
    least: dict[int, float]    # smallest cosine of a list's rows with its centroid
    probes: int                # lists a query looks at


def centroids_of(x: np.ndarray, lists: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Spherical k-means over unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c


def probes_for(x: np.ndarray, c: np.ndarray, k: int, recall: float, queries: int = 512) -> int:
    """The fewest lists in which the sample's own rows find ``recall`` of their ``k`` nearest."""
    q = x[:queries]
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -2
    k = min(k, len(x) - 1)
    if k <= 0:
        return len(c)
    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
    place = (-(q @ c.T)).argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
    needed = np.take_along_axis(place, (x @ c.T).argmax(axis=1)[best], axis=1)
    return int(np.sort(needed.ravel())[max(int(np.ceil(recall * needed.size)) - 1, 0)]) + 1


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _unit(v: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(a, np.float64) for a in v])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def build(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", lists: int = 64,
          max_sample: int = 4096, k: int = 10, recall: float = 0.95) -> InvertedFile:
    """Index every row of ``vectors``. At most ``max_sample`` rows, chosen by a hash of the id, give the
    ``lists`` centroids and the number of probes at which that sample finds ``recall`` of its ``k`` nearest.

    Rows with a null id, a null or zero vector, a null or non-finite component, or another length than most of the
    sample are left out. Repeated rows stay; other columns are ignored; an empty table gives an empty index."""
    spark = vectors.sparkSession
    ship_package(spark)
    usable = _usable(vectors, id_col, vec_col)
    sample = [np.array(r["v"]) for r in usable.orderBy(F.xxhash64("id"), "id", F.xxhash64("v")).limit(max_sample).collect()]
    kind = usable.schema["id"].dataType.simpleString()
    if not sample:
        rows = spark.createDataFrame([], f"id {kind}, unit array<double>, list int, near double")
        return InvertedFile(np.zeros((0, 0)), rows, {}, {}, 0)
    widths = [len(x) for x in sample]
    dim = max(set(widths), key=lambda n: (widths.count(n), n))
    x = _unit(pd.Series([x for x in sample if len(x) == dim]))
    c = centroids_of(x, lists)

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                unit = _unit(part["v"])
                s = unit @ c.T
                yield pd.DataFrame({"id": part["id"], "unit": list(unit), "list": s.argmax(axis=1).astype(np.int32),
                                    "near": s.max(axis=1)})

    rows = written(usable.where(F.size("v") == dim).mapInPandas(
        assign, f"id {kind}, unit array<double>, list int, near double"), "inverted-file")
    stats = rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("least")).collect()  # a row a list
    return InvertedFile(c, rows, {r["list"]: r["n"] for r in stats}, {r["list"]: r["least"] for r in stats},
                        probes_for(x, c, k, recall))


def _scores(index: InvertedFile, wanted: DataFrame, k: int, block: int) -> DataFrame:
    """(query, id, score): the ``k`` best rows of every block of every wanted (query, unit, list)."""
    spark = wanted.sparkSession
    asked = {r["list"]: r["n"] for r in wanted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a list
    kind = index.rows.schema["id"].dataType.simpleString()
    out = f"query {kind}, id {kind}, score double"
    parts = [(i, -(-index.sizes[i] // block), -(-n // block)) for i, n in asked.items() if i in index.sizes]
    if not parts:
        return spark.createDataFrame([], out)
    table = F.broadcast(spark.createDataFrame(parts, "list int, nb int, nq int"))  # a row a list
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.rows.join(table, "list").select(
        "list", F.pmod(F.xxhash64("id", "unit"), "nb").cast("int").alias("b"), upto("nq").alias("q"), "id", "unit")
    right = wanted.join(table, "list").select(
        "list", upto("nb").alias("b"), F.pmod(F.xxhash64("query"), "nq").cast("int").alias("q"), "query", "unit")

    def best(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asks):
            return pd.DataFrame({"query": asks["query"][:0], "id": rows["id"][:0], "score": np.zeros(0)})
        ids, queries = rows["id"].to_numpy(), asks["query"].to_numpy()
        s = np.round(np.stack(asks["unit"]) @ np.stack(rows["unit"]).T, DIGITS)
        s[queries[:, None] == ids[None, :]] = -2
        m = min(k, len(ids))
        least = -np.partition(-s, m - 1, axis=1)[:, m - 1]
        at, row = np.nonzero((s >= least[:, None]) & (s > -2))
        order = np.lexsort((ids[row], -s[at, row], at))
        at, row = at[order], row[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        at, row = at[rank < k], row[rank < k]
        return pd.DataFrame({"query": queries[at], "id": ids[row], "score": s[at, row]})

    keys = ["list", "b", "q"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, out)


def search(index: InvertedFile, queries: DataFrame, k: int = 10, probes: int | None = None, exact: bool = False,
           id_col: str = "vec_id", vec_col: str = "embedding", block: int = 4096) -> DataFrame:
    """(query_id, rank, neighbour_id, score): the ``k`` rows most similar to each row of ``queries``, without rows of the
    same id; fewer where the lists looked at hold fewer.

    ``probes`` lists per query (default: the index's); ``exact`` looks at all that can change the result.
    Queries that the index would leave out give no rows; ids are expected once in ``queries``."""
    spark = queries.sparkSession
    ship_package(spark)
    c, sizes = index.centroids, sorted(index.sizes)
    kind = index.rows.schema["id"].dataType.simpleString()
    if not len(c):
        return spark.createDataFrame([], f"query_id {kind}, rank int, neighbour_id {kind}, score double")
    held = np.array(sizes, np.int64)
    radius = np.arccos(np.clip([index.least[i] for i in sizes], -1, 1))
    probes = max(1, probes or index.probes)

    def nearest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                unit = _unit(part["v"])
                order = (-(unit @ c[held].T)).argsort(axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"query": part["id"], "unit": list(unit), "lists": list(held[order].astype(np.int32))})

    def others(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                unit = np.stack(part["unit"])
                angle = np.arccos(np.clip(unit @ c[held].T, -1, 1))
                most = np.cos(np.maximum(angle - radius, 0))
                may = most >= part["bound"].to_numpy()[:, None] - 2 * 10.0 ** -DIGITS
                yield pd.DataFrame({"query": part["query"], "unit": part["unit"], "lists": [
                    np.setdiff1d(held[m], seen).astype(np.int32) for m, seen in zip(may, part["lists"])]})

    schema = f"query {kind}, unit array<double>, lists array<int>"
    asked = written(_usable(queries, id_col, vec_col).where(F.size("v") == c.shape[1]).mapInPandas(nearest, schema), "queries")
    spread = lambda df: df.select("query", "unit", F.explode("lists").alias("list"))
    found = _scores(index, spread(asked), k, block)
    if exact:
        w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
        found = written(found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r"), "near")
        bound = found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
        rest = written(asked.join(bound, "query", "left").withColumn(
            "bound", F.when(F.col("n") >= k, F.col("worst")).otherwise(F.lit(-2.0)))
            .select("query", "unit", "lists", "bound").mapInPandas(others, schema), "further-lists")
        found = found.unionByName(_scores(index, spread(rest), k, block))
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(F.col("query").alias("query_id"), "rank", F.col("id").alias("neighbour_id"), "score"))
