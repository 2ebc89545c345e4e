"""Cosine top-k over stored vectors.

The query vector is one value, fetched with a scalar subquery (evaluated once, shipped
with the plan as a constant) - no join, no driver round trip. Scores are row-wise array arithmetic in the JVM; the top-k is a
``TakeOrderedAndProject`` (each task keeps k rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def _norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def cosine_scores(vectors: DataFrame, query: Column, id_col: str = "vec_id",
                  vec_col: str = "embedding", digits: int = 6) -> DataFrame:
    """Cosine similarity to ``query``; zero-norm vectors (either side) are left out,
    scores are rounded so near-ties rank deterministically (ties by id)."""
    v = F.col(vec_col)
    nv, nq = _norm(v), _norm(query)
    scored = vectors.select(id_col, F.try_divide(_dot(v, query), nv * nq).alias("score"))
    return scored.where(F.col("score").isNotNull()).select(
        id_col, F.round("score", digits).alias("score"))


def topk(vectors: DataFrame, query_id: int, k: int = 10, id_col: str = "vec_id",
         vec_col: str = "embedding") -> DataFrame:
    """The ``k`` vectors most similar to vector ``query_id`` (itself included)."""
    q = vectors.where(F.col(id_col) == query_id).select(vec_col).scalar()
    # the subquery gets its own column: Spark allows no subquery inside a lambda
    with_q = vectors.select(id_col, vec_col, q.alias("_q"))
    scored = cosine_scores(with_q, F.col("_q"), id_col, vec_col)
    top = scored.orderBy(F.col("score").desc(), F.col(id_col).asc()).limit(k)
    w = Window.orderBy(F.col("score").desc(), F.col(id_col).asc())
    return top.select(id_col, "score", F.row_number().over(w).alias("rank"))
