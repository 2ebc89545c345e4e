"""Inverted-file search against a full scan."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from learnlog.operators import neighbours as N

from conftest import SF_ORACLE


def _table(spark, x, ids=None):
    rows = [(int(i), [float(a) for a in v]) for i, v in zip(range(len(x)) if ids is None else ids, x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def _full(x, step, k):
    x = np.asarray(x, np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, N.DIGITS)
    np.fill_diagonal(s, -2)
    ids = np.arange(len(x))
    return {q: [int(i) for i in np.lexsort((ids, -s[q]))[:k]] for q in range(0, len(x), step)}


def _got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["neighbour_id"])
    return out


@pytest.fixture(scope="module")
def grouped():
    """Groups of very different sizes; one holds a third of the rows, some rows are equal."""
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(12, 16))
    of = np.where(np.arange(1500) % 3 == 0, 0, rng.integers(0, 12, 1500))
    x = middle[of] + rng.normal(0, 0.3, (1500, 16))
    x[700:720] = x[700]
    return x


def test_exact_search_equals_a_full_scan(spark, grouped):
    df = _table(spark, grouped)
    index = N.build(df, lists=20)
    for block in (4096, 60):  # a hot list in one block and in many
        assert _got(N.search(index, df.where("vec_id % 25 = 0"), exact=True, probes=1, block=block)) == _full(grouped, 25, 10)


def test_recall_and_share_of_rows_looked_at(spark, grouped):
    df = _table(spark, grouped)
    index = N.build(df, lists=20)
    want, got = _full(grouped, 25, 10), _got(N.search(index, df.where("vec_id % 25 = 0")))
    assert sum(len(set(want[q]) & set(got[q])) for q in want) >= 0.9 * sum(map(len, want.values()))
    assert index.probes < 20 and sum(index.sizes.values()) == 1500


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet(f"{SF_ORACLE}/embeddings.parquet")
    index = N.build(df)
    queries = df.where("vec_id % 50 = 0")
    want, got = _got(N.search(index, queries, exact=True)), _got(N.search(index, queries))
    assert sum(len(set(want[q]) & set(got.get(q, []))) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_rows_that_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]),
            (7, [float("inf"), 1.0]), (None, [1.0, 0.0]), (8, [1.0, 2.0, 3.0]), (2, [1.0, 0.1]), (9, []), (10, [0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit(1).alias("list"), F.lit("x").alias("id"))
    got = _got(N.search(N.build(df, lists=2), df.dropDuplicates(["vec_id"]), k=5, exact=True))
    assert got == {1: [2, 2, 10], 2: [1, 10], 10: [1, 2, 2]}
    empty = N.build(df.limit(0))
    assert N.search(empty, df).collect() == [] and N.search(N.build(df), df.limit(0), exact=True).collect() == []
