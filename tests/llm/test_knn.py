"""Exact top-k against all products."""

import random

import pytest
from pyspark.sql import functions as F

from gradeframe.llm.knn import Voronoi, nearest


def brute(rows, k):
    import math

    ok = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, qv in sorted(ok):
        if q % 10 == 0:
            scores = sorted({(-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q and len(v) == len(qv)})[:k]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("k,pivots,block", [(3, 4, 7), (10, 16, 1000), (100, 5, 20)])
def test_matches_all_products(spark, k, pivots, block):
    rnd = random.Random(k)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [x + rnd.gauss(0, 0.3) for x in rnd.choice(centres)]) for i in range(120)]
    rows += [(i, [0.5] * 6) for i in range(200, 240)] + [(i, [0.0] * 6) for i in range(300, 305)]
    rows += [(400, None), (401, [0.1, None, 1.0]), (410, [float("nan")] * 6), (411, [float("inf")] * 6), (None, [0.5] * 6),
             (420, [0.25, 0.5]), (421, [1.0, -1.0]), (430, []), (431, []), (200, [0.5] * 6)]
    data = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    job = Voronoi(k=k, pivots=pivots, block_rows=block, block_queries=2)
    got = sorted(map(tuple, nearest(data, F.col("vec_id") % 10 == 0, job).collect()))
    rounded = [(i, None if v is None else [None if x is None else float(r) for x, r in zip(v, as_float(v))]) for i, v in rows]
    assert got == brute(rounded, k)


@pytest.mark.parametrize("repeats", [2, 15])
@pytest.mark.parametrize("pivots,block", [(1, 20_000), (8, 20_000), (8, 5)])
def test_repeated_rows_take_no_places(spark, repeats, pivots, block):
    # No two scores of a query are equal; the best rows, and the queries themselves, are in the table several times.
    rows = [(i, [float(1 + i % 7), float(100 * i + i * i % 13)]) for i in range(60)]
    rows += [(i, v) for i, v in rows if i in (50, 57, 59)] * (repeats - 1)
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    job = Voronoi(k=10, pivots=pivots, block_rows=block)
    assert sorted(map(tuple, nearest(data, F.col("vec_id") % 10 == 0, job).collect())) == brute(rows, 10)


def test_ids_with_several_vectors(spark):
    # Vectors of one id that differ and give a query the same score, and the signs of a zero.
    rows = [(i, [1.0 + i, 0.0]) for i in range(30)] + [(29, [30.0, float(j)]) for j in range(1, 20)]
    rows += [(28, [29.0, -0.0])] * 12
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for pivots in (1, 8):
        job = Voronoi(k=10, pivots=pivots)
        assert sorted(map(tuple, nearest(data, F.col("vec_id") % 10 == 0, job).collect())) == brute(rows, 10)


def as_float(values):
    import numpy as np

    return [None if x is None else np.float32(x) for x in values]


def test_large_components_are_exact(spark):
    rows = [(0, [1e9, 3e8]), (1, [1e9 + 7, 2e8]), (2, [1e9, 2e8 + 1.5]), (3, [-1e9, 0.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, nearest(data, F.col("vec_id") == 0, Voronoi(scale=1)).collect()))
    assert got == [r for r in brute_scale_one(rows)]


def brute_scale_one(rows):
    import math

    q = [math.floor(x) for x in rows[0][1]]
    scores = sorted((-sum(a * math.floor(b) for a, b in zip(q, v)), i) for i, v in rows[1:])
    return [(0, n + 1, i, -s) for n, (s, i) in enumerate(scores)]


def test_empty_tables(spark):
    data = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(data, F.col("vec_id") % 10 == 0).collect() == []
    some = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert nearest(some, F.col("vec_id") % 10 == 0).collect() == []
    assert nearest(some, F.col("vec_id") == 1).collect() == []


def test_rows_are_copied_once_per_block_of_queries(spark, monkeypatch):
    """Over the given vectors a row goes to a few blocks of queries, not to every cell of queries."""
    from gradeframe.llm import knn

    seen = []
    whole = knn.query_groups
    monkeypatch.setattr(knn, "query_groups", lambda job, pivots, cells: seen.append((cells, whole(job, pivots, cells))) or seen[-1][1])
    data = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    for every, job in ((100, Voronoi()), (3, Voronoi(block_queries=100))):
        assert nearest(data, F.col("vec_id") % every == 0, job).count() == 10 * data.where(F.col("vec_id") % every == 0).count()
        cells, groups = seen[-1]
        queries = sum(c.queries for c in cells)
        assert set(groups) == {c.cell for c in cells if c.queries}
        assert len(set(groups.values())) <= queries // job.block_queries + 1
