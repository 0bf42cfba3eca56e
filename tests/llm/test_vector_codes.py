"""Codebooks and codes against evaluation of all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from gradeframe.llm.vector_codes import VectorCodes, code_report, encode, nearest_entries, _distances

SCHEMA = "vec_id long, embedding array<double>, label int, id int, vector int, entry int"


def brute(rows, job):
    """(id, code, error, label_error, digest) with every distance evaluated, in Python integers."""
    kept = sorted((i, [math.floor(job.scale * x) for x in v], label) for i, v, label in rows
                  if i is not None and v and all(x is not None and math.isfinite(x) for x in v))
    if not kept:
        return []
    width = len(kept[0][1]) // job.parts
    parts = [[v[p * width:(p + 1) * width] for p in range(job.parts)] for _, v, _ in kept]
    books = [[row[p] for row in parts[:job.entries]] for p in range(job.parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), k) for k, entry in enumerate(book))

    for _ in range(job.rounds):
        new = []
        for p, book in enumerate(books):
            of = [nearest(row[p], book)[1] for row in parts]
            new.append([[sum(c) // of.count(k) for c in zip(*[row[p] for row, o in zip(parts, of) if o == k])] if k in of else entry
                        for k, entry in enumerate(book)])
        books = new
    found = [[nearest(row[p], books[p]) for p in range(job.parts)] for row in parts]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    errors = [sum(gap for gap, _ in row) for row in found]
    by_label = {}
    for (_, _, label), error in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + error
    return sorted((i, "".join(f"{k:02x}" for _, k in row), error, by_label[label], digest)
                  for (i, _, label), row, error in zip(kept, found, errors))


def made(seed, n, size=8):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(size)] for _ in range(5)]
    rows = [(i, [x + rnd.gauss(0, 0.1) for x in rnd.choice(centres)], rnd.choice([0, 1, None])) for i in range(n)]
    # Equal vectors, ties between entries, and what takes no part.
    rows += [(n + i, [0.25] * size, 1) for i in range(20)] + [(3, [0.5] * size, 2), (3, [0.5] * size, 2)]
    return rows + [(900, None, 0), (901, [0.1] * (size - 1) + [None], 0), (902, [math.nan] * size, 0), (903, [math.inf] * size, 0),
                   (None, [0.5] * size, 0), (904, [], 1)]


@pytest.mark.parametrize("job", [VectorCodes(entries=16, block_rows=13), VectorCodes(parts=2, entries=256, pivots=3),
                                 VectorCodes(entries=1, rounds=1, pivots=1), VectorCodes(entries=7, rounds=0, scale=3)])
def test_matches_all_distances(spark, job):
    rows = made(job.entries, 90)
    data = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(4)
    got = code_report(data, job)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect())) == brute(rows, job)


def test_bounds_leave_entries_out(spark):
    """Well-separated vectors: most distances are never evaluated, and none that counts is missed."""
    rnd = random.Random(1)
    rows = [(i, [100.0 * (i % 32) + rnd.random() for _ in range(8)], 0) for i in range(400)]
    job = VectorCodes(entries=32)
    found = encode(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), job)
    assert max(found.evaluated) < 0.2 * 400 * 4 * 32
    assert sorted(map(tuple, found.rows.select("id", "code").collect())) == [r[:2] for r in brute(rows, job)]


def test_nearest_entry_with_ties():
    rng = np.random.default_rng(3)
    for trial in range(30):
        points = rng.integers(-3, 4, (50, 2))
        entries = rng.integers(-3, 4, (20, 2))
        pivots = entries[:3]
        gaps = _distances(points, pivots).astype(np.float32)
        index, best, tried = nearest_entries(points, gaps, entries, pivots)
        every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all() and tried <= every.size


def test_empty_and_unfit_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert code_report(spark.createDataFrame([], schema)).collect() == []
    assert code_report(spark.createDataFrame([(1, None, 2)], schema)).collect() == []
    for unfit in ([(1, [1.0] * 4, 0), (2, [1.0] * 8, 0)], [(1, [1.0] * 6, 0)], [(1, [1e9] * 4, 0)]):
        with pytest.raises(ValueError):
            code_report(spark.createDataFrame(unfit, schema))
