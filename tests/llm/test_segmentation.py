"""Sampled segmentation: exact distribution, reproducibility and round trips."""

import collections
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gradeframe.llm import segmentation as sg


@pytest.fixture(scope="module")
def pieces():
    return sg.Pieces(sg.Segmentation())


def split(flat, counts):
    ends = np.cumsum(counts)
    return [flat[e - n:e].tolist() for e, n in zip(ends, counts)]


def test_draws_follow_the_weights(pieces):
    text, n = b"and the", 60_000
    drawn = split(*sg.sample(pieces, [text] * n, sg.row_keys(list(range(n)), 0)))
    spelt = {pieces.text[i]: i for i in range(pieces.size) if np.isfinite(pieces.weight[i]) and i not in set(pieces.byte_ids)}

    def ways(rest):
        if not rest:
            yield ()
        for k in range(1, len(rest) + 1):
            if rest[:k] in spelt:
                for more in ways(rest[k:]):
                    yield (spelt[rest[:k]], *more)

    weight = {w: math.exp(sum(pieces.weight[i] for i in w)) for w in ways(b" and the")}
    total, seen = sum(weight.values()), collections.Counter(map(tuple, drawn))
    assert set(seen) <= set(weight)
    assert all(abs(seen[w] / n - x / total) < 0.012 for w, x in weight.items())


def test_a_row_draws_the_same_in_any_company(pieces):
    texts = [b"some words here " * 30, "Über   größe\n".encode(), b"", b"some words here " * 30]
    keys = sg.row_keys([5, 6, 7, 8], 1)
    together = split(*sg.sample(pieces, texts, keys))
    alone = [split(*sg.sample(pieces, [t], keys[i:i + 1]))[0] for i, t in enumerate(texts)]
    assert together == alone
    assert together[0] != together[3]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_round_trip(texts):
    pieces = _PIECES
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    drawn = split(*sg.sample(pieces, data, sg.row_keys(list(range(len(data))), 3)))
    assert [sg.decode(pieces, ids) for ids in drawn] == data


_PIECES = sg.Pieces(sg.Segmentation())


def test_low_temperature_gives_the_best_path():
    pieces = sg.Pieces(sg.Segmentation(temperature=1e-4))
    flat, _ = sg.sample(pieces, [b"the and"], sg.row_keys([1], 0))
    assert [pieces.text[i] for i in flat] == [b" the", b" and"]


def test_odd_rows(spark):
    long = "word " * 30_000 + "x" * 3000
    rows = [(1, None), (2, ""), (3, "▁a ▁"), (4, long), (5, "same text here"), (5, "same text here"), (None, "no key \x00 \U0001f600")]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, pieces string")
    job = sg.Segmentation(seed=9)
    ids = sg.segmented(docs, job)
    back = ids.select("doc_id", sg.decoded_column(F.col("pieces"), job).alias("text"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    same = [r.pieces for r in ids.collect() if r.doc_id == 5]
    assert same[0] == same[1]
    digest = docs.select(sg.digest_column(F.col("text"), F.col("doc_id"), job).alias("d")).select("d.*").collect()
    assert all(r.lossless for r in digest) and len(digest) == len(rows)
    assert sg.segmented(docs.limit(0), job).collect() == []
