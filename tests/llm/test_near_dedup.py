"""Near-duplicate groups against brute force over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings, strategies as st

from gradeframe.llm import near_dedup as nd
from gradeframe.llm.components import components

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]


def brute(rows, size, least=80, of=100):
    """(n, component) by comparing all pairs."""
    sets = {}
    for i, text in rows:
        sets.setdefault(i, []).append(nd.shingle_set((text or "").encode(), size))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and of * len(x & y) >= least * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: find(i) for i in ids}


def corpus(seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(12):
        base = [rnd.choice(WORDS) + str(rnd.randrange(40)) for _ in range(rnd.choice([1, 3, 40, 90]))]
        for _ in range(rnd.choice([1, 2, 8])):
            words = [w if rnd.random() > 0.06 else rnd.choice(WORDS) for w in base]
            rows.append((len(rows) * 3 + 5, " ".join(words)))
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_components_match_all_pairs(spark, size):
    rows = corpus(size)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in nd.near_duplicates(docs, nd.NearDedup(shingle_words=size)).collect()}
    want = brute(rows, size)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(nd.shingle_set(t.encode(), size)) for i, t in rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_outsiders_meet_in_parts_of_an_arena(spark):
    """Chains that leave their leader's reach, in arenas cut into small parts."""
    rnd = random.Random(3)
    rows, words = [], [f"w{i}" for i in range(120)]
    for i in range(60):
        rows.append((i, " ".join(words)))
        words[rnd.randrange(120)] = f"n{i}"
        words[rnd.randrange(120)] = f"m{i}"
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    job = nd.NearDedup(shingle_words=2, part_shingles=400, part_queries=4)
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(docs, job).collect()}
    assert got == brute([(k, t) for k, (_, t) in enumerate(rows)], 2)


def test_odd_rows(spark):
    long = " ".join(f"x{i % 977}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "two"), (7, long), (8, long + " end"),
            (9, "one two"), (None, "one two"), (4, "One"), (10, "a b c"), (10, "d e f"), (11, "d e f")]
    docs = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, n_shingles int, component_id string")
    found = nd.near_duplicates(docs, nd.NearDedup(shingle_words=2)).collect()
    assert len(found) == len(rows)
    comp = {(r.doc_id, r.component_id) for r in found}
    assert {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 7), (8, 7), (9, 9), (None, None), (10, 10), (11, 10)} == comp
    assert {r.n_shingles for r in found if r.doc_id in (1, 2, 3)} == {0}
    kept = nd.keep_one_of_each(docs, nd.NearDedup(shingle_words=2))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted("1 2 3 4 6 7 9 10 None".split())


def test_which_row_of_an_id_stays(spark):
    """Of rows that share a kept id the one whose text has the least hash; an id none of whose rows is kept goes."""
    shared = "one two three four five six seven"
    rows = [(1, shared, "x"), (1, "quite another text of eight words it is", "y"), (1, shared, "x"), (2, shared, "z"), (2, shared, "w"), (3, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string").repartition(3)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    least = min((t for i, t, _ in rows if i == 1), key=hashes.get)
    for _ in range(3):
        kept = sorted(map(tuple, nd.keep_one_of_each(docs.repartition(4)).collect()))
        assert kept == sorted([next(r for r in rows if r[:2] == (1, least)), (3, None, "n")])


def test_texts_that_stay_do_not_move(spark):
    """The ids that go are looked up; the frame that is written has no shuffle but of rows whose id repeats."""
    docs = spark.createDataFrame([(i, f"text {i // 2} of seven words or so", "s") for i in range(40)], "doc_id long, text string, source string")
    kept = nd.keep_one_of_each(docs)
    assert kept.count() == 20
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftAnti") >= 1 and "SortMergeJoin" not in plan


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_duplicates(docs).collect() == []
    assert nd.keep_one_of_each(docs).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=40), st.integers(1, 24))
def test_signature_is_the_minimum_over_elements(values, registers):
    """Stopping early gives the same registers as going through all ranks; order of elements does not matter."""
    elements = np.unique(np.array(values, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    whole = nd.super_minhash(elements, np.array([len(elements)]), registers)[0]
    single = np.stack([nd.super_minhash(np.array([e]), np.array([1]), registers)[0] for e in elements])
    assert (whole == single.min(axis=0)).all()
    # One element's ranks are a permutation of the registers.
    assert sorted((single[0] >> np.uint64(32)).tolist()) == list(range(registers))


def test_signature_agreement_estimates_similarity():
    rnd = np.random.default_rng(5)
    pool = rnd.integers(0, 2 ** 63, 260, dtype=np.uint64)
    a, b = np.sort(pool[:200]), np.sort(pool[60:])
    table = nd.super_minhash(np.concatenate((a, b)), np.array([200, 200]), 200)
    assert abs((table[0] == table[1]).mean() - 140 / 260) < 0.12


@pytest.mark.parametrize("local", [0, 10 ** 6])
def test_components(spark, local):
    rnd = random.Random(1)
    links = [(rnd.randrange(90), rnd.randrange(90)) for _ in range(70)] + [(i, i + 1) for i in range(500, 540)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    frame = spark.createDataFrame(links + [(None, 3)], "a long, b long").repartition(4)
    got = sorted(map(tuple, components(frame, local).collect()))
    assert got == sorted((x, find(x)) for x in parent)
