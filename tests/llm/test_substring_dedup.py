"""Repeated windows against brute force, and the full-text index by itself."""

import hashlib
import random

import numpy as np
import pytest

from gradeframe.llm import substring_dedup as sd
from gradeframe.llm.fm_index import FMIndex


def brute(rows, window):
    first = {}
    for i, text in rows:
        words = (text or "").encode().split()
        if i is not None:
            for k in range(len(words) - window + 1):
                key = tuple(words[k:k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for k in range(len(words) - window + 1):
            if i is not None and first[tuple(words[k:k + window])] < i:
                gone |= set(range(k, k + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, passages=4, docs=40):
    rnd = random.Random(seed)
    shared = [[rnd.choice("abcdefgh") * rnd.randrange(1, 4) for _ in range(rnd.randrange(8, 40))] for _ in range(passages)]
    rows = []
    for i in rnd.sample(range(200), docs):
        words = []
        for _ in range(rnd.randrange(0, 5)):
            words += rnd.choice(shared) if rnd.random() < 0.6 else [f"u{rnd.randrange(10 ** 6)}" for _ in range(rnd.randrange(12))]
        rows.append((i, rnd.choice([" ", "\n", " \t "]).join(words)))
    return rows + [(300, "z " * 400), (301, "z " * 90), (302, "y z " * 60), (303, rows[0][1]), (304, None), (305, "")]


@pytest.mark.parametrize("shard_words", [60, 100_000])
def test_matches_brute_force(spark, shard_words):
    rows = corpus(shard_words)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    job = sd.SubstringDedup(window_words=10, anchor_words=3, shard_words=shard_words)
    got = sorted(map(tuple, sd.removal_report(docs, job).collect()), key=str)
    assert got == brute(rows, 10)
    assert sum(r[2] for r in got) > 100


def contents(texts, job, level=0):
    """Words of the different segments of each anchor."""
    found = {}
    for words in texts:
        _, start, size, anchor, content = sd.cut(sd.word_hashes([w.encode() for w in words]), np.array([len(words)]), job, level)
        for s, n, a, c in zip(start, size, anchor, content):
            assert found.setdefault(int(a), {}).setdefault(int(c), tuple(words[s:s + n])) == tuple(words[s:s + n])
    return {a: sum(map(len, different.values())) for a, different in found.items()}


@pytest.mark.parametrize("period", [1, 2, 7])
def test_runs_of_any_lengths_share_their_pieces(period):
    """What an anchor holds of runs of one word, or of a few, does not grow with the number of runs or their lengths."""
    job = sd.SubstringDedup()
    run = [f"w{i}" for i in range(period)] * 2000
    some, many = ([run[i % period:][:n] for i, n in enumerate(range(50, high))] for high in (250, 1500))
    most = max(contents(some, job).values())
    assert most <= period * 51 * 100 and max(contents(many, job).values()) <= max(most * 2, period * 4000)
    # By whole windows, which is how the last cut goes, only equal windows meet.
    assert max(contents(many, job, job.most_cuts).values()) <= 51 * 100


@pytest.mark.parametrize("shard_words,most_cuts", [(1000, 8), (60, 1), (60, 2)])
def test_many_runs_match_brute_force(spark, shard_words, most_cuts):
    rows = [(i, "0 " * (10 + i)) for i in range(60)] + [(100 + i, "a b " * (6 + i) + "0 " * i) for i in range(30)]
    job = sd.SubstringDedup(window_words=10, anchor_words=3, shard_words=shard_words, most_cuts=most_cuts)
    got = sorted(map(tuple, sd.removal_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), job).collect()), key=str)
    assert got == brute(rows, 10)


def test_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage), (2, "x " + passage), (None, passage), (1, passage + " tail"), (3, passage), (3, passage)]
    docs = spark.createDataFrame([(a, b, "c", 7) for a, b in rows], "doc_id long, text string, row string, n_words int")
    assert sorted(map(tuple, sd.removal_report(docs).collect()), key=str) == brute(rows, 50)
    left = sd.remove_repeats(docs, length_col="n_words")
    assert left.columns == docs.columns
    texts = sorted(map(tuple, left.select("doc_id", "text", "n_words").collect()), key=str)
    assert texts == sorted([(1, passage, 7), (2, "x ", 2), (None, passage, 7), (1, passage + " tail", 7), (3, "", 0), (3, "", 0)], key=str)


def test_other_text_is_left_as_it_is(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    docs = spark.createDataFrame([(1, passage), (2, f"  Títle\n\n{passage}\n end \t of it ")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in sd.remove_repeats(docs).collect()} == {1: passage, 2: "  Títle\n\nend \t of it "}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sd.removal_report(docs).collect() == []


def test_matching_statistics():
    rng = np.random.default_rng(1)
    for trial in range(120):
        longest, symbols = int(rng.integers(1, 9)), int(rng.integers(1, 5))
        texts = [rng.integers(1, symbols + 1, rng.integers(0, 14)) for _ in range(rng.integers(1, 5))]
        text = np.concatenate([np.append(t, 0) for t in texts]).astype(np.int64)
        index = FMIndex(text, symbols + 1, longest)
        asked = [rng.integers(1, symbols + 1, rng.integers(0, 16)) for _ in range(4)]
        asked[0] = np.where(rng.random(len(asked[0])) < 0.2, -1, asked[0])
        starts = np.concatenate(([0], np.cumsum([len(q) for q in asked])))
        length, row = index.matching_statistics(np.concatenate(asked).astype(np.int64), starts)
        there = {tuple(t[i:i + k]) for t in texts for i in range(len(t)) for k in range(1, longest + 1) if i + k <= len(t)}
        for q, start in zip(asked, starts):
            for i in range(len(q)):
                want = max([k for k in range(1, min(longest, len(q) - i) + 1) if tuple(q[i:i + k]) in there] or [0])
                assert length[start + i] == want
                at = index.suffixes[row[start + i]]
                assert tuple(text[at:at + want]) == tuple(q[i:i + want])


def test_index_of_many_symbols_has_no_overflow():
    """Products of ranks leave 32 bits; matches of whole windows are found all the same."""
    rng = np.random.default_rng(2)
    base = rng.permutation(60_000) + 1
    text = np.concatenate((base, [0], base[100:30_100], [0]))
    index = FMIndex(text, 60_001, 50)
    starts = np.array([0, 60_000, 90_000])
    length, row = index.matching_statistics(np.concatenate((base, base[100:30_100])), starts)
    assert (length[:59_951] == 50).all() and (length[60_000:89_951] == 50).all()
    of, edges = index.classes(50)
    first = np.minimum.reduceat(index.suffixes, edges[:-1])[of[row[60_000:89_951]]]
    assert (first == np.arange(100, 30_051)).all()
