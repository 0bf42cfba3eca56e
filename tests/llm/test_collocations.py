"""Phrase counts and collocations against plain counting."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeframe.llm import collocations as module
from gradeframe.llm.collocations import Collocations, collocations, phrase_counts

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, most_words):
    counts = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(_LOWER)):
            words = re.findall("[^ \t]+", piece)
            for k in range(1, most_words + 1):
                for i in range(len(words) - k + 1):
                    counts[lang or "und", tuple(words[i:i + k])] += 1
    return counts


def plain_collocations(rows, job):
    f = plain_counts(rows, job.most_words)
    totals = Counter()
    for (lang, words), n in f.items():
        totals[lang] += n if len(words) == 1 else 0
    candidates = {key: n for key, n in f.items() if len(key[1]) > 1 and n >= job.least}
    best = defaultdict(list)
    for (lang, words), a in candidates.items():
        longer = [n for (other, long), n in candidates.items() if other == lang and len(long) > len(words)
                  and any(long[i:i + len(words)] == words for i in range(len(long) - len(words) + 1))]
        if longer and 100 * max(longer) >= job.covered_percent * a:
            continue
        score, cut = min((1_000_000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words)))
        best[lang].append((-score, -a, " ".join(words).encode(), f[lang, words[:cut]], f[lang, words[cut:]]))
    return sorted((lang, place + 1, phrase.decode(), -a, l, r, totals[lang], -score) for lang, found in best.items()
                  for place, (score, a, phrase, l, r) in enumerate(sorted(found)[:job.per_language]))


def sample(seed):
    rnd = random.Random(seed)
    words = ["New", "york", "City", "the", "of", "a", "é", "É", "new", " ", "x\x00y", "..", "😀"]
    rows = []
    for _ in range(150):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ", ", "\n", "\r", ""]) for _ in range(rnd.randint(0, 40)))
        rows.append((rnd.choice(["en", "de", None, "und", "a\nb"]), text))
    return rows + [("en", None), (None, None), (None, ""), ("de", "..!? \t")] + [("en", "new york city of new york city")] * 12


JOBS = [
    Collocations(least=10, filter_slots=1 << 15),
    # Windows that end within texts, and tables full of foreign marks.
    Collocations(least=3, most_words=4, shards=3, filter_slots=1 << 15, window_bytes=7),
    Collocations(least=2, most_words=2, shards=1, per_language=5, filter_slots=1 << 15, window_bytes=100),
]


@pytest.mark.parametrize("job", JOBS, ids=range(len(JOBS)))
def test_matches_plain_counting(spark, job):
    rows = sample(job.least)
    docs = spark.createDataFrame([(lang, text, 1, 2) for lang, text in rows], "lang string, text string, key int, n int").repartition(5)
    found = {(r.lang, r.phrase): r.f for r in phrase_counts(docs, job).where("words > 0").collect()}
    assert found == {(lang, " ".join(words)): n for (lang, words), n in plain_counts(rows, job.most_words).items() if n >= job.least}
    got = collocations(docs, job)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, job)


def test_foreign_marks_of_any_age(spark):
    """Over a table that most slots of are taken, at different scans, every phrase is counted for a whole cycle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    job = Collocations(filter_slots=1 << 15, window_bytes=3000)
    found = {(r.lang, r.phrase): r.f for r in phrase_counts(docs, job).where("words > 0").collect()}
    counts = plain_counts([tuple(r) for r in docs.select("lang", "text").collect()], 3)
    assert found == {(lang, " ".join(words)): n for (lang, words), n in counts.items() if n >= 10}


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """Where every slot is taken, every phrase is activated at once, and counted for one cycle all the same."""
    import numpy as np

    from gradeframe.llm import collocations as module

    rows = sample(7)
    docs = spark.createDataFrame(rows, "lang string, text string")
    job = Collocations(least=4, filter_slots=1 << 15, shards=2)
    entered = module._mark

    def all_marked(reached, found, names, scan):
        any_found = entered(reached, found, names, scan)
        np.minimum(reached, scan, out=reached)
        return any_found

    monkeypatch.setattr(module, "_mark", all_marked)
    assert sorted(map(tuple, collocations(docs, job).collect())) == plain_collocations(rows, job)


def test_hash_of_several_words(spark):
    """Tasks and Spark give a phrase the same hash."""
    import numpy as np

    from gradeframe.llm.collocations import chained_hash

    values = [(1, 2, None), (-5, 2 ** 62, 7), (0, None, None), (2 ** 63 - 1, -2 ** 63, -1)]
    rows = spark.createDataFrame(values, "a long, b long, c long").select("a", "b", "c", F.xxhash64("a", "b", "c").alias("h")).collect()
    for row in rows:
        hashed = np.array([42], np.uint64)
        for value in row[:3]:
            if value is not None:
                hashed = chained_hash(hashed, np.array([value], np.int64).view(np.uint64))
        assert hashed.view(np.int64)[0] == row.h


def test_words_that_share_a_hash_start_anew(spark, monkeypatch):
    """Under the first seeds all words of one length share a hash; the counts come out all the same."""
    import xxhash

    from gradeframe.llm import collocations as module

    class Colliding:
        @staticmethod
        def xxh64_intdigest(key, seed):
            return len(key) if seed < 2 else xxhash.xxh64_intdigest(key, seed)

    tried, plain = [], module._counted
    monkeypatch.setattr(module, "xxhash", Colliding)
    monkeypatch.setattr(module, "_counted", lambda shards, job, seed: tried.append(seed) or plain(shards, job, seed))
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module.__name__])
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = sample(8)
    job = Collocations(least=4, filter_slots=1 << 15, shards=2)
    found = sorted(map(tuple, collocations(spark.createDataFrame(rows, "lang string, text string"), job).collect()))
    assert tried == [0, 1, 2] and found == plain_collocations(rows, job)


def test_products_beyond_64_bits(spark):
    from gradeframe.llm.collocations import _cuts

    a, l, r = 4_000_000_000_000, 9_000_000_000_000, 8_000_000_000_001
    known = spark.createDataFrame([("en", "x", 1, l), ("en", "y", 1, r), ("en", "x y", 2, a)], "lang string, phrase string, words int, f long")
    assert _cuts(known.where("words > 1"), known, Collocations()).first()["score"] == 1_000_000 * a * a // (l * r)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    job = Collocations(filter_slots=1 << 15, shards=2)
    assert collocations(docs, job).collect() == []
    assert collocations(spark.createDataFrame([(None, None)], docs.schema), job).collect() == []


def test_one_text_of_many_words(spark):
    docs = spark.range(1).select(F.repeat(F.lit("Big Apple pie. "), 40_000).alias("text"), F.lit("en").alias("lang"))
    job = Collocations(filter_slots=1 << 15, window_bytes=50_000, shards=2)
    assert list(map(tuple, collocations(docs, job).collect())) == [
        ("en", 1, "big apple pie", 40_000, 40_000, 40_000, 120_000, 1_000_000)]


def test_marks_leave_a_task_as_bitmaps():
    """However many phrases a task has, what it sends on is bounded by the table's size."""
    rnd, size = np.random.default_rng(0), 1 << 17
    hashes = rnd.integers(0, 1 << 64, 300_000, np.uint64)
    batches = [pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"]) for h in np.array_split(hashes, 7)]
    rows = [r for b in module._bitmaps(size)(iter(batches)) for r in b.to_pylist()]
    assert len(rows) <= size >> 15 and {len(r["bits"]) for r in rows} == {4096}
    want = {int(h) & size - 1 for h in hashes} | {int(h) >> 32 & size - 1 for h in hashes}
    got = {r["part"] * 32768 + 8 * i + j for r in rows for i, b in enumerate(r["bits"]) for j in range(8) if b >> j & 1}
    assert got == want


def test_marking_makes_no_row_per_phrase(spark, monkeypatch):
    """Phrases are entered without a row for each slot."""
    plans, frame = [], type(spark.range(1))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: plans.append(df._jdf.queryExecution().toString()) or collect(df))
    found = spark.range(50_000).select(F.col("id").alias("k1"), F.lit(None).cast("long").alias("k2"))
    reached = np.full(1 << 15, 255, np.uint8)
    assert module._mark(reached, found, ["k1", "k2"], 3) and not module._mark(reached, found, ["k1", "k2"], 3)
    assert (reached == 3).sum() > 30_000
    assert plans and not any("Generate" in p for p in plans)


def test_a_window_takes_bounded_memory():
    """Counting pairs and triples of a window takes less than 25 bytes of arrays for each byte of text."""
    rnd = np.random.default_rng(1)
    text = " ".join(f"w{n}" for n in rnd.zipf(1.3, 400_000) % 50_000)
    job, data = Collocations(), np.frombuffer(text.encode(), np.uint8)
    reached = np.full(job.filter_slots, 1, np.uint8)
    tracemalloc.start()
    try:
        found = sum(int(n.sum()) for _, _, _, n in module._phrases(job, data, np.array([len(data)]), pa.array([b"en"], pa.large_binary()), 3, reached, 0))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found >= 399_999 and peak < 25 * len(data)
