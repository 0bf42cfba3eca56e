"""Language ID by compression: held-out accuracy and odd rows."""

import zlib

import pytest
from pyspark.sql import functions as F

from gradeframe.llm import langid
from gradeframe.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    return langid.train(docs.where(~langid.is_held_out(F.col("doc_id"))))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op10_language_id"](spark, SF_DIR).join(docs, "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.03 * len(rows)


def test_odd_rows(spark, model):
    long = "the and of that with " * 40_000
    rows = [(1, None), (2, ""), (3, "123 ... !"), (4, long), (5, "The thing and the other"), (5, "The thing and the other"), (None, "der und die")]
    docs = spark.createDataFrame([(a, b, 0.5, "x") for a, b in rows], "doc_id long, text string, score double, found string")
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert all(r.rejected and r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    same = [tuple(r) for r in got if r.doc_id == 5]
    assert same[0] == same[1]
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {4, 5, None}


def test_few_languages_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "so it goes", "xx"), (2, "on and on", None)], "doc_id long, text string, lang string")
    none = langid.train(docs.where("lang = 'zz'"))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    one = langid.train(docs)
    assert [(r.lang_pred, r.score) for r in langid.identify(docs, one).collect()] == [("xx", 1.0)] * 2
    assert langid.identify(docs.limit(0), one).collect() == []


def test_copies_do_not_fill_the_sample(spark):
    rows = [("en", "copy of one text")] * 200 + [("en", f"text number {i} word{i}") for i in range(20)]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"), docs_per_lang=15)
    assert model.samples[0].count(b"copy of one text") <= 1
    assert model.samples[0].count(b"text number") >= 13


def test_all_sampled_texts_train_and_not_by_their_beginning(spark):
    names = [f"qu{chr(97 + i // 8)}{chr(97 + i % 8)}x" for i in range(40)]
    rows = [("en", "boiler plate of all texts " * 60 + f"{name} " * 3000) for name in names]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"), bytes_per_lang=4000)
    assert sum(name.encode() in model.samples[0] for name in names) >= 30
    assert len(model.samples[0]) <= 4000
    assert [langid._most_bytes(*a) for a in (([3, 5], 9), ([2, 8, 8], 12), ([4, 4], 0), ([1], 5))] == [5, 5, 0, 1]


def test_long_texts_are_measured_in_blocks(model):
    sizer = langid._Sizer(model)
    text = b"word " * 5000
    step = model.block_bytes
    assert sizer.sizes(text) == [sum(len(c.compress(text[i:i + step])) for i in range(0, len(text), step)) for c in sizer.compressors]
