"""Queries and pipeline over the given tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from gradeframe.llm.common import documents
from gradeframe.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in "documents pages embeddings conversations".split():
        con.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    got = QUERIES[name](spark, SF_DIR)
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(cursor.fetchall(), key=repr)
    mine = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    assert mine and mine == want


def test_pipeline_stages(spark):
    docs = documents(spark, SF_DIR)
    columns, count = docs.columns, docs.count()
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "substring_dedup", "source_mixing", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == columns, name
        if name == "near_dedup":
            assert docs.select("doc_id").distinct().count() == docs.count() < count
    for empty in (documents(spark, SF_DIR).limit(0),):
        for _, stage in corpus_pipeline.STAGES:
            empty = stage(spark, empty, SF_DIR)
        assert empty.collect() == []


def test_stages_remove_what_they_staged(spark, tmp_path):
    """Once a stage's documents are read from elsewhere, nothing of earlier stages is left."""
    docs, seen = documents(spark, SF_DIR), set()
    for name, stage in corpus_pipeline.STAGES:
        earlier = set(seen)
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen |= set(corpus_pipeline._left_by_stages)
        assert not [p for p in earlier if os.path.exists(p.removeprefix("file:"))], name
    assert docs.count() and len(seen) > 20


def test_a_stage_keeps_what_its_documents_are_read_from(spark):
    docs = documents(spark, SF_DIR)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF_DIR)
    assert docs.count() > 0
