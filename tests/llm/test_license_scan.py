"""Licence scan: held-out phrasings, planted lines and odd rows; no Python in the plan."""

import pytest
from pyspark.sql import Window, functions as F

from gradeframe.llm import license_scan as ls

SF_DIR = "/root/testdata/sf0.01"
KNOWN = {"apache": "Apache License, Version 2.0.", "mit": "the MIT License.", "gpl": "GNU General Public License, version 3.",
         "cc-by-nc": "CC BY-NC 4.0.", "proprietary": "All rights reserved."}


@pytest.fixture(scope="module")
def model(spark):
    return ls.train(spark.read.parquet(f"{SF_DIR}/documents.parquet"))


def test_planted_lines(spark, model):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = ls.licensed_paragraphs(docs, model).where("confirmed").select("id", "family").distinct().collect()
    got = {(r.id, r.family) for r in found}
    want = {(r.doc_id, k) for r in docs.collect() for k, v in KNOWN.items() if v in r.text}
    assert want <= got
    assert len(got - want) <= 0.002 * docs.count()


def test_odd_rows(spark):
    gpl = ("This program is free software: you can redistribute it and/or modify it\nunder the terms of the GNU General Public License as published by\n"
           "the Free Software Foundation, either version 3 of the License.")
    plain = "Nothing here but some words about rivers and mountains and the weather of the last days."
    rows = [(1, None), (2, ""), (3, "\n \n"), (4, gpl), (5, plain), (5, plain), (None, "Released under the MIT License."),
            (6, "word " * 40_000 + "\nLicensed under the Apache License, Version 2.0."),
            (7, "Licensed under CC BY-SA 4.0.\nReleased under the MIT License.\nReleased under the MIT License.")]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, family string")
    got = ls.scan(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.license_family for r in got} == {
        1: "unknown", 2: "unknown", 3: "unknown", 4: "gpl", 5: "unknown", None: "mit", 6: "apache", 7: "mit"}
    assert all((r.probability is None) == (r.license_family == "unknown") for r in got)


def test_the_plan_has_no_python(spark, model):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    plan = ls.licensed_paragraphs(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    assert ls.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pairs(spark):
    df = spark.createDataFrame([("A b, C-d.",), ("one",), ("",)], "t string")
    got = [r.p for r in df.select(ls.pairs_of(ls.words_of(F.col("t"))).alias("p")).collect()]
    assert got == [["a b", "b c-d"], [], []]


def test_text_beyond_the_first_thousands_of_documents_counts(spark):
    # Ordinary lines that name a licence's words stand in the documents with the highest id hashes only.
    rank = F.row_number().over(Window.orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(0))))
    plain = F.concat(F.lit("Some words about river "), "doc_id", F.lit(" and the weather of the last days."))
    odd = F.concat(F.lit("The MIT campus has hall "), "doc_id", F.lit(" where visitors were seen."))
    docs = spark.range(3600).select(F.col("id").alias("doc_id")) \
        .select("doc_id", F.when(rank > 3200, odd).otherwise(plain).alias("text")).localCheckpoint()
    found = ls.scan(docs).agg(F.sum("n_confirmed").alias("yes"), F.sum("n_unconfirmed").alias("no")).first()
    assert found.yes == 0
    assert found.no <= 0.005 * 3600


@pytest.mark.parametrize("share", [0.0, 0.37, 0.5, 0.999, 1.0])
def test_percentile(spark, share):
    rows = spark.range(1, 5001).select((F.pmod(F.xxhash64("id"), F.lit(3001)) / 3001).alias("p"))
    # Ties, and values that only the last bit tells apart.
    rows = rows.union(spark.createDataFrame([(0.5,)] * 700 + [(0.5000000000000001,)] * 300, "p double"))
    want = rows.agg(F.percentile("p", share)).first()[0]
    assert ls._percentile(rows, share) == pytest.approx(want, rel=1e-15)


def test_percentile_of_nothing(spark):
    assert ls._percentile(spark.createDataFrame([], "p double"), 0.5) is None
