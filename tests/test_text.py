"""Text functions on literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from gradeframe import fixed_values as fv
from gradeframe import normalize_missing, render_prompt, sentence_count, strip
from gradeframe.plans.evaluate import four_decimals


def one_column(spark, values, expression, kind="string"):
    """Apply an expression of column ``v`` to each value, order kept."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r.o for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_strip_is_pythons_strip(spark):
    cases = [" A　", "\t a b \n", "", "   ", "\x1cx\x1f", " A ", "x", "​z", None]
    cases += [c + "k" + c for c in fv.WHITE_SPACE]
    assert one_column(spark, cases, strip) == [None if c is None else c.strip() for c in cases]


@pytest.mark.parametrize("text,n", [
    ("1. a 2. b 3.5 mg", 3), ("S1: 1. x", 2), ("S1. x", 0), ("S1 : a\nS22:\tb", 2), ("", 0), (None, 0),
    ("xS1: a", 0), ("v2. a", 0), ("S1\x1c: a", 1), ("S١: a", 1), ("٣. a", 1), ("1.2.3.", 3), ("éS1: a", 0),
])
def test_sentence_count(spark, text, n):
    assert one_column(spark, [text], sentence_count) == [n]


def test_prompt_is_filled_once(spark):
    df = spark.createDataFrame([(" a {options} {{x}} ", "Q {sentences}?"), (None, None)], "s string, o string")
    made = df.select(render_prompt("<{sentences}|{options}|{{k}}>", F.col("s"), F.col("o")).alias("p")).collect()
    assert [r.p for r in made] == ["<a {options} {{x}}|Q {sentences}?|{k}>", "<nan|nan|{k}>"]


def test_default_prompt_equals_format(spark):
    df = spark.createDataFrame([("S1: a", "B?")], "s string, o string")
    made = df.select(render_prompt(fv.DEFAULT_PROMPT, F.col("s"), F.col("o")).alias("p")).first().p
    assert made == fv.DEFAULT_PROMPT.format(sentences="S1: a", options="B?")


@pytest.mark.parametrize("template", [
    '{sentences} {options} {"Answer": "<letter>"}', "{sentences} {", "{other}", "{sentences:>9}", "{}", "{sentences} }",
])
def test_bad_template_fails_before_any_row(spark, template):
    with pytest.raises(ValueError, match="prompt template"):
        render_prompt(template, F.lit("s"), F.lit("o"))


def test_missing_markers(spark):
    df = spark.createDataFrame([(m, 1) for m in fv.MISSING_MARKERS] + [("na", 2), (" NA", 2), ("None.", 2)], "g string, k int")
    kept = normalize_missing(df).where("g is not null").collect()
    assert sorted(r.g for r in kept) == [" NA", "None.", "na"]
    assert normalize_missing(df, ["k"]).where("g is null").count() == 0


def test_four_decimals_is_pythons_rounding(spark):
    rng = random.Random(7)
    values = [i / 32 for i in range(33)] + [i / 20000 for i in range(0, 20001, 3)]
    values += [rng.random() for _ in range(5000)] + [-v / 64 for v in range(1, 64)]
    values += [5e-5, -5e-5, 1.5e-4, 0.0, -1e-9, 1234.00005, 4.99999e-5, 5.00001e-5]
    got = one_column(spark, values, four_decimals, "double")
    assert got == [f"{v:.4f}" for v in values]
    assert one_column(spark, [None], four_decimals, "double") == ["nan"]
