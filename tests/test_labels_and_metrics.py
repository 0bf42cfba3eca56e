"""Label arrays, predicates, metrics, summary and report on small tables."""

import math
from collections import Counter
from statistics import mean, stdev

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

import gradeframe as gf
from gradeframe.functions.labels import share_name
from gradeframe import EvalSpec, Question

H, L, I = "High Relevance", "Low Relevance", "Irrelevant"
DOMAIN = (H, L, I)
SCHEMA = "id long, grp string, LLM_answer string, gold string, labels array<string>"
SPEC = EvalSpec(id_col="id", group_col="grp", gold_col="gold", model_name="m")

ROWS = [
    (1, "x", "A", "A", [I, L, L, I]),       # tie: first seen wins
    (2, "x", " B", "A", [H]),
    (3, "x", None, None, []),                 # refused; equal in the summary only
    (4, "y", "C", "c", [H, None, H, L]),      # gold keeps its case
    (5, "y", "K", "K", None),
    (6, None, "D", " D ", [f" {H} ", "high relevance"]),
    (7, "z", None, "A", []),
    (8, "z", "", "B", ["?"]),
]


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def rows_of(df, *keys):
    return sorted((tuple(r[k] for k in keys) for r in df.collect()), key=repr)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([*DOMAIN, None, f" {H}\n", "else", "high relevance"]), max_size=9), min_size=40, max_size=40))
def test_label_functions_against_plain_counts(spark, many):
    df = spark.createDataFrame(list(enumerate(many)), "i int, l array<string>")
    df = df.withColumn("v", gf.valid_labels(F.col("l"))).select(
        "i", "v", gf.majority_label(F.col("v")).alias("m"),
        *[gf.label_share(F.col("v"), k).alias(share_name(k)) for k in DOMAIN])
    for row in df.collect():
        want = [x.strip() for x in many[row.i] if x is not None and x.strip() in DOMAIN]
        assert row.v == want
        assert row.m == (Counter(want).most_common(1)[0][0] if want else None)
        shares = [row[share_name(k)] for k in DOMAIN]
        assert shares == [want.count(k) / max(len(want), 1) for k in DOMAIN]
        assert math.isclose(sum(shares), 1.0 if want else 0.0)


def test_wide_and_back(spark):
    df = spark.createDataFrame([(1, ["a", None, "c"], "x"), (2, [], "y")], "id int, labels array<string>, k string")
    wide = gf.labels_to_wide(df, 4)
    assert wide.columns == ["id", "k", "label_1", "label_2", "label_3", "label_4"]
    assert wide.first()[2:] == ("a", None, "c", None)
    back = gf.labels_from_wide(wide.drop("label_2"), 3)
    assert back.columns == ["id", "k", "label_4", "labels"]
    assert back.orderBy("id").first().labels == ["a", "c"]
    assert gf.labels_from_wide(df.drop("labels"), 3).first().labels == []


def test_refusal(results):
    assert gf.refusal_rate(results, "LLM_answer").first() == (4, 8, 0.5)
    assert rows_of(gf.refusal_rate(results, "LLM_answer", "grp"), "grp", "refused", "total") == [
        ("x", 1, 3), ("y", 1, 2), ("z", 2, 2)]


def test_accuracy(results):
    assert gf.accuracy(results, "LLM_answer", "gold").first() == (2, 4, 0.5)
    assert rows_of(gf.accuracy(results, "LLM_answer", "gold", "grp"), "grp", "correct", "valid") == [
        ("x", 1, 2), ("y", 0, 1)]


def test_answer_metrics_and_headline(results):
    got = rows_of(gf.answer_metrics(results, "LLM_answer", "gold", "grp"), "scope", "grp", "refused", "total", "correct", "valid", "accuracy")
    assert got == [("group", "x", 1, 3, 1, 2, 0.5), ("group", "y", 1, 2, 0, 1, 0.0),
                   ("group", "z", 2, 2, 0, 0, None), ("overall", None, 4, 8, 2, 4, 0.5)]
    assert gf.answer_metrics(results, "LLM_answer", "absent", "absent").collect() == [("overall", None, 4, 8, 0.5, None, 4, None)]
    assert gf.answer_metrics(results, "LLM_answer", None, "grp").where("grp = 'x'").first()[2:] == (1, 3, 1 / 3, None, 2, None)
    assert gf.headline(results, "LLM_answer", "gold").first() == (8, 0.5, 0.5)
    assert gf.headline(results, "LLM_answer", "absent").first() == (8, 0.5, None)


def test_mean_ci(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.1), ("b", 0.4), ("b", 0.9), ("c", None), (None, 0.7)], "g string, v double")
    got = {r.g: r for r in gf.mean_ci(df, "v", "g").collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"][1:] == (1, 0.5, None, None, None)
    assert got["c"][1:] == (0, None, None, None, None)
    values = [0.1, 0.4, 0.9]
    half = 1.96 * stdev(values) / math.sqrt(3)
    assert got["b"][1:] == pytest.approx((3, mean(values), stdev(values), mean(values) - half, mean(values) + half))


def test_distribution(results):
    overall = {r.label: (r.n, r.mean) for r in gf.relevance_distribution(results, "labels").collect()}
    assert overall == {H: (4, pytest.approx((0 + 1 + 2 / 3 + 1) / 4)), L: (4, pytest.approx((0.5 + 0 + 1 / 3) / 4)),
                       I: (4, pytest.approx(0.5 / 4))}
    groups = gf.relevance_distribution(results, "labels", "grp").collect()
    assert len(groups) == 9
    assert [(r.n, r.mean) for r in groups if r.grp == "z"] == [(0, None)] * 3


def test_label_accuracy(results):
    got = rows_of(gf.relevance_accuracy(results, "LLM_answer", "gold", "labels"), "label", "correct", "total", "accuracy")
    assert got == [(H, 1, 3, pytest.approx(1 / 3)), (I, 1, 1, 1.0), (L, 0, 0, None)]
    by = rows_of(gf.relevance_accuracy(results, "LLM_answer", "gold", "labels", "grp"), "grp", "label", "total")
    assert len(by) == 9 and ("z", L, 0) in by and ("x", H, 1) in by


def test_row_summary(results):
    got = gf.row_summary(results, SPEC)
    assert got.columns == ["id", "group", "majority_relevance", "pct_high_relevance", "pct_low_relevance",
                           "pct_irrelevant", "LLM_answer_answer", "LLM_answer_refused", "LLM_answer_is_correct"]
    rows = {r.id: r for r in got.collect()}
    assert rows[1].majority_relevance == I and rows[3].majority_relevance is None
    assert rows[3][3:] == (0.0, 0.0, 0.0, None, True, True)
    assert rows[5].LLM_answer_refused and rows[5].LLM_answer_is_correct
    assert (rows[2].LLM_answer_answer, rows[4].LLM_answer_is_correct, rows[6].LLM_answer_is_correct) == (" B", False, True)


def test_row_summary_without_optional_columns(results):
    got = gf.row_summary(results.drop("id", "grp", "gold", "labels"), SPEC)
    assert got.columns == ["majority_relevance", "pct_high_relevance", "pct_low_relevance", "pct_irrelevant",
                           "LLM_answer_answer", "LLM_answer_refused"]
    missing = gf.row_summary(results.drop("LLM_answer"), SPEC).first()
    assert missing.LLM_answer_answer is None and missing.LLM_answer_refused and not missing.LLM_answer_is_correct


def test_max_sentences_limits_the_labels(results):
    short = EvalSpec(id_col="id", max_sentences=2)
    assert {r.id: r.majority_relevance for r in gf.row_summary(results, short).collect()}[4] == H
    one = EvalSpec(max_sentences=1)
    value = gf.evaluate(results.where("id = 1"), one).where("label = 'Irrelevant'").first().value
    assert value == 1.0


def report_text(results, spec):
    lines = gf.report_lines(gf.evaluate(results, spec), results.columns, spec, "in.csv")
    return [r.text for r in lines.orderBy(*[c for c in lines.columns if c != "text"]).collect()]


def test_report(results):
    assert report_text(results, SPEC) == """\
=== Analysis Report ===
Input:  in.csv
Model:  m

--- LLM_answer ---
  Refusal Rate (answer not a valid letter):
    Overall: 4/8 = 0.5000
    x: 1/3 = 0.3333
    y: 1/2 = 0.5000
    z: 2/2 = 1.0000
  Accuracy:
    Overall: 2/4 = 0.5000
    x: 1/2 = 0.5000
    y: 0/1 = 0.0000
  Accuracy by majority sentence-relevance label:
    High Relevance: 1/3 = 0.3333
    Low Relevance: N/A
    Irrelevant: 1/1 = 1.0000

--- Sentence Relevance Distribution ---
  Relevance Distribution (% per row, mean ± 95% CI):
    Overall:
    High Relevance: mean=0.6667, std=0.4714, 95% CI=(0.2047, 1.1286)
    Low Relevance: mean=0.2083, std=0.2500, 95% CI=(-0.0367, 0.4533)
    Irrelevant: mean=0.1250, std=0.2500, 95% CI=(-0.1200, 0.3700)
    x:
    High Relevance: mean=0.5000, std=0.7071, 95% CI=(-0.4800, 1.4800)
    Low Relevance: mean=0.2500, std=0.3536, 95% CI=(-0.2400, 0.7400)
    Irrelevant: mean=0.2500, std=0.3536, 95% CI=(-0.2400, 0.7400)
    y:
    High Relevance: mean=0.6667, std=nan, 95% CI=(nan, nan)
    Low Relevance: mean=0.3333, std=nan, 95% CI=(nan, nan)
    Irrelevant: mean=0.0000, std=nan, 95% CI=(nan, nan)
    z:
    High Relevance: N/A (no data)
    Low Relevance: N/A (no data)
    Irrelevant: N/A (no data)""".split("\n")


def test_report_of_nothing(results):
    empty = report_text(results.where("false"), SPEC)
    assert empty[5:7] == ["  Refusal Rate (answer not a valid letter):", "    Overall: N/A"]
    assert "    Overall: N/A" == empty[8] and empty.count("    High Relevance: N/A (no data)") == 1


def test_report_with_absent_columns(results):
    spec = EvalSpec(group_col="none", questions=(Question("LLM_answer", "absent"), Question("Q9", "gold"), Question("gold")))
    text = report_text(results, spec)
    assert text[4:15] == [
        "--- LLM_answer ---", "  Refusal Rate (answer not a valid letter):", "    Overall: 4/8 = 0.5000",
        "  (No correct-answer column configured — skipping accuracy.)", "",
        "--- Q9 ---", "  Column 'Q9' not found in data. Skipping.", "",
        "--- gold ---", "  Refusal Rate (answer not a valid letter):", "    Overall: 3/8 = 0.3750",
    ]


def test_numeric_groups_sort_as_numbers(spark):
    df = spark.createDataFrame([(g, "A", "A") for g in (10, 9, 2)], "grp int, LLM_answer string, gold string")
    text = report_text(df, EvalSpec(group_col="grp", gold_col="gold"))
    assert text[7:10] == ["    2: 0/1 = 0.0000", "    9: 0/1 = 0.0000", "    10: 0/1 = 0.0000"]


def test_evaluate_agrees_with_the_single_metrics(results):
    table = gf.evaluate(results, SPEC)
    refusal = table.where("section = 'refusal' and scope = 'group'").select("grp", "n", "total", "value")
    assert rows_of(refusal, *refusal.columns) == rows_of(gf.refusal_rate(results, "LLM_answer", "grp"), "grp", "refused", "total", "refusal_rate")
    for scope, by in (("overall", None), ("group", "grp")):
        keys = (["grp"] if by else []) + ["label", "n"]
        dist = table.where(f"section = 'distribution' and scope = '{scope}'")
        assert rows_of(dist, *keys) == rows_of(gf.relevance_distribution(results, "labels", by), *keys)
        labels = table.where(f"section = 'label_accuracy' and scope = '{scope}'").withColumnRenamed("n", "correct")
        keys = (["grp"] if by else []) + ["label", "correct", "total"]
        assert rows_of(labels, *keys) == rows_of(gf.relevance_accuracy(results, "LLM_answer", "gold", "labels", by), *keys)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["g1", "g2", None]), st.sampled_from(["A", "b", None, " C"]), st.sampled_from(["A", "C", None])), max_size=30))
def test_sums_fit(spark, rows):
    df = spark.createDataFrame(rows, "grp string, LLM_answer string, gold string")
    overall = gf.evaluate(df, SPEC).where("section = 'refusal' and scope = 'overall'").first()
    valid = gf.accuracy(df, "LLM_answer", "gold").first().valid
    assert overall.total == len(rows) and overall.n + valid == len(rows)
    groups = gf.refusal_rate(df, "LLM_answer", "grp").collect()
    assert sum(g.total for g in groups) == sum(r[0] is not None for r in rows)


def test_many_questions(spark):
    """More aggregates than generated code takes in one operator."""
    n = 25
    names = [f"q{i}" for i in range(n)]
    rows = [tuple(["ABCDEFGHIJ"[(r + i) % 10] if (r * i) % 3 else None for i in range(n)] + ["A", f"g{r % 2}"]) for r in range(40)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in [*names, "gold", "grp"]))
    spec = EvalSpec(group_col="grp", questions=tuple(Question(name, "gold") for name in names))
    got = gf.question_metrics(df, spec).where("section in ('refusal', 'accuracy') and scope = 'overall'").collect()
    assert len(got) == 2 * n
    for row in got:
        answers = [r[row.question_no] for r in rows]
        valid = [a for a in answers if a]
        want = (len(answers) - len(valid), len(answers)) if row.section == "refusal" else (valid.count("A"), len(valid))
        assert (row.n, row.total) == want
