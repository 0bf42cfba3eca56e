"""What Spark makes of the plans: passes, shuffles, pruning, skew."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import gradeframe as gf
from gradeframe.operators import resume
from workload import tables as t
from workload.queries import QUERIES, make_counting_responder

SF_DIR = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final(df):
    """The adaptive plan after running."""
    rows = df.collect()
    text = physical(df)
    return rows, text.split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "results")
    t.results(spark, SF_DIR).write.parquet(path)
    return spark.read.parquet(path)


def test_response_is_parsed_once(spark):
    """One strict reading of the object and one of its label list by type."""
    assert optimized(t.results(spark, SF_DIR)).count("from_json(") == 2
    assert optimized(t.multi_results(spark, SF_DIR)).count("from_json(") == 2


def test_a_filter_on_the_answer_adds_one_parse_at_most(spark):
    rows = t.results(spark, SF_DIR).where(gf.is_valid_answer(F.col("LLM_answer")))
    assert optimized(rows).count("from_json(") <= 4


def test_evaluate_is_one_narrow_scan(stored):
    text = physical(gf.evaluate(stored, t.SPEC))
    assert text.count("FileScan") == 1
    schema = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
    assert sorted(f.split(":")[0] for f in schema.split(",")) == ["LLM_answer", "gold", "grp", "labels"]
    # One exchange of partial sums, two of group rows to merge them into the overall row.
    assert text.count("Exchange") == 3
    assert "Python" not in text and "Join" not in text and "Window" not in text


def test_each_metric_is_one_partial_aggregation(stored):
    for df in (
        gf.refusal_rate(stored, "LLM_answer", "grp"), gf.accuracy(stored, "LLM_answer", "gold", "grp"),
        gf.relevance_distribution(stored, "labels", "grp"),
        gf.relevance_accuracy(stored, "LLM_answer", "gold", "labels", "grp"),
    ):
        text = physical(df)
        assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 1
        assert text.count("HashAggregate") == 2 and "Python" not in text
    # Here the group rows are gone through once more, to add the overall row of an empty table.
    text = physical(gf.answer_metrics(stored, "LLM_answer", "gold", "grp"))
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 2 and "Python" not in text


def test_metrics_by_group_push_the_group_filter_down(stored):
    assert "IsNotNull(grp)" in physical(gf.refusal_rate(stored, "LLM_answer", "grp"))


def test_row_level_work_does_not_shuffle(stored):
    for df in (t.results(stored.sparkSession, SF_DIR), gf.row_summary(stored, t.SPEC), gf.labels_to_wide(stored, 30)):
        assert "Exchange" not in physical(df)


def test_the_responder_is_one_python_step(spark):
    text = physical(gf.score(t.items(spark, SF_DIR), t.SPEC, make_counting_responder))
    assert text.count("ArrowEvalPython") == 1 and "Exchange" not in text


def test_no_query_pairs_rows_without_a_key(spark):
    for name, query in QUERIES.items():
        text = physical(query(spark, SF_DIR))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


@pytest.fixture
def skewed(spark, tmp_path):
    """A third of the items has one id, a third has none; small limits so that
    adaptive execution treats this as a large skew."""
    limits = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
    }
    old = {k: spark.conf.get(k, None) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    key = F.when(F.col("id") % 3 == 0, F.lit(6)).when(F.col("id") % 3 == 1, F.col("id"))
    spark.range(0, 60000, 1, 8).select(key.alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("x")).write.parquet(str(tmp_path / "items"))
    yield spark.read.parquet(str(tmp_path / "items"))
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("hot_is_done", [True, False])
def test_pending_splits_a_hot_id(spark, skewed, hot_is_done):
    done = spark.range(0, 60000, 2).where("id != 6")
    if hot_is_done:
        # The existing results repeat the hot id as well.
        done = done.union(spark.range(20000).selectExpr("6L as id"))
    rows, text = final(gf.pending(skewed, done, "id"))
    assert "skew=true" in text
    done_ids = set(range(0, 60000, 2)) - {6} | ({6} if hot_is_done else set())
    want = Counter(i for i in (6 if k % 3 == 0 else k if k % 3 == 1 else None for k in range(60000)) if i not in done_ids)
    assert Counter(r.id for r in rows) == want


@pytest.mark.parametrize("unique", [True, False])
def test_attach_splits_a_hot_id(spark, skewed, unique):
    said = spark.range(0, 60000, 5).selectExpr("id", "concat('r', id) as response").union(
        spark.createDataFrame([(6, "hot")], "id long, response string"))
    if not unique:
        said = said.unionAll(said)
    rows, text = final(gf.attach_responses(skewed, said, "id", unique=unique))
    assert "skew=true" in text
    assert len(rows) == 60000
    assert sum(r.Raw_Response == "hot" for r in rows) == 20000
    assert all(r.Raw_Response == (f"r{r.id}" if r.id % 5 == 0 else "") for r in rows if r.id not in (6, None))
    assert all(r.error for r in rows if r.id is None)


def test_small_done_sets_are_broadcast_by_their_measured_size(spark, tmp_path):
    spark.range(100000).write.parquet(str(tmp_path / "i"))
    text = physical(gf.pending(spark.read.parquet(str(tmp_path / "i")), spark.range(50), "id"))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_ids_and_responses_are_reduced_before_they_meet(spark, skewed, monkeypatch):
    """Map-side combine on both sides, and no shuffle beyond that."""
    seen = []
    monkeypatch.setattr(resume, "staged", lambda df, *rest: seen.append(df) or df)
    said = skewed.withColumnRenamed("x", "response").withColumn("attempt", F.lit(1))
    gf.pending(skewed, said, "id")
    gf.attach_responses(skewed, said, "id", attempt_col="attempt")
    for df in seen:
        text = physical(df)
        assert text.count("Exchange hashpartitioning") == 2 and text.count("Exchange") == 2
        for side in text.split("Exchange hashpartitioning")[1:]:
            below = side.split("Exchange")[0]
            assert "HashAggregate" in below or "partial_max" in below
    ids_only = physical(seen[0])
    assert "ReadSchema: struct<id:bigint>" in ids_only and "x:string" not in ids_only


def test_wide_items_are_not_sorted_to_be_resumed(spark, skewed):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64MB")
    rows, text = final(gf.pending(skewed, spark.range(0, 60000, 2), "id"))
    assert "ShuffledHashJoin" in text and "Sort [" not in text


def test_few_new_items_do_not_shuffle_the_ids_of_the_results(spark, tmp_path, monkeypatch):
    """The ids of a small batch are broadcast to the scan of the results."""
    seen = []
    monkeypatch.setattr(resume, "staged", lambda df, *rest: seen.append(df) or df)
    spark.range(200000).write.parquet(str(tmp_path / "results"))
    spark.range(0, 50).write.parquet(str(tmp_path / "items"))
    gf.pending(spark.read.parquet(str(tmp_path / "items")), spark.read.parquet(str(tmp_path / "results")), "id")
    _, text = final(seen[0])
    # From the top: reduce, shuffle what is left, join, scan of the results.
    above, below = text.split("BroadcastHashJoin")
    assert above.count("HashAggregate") == 2 and above.count("Exchange hashpartitioning") == 1
    assert "LeftSemi, BuildRight" in below.splitlines()[0]
    assert "Exchange" not in below.split("FileScan")[0]
