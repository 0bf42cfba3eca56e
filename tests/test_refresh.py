"""Merged figures, streams of them, and evaluations that read new files only."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

import gradeframe as gf
from gradeframe.operators.moments import mean_of, merged_with_overall, moment, std_of

H, L, I = "High Relevance", "Low Relevance", "Irrelevant"
SCHEMA = "id string, grp string, gold string, LLM_answer string, Q2 string, labels array<string>, error string"
SINGLE = gf.EvalSpec(id_col="id", group_col="grp", gold_col="gold")
MULTI = gf.EvalSpec(id_col="id", group_col="grp", questions=(gf.Question("LLM_answer", "gold"), gf.Question("Q2"), gf.Question("absent")))


def rows(seed, n, groups=("x", "y", "z", None), errors=False):
    rnd = random.Random(seed)
    return [(f"{seed}-{i}", rnd.choice(groups), rnd.choice("AB"), rnd.choice(["A", "B", "Z", None]), rnd.choice(["C", None]),
             [rnd.choice([H, L, I, "odd", None]) for _ in range(rnd.randint(0, 7))], "late" if errors and i % 9 == 0 else None) for i in range(n)]


def table(spark, made):
    return spark.createDataFrame(made, SCHEMA)


def shown(metrics):
    def plain(v):
        return round(v, 10) if isinstance(v, float) else v
    return sorted((tuple(plain(v) for v in r) for r in metrics.collect()), key=repr)


def by_all_rows(df, value, group=None):
    df = df if group is None else df.where(F.col("g").eqNullSafe(F.lit(group)))
    return df.agg(F.count(value), F.avg(value), F.stddev_samp(value)).first()


@pytest.mark.parametrize("shift", [0.0, 1e9])
def test_merged_moments_equal_those_of_all_rows(spark, shift):
    rnd = random.Random(3)
    made = [(rnd.choice(["a", "b", "c", None, "one"]), rnd.choice([None, shift + rnd.random(), shift + 0.25]), rnd.randrange(4)) for _ in range(400)]
    made += [("empty", None, 0), ("single", shift + 0.5, 1)]
    df = spark.createDataFrame(made, "g string, v double, part int")
    # Several rows per group, as from several tables.
    some = df.groupBy(F.col("g").alias("grp"), "part").agg(F.count(F.lit(1)).alias("total"), moment(F.col("v")).alias("m")).drop("part")
    got = merged_with_overall(some, ["total"], ["m"]).select("*", mean_of(F.col("m")).alias("mean"), std_of(F.col("m")).alias("std"))
    found = {(r.is_overall, r.grp): r for r in got.collect()}
    assert set(found) == {(True, None)} | {(False, g) for g in ("a", "b", "c", "one", "empty", "single")}
    for (overall, group), row in found.items():
        n, mean, std = by_all_rows(df, "v", None if overall else group)
        assert row["m"]["n"] == n
        for mine, other in ((row["mean"], mean), (row["std"], std)):
            assert (mine is None) == (other is None) and (mine is None or math.isclose(mine, other, rel_tol=1e-6 if shift else 1e-12, abs_tol=1e-12))
    assert found[True, None].total == len(made)


def test_equal_values_have_no_spread(spark):
    df = spark.range(3000).select((F.col("id") % 700).cast("string").alias("grp"), F.lit(0.1).alias("v"))
    got = merged_with_overall(df.groupBy("grp").agg(moment(F.col("v")).alias("m")), [], ["m"]).where("is_overall").first()
    assert got["m"]["n"] == 3000 and got["m"]["mean"] == pytest.approx(0.1, abs=1e-15) and got["m"]["spread"] < 1e-25


def test_rows_are_not_doubled_for_the_overall_figures(spark, tmp_path):
    """The table's rows are aggregated once, by group; only group rows are merged into the overall row."""
    table(spark, rows(1, 50)).write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    for frame in (gf.evaluate(stored, SINGLE), gf.answer_metrics(stored, "LLM_answer", "gold", "grp")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan and plan.count("FileScan") == 1
        # The scan feeds the aggregation by group; what doubles rows comes after it.
        assert plan.index("Generate") < plan.rindex("keys=[grp")


def test_no_rows_and_no_groups(spark):
    empty = gf.evaluate(table(spark, []), SINGLE).collect()
    assert {r.scope for r in empty} == {"overall"} and {r.total for r in empty} == {0} and {r.value for r in empty} == {None}
    nameless = gf.evaluate(table(spark, rows(1, 30, groups=(None,))), SINGLE)
    assert {r.scope for r in nameless.collect()} == {"overall"}
    ungrouped = gf.evaluate(table(spark, rows(1, 30)), gf.EvalSpec(gold_col="gold"))
    with_group = gf.evaluate(table(spark, rows(1, 30)), SINGLE).where("scope = 'overall'")
    assert shown(ungrouped) == shown(with_group)


@pytest.mark.parametrize("spec", [SINGLE, MULTI], ids=["single", "multi"])
def test_stream_equals_evaluate(spark, tmp_path, spec):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):
        table(spark, rows(part, 40)).coalesce(1).write.mode("append").parquet(src)
        gf.stream_evaluate(gf.read_stream(spark, src, SCHEMA, 1), spec, out, str(tmp_path / "p")).trigger(availableNow=True) \
            .start().awaitTermination()
        assert shown(gf.read_stream_metrics(spark, out)) == shown(gf.evaluate(spark.read.parquet(src), spec))


def report_of(folder):
    return "".join(p.read_text() for p in sorted((folder / "report").glob("part-*")))


@pytest.mark.parametrize("spec", [SINGLE, MULTI], ids=["single", "multi"])
def test_refresh_equals_evaluation_and_reads_new_files_only(spark, tmp_path, spec):
    path, out, whole = str(tmp_path / "r"), tmp_path / "out", tmp_path / "whole"
    for part in range(3):
        gf.append_part(table(spark, rows(part, 40)).repartition(2), path, f"p-{part}", "id")
        # What was read before cannot be read now.
        old = [f for f in (tmp_path / "r").glob("*.parquet") if not f.name.startswith(f"p-{part}~")]
        kept = {f: f.read_bytes() for f in old}
        times = {f: f.stat() for f in old}
        for f in old:
            f.write_bytes(b"x" * len(kept[f]))
            os.utime(f, ns=(times[f].st_atime_ns, times[f].st_mtime_ns))
        metrics = shown(gf.refresh_evaluation(spark, path, spec, str(out)))
        for f in old:
            f.write_bytes(kept[f])
            os.utime(f, ns=(times[f].st_atime_ns, times[f].st_mtime_ns))
        assert metrics == shown(gf.run_evaluation(spark, path, spec, str(whole)))
        assert report_of(out) == report_of(whole)
        one, other = (spark.read.parquet(str(f / "summary")) for f in (out, whole))
        assert sorted(map(repr, one.collect())) == sorted(map(repr, other.select(*one.columns).collect()))
    # Nothing new: nothing is read.
    assert shown(gf.refresh_evaluation(spark, path, spec, str(out))) == metrics


def test_refresh_after_a_repeated_append(spark, tmp_path):
    path, out, whole = str(tmp_path / "r"), str(tmp_path / "out"), str(tmp_path / "whole")
    gf.append_part(table(spark, rows(1, 40)), path, "a", "id")
    gf.append_results(table(spark, rows(2, 30)), path)
    gf.refresh_evaluation(spark, path, SINGLE, out)
    gf.append_part(table(spark, rows(3, 35)), path, "a", "id")
    got = shown(gf.refresh_evaluation(spark, path, SINGLE, out))
    assert got == shown(gf.run_evaluation(spark, path, SINGLE, whole))
    assert sorted(r.id for r in spark.read.parquet(out + "/summary").collect()) == sorted(r.id for r in spark.read.parquet(path).collect())


def test_refresh_with_rows_in_error_evaluates_the_whole(spark, tmp_path):
    path, out, whole = str(tmp_path / "r"), str(tmp_path / "out"), str(tmp_path / "whole")
    gf.append_part(table(spark, rows(1, 40, errors=True)), path, "a", "id")
    retried = [(*r[:-1], None) for r in rows(1, 40, errors=True) if r[-1]]
    for step in range(2):
        assert shown(gf.refresh_evaluation(spark, path, SINGLE, out)) == shown(gf.run_evaluation(spark, path, SINGLE, whole))
        one, other = (spark.read.parquet(f + "/summary") for f in (out, whole))
        assert sorted(map(repr, one.collect())) == sorted(map(repr, other.collect()))
        gf.append_part(table(spark, retried), path, "b", "id")


def test_refresh_without_results(spark, tmp_path):
    with pytest.raises(ValueError, match="no results"):
        gf.refresh_evaluation(spark, str(tmp_path / "absent"), SINGLE, str(tmp_path / "out"))
