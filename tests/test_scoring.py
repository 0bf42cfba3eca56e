"""Sources, resume, scoring jobs and streams."""

import os
import sys

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

import gradeframe as gf
from gradeframe import EvalSpec
from gradeframe.operators.resume import settled_results
from gradeframe.plans import jobs
from gradeframe.sources.tables import scratch_path, scratch_root

cloudpickle.register_pickle_by_value(sys.modules[__name__])

H = "High Relevance"
SPEC = EvalSpec(id_col="id", sentences_col="s", options_col="o", gold_col="gold", group_col="grp", model_name="m")


def items_of(spark, ids):
    rows = [(i, f"S1: text {i}", f"Q{i}", "A", "g") for i in ids]
    return spark.createDataFrame(rows, "id string, s string, o string, gold string, grp string")


def make_responder(spec):
    def respond(prompts):
        if any("text bad" in p for p in prompts):
            raise RuntimeError("cannot")
        return [None if "text none" in p else f'  {{"Answer": "a", "Sentence_Relevance": ["{H}"]}} ' for p in prompts]
    return respond


def ids(df):
    return sorted((r.id for r in df.select("id").collect()), key=repr)


def test_csv_round_trip(spark, tmp_path):
    rows = [("1", 'two\nlines, "quoted"', " padded ", "NA"), ("007", "x", "None", "A")]
    gf.write_table(spark.createDataFrame(rows, "id string, s string, o string, gold string"), str(tmp_path / "c"), "csv")
    got = gf.read_items(spark, str(tmp_path / "c"), "csv")
    assert sorted(tuple(r) for r in got.collect()) == [
        ("007", "x", None, "A"), ("1", 'two\nlines, "quoted"', " padded ", None)]


def test_hand_written_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,Raw_Response,LLM_answer,label_1,label_2,gold\n1,"{""Answer"": ""A""}\nbye",A,High Relevance,,A\n2,,,nan,Low Relevance,NA\n')
    got = gf.read_results(spark, str(path), "csv").orderBy("id").collect()
    assert got[0].Raw_Response == '{"Answer": "A"}\nbye'
    assert [r.labels for r in got] == [[H, None], [None, "Low Relevance"]]
    assert (got[1].LLM_answer, got[1].gold) == (None, None)


CSV_FILES = {
    "crlf": b'id,s,o\r\n1,a,x\r\n2,c,\r\n',
    "bom": b'\xef\xbb\xbfid,s,o\n1,a,b\n',
    "backslash": b'id,s,o\n1,"a\\",b\n2,c\\n,"d""e"\n',
    "blank line": b'id,s,o\n1,a,b\n\n2,c,d\n',
    "short line": b'id,s,o\n1,a\n2,c,d\n',
    "blanks": b'id,s,o\n 1 , a ," b "\n',
    "hash": b'id,s,o\n#1,a,b\n',
    "odd breaks": b'id,s,o\n1,"\xc3\xa9\xe2\x80\xa8z\r\nk",b\n',
    "no last break": b'id,s,o\n1,a,"b"',
    "header only": b'id,s,o\n',
    "markers": b'id,s,o\n1,"",NA\n2,"null",none\n',
}


@pytest.mark.parametrize("name", CSV_FILES)
def test_csv_reads_as_pandas_reads_it(spark, tmp_path, name):
    path = tmp_path / "in.csv"
    path.write_bytes(CSV_FILES[name])
    want = pd.read_csv(path, dtype=str)
    got = gf.read_items(spark, str(path), "csv")
    assert got.columns == list(want.columns)
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in want.itertuples(index=False)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)


def test_preview_and_roles(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "id int, `my.col` string")
    assert ids(gf.preview(df, 2, "id")) == [1, 2]
    assert gf.preview(df, 5).count() == 3
    assert gf.bind_roles(df, EvalSpec(id_col="id", sentences_col="my.col", options_col="my.col")).columns == ["id", "sentences", "options"]


def test_pending_keeps_missing_and_repeated_ids(spark):
    items = items_of(spark, ["1", None, "2", "2", None])
    done = spark.createDataFrame([(1,), (None,)], "id int")
    assert ids(gf.pending(items, done, "id")) == sorted([None, None, "2", "2"], key=repr)
    assert gf.pending(items, None, "id").count() == 5
    assert gf.pending(items, done, None).count() == 5
    assert gf.pending(items, done.withColumnRenamed("id", "other"), "id").count() == 5
    assert [r.id for r in gf.processed_ids(done, "id").collect()] == ["1"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(0, 6))), st.lists(st.one_of(st.none(), st.integers(0, 6))))
def test_pending_and_processed_make_up_the_input(spark, given_ids, done_ids):
    items = spark.createDataFrame([(i,) for i in given_ids], "id int")
    done = spark.createDataFrame([(None if i is None else str(i),) for i in done_ids], "id string")
    left = ids(gf.pending(items, done, "id"))
    processed = {r.id for r in gf.processed_ids(done, "id").collect()}
    assert processed == {str(i) for i in done_ids if i is not None}
    skipped = [i for i in given_ids if i is not None and str(i) in processed]
    assert sorted(left + skipped, key=repr) == sorted(given_ids, key=repr)
    assert not {str(i) for i in left if i is not None} & processed


def test_attach_takes_the_last_attempt(spark):
    items = items_of(spark, ["1", "1", "2", "3", None])
    said = spark.createDataFrame([("1", "old", 1), ("1", " new ", 2), ("2", None, 1), (None, "x", 1)], "id string, response string, attempt int")
    got = gf.attach_responses(items, said, "id", attempt_col="attempt")
    assert sorted((str(r.id), r.Raw_Response, r.error is None) for r in got.collect()) == [
        ("1", "new", True), ("1", "new", True), ("2", "", False), ("3", "", False), ("None", "", False)]
    once = said.where("attempt = 1")
    assert gf.attach_responses(items, once, "id", unique=True).count() == 5


def test_score_isolates_failing_rows(spark):
    scored = gf.score(items_of(spark, ["1", "bad", "none", "2"]).coalesce(1), SPEC, make_responder)
    rows = {r.id: r for r in scored.collect()}
    assert rows["1"].LLM_answer == "A" and rows["1"].labels == [H] and rows["1"].error is None
    assert rows["1"].Raw_Response == f'{{"Answer": "a", "Sentence_Relevance": ["{H}"]}}'
    assert (rows["bad"].Raw_Response, rows["bad"].LLM_answer, rows["bad"].labels) == ("", None, [])
    assert rows["bad"].error == "RuntimeError: cannot" and rows["none"].error == "no response"


def test_wrong_number_of_responses_is_an_error(spark):
    scored = gf.score(items_of(spark, ["1", "2"]).coalesce(1), SPEC, lambda spec: lambda prompts: ["x"] * 3, partitions=2)
    assert {r.error for r in scored.collect()} == {"ValueError: 1 prompts but 3 responses"}


def test_a_response_that_is_no_text_is_an_error(spark):
    scored = gf.score(items_of(spark, ["1"]), SPEC, lambda spec: lambda prompts: [5 for _ in prompts])
    assert scored.first().error == "response is no text but int"


def test_batches_are_bounded_and_the_responder_made_once_per_task(spark):
    def make(spec):
        sizes = []

        def respond(prompts):
            sizes.append(len(prompts))
            return [",".join(map(str, sizes))] * len(prompts)
        return respond

    scored = gf.score(items_of(spark, [str(i) for i in range(10)]).coalesce(1), SPEC, make, batch_rows=4)
    assert {r.Raw_Response for r in scored.collect()} == {"4", "4,4", "4,4,2"}


def test_items_with_result_columns_are_refused(spark):
    with pytest.raises(ValueError, match="error"):
        gf.score(items_of(spark, ["1"]).withColumn("error", F.lit(1)), SPEC, make_responder)


def test_resume_equals_one_run(spark, tmp_path):
    everything = items_of(spark, ["1", "2", "2", "bad", "3", "4"])
    half, whole = str(tmp_path / "half"), str(tmp_path / "whole")
    first = gf.run_scoring(everything.where("id in ('1', '2', 'bad')"), SPEC, make_responder, half)
    assert (first.processed, first.errors, first.written) == (3, 1, 4)
    second = gf.run_scoring(everything, SPEC, make_responder, half)
    assert (second.processed, second.errors, second.written) == (6, 0, 2)
    gf.run_scoring(everything, SPEC, make_responder, whole)
    assert sorted(map(repr, spark.read.parquet(half).collect())) == sorted(map(repr, spark.read.parquet(whole).collect()))
    third = gf.run_scoring(everything, SPEC, make_responder, whole)
    assert third.written == 0


def test_a_sliced_run_keeps_what_was_done_before_it_died(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "r")
    items = items_of(spark, ["1", "2", "bad", "4", "5", "6", "7", "8"]).repartition(4)
    plain, calls = jobs.append_part, []

    def dying(df, where, *more):
        calls.append(where)
        if len(calls) == 3:
            raise RuntimeError("driver lost")
        plain(df, where, *more)

    monkeypatch.setattr(jobs, "append_part", dying)
    with pytest.raises(RuntimeError, match="driver lost"):
        gf.run_scoring(items, SPEC, make_responder, path, slices=3)
    done = spark.read.parquet(path).count()
    assert 0 < done < 8
    again = gf.run_scoring(items, SPEC, make_responder, path, slices=3)
    assert again.written == 8 - done
    assert ids(spark.read.parquet(path)) == ["1", "2", "4", "5", "6", "7", "8", "bad"]


def test_retry_replaces_error_rows(spark, tmp_path):
    path = str(tmp_path / "r")
    items = items_of(spark, ["1", "bad", "none"])
    gf.run_scoring(items, SPEC, make_responder, path)
    again = gf.run_scoring(items.where("id != 'none'"), SPEC, lambda spec: lambda ps: ["Answer: B"] * len(ps), path, retry_errors=True)
    assert again.written == 1
    settled = settled_results(spark.read.parquet(path), "id")
    assert sorted((r.id, r.LLM_answer) for r in settled.collect()) == sorted([("1", "A"), ("bad", "B"), ("none", None)])
    for settle, total in ((False, 4), (True, 3)):
        metrics = gf.run_evaluation(spark, path, SPEC, str(tmp_path / "out"), settle=settle)
        assert metrics.where("section = 'refusal' and scope = 'overall'").first().total == total


def test_append_is_by_name_and_strict(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "x")], "a int, b string")
    gf.append_results(one, path)
    gf.append_results(one.select("b", "a"), path)
    assert spark.read.parquet(path).distinct().count() == 1
    for wrong in (one.withColumn("c", F.lit(1)), one.drop("b"), one.withColumn("a", F.lit("1"))):
        with pytest.raises(ValueError, match="other columns"):
            gf.append_results(wrong, path)
    assert gf.existing_results(spark, str(tmp_path / "absent")) is None
    (tmp_path / "bare").mkdir()
    assert gf.existing_results(spark, str(tmp_path / "bare")) is None
    assert gf.results_union(one, one.select("b", "a")).count() == 2


def test_evaluation_job_writes_all_three(spark, tmp_path):
    path, out = str(tmp_path / "results"), tmp_path / "out"
    gf.run_all(items_of(spark, ["1", "2", "bad"]), SPEC, make_responder, path, str(out))
    text = "".join(p.read_text() for p in sorted((out / "report").glob("part-*")))
    assert text.startswith(f"=== Analysis Report ===\nInput:  {path}\nModel:  m\n\n--- LLM_answer ---\n")
    assert "    Overall: 1/3 = 0.3333\n    g: 1/3 = 0.3333\n  Accuracy:\n    Overall: 2/2 = 1.0000" in text
    assert text.endswith("\n    Irrelevant: mean=0.0000, std=0.0000, 95% CI=(0.0000, 0.0000)\n")
    assert spark.read.parquet(str(out / "summary")).count() == 3
    gf.run_evaluation(spark, path, SPEC, str(out), summary_fmt="csv")
    csv = spark.read.option("header", True).csv(str(out / "summary"))
    assert {r.LLM_answer_refused for r in csv.collect()} == {"True", "False"}


def test_recorded_job(spark, tmp_path):
    said = spark.createDataFrame([("1", "Answer: C"), ("2", "no")], "id string, response string")
    counters = gf.run_recorded(items_of(spark, ["1", "2", "3"]), said, SPEC, str(tmp_path / "r"))
    assert (counters.processed, counters.errors, counters.written) == (2, 1, 3)


def test_run_counters(spark):
    items = items_of(spark, ["1", "bad"])
    assert gf.run_counters(items, gf.score(items, SPEC, make_responder)).first() == (1, 1)


def test_stream_survives_a_failure_between_write_and_commit(spark, tmp_path, monkeypatch):
    src, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for group in (["1", "2"], ["2", None], ["3", None]):
        items_of(spark, group).coalesce(1).write.mode("append").parquet(src)
    stream = gf.read_stream(spark, src, items_of(spark, []).schema, 1)
    writer_class = type(stream.writeStream)
    plain = writer_class.foreachBatch
    failures = []

    def failing(self, write):
        def then_fail(batch, number):
            write(batch, number)
            if number == 1 and not failures:
                failures.append(number)
                raise RuntimeError("driver lost")
        return plain(self, then_fail)

    monkeypatch.setattr(writer_class, "foreachBatch", failing)

    def run():
        writer = gf.stream_score(stream, SPEC, lambda todo: gf.score(todo, SPEC, make_responder), out, progress, "s")
        writer.trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="driver lost"):
        run()
    assert len(ids(gf.read_stream_results(spark, out))) > 2
    run()
    assert failures and ids(gf.read_stream_results(spark, out)) == sorted(["1", "2", "3", None, None], key=repr)


def test_stream_name_is_checked(spark, tmp_path):
    with pytest.raises(ValueError, match="stream_name"):
        gf.stream_score(spark.range(1), SPEC, lambda d: d, str(tmp_path), str(tmp_path), "a/b")


def test_scratch_goes_to_the_shared_folder(spark):
    class Session:
        class conf:
            shared = "hdfs://shared/x/"

            @classmethod
            def get(cls, key, default=None):
                return {"spark.checkpoint.dir": cls.shared, "spark.sql.warehouse.dir": "s3a://w/house"}[key]

    assert scratch_root(Session) == "hdfs://shared/x"
    Session.conf.shared = None
    assert scratch_root(Session) == "s3a://w/house/_scratch"
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


def test_a_run_with_default_arguments_keeps_what_was_paid_for(spark, tmp_path, monkeypatch):
    path, asked = str(tmp_path / "r"), str(tmp_path / "asked")
    items = items_of(spark, [str(i) for i in range(40)]).coalesce(1)
    plain, calls = jobs.append_part, []

    def dying(df, where, *more):
        calls.append(where)
        if len(calls) == 3:
            raise RuntimeError("driver lost")
        plain(df, where, *more)

    def make(spec):
        def respond(prompts):
            with open(asked, "a") as out:
                out.write("".join(f"{p[-30:]!r}\n" for p in prompts))
            return ["Answer: A"] * len(prompts)
        return respond

    monkeypatch.setattr(jobs, "append_part", dying)
    with pytest.raises(RuntimeError, match="driver lost"):
        gf.run_scoring(items, SPEC, make, path)
    kept = spark.read.parquet(path).count()
    assert kept >= 20
    assert gf.run_scoring(items, SPEC, make, path).written == 40 - kept
    assert len(open(asked).read().splitlines()) == 40
    assert not [p for p in os.listdir(scratch_root(spark).removeprefix("file:")) if p.startswith("slices-")]


def test_recorded_responses_that_come_late(spark, tmp_path):
    path = str(tmp_path / "r")
    items = items_of(spark, ["1", "2"])
    early = spark.createDataFrame([("1", "Answer: A")], "id string, response string")
    late = spark.createDataFrame([("1", "Answer: B"), ("2", "Answer: C")], "id string, response string")
    assert gf.run_recorded(items, early, SPEC, path).errors == 1
    assert gf.run_recorded(items, late, SPEC, path).written == 0
    assert gf.run_recorded(items, late, SPEC, path, retry_errors=True).written == 1
    metrics = gf.run_evaluation(spark, path, SPEC, str(tmp_path / "out"))
    assert metrics.where("section = 'refusal' and scope = 'overall'").first().total == 2


def test_two_failed_tries_count_once(spark):
    rows = [("1", None, "x"), ("1", None, "y"), ("2", "A", None), (None, None, "z"), (None, None, "z")]
    settled = settled_results(spark.createDataFrame(rows, "id string, LLM_answer string, error string"), "id")
    assert sorted(str(r.id) for r in settled.collect()) == ["1", "2", "None", "None"]


def test_all_labels_are_kept(spark):
    labels = ", ".join('"Irrelevant"' for _ in range(40))
    sentences = " ".join(f"S{i}: x" for i in range(1, 41))
    df = spark.createDataFrame([(sentences, f'{{"Answer": "A", "Sentence_Relevance": [{labels}]}}')], "s string, r string")
    made = gf.parse_single(df, F.col("r"), gf.sentence_count(F.col("s")))
    assert len(made.first().labels) == 40
    wide = gf.labels_to_wide(made, 40)
    assert len(gf.labels_from_wide(wide).first().labels) == 40


def test_csv_rows_with_too_many_fields_are_an_error(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,a,b\n1,x,y\n2,p,q,EXTRA\n")
    with pytest.raises(Exception, match="too many fields"):
        gf.read_items(spark, str(tmp_path / "in.csv"), "csv").collect()
    (tmp_path / "short.csv").write_text("id,a,b\n1,x\n2,p,q\n")
    assert [tuple(r) for r in gf.read_items(spark, str(tmp_path / "short.csv"), "csv").collect()] == [("1", "x", None), ("2", "p", "q")]


def test_csv_headers_in_another_order_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,grp\n1,g\n")
    (tmp_path / "b.csv").write_text("grp,id\ng,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        gf.read_items(spark, str(tmp_path), "csv").collect()
    with pytest.raises(Exception, match="(?i)header"):
        gf.read_items(spark, str(tmp_path / "a.csv"), "csv", "grp string, id string").collect()


def test_csv_types_give_numeric_groups(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,grp\n1,10\n2,2\n3,NA\n4,1\n")
    got = gf.read_items(spark, str(tmp_path / "in.csv"), "csv", types={"grp": "int"})
    assert [r.grp for r in got.orderBy("grp").collect()] == [None, 1, 2, 10]


def test_nan_is_a_missing_group_and_empty_tables_have_an_overall_row(spark):
    rows = spark.createDataFrame([(1.0, "A"), (float("nan"), "A"), (None, "B")], "grp double, LLM_answer string")
    got = gf.answer_metrics(rows, "LLM_answer", None, "grp").collect()
    assert sorted((r.scope, r.grp, r.total) for r in got) == [("group", 1.0, 1), ("overall", None, 3)]
    assert [r.grp for r in gf.refusal_rate(rows, "LLM_answer", "grp").collect()] == [1.0]
    groups = gf.evaluate(rows, EvalSpec(group_col="grp")).where("scope = 'group'").select("grp").distinct().collect()
    assert [r.grp for r in groups] == [1.0]
    empty = gf.answer_metrics(rows.limit(0), "LLM_answer", None, "grp").collect()
    assert [(r.scope, r.total, r.refused, r.refusal_rate) for r in empty] == [("overall", 0, 0, None)]


def test_results_as_csv_and_back(spark, tmp_path):
    rows = [("1", '{"Answer": "A"}\n"x"', "A", [H, None]), ("2", "", None, [])]
    made = spark.createDataFrame(rows, "id string, Raw_Response string, LLM_answer string, labels array<string>")
    gf.write_table(gf.labels_to_wide(made, 2), str(tmp_path / "c"), "csv")
    back = {r.id: r for r in gf.read_results(spark, str(tmp_path / "c"), "csv").collect()}
    assert (back["1"].Raw_Response, back["1"].LLM_answer, back["1"].labels) == ('{"Answer": "A"}\n"x"', "A", [H, None])
    assert (back["2"].Raw_Response, back["2"].LLM_answer, back["2"].labels) == (None, None, [None, None])


def test_working_columns_do_not_take_the_callers(spark):
    items = items_of(spark, ["1"]).withColumns({n: F.lit(n) for n in ("_n", "_json", "_prompt", "_text")})
    said = spark.createDataFrame([("1", "Answer: C")], "id string, response string")
    for scored in (gf.score(items, SPEC, make_responder), gf.score_recorded(items, said, SPEC)):
        assert scored.columns[:9] == [*items.columns]
        assert scored.first()["_n"] == "_n"
    with pytest.raises(ValueError, match="id_col"):
        gf.score_recorded(items, said, EvalSpec(sentences_col="s", options_col="o"))


@pytest.mark.parametrize("second", ["b", "a"])
def test_streams_share_a_sink(spark, tmp_path, second):
    """Another stream, or the same one later, skips the ids already there."""
    schema = items_of(spark, []).schema
    for name, group in (("a", ["1", "2"]), (second, ["2", "3"])):
        src = str(tmp_path / ("in-" + name))
        items_of(spark, group).coalesce(1).write.mode("append").parquet(src)
        gf.stream_score(
            gf.read_stream(spark, src, schema), SPEC, lambda todo: gf.score(todo, SPEC, make_responder),
            str(tmp_path / "out"), str(tmp_path / ("progress-" + name)), name,
        ).trigger(availableNow=True).start().awaitTermination()
    assert ids(gf.read_stream_results(spark, str(tmp_path / "out"))) == ["1", "2", "3"]


def test_a_batch_reads_nothing_of_what_its_stream_wrote(spark, tmp_path):
    """Earlier output of the stream is made unreadable: later batches do not look, and still skip what was done."""
    schema = items_of(spark, []).schema
    src, out = tmp_path / "in", tmp_path / "out"

    def arrive(group):
        items_of(spark, group).coalesce(1).write.mode("append").parquet(str(src))
        gf.stream_score(
            gf.read_stream(spark, str(src), schema), SPEC, lambda todo: gf.score(todo, SPEC, make_responder),
            str(out), str(tmp_path / "progress"), "a",
        ).trigger(availableNow=True).start().awaitTermination()

    arrive(["1", "2", "2", None])
    first = sorted(out.glob("stream=a/*/*.parquet"))
    kept = [f.read_bytes() for f in first]
    for f in first:
        f.write_bytes(b"not a table")
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    arrive(["2", "3", "1", "3", None])
    for f, content in zip(first, kept):
        f.write_bytes(content)
    assert ids(gf.read_stream_results(spark, str(out))) == sorted(["1", "2", "2", "3", "3", None, None], key=repr)


def test_the_state_of_a_stream_is_gone_through_once(spark, tmp_path):
    """A scorer that reads its items twice does not have them looked up and entered twice; rows of an id in any order stay together."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    said = spark.createDataFrame([(str(i), "Answer: C") for i in range(40)], "id string, response string")
    entered, want = [], []
    for first in (0, 20):
        group = [str(i) for i in range(first, first + 40)] * 2 + ["hot"] * 3000 + [None] * 5
        items_of(spark, group).coalesce(1).write.mode("append").parquet(src)
        want += [str(i) for i in range(first if first == 0 else 40, first + 40)] * 2 + ["hot"] * (3000 if first == 0 else 0) + [None] * 5
        query = gf.stream_score(
            gf.read_stream(spark, src, items_of(spark, []).schema), SPEC,
            lambda todo: gf.score_recorded(todo, said, SPEC, unique=True), out, str(tmp_path / "progress"), "a",
        ).trigger(availableNow=True).start()
        query.awaitTermination()
        entered.append(sum(o.numRowsUpdated for p in query.recentProgress for o in p.stateOperators))
    assert sorted(ids(gf.read_stream_results(spark, out)), key=repr) == sorted(want, key=repr)
    assert entered == [41, 20]


def test_metrics_stream_equals_batch(spark, tmp_path):
    rows = [(g, a, "A") for g in ("x", "y", None) for a in ("A", "B", None, "A")]
    results = spark.createDataFrame(rows, "grp string, LLM_answer string, gold string")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for g in ("grp = 'x'", "grp is null", "grp = 'y'"):
        results.where(g).coalesce(1).write.mode("append").parquet(src)
        gf.stream_metrics(gf.read_stream(spark, src, results.schema, 1), "LLM_answer", "gold", "grp", out, str(tmp_path / "p")
                          ).trigger(availableNow=True).start().awaitTermination()
    want = gf.answer_metrics(results, "LLM_answer", "gold", "grp")
    assert sorted(map(repr, gf.read_stream_metrics(spark, out).collect())) == sorted(map(repr, want.collect()))
