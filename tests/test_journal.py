"""Replies that were committed are never asked for again, and appends can be retried."""

import os
import signal
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

import gradeframe as gf
from gradeframe.plans import jobs
from gradeframe.sources.journal import Journal, journal_of
from gradeframe.sources.parts import append_part, files_with, indexed_parts, pending_at

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SPEC = gf.EvalSpec(id_col="id", sentences_col="s", options_col="o")


def items_of(spark, ids):
    return spark.createDataFrame([(i, "S1: a", f"Q{i} ?") for i in ids], "id string, s string, o string")


def asking(log):
    """A responder that writes down what it was asked, and stops the whole run at a prompt of Q13."""
    def make(spec):
        def respond(prompts):
            with open(log, "a") as out:
                for prompt in prompts:
                    out.write(prompt.split("Q")[-1].split(" ")[0] + "\n")
            return ["Answer: B"] * len(prompts)
        return respond
    return make


def asked(log):
    return sorted(open(log).read().split()) if os.path.exists(log) else []


SCRIPT = '''
import os, sys, time
sys.path.insert(0, sys.argv[1])
folder = sys.argv[2]
import gradeframe as gf
from gradeframe.session import SETTINGS
from pyspark.sql import SparkSession

builder = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file:" + folder + "/shared")
for key, value in SETTINGS.items():
    builder = builder.config(key, value)
spark = builder.config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

def make_responder(spec):
    def respond(prompts):
        names = [p.split("Q")[-1].split(" ")[0] for p in prompts]
        with open(folder + "/asked", "a") as out:
            out.write("".join(n + "\\\\n" for n in names))
        if len(open(folder + "/asked").read().split()) > 60:
            time.sleep(600)
        return ["Answer: B"] * len(prompts)
    return respond

items = spark.range(0, 100, 1, 4).selectExpr("cast(id as string) id", "'S1: a' as s", "concat('Q', id, ' ?') as o")
spec = gf.EvalSpec(id_col="id", sentences_col="s", options_col="o")
gf.run_scoring(items, spec, make_responder, folder + "/results", slices=1, replies_per_commit=5)
'''


def test_a_job_killed_in_mid_slice_asks_for_no_committed_reply_again(spark, tmp_path):
    """The driver is killed while one slice of 100 items is asked for in 20 tasks; nothing was appended yet."""
    script, log, results = tmp_path / "job.py", str(tmp_path / "asked"), str(tmp_path / "results")
    script.write_text(SCRIPT.replace("\\\\n", "\\n"))
    job = subprocess.Popen([sys.executable, str(script), ROOT, str(tmp_path)], start_new_session=True, cwd=tmp_path,
                           stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    try:
        end = time.time() + 120
        while len(asked(log)) <= 60 and time.time() < end:
            time.sleep(0.2)
        time.sleep(1)
    finally:
        os.killpg(job.pid, signal.SIGKILL)
        job.wait()
    first = asked(log)
    assert not os.path.exists(results) and 60 < len(first) < 100
    journal = Journal(spark, results)
    committed = sorted(r.id for name in journal.kept() for r in journal.read(name).select("id").collect())
    # Only the two tasks at work lost theirs, of some five rows each.
    assert len(committed) >= len(first) - 20 and set(committed) <= set(first)

    items = items_of(spark, [str(i) for i in range(100)])
    counters = gf.run_scoring(items, SPEC, asking(log), results)
    again = asked(log)
    assert sorted(first + sorted(set(map(str, range(100))) - set(committed))) == again
    assert counters.written == 100
    rows = spark.read.parquet(results)
    assert rows.count() == rows.select("id").distinct().count() == rows.where("LLM_answer = 'B'").count() == 100
    assert not os.path.exists(journal_of(results))


def test_a_failed_publication_is_repeated_without_asking(spark, tmp_path, monkeypatch):
    """Dying after the append, before the journal knows, publishes the same part once more, in place of itself."""
    results, log = str(tmp_path / "r"), str(tmp_path / "asked")
    items = items_of(spark, ["1", "2", "3", None, None])

    def dead(self, name):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(Journal, "remove", dead)
        with pytest.raises(RuntimeError, match="driver lost"):
            gf.run_scoring(items, SPEC, asking(log), results, slices=1)
    assert spark.read.parquet(results).count() == 5 and len(asked(log)) == 5
    gf.run_scoring(items.where("id is not null"), SPEC, asking(log), results)
    assert spark.read.parquet(results).count() == 5 and len(asked(log)) == 5


def test_replies_are_kept_unparsed(spark, tmp_path, monkeypatch):
    results, log = str(tmp_path / "r"), str(tmp_path / "asked")

    def dead(*args):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(jobs, "append_part", dead)
    with pytest.raises(RuntimeError, match="driver lost"):
        gf.run_scoring(items_of(spark, ["1", "2"]), SPEC, asking(log), results)
    journal = Journal(spark, results)
    kept = journal.read(journal.kept()[0])
    assert kept.columns == ["id", "s", "o", "Raw_Response", "error"]
    assert {r.Raw_Response for r in kept.collect()} == {"Answer: B"}


def test_the_same_append_twice_leaves_one_copy(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.createDataFrame([(str(i), i) for i in range(50)], "id string, n int").repartition(4)
    gf.append_results(rows.where("n < 10"), path)
    append_part(rows.where("n >= 10"), path, "run-0", "id")
    append_part(rows.where("n >= 10").select("n", "id"), path, "run-0", "id")
    append_part(rows.where("n >= 100"), path, "run-1", "id")
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == list(range(50))
    # What a try left that died between its files and its index.
    folder = tmp_path / "r"
    one = next(f for f in sorted(folder.iterdir()) if f.name.startswith("run-0~"))
    (folder / ("run-2~" + one.name.partition("~")[2])).write_bytes(one.read_bytes())
    assert spark.read.parquet(path).count() > 50
    append_part(rows.where("n = 7"), path, "run-2", "id")
    assert spark.read.parquet(path).count() == 51
    with pytest.raises(ValueError, match="other columns"):
        append_part(rows.select("id"), path, "run-3", "id")
    with pytest.raises(ValueError, match="name"):
        append_part(rows, path, "_x", "id")


def test_few_items_read_few_of_many_parts(spark, tmp_path):
    """A thousand items against a thousand parts (their files written in one go): only parts with one of their ids are read, with the same result."""
    path, parts = tmp_path / "r", 1000
    ids = spark.range(0, 20 * parts, 1, 8).select(F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("error"),
                                                  (F.col("id") % parts).alias("p"))
    # What append_part writes, without a job per part.
    ids.repartition(8, "p").write.partitionBy("p").parquet(str(tmp_path / "staged"))
    from gradeframe.sources.parts import _printed

    slot, print_ = _printed(F.col("id"))
    ids.select(slot.alias("slot"), print_.alias("print"), F.concat(F.lit("b"), "p").alias("part")).groupBy("part", "slot") \
        .agg(F.collect_set("print").alias("prints")).repartition(8, "part").write.partitionBy("part").parquet(str(path / "_parts"))
    for p in range(parts):
        (path / "_parts" / f"part=b{p}" / "_SUCCESS").touch()
        for n, file in enumerate((tmp_path / "staged" / f"p={p}").glob("*.parquet")):
            os.link(file, path / f"b{p}~{n}.parquet")
    assert len(indexed_parts(spark, str(path))) == parts
    old = [str(i) for i in (3, 1003, 7, 19_999)]
    items = items_of(spark, [f"new-{i}" for i in range(996)] + old)
    assert sorted(files_with(items, str(path), "id")) == ["b3~0.parquet", "b7~0.parquet", "b999~0.parquet"]
    left = pending_at(items, str(path), "id")
    assert left.count() == 996 and left.where(~F.startswith("id", F.lit("new"))).count() == 0
    # Files without an index are always read.
    gf.append_results(ids.drop("p").limit(1).withColumn("id", F.lit("new-5")), str(path))
    assert pending_at(items, str(path), "id").count() == 995


@pytest.mark.parametrize("retry", [False, True])
def test_indexed_pending_equals_the_plain_one(spark, tmp_path, retry):
    path = str(tmp_path / "r")
    rows = [(str(i % 60) if i % 7 else None, None if i % 5 else "failed") for i in range(90)]
    done = spark.createDataFrame(rows, "id string, error string")
    for n in range(3):
        append_part(done.where(f"pmod(hash(id, error), 3) = {n}"), path, f"p-{n}", "id")
    items = items_of(spark, [str(i) for i in range(50, 80)] + [None, None, "55"])
    got = pending_at(items, path, "id", retry)
    want = gf.pending(items, spark.read.parquet(path), "id", retry)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert pending_at(items, str(tmp_path / "absent"), "id").count() == 33
    assert pending_at(items, path, None).count() == 33
    ints = spark.createDataFrame([(55,), (99,)], "id int")
    assert [r.id for r in pending_at(ints, path, "id").collect()] == [99]
