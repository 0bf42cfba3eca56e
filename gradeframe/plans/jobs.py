"""The three jobs: score, evaluate, and both."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gradeframe import fixed_values as fv
from gradeframe.functions.response import parse_responses
from gradeframe.operators.resume import settled_results
from gradeframe.operators.scoring import MakeResponder, ask, score_recorded
from gradeframe.operators.summary import row_summary
from gradeframe.plans.evaluate import evaluate, report_lines
from gradeframe.sources.journal import Journal
from gradeframe.sources.parts import append_part, pending_at
from gradeframe.sources.tables import read_results, remove_path, scratch_path, write_report, write_summary
from gradeframe.spec import EvalSpec, has_column

_SLICE = "_gf_slice"
ROWS_PER_SLICE, MOST_SLICES = 16, 100
# Rows that a task asks for before it commits their replies.
REPLIES_PER_COMMIT = 256


@dataclass(frozen=True)
class RunCounters:
    """What a scoring run did; rows skipped as done count as processed."""

    processed: int
    errors: int
    written: int


def _append_counted(scored: DataFrame, results_path: str, part: str, id_col: str | None) -> tuple[int, int]:
    """Append as a named part and count (rows, errors) in one pass: the responder
    must not run a second time for the counts."""
    seen = Observation("scored")
    append_part(scored.observe(
        seen, F.count(F.lit(1)).alias("written"), F.count_if(F.col(fv.ERROR).isNotNull()).alias("errors"),
    ), results_path, part, id_col)
    return seen.get["written"], seen.get["errors"]


def _publish(journal: Journal, name: str, spec: EvalSpec, results_path: str) -> tuple[int, int]:
    """Parse the kept replies of a slice, append them as a part, and forget them.

    A driver that dies in between leaves replies that are published again, in
    place of what is there of the part.
    """
    counts = _append_counted(parse_responses(journal.read(name), spec), results_path, journal.part(name), spec.id_col)
    journal.remove(name)
    return counts


def _slices(todo: DataFrame, n: int, path: str) -> list[DataFrame]:
    """The rows staged in n parts, to be read one part at a time. Rows of one
    input partition are dealt to all parts; no shuffle, and no id weighs on one
    part."""
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    todo.withColumn(_SLICE, turn).write.partitionBy(_SLICE).parquet(path)
    schema = StructType([*todo.schema.fields, StructField(_SLICE, IntegerType())])
    read = todo.sparkSession.read.schema(schema).parquet(path)
    return [read.where(F.col(_SLICE) == k).drop(_SLICE) for k in range(n)]


def run_scoring(
    items: DataFrame, spec: EvalSpec, make_responder: MakeResponder, results_path: str,
    partitions: int | None = None, batch_rows: int = 64, retry_errors: bool = False, slices: int | None = None,
    replies_per_commit: int = REPLIES_PER_COMMIT,
) -> RunCounters:
    """Score the items that have no result yet and append their results.

    The open items are staged and asked for slice by slice; each slice is
    appended when it is done. By default there is a slice per ``ROWS_PER_SLICE``
    items, ``MOST_SLICES`` at most. Within a slice the tasks are small,
    ``replies_per_commit`` items each, and every task commits its raw replies to
    a journal beside the results when it is done. A re-run first publishes
    what runs that died left there, then asks for the rest: what is lost with a run
    are the replies of tasks that were at work, wherever in a slice it died.

    ``partitions`` limits how many responders work at a time: a slice then has as
    many tasks, and a commit as many replies as a slice has for each of them.
    """
    spark = items.sparkSession
    journal = Journal(spark, results_path)
    written = errors = 0
    for name in journal.kept():
        counts = _publish(journal, name, spec, results_path)
        written, errors = written + counts[0], errors + counts[1]
    todo = pending_at(items, results_path, spec.id_col, retry_errors)
    total = items.count()
    slices = slices or max(1, min(MOST_SLICES, -(-total // ROWS_PER_SLICE)))
    tasks = partitions or max(-(-total // (slices * replies_per_commit)), spark.sparkContext.defaultParallelism)
    path = scratch_path(spark, "slices")
    try:
        for number, part in enumerate(_slices(todo, slices, path) if slices > 1 else [todo]):
            name = journal.write(ask(part.repartition(tasks), spec, make_responder, batch_rows), number)
            counts = _publish(journal, name, spec, results_path)
            written, errors = written + counts[0], errors + counts[1]
    finally:
        remove_path(spark, path)
    journal.clear()
    return RunCounters(total - errors, errors, written)


def run_recorded(
    items: DataFrame, responses: DataFrame, spec: EvalSpec, results_path: str,
    response_col: str = "response", attempt_col: str | None = None, unique: bool = False, retry_errors: bool = False,
) -> RunCounters:
    """The same with recorded responses in place of a responder.

    ``retry_errors`` looks again for responses that were not there before.
    """
    todo = pending_at(items, results_path, spec.id_col, retry_errors)
    scored = score_recorded(todo, responses, spec, response_col, attempt_col, unique)
    written, errors = _append_counted(scored, results_path, uuid.uuid4().hex, spec.id_col)
    return RunCounters(items.count() - errors, errors, written)


def run_evaluation(
    spark: SparkSession, results_path: str, spec: EvalSpec, output_dir: str,
    fmt: str = "parquet", summary_fmt: str = "parquet", settle: bool | None = None,
) -> DataFrame:
    """Write metrics, report and summary of a results table; gives the metrics.

    Error rows that a run with ``retry_errors`` replaced are left out, unless
    ``settle`` is False.

    The report is made from the written metrics, so the results are scanned
    once for all metrics and once for the summary.
    """
    results = read_results(spark, results_path, fmt, spec.max_sentences)
    if settle is None:
        settle = has_column(results, fv.ERROR) and has_column(results, spec.id_col) \
            and not results.where(F.col(fv.ERROR).isNotNull()).isEmpty()
    if settle:
        results = settled_results(results, spec.id_col)
    evaluate(results, spec).write.mode("overwrite").parquet(f"{output_dir}/metrics")
    metrics = spark.read.parquet(f"{output_dir}/metrics")
    write_report(report_lines(metrics, results.columns, spec, results_path), f"{output_dir}/report")
    write_summary(row_summary(results, spec), f"{output_dir}/summary", summary_fmt)
    return metrics


def run_all(
    items: DataFrame, spec: EvalSpec, make_responder: MakeResponder, results_path: str, output_dir: str,
    partitions: int | None = None, batch_rows: int = 64, retry_errors: bool = False, slices: int | None = None,
    settle: bool | None = None,
) -> DataFrame:
    """Score, then evaluate everything scored so far."""
    run_scoring(items, spec, make_responder, results_path, partitions, batch_rows, retry_errors, slices)
    return run_evaluation(items.sparkSession, results_path, spec, output_dir, settle=settle)
