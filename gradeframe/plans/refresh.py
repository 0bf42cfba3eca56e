"""Evaluation that reads only what has come since the last one.

Beside the metrics, in ``_figures``, the figures that they are made of are kept per
evaluation: one row per group with counts and moments of the result files that were new
then, and the names of these files. The next evaluation works out figures of the
files that are in no list yet and merges all of them. Where a file of a list is gone or
has changed (an append that was repeated), the list's figures are dropped and its other files
read again. The per-row summary grows by a part per evaluation in the same way.

Rows in error that a later retry replaced cannot be told from the figures; while
there are rows in error, the results are evaluated as a whole.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeframe.operators.summary import row_summary
from gradeframe.plans.evaluate import group_figures, metrics_of_figures, report_lines
from gradeframe.plans.jobs import run_evaluation
from gradeframe.sources.parts import Folder, append_part, remove_part
from gradeframe.sources.tables import with_label_array, write_report
from gradeframe.spec import EvalSpec

_FIGURES, _FILES = "figures", "files"


def _store_of(output_dir: str, spec: EvalSpec) -> str:
    """Figures of another spec are other figures."""
    told = repr((spec.group_col, spec.targets, spec.max_sentences))
    return f"{output_dir}/_figures/{hashlib.sha256(told.encode()).hexdigest()[:16]}"


class _Store:
    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._folder = spark, Folder(spark, path)

    def lists(self) -> dict[str, dict[str, str]]:
        """Files, with their marks, of each complete entry."""
        entries = [n for n in self._folder.names(_FILES) if self._folder.exists(f"{_FILES}/{n}/_SUCCESS")]
        if not entries:
            return {}
        rows = self._spark.read.schema("file string, mark string, entry string").option("basePath", self._folder.at(_FILES)) \
            .parquet(*[self._folder.at(f"{_FILES}/{n}") for n in entries]).collect()
        lists: dict[str, dict[str, str]] = {n.partition("=")[2]: {} for n in entries}
        for row in rows:
            lists[row["entry"]][row["file"]] = row["mark"]
        return lists

    def add(self, entry: str, figures: DataFrame, files: dict[str, str]) -> None:
        """The list of files is written last: it makes the entry complete."""
        figures.write.mode("overwrite").parquet(self._folder.at(f"{_FIGURES}/entry={entry}"))
        listed = self._spark.createDataFrame(sorted(files.items()), "file string, mark string")
        listed.coalesce(1).write.mode("overwrite").parquet(self._folder.at(f"{_FILES}/entry={entry}"))

    def remove(self, entry: str) -> None:
        self._folder.remove(f"{_FILES}/entry={entry}")
        self._folder.remove(f"{_FIGURES}/entry={entry}")

    def figures(self, entries: list[str]) -> DataFrame:
        return self._spark.read.parquet(*[self._folder.at(f"{_FIGURES}/entry={e}") for e in entries])


def refresh_evaluation(spark: SparkSession, results_path: str, spec: EvalSpec, output_dir: str) -> DataFrame:
    """Write metrics, report and summary of a parquet results table; gives the metrics.

    The same as ``run_evaluation``, but only result files that are new since the last
    refresh into the same folder are read.
    """
    results, store = Folder(spark, results_path), _Store(spark, _store_of(output_dir, spec))
    there, lists = results.files(), store.lists()
    valid = {e: files for e, files in lists.items() if all(there.get(f) == mark for f, mark in files.items())}
    for entry in set(lists) - set(valid):
        remove_part(spark, f"{output_dir}/summary", entry)
        store.remove(entry)
    known = {f for files in valid.values() for f in files}
    fresh = {f: mark for f, mark in there.items() if f not in known}
    rows = None
    if fresh or not valid:
        if not there:
            raise ValueError(f"no results at {results_path}")
        rows = read_files(spark, results_path, list(fresh), spec)
        entry = uuid.uuid4().hex
        if not valid:
            Folder(spark, output_dir).remove("summary")
        append_part(row_summary(rows, spec), f"{output_dir}/summary", entry)
        store.add(entry, group_figures(rows, spec, with_errors=True), fresh)
        valid[entry] = fresh
    figures = store.figures(sorted(valid))
    if spec.id_col and figures.agg(F.sum("errors")).first()[0]:
        metrics = run_evaluation(spark, results_path, spec, output_dir)
        # The summary is whole now: the next refresh starts anew.
        for entry in valid:
            store.remove(entry)
        return metrics
    metrics_of_figures(figures, spec).write.mode("overwrite").parquet(f"{output_dir}/metrics")
    metrics = spark.read.parquet(f"{output_dir}/metrics")
    if rows is None:
        rows = read_files(spark, results_path, list(there)[:1], spec)
    write_report(report_lines(metrics, rows.columns, spec, results_path), f"{output_dir}/report")
    return metrics


def read_files(spark: SparkSession, results_path: str, files: list[str], spec: EvalSpec) -> DataFrame:
    """Some files of a results folder, as ``read_results`` reads all of them."""
    folder = Folder(spark, results_path)
    rows = spark.read.option("basePath", folder.path).parquet(*[folder.at(f) for f in files])
    return with_label_array(rows, spec.max_sentences)
