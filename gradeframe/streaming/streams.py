"""Scoring and metrics as streams."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from gradeframe.operators.metrics import answer_counts, metrics_of_counts
from gradeframe.operators.resume import pending
from gradeframe.plans.evaluate import group_figures, metrics_of_figures
from gradeframe.sources.parts import Folder
from gradeframe.sources.tables import existing_results, remove_path, scratch_path, staged
from gradeframe.spec import EvalSpec, has_column
from gradeframe.streaming.done_ids import first_batch_of_each, use_rocksdb

_STREAM, _BATCH, _VERSION = "stream", "batch_id", "version"


def read_stream(
    spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files as they arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def read_stream_results(spark: SparkSession, path: str) -> DataFrame:
    """What a scoring stream has written, without its bookkeeping columns."""
    return spark.read.parquet(path).drop(_STREAM, _BATCH)


def _other_streams(spark: SparkSession, path: str, stream_name: str) -> DataFrame | None:
    """What other streams have written into a sink; the folders of this one are not even listed."""
    folder = Folder(spark, path)
    others = [n for n in folder.names() if n.startswith(f"{_STREAM}=") and n != f"{_STREAM}={stream_name}"]
    read = [existing_results(spark, folder.at(n)) for n in others]
    read = [there for there in read if there is not None]
    return reduce(lambda a, b: a.unionByName(b), read) if read else None


def stream_score(
    items: DataFrame, spec: EvalSpec, scorer: Callable[[DataFrame], DataFrame],
    path: str, checkpoint: str, stream_name: str,
) -> DataStreamWriter:
    """Score arriving items, skipping ids that are already in the sink.

    The ids this stream has passed on are its state (see ``done_ids``), so a
    micro-batch reads nothing of what the stream has written. Only the id columns of other
    streams in the same sink are looked up, if there are any.

    Every micro-batch owns one partition of the sink and overwrites it. A batch
    that is replayed after a failure starts from the same state and replaces
    itself: nothing is written twice, nothing is lost. Batch numbers and state belong
    to a checkpoint; use a new ``stream_name`` with a new one.

    ``scorer`` takes the items to do and gives scored rows, e.g.
    ``lambda todo: score(todo, spec, make_responder)``. Start the writer with
    the trigger of your choice.
    """
    if not re.fullmatch(r"[A-Za-z][\w.-]*", stream_name):
        raise ValueError("stream_name becomes a folder name: a letter, then letters, digits, _ . - only")
    scratch, fresh_path = (scratch_path(items.sparkSession, name) for name in ("done-ids", "fresh"))
    named = has_column(items, spec.id_col)
    if named:
        use_rocksdb(items.sparkSession)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        others = _other_streams(spark, path, stream_name) if named else None
        if named:
            # A scorer may read its items more than once; the state is gone through once.
            batch = staged(batch, "fresh", fresh_path)
        if others is not None:
            batch = pending(batch, others, spec.id_col, scratch=scratch)
        scorer(batch).write.mode("overwrite").parquet(f"{path}/{_STREAM}={stream_name}/{_BATCH}={batch_id}")
        if named:
            remove_path(spark, fresh_path)

    fresh = first_batch_of_each(items, spec.id_col) if named else items
    return fresh.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a table."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = there.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(there):
        return []
    names = [s.getPath().getName() for s in files.listStatus(there)]
    done = [n for n in names if n.startswith(f"{_VERSION}=")
            and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.partition("=")[2]) for n in done)


def read_stream_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version of what stream_metrics writes; None before the first."""
    versions = _versions(spark, path)
    return spark.read.parquet(f"{path}/{_VERSION}={versions[-1]}") if versions else None


def _versioned(figures: DataFrame, finish: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataStreamWriter:
    """Write the whole table that ``finish`` makes of the running figures, a version per micro-batch.

    The state is one row of counters per group. A reader takes the newest
    version that is complete, so it never meets a table that is half
    replaced. Older versions but the last are removed.
    """
    def write_batch(groups: DataFrame, batch_id: int) -> None:
        finish(groups).write.mode("overwrite").parquet(f"{path}/{_VERSION}={batch_id}")
        for old in _versions(groups.sparkSession, path):
            if old < batch_id - 1:
                remove_path(groups.sparkSession, f"{path}/{_VERSION}={old}")

    return figures.writeStream.outputMode("complete").foreachBatch(write_batch).option("checkpointLocation", checkpoint)


def stream_metrics(
    results: DataFrame, answer_col: str, gold_col: str, by: str, path: str, checkpoint: str
) -> DataStreamWriter:
    """Running refusal and accuracy, overall and per group, over arriving results.

    ``read_stream_metrics`` reads the newest complete version.
    """
    return _versioned(answer_counts(results, answer_col, gold_col, by), metrics_of_counts, path, checkpoint)


def stream_evaluate(results: DataFrame, spec: EvalSpec, path: str, checkpoint: str) -> DataStreamWriter:
    """The running metrics table over arriving results: all that ``evaluate`` gives, label shares and accuracy by label included.

    ``read_stream_metrics`` reads the newest complete version.
    """
    return _versioned(group_figures(results, spec), lambda figures: metrics_of_figures(figures, spec), path, checkpoint)
