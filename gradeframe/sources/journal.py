"""Raw replies on disk as soon as a task has them.

A journal is a folder beside the results. Each task that asks commits its own
file of replies there (the file committer's second algorithm moves a task's file
to its place when the task is done, not when the job is), so whatever was
committed outlives the job, the driver and the cluster. Replies are kept as they came,
with the columns of their items, and are parsed when they are published.

    results.journal/run=<id>/slice=<n>/part-...

Object stores whose committers show nothing before the job is done keep replies
per job only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gradeframe.sources.parts import Folder

_COMMIT = "mapreduce.fileoutputcommitter.algorithm.version"


def journal_of(results_path: str) -> str:
    return results_path.rstrip("/") + ".journal"


class Journal:
    """The replies of scoring runs into one results folder that are not published yet."""

    def __init__(self, spark: SparkSession, results_path: str):
        self._spark = spark
        self._folder = Folder(spark, journal_of(results_path))
        self._run = uuid.uuid4().hex

    def write(self, replies: DataFrame, number: int) -> str:
        """Keep the replies of a slice of this run, task by task; gives the slice's name."""
        name = f"run={self._run}/slice={number}"
        replies.write.mode("append").option(_COMMIT, "2").parquet(self._folder.at(name))
        return name

    def kept(self) -> list[str]:
        """Names of all slices that hold replies, of this run and of runs that died."""
        runs = [n for n in self._folder.names() if n.startswith("run=")]
        slices = [f"{run}/{n}" for run in runs for n in self._folder.names(run) if n.startswith("slice=")]
        return [name for name in slices if any(n.endswith(".parquet") for n in self._folder.names(name))]

    def read(self, name: str) -> DataFrame:
        return self._spark.read.parquet(self._folder.at(name))

    def part(self, name: str) -> str:
        """What the slice is called as a part of the results."""
        run, _, number = name.partition("/")
        return f"{run.partition('=')[2]}-{number.partition('=')[2]}"

    def remove(self, name: str) -> None:
        """Forget a slice that was published."""
        self._folder.remove(name)
        run = name.partition("/")[0]
        if not self._folder.names(run):
            self._folder.remove(run)
        if not self._folder.names():
            self._folder.remove("")

    def clear(self) -> None:
        """Remove what dead runs left that holds no reply."""
        if not self.kept():
            self._folder.remove("")
