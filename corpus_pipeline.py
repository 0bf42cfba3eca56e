"""Documents to training data, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns rows that are written as
Parquet in the shared folder and read again as the next stage's documents.
What a stage staged on its way is removed when the next one starts, unless the
documents that one was given are still read from there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeframe.llm import langid
from gradeframe.llm.common import documents, noting_paths, remove, scratch
from gradeframe.llm.mixing import mixed
from gradeframe.llm.near_dedup import keep_one_of_each
from gradeframe.llm.queries import MIX, source_domain
from gradeframe.llm.segmentation import Segmentation, segmented
from gradeframe.llm.substring_dedup import remove_repeats


BATCH_BYTES = str(8 << 20)
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left_by_stages: list[str] = []


def _drop_unread(spark: SparkSession, docs: DataFrame) -> None:
    """Remove the folders of earlier stages that the documents are not read from."""
    read = docs.inputFiles() if _left_by_stages else []
    names = {part for file in read for part in file.split("/")}
    for path in [p for p in _left_by_stages if p.rpartition("/")[2] not in names]:
        remove(spark, path)
        _left_by_stages.remove(path)


def stage(work: Stage) -> Stage:
    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _drop_unread(spark, docs)
        # Texts go to Python workers in batches of this size; the JVM and the worker hold one each.
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        with noting_paths(_left_by_stages):
            return work(spark, docs, sf_dir)

    return run_stage


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn languages from the documents that are not held out; rejected documents go."""
    model = langid.train(docs.where(~langid.is_held_out(F.col("doc_id"))))
    return langid.keep_identified(docs, model)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five words, similarity 0.8)."""
    return keep_one_of_each(docs)


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are taken out of the text."""
    return remove_repeats(docs, length_col="n_chars")


@stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by source budgets; one that is taken for two epochs comes twice."""
    return mixed(docs, MIX, source_domain())


@stage
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every text."""
    return segmented(docs, Segmentation(seed=4))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

# Compression and sampled segmentation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, given = documents(spark, sf_dir), None
    for name, work in STAGES[:-1]:
        written = scratch(spark, name)
        work(spark, docs, sf_dir).write.parquet(written)
        docs = spark.read.parquet(written)
        if given:
            remove(spark, given)
        given = written
    return STAGES[-1][1](spark, docs, sf_dir)
