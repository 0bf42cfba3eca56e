"""Refusal, accuracy and relevance metrics.

Each metric is one conditional aggregation: partial sums per task, then one
shuffle of at most one row per group and task. A group that holds most of the
rows is therefore no heavier than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType

from gradeframe import fixed_values as fv
from gradeframe.functions.labels import label_count, majority_label, valid_labels
from gradeframe.functions.predicates import is_correct, is_refused, is_valid_answer
from gradeframe.operators.moments import merged_with_overall
from gradeframe.spec import column, has_column


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, NULL when whole is 0."""
    return F.try_divide(part.cast("double"), whole)


def interval(mean: Column, std: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % interval of a mean."""
    half = F.lit(fv.Z_95) * F.try_divide(std, F.sqrt(n))
    return mean - half, mean + half


def mean_ci_columns(value: Column) -> list[Column]:
    """n, mean, sample std and 95 % interval of a value, as aggregates.

    Missing values are left out. With one value the std and the interval are
    NULL, with none the mean is too.
    """
    n, mean, std = F.count(value), F.avg(value), F.stddev_samp(value)
    low, high = interval(mean, std, n)
    return [n.alias("n"), mean.alias("mean"), std.alias("std"), low.alias("ci_low"), high.alias("ci_high")]


def mean_ci(df: DataFrame, value_col: str, by: str | None = None) -> DataFrame:
    """``mean_ci_columns`` over a table, or per group with missing groups left out."""
    return _grouped(df, by).agg(*mean_ci_columns(column(value_col).cast("double")))


def present(df: DataFrame, name: str) -> Column:
    """A group column with NaN as NULL: both are missing groups."""
    value = column(name)
    kind = df.schema[name].dataType
    return F.when(~F.isnan(value), value) if isinstance(kind, (DoubleType, FloatType)) else value


def _grouped(df: DataFrame, by: str | None):
    """All rows, or one group per value; the missing group is left out."""
    return df.where(present(df, by).isNotNull()).groupBy(column(by)) if by else df.groupBy()


def refusal_rate(df: DataFrame, answer_col: str, by: str | None = None) -> DataFrame:
    """Refused rows, all rows and their ratio."""
    refused, total = F.count_if(is_refused(column(answer_col))), F.count(F.lit(1))
    return _grouped(df, by).agg(
        refused.alias("refused"), total.alias("total"), ratio(refused, total).alias("refusal_rate")
    )


def accuracy(df: DataFrame, answer_col: str, gold_col: str, by: str | None = None) -> DataFrame:
    """Correct rows, rows with a valid answer and their ratio.

    A group without a valid answer does not appear.
    """
    answer = column(answer_col)
    correct, valid = F.count_if(is_correct(answer, column(gold_col))), F.count_if(is_valid_answer(answer))
    rows = _grouped(df, by).agg(
        correct.alias("correct"), valid.alias("valid"), ratio(correct, valid).alias("accuracy")
    )
    return rows.where(F.col("valid") > 0) if by else rows


ANSWER_COUNTS = ("refused", "total", "valid")


def answer_counts(df: DataFrame, answer_col: str, gold_col: str | None = None, by: str | None = None) -> DataFrame:
    """What refusal and accuracy are made of, one row per group (``grp``), the missing group included.

    ``correct`` is there with the gold column only.
    """
    answer = column(answer_col)
    group = present(df, by) if has_column(df, by) else F.lit(None).cast("string")
    facts = df.select(
        group.alias("grp"), is_valid_answer(answer).alias("ok"),
        *([is_correct(answer, column(gold_col)).alias("right")] if has_column(df, gold_col) else []))
    return facts.groupBy("grp").agg(
        F.count_if(~F.col("ok")).alias("refused"), F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("valid"),
        *([F.count_if("right").alias("correct")] if has_column(df, gold_col) else []))


def metrics_of_counts(counts: DataFrame) -> DataFrame:
    """Refusal and accuracy, overall and per group, of what ``answer_counts`` gives."""
    known = [n for n in (*ANSWER_COUNTS, "correct") if n in counts.columns]
    rows = merged_with_overall(counts, known, [])
    if "correct" not in known:
        rows = rows.withColumn("correct", F.lit(None).cast("long"))
    return rows.select(
        F.when(F.col("is_overall"), "overall").otherwise("group").alias("scope"), "grp",
        "refused", "total", ratio(F.col("refused"), F.col("total")).alias("refusal_rate"),
        "correct", "valid", ratio(F.col("correct"), F.col("valid")).alias("accuracy"),
    )


def answer_metrics(
    df: DataFrame, answer_col: str, gold_col: str | None = None, by: str | None = None
) -> DataFrame:
    """Refusal and accuracy, overall and per group, in one pass.

    ``scope`` tells the overall row from the groups; the accuracy of a group
    without a valid answer is NULL. Without the gold column there is no
    accuracy, without the group column no group. The overall row is added up
    from the groups.
    """
    return metrics_of_counts(answer_counts(df, answer_col, gold_col, by))


def headline(df: DataFrame, answer_col: str, gold_col: str | None = None) -> DataFrame:
    """Total rows, refusal rate and accuracy (NULL without a gold column)."""
    answer, total = column(answer_col), F.count(F.lit(1))
    if has_column(df, gold_col):
        right = ratio(F.count_if(is_correct(answer, column(gold_col))), F.count_if(is_valid_answer(answer)))
    else:
        right = F.lit(None).cast("double")
    return df.agg(
        total.alias("total_rows"),
        ratio(F.count_if(is_refused(answer)), total).alias("refusal_rate"),
        right.alias("accuracy"),
    )


def label_facts(labels: Column) -> Column:
    """Majority label and label shares of a row; all NULL without labels.

    Free of conditions, so that the counts are shared within the projection.
    """
    return F.struct(
        majority_label(labels).alias("majority"),
        *[
            ratio(label_count(labels, name), F.size(labels)).alias(f"share_{i}")
            for i, name in enumerate(fv.RELEVANCE_LABELS)
        ],
    )


def with_label_facts(df: DataFrame, labels_col: str, max_sentences: int | None = None) -> DataFrame:
    """Add ``_labels`` facts; the valid labels are worked out once per row."""
    labels = column(labels_col)
    if max_sentences is not None:
        labels = F.slice(labels, 1, max_sentences)
    known = df.withColumn("_valid", valid_labels(labels))
    return known.withColumn("_labels", label_facts(F.col("_valid"))).drop("_valid")


def relevance_distribution(df: DataFrame, labels_col: str, by: str | None = None) -> DataFrame:
    """Mean share of each label over the rows that have labels, with interval.

    One row per label; a group without labels keeps its rows, with n = 0.
    """
    facts = with_label_facts(df, labels_col)
    rows = _grouped(facts, by).agg(F.array(*[
        F.struct(
            F.lit(i).alias("label_no"), F.lit(name).alias("label"),
            *mean_ci_columns(F.col("_labels")[f"share_{i}"]),
        )
        for i, name in enumerate(fv.RELEVANCE_LABELS)
    ]).alias("rows"))
    return rows.select(*([column(by)] if by else []), F.inline("rows"))


def relevance_accuracy(
    df: DataFrame, answer_col: str, gold_col: str, labels_col: str, by: str | None = None
) -> DataFrame:
    """Accuracy of valid answers by the majority label of their row.

    All labels come out, also those of no row.
    """
    answer = column(answer_col)
    facts = with_label_facts(df, labels_col).withColumns({
        "_ok": is_valid_answer(answer), "_right": is_correct(answer, column(gold_col)),
    })
    entries = []
    for i, name in enumerate(fv.RELEVANCE_LABELS):
        here = F.col("_labels")["majority"] == name
        correct, total = F.count_if(here & F.col("_right")), F.count_if(here & F.col("_ok"))
        entries.append(F.struct(
            F.lit(i).alias("label_no"), F.lit(name).alias("label"),
            correct.alias("correct"), total.alias("total"), ratio(correct, total).alias("accuracy"),
        ))
    rows = _grouped(facts, by).agg(F.array(*entries).alias("rows"))
    return rows.select(*([column(by)] if by else []), F.inline("rows"))
