"""Relevance-label arrays of one row. No explode: rows are never multiplied."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions.text import strip
from gradeframe.spec import column, has_column


def wide_label_names(df: DataFrame, max_sentences: int | None = None) -> list[str]:
    """The ``label_i`` columns that are there, by number, up to a number if one is given."""
    prefix = fv.WIDE_LABEL.format("")
    numbers = sorted(int(n.removeprefix(prefix)) for n in df.columns
                     if n.startswith(prefix) and re.fullmatch("[1-9][0-9]*", n.removeprefix(prefix)))
    return [fv.WIDE_LABEL.format(i) for i in numbers if max_sentences is None or i <= max_sentences]


def labels_from_wide(df: DataFrame, max_sentences: int | None = None) -> DataFrame:
    """Replace ``label_1 .. label_N`` by one array; absent columns are skipped."""
    names = wide_label_names(df, max_sentences)
    labels = F.array(*[column(n).cast("string") for n in names]).cast("array<string>")
    return df.withColumn(fv.LABELS, labels).drop(*names)


def labels_to_wide(df: DataFrame, max_sentences: int) -> DataFrame:
    """Replace the label array by ``label_1 .. label_N``, NULL past its end."""
    return df.select(
        *[column(n) for n in df.columns if n != fv.LABELS],
        *[
            F.get(F.col(fv.LABELS), F.lit(i)).alias(fv.WIDE_LABEL.format(i + 1))
            for i in range(max_sentences)
        ],
    )


def valid_labels(labels: Column) -> Column:
    """The stripped labels that are in the domain, in order; never NULL."""
    kept = F.filter(F.transform(labels, strip), lambda name: name.isin(*fv.RELEVANCE_LABELS))
    return F.coalesce(kept, F.array().cast("array<string>"))


def label_count(valid: Column, label: str) -> Column:
    """How often a label occurs among valid labels."""
    return F.size(valid) - F.size(F.array_remove(valid, label))


def label_share(valid: Column, label: str) -> Column:
    """Share of a label among valid labels; 0.0 when there are none."""
    return label_count(valid, label) / F.greatest(F.size(valid), F.lit(1))


def majority_label(valid: Column) -> Column:
    """Most frequent label; ties go to the one seen first; NULL when none.

    Of the labels that reach the highest count, the one at the lowest position.
    """
    most = F.greatest(*[label_count(valid, label) for label in fv.RELEVANCE_LABELS])
    first = F.least(*[
        F.when(label_count(valid, label) == most, F.array_position(valid, label)) for label in fv.RELEVANCE_LABELS
    ])
    return F.get(valid, (first - 1).cast("int"))


def share_name(label: str) -> str:
    """``High Relevance`` -> ``pct_high_relevance``."""
    return "pct_" + label.lower().replace(" ", "_")
