"""The per-row summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions.labels import label_share, majority_label, share_name, valid_labels
from gradeframe.functions.predicates import is_refused, is_same_text
from gradeframe.spec import EvalSpec, column, has_column


def row_summary(results: DataFrame, spec: EvalSpec) -> DataFrame:
    """id, group, majority label, label shares, and per question the answer,
    whether it was refused and whether it equals the gold value.

    A projection only. Roles without a column are left out.
    """
    labels = F.col(fv.LABELS) if has_column(results, fv.LABELS) else F.array().cast("array<string>")
    if spec.max_sentences is not None:
        labels = F.slice(labels, 1, spec.max_sentences)
    known = results.withColumn("_valid", valid_labels(labels))
    out = []
    if has_column(results, spec.id_col):
        out.append(column(spec.id_col).alias("id"))
    if has_column(results, spec.group_col):
        out.append(column(spec.group_col).alias("group"))
    out.append(majority_label(F.col("_valid")).alias("majority_relevance"))
    out += [label_share(F.col("_valid"), name).alias(share_name(name)) for name in fv.RELEVANCE_LABELS]
    for question in spec.targets:
        there = has_column(results, question.name)
        answer = column(question.name) if there else F.lit(None).cast("string")
        out.append(answer.alias(f"{question.name}_answer"))
        out.append(is_refused(answer).alias(f"{question.name}_refused"))
        if has_column(results, question.gold_col):
            same = is_same_text(answer, column(question.gold_col)) if there else F.lit(False)
            out.append(same.alias(f"{question.name}_is_correct"))
    return known.select(*out)
