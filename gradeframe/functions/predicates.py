"""Answer predicates. They are never NULL, so no row is lost to a filter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions.text import strip


def is_valid_answer(answer: Column) -> Column:
    """The stripped text is one of the answer letters, in upper case."""
    return F.coalesce(strip(answer.cast("string")).isin(*fv.ANSWER_LETTERS), F.lit(False))


def is_refused(answer: Column) -> Column:
    """Not a valid answer; a missing answer counts as refused."""
    return ~is_valid_answer(answer)


def is_correct(answer: Column, gold: Column) -> Column:
    """Valid answer equal to the stripped gold value, case included."""
    same = strip(answer.cast("string")) == strip(gold.cast("string"))
    return is_valid_answer(answer) & F.coalesce(same, F.lit(False))


def is_same_text(answer: Column, gold: Column) -> Column:
    """Summary rule: equal stripped text, where missing equals missing.

    A missing cell has the text ``nan``, as in the published summary.
    """
    def text(cell: Column) -> Column:
        return F.coalesce(strip(cell.cast("string")), F.lit(fv.MISSING_TEXT))

    return text(answer) == text(gold)
