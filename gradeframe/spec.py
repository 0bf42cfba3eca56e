"""What a job is told about the tables it reads."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from gradeframe import fixed_values as fv


@dataclass(frozen=True)
class Question:
    """One answer column and, if known, the column with its right answer."""

    name: str
    gold_col: str | None = None


@dataclass(frozen=True)
class EvalSpec:
    """Column roles and settings of one evaluation.

    Without ``questions`` a response holds one answer, stored as
    ``LLM_answer`` and compared with ``gold_col``; with ``questions`` it holds
    one answer per question name.
    """

    sentences_col: str = "sentences"
    options_col: str = "question_options"
    id_col: str | None = None
    group_col: str | None = None
    gold_col: str | None = None
    questions: tuple[Question, ...] = ()
    # Labels past this number are cut off; None keeps all.
    max_sentences: int | None = None
    prompt: str = fv.DEFAULT_PROMPT
    model_name: str = ""
    # Handed to the responder untouched (temperature, endpoint, ...).
    model_options: dict = field(default_factory=dict)

    @property
    def is_single(self) -> bool:
        return not self.questions

    @property
    def targets(self) -> tuple[Question, ...]:
        return self.questions or (Question(fv.SINGLE_ANSWER, self.gold_col),)

    @property
    def answer_columns(self) -> list[str]:
        return [question.name for question in self.targets]


def column(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def has_column(df, name: str | None) -> bool:
    """Whether an optional role is bound to a column that is there."""
    return bool(name) and name in df.columns
