"""Prompts to a responder, responses to answers and labels."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions.response import parse_responses
from gradeframe.functions.text import render_prompt
from gradeframe.operators.resume import attach_responses, with_reply
from gradeframe.spec import EvalSpec, column

# What the responder task needs of this package travels with the task, so the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules["gradeframe"])

Respond = Callable[[list[str]], Sequence[str | None]]
MakeResponder = Callable[[EvalSpec], Respond]


def with_prompt(items: DataFrame, spec: EvalSpec, name: str = "prompt") -> DataFrame:
    """Add the rendered prompt of each item."""
    return items.withColumn(
        name, render_prompt(spec.prompt, column(spec.sentences_col), column(spec.options_col))
    )


def _replies(respond: Respond, prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """(text, error) per prompt; a failing batch is asked again one by one."""
    try:
        texts = list(respond(prompts))
        if len(texts) != len(prompts):
            raise ValueError(f"{len(prompts)} prompts but {len(texts)} responses")
    except Exception as error:
        if len(prompts) == 1:
            return [(None, f"{type(error).__name__}: {error}")]
        return [reply for prompt in prompts for reply in _replies(respond, [prompt])]
    return [(text, None) if isinstance(text, str) else (None, _no_text(text)) for text in texts]


def _no_text(reply: object) -> str:
    return "no response" if reply is None else f"response is no text but {type(reply).__name__}"


def responder_udf(make_responder: MakeResponder, spec: EvalSpec, batch_rows: int):
    """The responder as an Arrow UDF: only the prompt leaves the JVM.

    The responder is made once per task. Marked non-deterministic so that the
    optimizer never evaluates it twice for a row.
    """

    @F.pandas_udf("text string, problem string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        respond = make_responder(spec)
        for prompts in batches:
            waiting = prompts.tolist()
            replies = []
            for start in range(0, len(waiting), batch_rows):
                replies += _replies(respond, waiting[start:start + batch_rows])
            yield pd.DataFrame(replies, columns=["text", "problem"], dtype=object)

    return ask.asNondeterministic()


def _check_free(items: DataFrame, spec: EvalSpec) -> None:
    added = {fv.RAW_RESPONSE, fv.LABELS, fv.ERROR, *spec.answer_columns}
    taken = sorted(added & set(items.columns))
    if taken:
        raise ValueError(f"items already have the result columns {taken}; rename them first")


def ask(
    items: DataFrame, spec: EvalSpec, make_responder: MakeResponder, batch_rows: int = 64,
) -> DataFrame:
    """Ask the responder for every item: adds ``Raw_Response`` and ``error``, nothing is parsed yet."""
    _check_free(items, spec)
    reply = responder_udf(make_responder, spec, batch_rows)
    asked = with_prompt(items, spec, "_gf_prompt").withColumn("_gf_reply", reply("_gf_prompt"))
    replied = with_reply(asked, F.col("_gf_reply")["text"], F.col("_gf_reply")["problem"])
    return replied.drop("_gf_prompt", "_gf_reply")


def score(
    items: DataFrame, spec: EvalSpec, make_responder: MakeResponder,
    partitions: int | None = None, batch_rows: int = 64,
) -> DataFrame:
    """Ask the responder for every item and parse what comes back.

    No shuffle follows the responder, so writing this frame asks once per row
    (save for lost tasks); write it before aggregating it. ``partitions`` sets
    how many responders work at a time, at the price of a shuffle.
    """
    if partitions:
        items = items.repartition(partitions)
    return parse_responses(ask(items, spec, make_responder, batch_rows), spec)


def score_recorded(
    items: DataFrame, responses: DataFrame, spec: EvalSpec, response_col: str = "response",
    attempt_col: str | None = None, unique: bool = False,
) -> DataFrame:
    """Score from recorded responses instead of asking."""
    _check_free(items, spec)
    if not spec.id_col:
        raise ValueError("recorded responses are found by id: the spec needs an id_col")
    attached = attach_responses(items, responses, spec.id_col, response_col, attempt_col, unique)
    return parse_responses(attached, spec)


def run_counters(items: DataFrame, scored: DataFrame) -> DataFrame:
    """Rows in error in this run, and rows processed: all input rows less these.

    Rows that were skipped because they were done count as processed.
    """
    failed = scored.agg(F.lit(0).alias("total"), F.count_if(F.col(fv.ERROR).isNotNull()).alias("errors"))
    total = items.agg(F.count(F.lit(1)).alias("total"), F.lit(0).alias("errors"))
    both = total.unionByName(failed)
    return both.agg(
        (F.sum("total") - F.sum("errors")).alias("processed"), F.sum("errors").alias("errors")
    )
