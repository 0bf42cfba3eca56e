"""Text expressions: stripping, sentence counting, prompt rendering."""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column, functions as F

from gradeframe import fixed_values as fv


def strip(text: Column) -> Column:
    """Drop white space, as Unicode defines it, from both ends.

    ``btrim`` with a character list is linear in the text; a ``\\s+$`` pattern
    is quadratic in long runs of blanks.
    """
    return F.btrim(text, F.lit(fv.WHITE_SPACE))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used.

    A projection alone does not ensure that: a filter above it gets a copy of
    the whole expression for every mention.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def prompt_text(cell: Column) -> Column:
    """A cell as it enters a prompt: stripped text, or ``nan`` when missing."""
    return F.coalesce(strip(cell.cast("string")), F.lit(fv.MISSING_TEXT))


def sentence_count(text: Column) -> Column:
    """How many ``S1:`` or ``1.`` marks the text has (0 when missing)."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(fv.SENTENCE_MARK)), F.lit(0))


def render_prompt(template: str, sentences: Column, options: Column) -> Column:
    """Fill ``{sentences}`` and ``{options}``; ``{{`` and ``}}`` are braces.

    The template is cut into pieces once, on the driver, so text that itself
    contains ``{options}`` is never filled a second time.
    """
    values = {"sentences": prompt_text(sentences), "options": prompt_text(options)}
    try:
        pieces = list(Formatter().parse(template))
    except ValueError as error:
        raise ValueError(f"prompt template: {error}; write literal braces as {{{{ and }}}}") from None
    parts = []
    for literal, name, layout, conversion in pieces:
        if literal:
            parts.append(F.lit(literal))
        if name is None:
            continue
        if name not in values or layout or conversion not in (None, "s"):
            raise ValueError(
                f"prompt template: unknown placeholder {{{name}}}; only {{sentences}} and "
                "{options} are filled, write literal braces as {{ and }}"
            )
        parts.append(values[name])
    return F.concat(*parts) if parts else F.lit("")
