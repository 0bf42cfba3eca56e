"""From response text to an answer letter and relevance labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions.text import let, sentence_count, strip
from gradeframe.spec import EvalSpec, column

_WHOLE, _BROKEN = "gf-whole-response", "gf-broken"
_MOST = str(2 ** 31 - 1)
_STRICT = {
    "allowSingleQuotes": "false", "columnNameOfCorruptRecord": _BROKEN,
    # No length makes a value invalid. Nesting stays within what recursive parsers read.
    "maxNumLen": _MOST, "maxStringLen": _MOST, "maxNestingDepth": "1000",
}
# Outside of strings: infinities that JSON readers other than Spark's refuse.
_STRINGS, _NOT_JSON = r'"(?:[^"\\]|\\.)*+"', r"\+I|INF"


def braced_text(text: Column) -> Column:
    """The text from the first ``{`` to the last ``}``, empty when there is none.

    Anchored and possessive up to the first brace, so linear in the text.
    """
    return F.regexp_extract(text, r"(?s)^[^{]*+(\{.*\})", 1)


def extract_json_object(text: Column, answer_keys: Sequence[str] = (fv.JSON_ANSWER,)) -> Column:
    """The JSON object in a text as ``struct<answer keys, Sentence_Relevance>``.

    NULL unless everything between the outer braces is one valid object. All
    fields are read as text, which makes the reader go through every token of
    every value, and a broken one marks the whole record. The object stands in
    an array between two elements that carry a hash of the text: only if it has
    exactly these neighbours was the text read as one value. A text that closes the array
    and opens another one, under the same key even, leaves each of them
    with one such neighbour at most. The labels are then
    read by type, for text alone does not tell a list from a string that looks
    like one; of repeated keys the last value counts.
    """
    names = [*answer_keys, fv.JSON_LABELS]
    seal = next(name for name in ("seal", "seal_", "seal__") if name not in names)
    fields = ", ".join(f"`{name}` string" for name in [*names, seal])
    kept = ", ".join(f"`{name}` string" for name in answer_keys)

    def whole(body: Column, read: Column, mark: Column) -> Column:
        value, ends = F.get(read[_WHOLE], F.lit(1)), [F.get(read[_WHOLE], F.lit(i))[seal] for i in (0, 2)]
        listed = F.from_json(body, f"`{fv.JSON_LABELS}` array<string>", _STRICT)[fv.JSON_LABELS]
        labels = F.when(F.startswith(value[fv.JSON_LABELS], F.lit("[")), listed)
        found = F.struct(*[value[name].alias(name) for name in answer_keys], labels.alias(fv.JSON_LABELS))
        sealed = (F.size(read[_WHOLE]) == 3) & (ends[0] == mark) & (ends[1] == mark)
        return F.when(read[_BROKEN].isNull() & sealed, found.cast(f"struct<{kept}, `{fv.JSON_LABELS}` array<string>>"))

    def parse(body: Column) -> Column:
        mark = F.xxhash64(body).cast("string")
        end = F.concat(F.lit(f'{{"{seal}":"'), mark, F.lit('"}'))
        framed = F.concat(F.lit(f'{{"{_WHOLE}":['), end, F.lit(","), body, F.lit(","), end, F.lit("]}"))
        read = F.from_json(framed, f"`{_WHOLE}` array<struct<{fields}>>, `{_BROKEN}` string", _STRICT)
        return let(read, lambda r: whole(body, r, mark))

    def readable(body: Column) -> Column:
        odd = F.regexp_replace(body, _STRINGS, '""').rlike(_NOT_JSON)
        suspect = F.contains(body, F.lit("INF")) | F.contains(body, F.lit("+I"))
        return (body != "") & ~F.when(suspect, odd).otherwise(False)

    return let(braced_text(text), lambda body: F.when(readable(body), parse(body)))


def _if_one_of(value: Column, allowed: Sequence[str]) -> Column:
    """The value if it is allowed, else NULL. A lookup names the value once."""
    pairs = ", ".join(f"'{name}', '{name}'" for name in allowed)
    return F.try_element_at(F.expr(f"map({pairs})"), value)


def answer_letter(value: Column) -> Column:
    """Stripped, upper-cased value if it is an answer letter, else NULL."""
    return _if_one_of(F.upper(strip(value)), fv.ANSWER_LETTERS)


def answer_from_text(text: Column) -> Column:
    """Letter of the first ``Answer: X`` in any case, upper-cased."""
    return answer_letter(F.regexp_extract(text, fv.ANSWER_MARK, 1))


def labels_from_text(text: Column) -> Column:
    """All ``[High Relevance]``-like marks in any case, in order."""
    found = F.regexp_extract_all(text, F.lit(fv.LABEL_MARK), F.lit(1))
    return F.transform(found, F.initcap)


def clean_labels(labels: Column, n_sentences: Column) -> Column:
    """Labels checked against the number of sentences.

    A wrong number gives an empty array; an unknown label gives NULL in place.
    """
    def known(label: Column) -> Column:
        return _if_one_of(strip(label), fv.RELEVANCE_LABELS)

    return let(
        labels,
        lambda found: F.when(F.size(found) == n_sentences, F.transform(found, known)).otherwise(
            F.array().cast("array<string>")
        ),
    )


def _cut(labels: Column, max_sentences: int | None) -> Column:
    return labels if max_sentences is None else F.slice(labels, 1, max_sentences)


def parse_single(
    df: DataFrame, response: Column, n_sentences: Column, max_sentences: int | None = None
) -> DataFrame:
    """Add ``LLM_answer`` and ``labels``: from the JSON object, else from marks.

    A label list of the right length with only unknown labels is not empty,
    so it is kept and the marks are not looked at. Each stage is a projection
    of its own: the JSON is read once per row.
    """
    text = F.coalesce(response, F.lit(""))
    return (
        df.withColumns({"_gf_json": extract_json_object(text), "_gf_n": n_sentences})
        .withColumns({
            "_gf_listed": clean_labels(F.col("_gf_json")[fv.JSON_LABELS], F.col("_gf_n")),
            fv.SINGLE_ANSWER: F.coalesce(answer_letter(F.col("_gf_json")[fv.JSON_ANSWER]), answer_from_text(text)),
        })
        .withColumn(
            fv.LABELS,
            _cut(
                F.when(F.size("_gf_listed") > 0, F.col("_gf_listed"))
                .otherwise(clean_labels(labels_from_text(text), F.col("_gf_n"))),
                max_sentences,
            ),
        )
        .drop("_gf_json", "_gf_n", "_gf_listed")
    )


def parse_multi(
    df: DataFrame, response: Column, names: Sequence[str], n_sentences: Column,
    max_sentences: int | None = None,
) -> DataFrame:
    """Add one answer column per question name and ``labels``, from JSON only."""
    text = F.coalesce(response, F.lit(""))
    answers = {name: answer_letter(F.col("_gf_json").getField(name)) for name in names}
    labels = clean_labels(F.col("_gf_json")[fv.JSON_LABELS], F.col("_gf_n"))
    return (
        df.withColumns({"_gf_json": extract_json_object(text, names), "_gf_n": n_sentences})
        .withColumns({**answers, fv.LABELS: _cut(labels, max_sentences)})
        .drop("_gf_json", "_gf_n")
    )


def parse_responses(df: DataFrame, spec: EvalSpec) -> DataFrame:
    """Parse ``Raw_Response`` of every row as the spec says."""
    n_sentences = sentence_count(column(spec.sentences_col))
    if spec.is_single:
        return parse_single(df, F.col(fv.RAW_RESPONSE), n_sentences, spec.max_sentences)
    return parse_multi(df, F.col(fv.RAW_RESPONSE), spec.answer_columns, n_sentences, spec.max_sentences)
