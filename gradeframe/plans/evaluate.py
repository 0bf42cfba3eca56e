"""All metrics of a results table in one pass, and the report over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType

from gradeframe import fixed_values as fv
from gradeframe.functions.predicates import is_correct, is_valid_answer
from gradeframe.operators.metrics import interval, present, ratio, with_label_facts
from gradeframe.operators.moments import mean_of, merged_with_overall, moment, std_of
from gradeframe.spec import EvalSpec, column, has_column

_LABEL_NUMBERS = range(len(fv.RELEVANCE_LABELS))


def _facts(results: DataFrame, spec: EvalSpec) -> DataFrame:
    """The few flags and shares per row that all metrics are made of."""
    if not has_column(results, fv.LABELS):
        results = results.withColumn(fv.LABELS, F.array().cast("array<string>"))
    labelled = with_label_facts(results, fv.LABELS, spec.max_sentences)
    failed = F.col(fv.ERROR).isNotNull() if has_column(results, fv.ERROR) else F.lit(False)
    facts = [F.lit(1).alias("present"), failed.alias("failed")]
    if has_column(results, spec.group_col):
        facts.append(present(results, spec.group_col).alias("grp"))
    for q, question in enumerate(spec.targets):
        if not has_column(results, question.name):
            continue
        answer = column(question.name)
        facts.append(is_valid_answer(answer).alias(f"ok_{q}"))
        if has_column(results, question.gold_col):
            facts.append(is_correct(answer, column(question.gold_col)).alias(f"right_{q}"))
    return labelled.select(*facts, "_labels.*")


def _counts_and_moments(facts: DataFrame, n_questions: int) -> tuple[dict[str, Column], dict[str, Column]]:
    """Named aggregates over the facts, all of which can be merged."""
    counts = {"total": F.count("present")}
    for q in range(n_questions):
        if f"ok_{q}" not in facts.columns:
            continue
        counts[f"valid_{q}"] = F.expr(f"count_if(ok_{q})")
        if f"right_{q}" in facts.columns:
            counts[f"correct_{q}"] = F.expr(f"count_if(right_{q})")
            for k, label in enumerate(fv.RELEVANCE_LABELS):
                counts[f"valid_{q}_{k}"] = F.expr(f"count_if(ok_{q} and majority = '{label}')")
                counts[f"correct_{q}_{k}"] = F.expr(f"count_if(right_{q} and majority = '{label}')")
    return counts, {f"share_{k}": moment(F.col(f"share_{k}")) for k in _LABEL_NUMBERS}


def group_figures(results: DataFrame, spec: EvalSpec, with_errors: bool = False) -> DataFrame:
    """All that the metrics are made of: one row per group (``grp``), the missing group included.

    Rows of several tables, or of a stream's batches, can be put together and go to ``metrics_of_figures``.
    ``with_errors`` adds the number of rows in error (``errors``).
    """
    facts = _facts(results, spec)
    if "grp" not in facts.columns:
        facts = facts.withColumn("grp", F.lit(None).cast("string"))
    counts, moments = _counts_and_moments(facts, len(spec.targets))
    if with_errors:
        counts["errors"] = F.count_if("failed")
    return facts.groupBy("grp").agg(*[a.alias(n) for n, a in (counts | moments).items()])


def evaluate(results: DataFrame, spec: EvalSpec) -> DataFrame:
    """The metrics table: refusal, accuracy, accuracy by majority label and
    label distribution, overall and per group, for every question.

    All of it comes from one scan and one aggregation by group; the overall figures
    are merged from the groups', and the rows of the table
    are unfolded from one wide row per group afterwards.

    ``n`` of ``total`` rows give ``value`` for the first three sections; for
    the distribution ``n`` rows give the mean ``value``, ``std`` and interval.
    """
    return metrics_of_figures(group_figures(results, spec), spec)


def metrics_of_figures(figures: DataFrame, spec: EvalSpec) -> DataFrame:
    """The metrics table of what ``group_figures`` gives."""
    names = [n for n in figures.columns if n not in ("grp", "errors")]
    moments = [n for n in names if n.startswith("share_")]
    totals = merged_with_overall(figures, [n for n in names if n not in moments], moments)
    totals = totals.withColumns({
        name + str(k): of(F.col(f"share_{k}")) for k in _LABEL_NUMBERS
        for name, of in (("n_", lambda m: m["n"]), ("mean_", mean_of), ("std_", std_of))})

    def entry(question, section, n, total, label="null", mean="null", std="null"):
        return (
            f"struct(cast({question} as int) as question_no, '{section}' as section, cast({label} as int) as label_no, "
            f"{n} as n, {total} as total, cast({mean} as double) as mean, cast({std} as double) as std)"
        )

    entries = []
    for q in range(len(spec.targets)):
        if f"valid_{q}" not in totals.columns:
            continue
        entries.append(entry(q, "refusal", f"total - valid_{q}", "total"))
        if f"correct_{q}" not in totals.columns:
            continue
        entries.append(entry(q, "accuracy", f"correct_{q}", f"valid_{q}"))
        entries += [entry(q, "label_accuracy", f"correct_{q}_{k}", f"valid_{q}_{k}", k) for k in _LABEL_NUMBERS]
    entries += [entry("null", "distribution", f"n_{k}", "total", k, f"mean_{k}", f"std_{k}") for k in _LABEL_NUMBERS]

    rows = totals.select("is_overall", "grp", F.expr(f"inline(array({', '.join(entries)}))"))
    # A group without a valid answer has no accuracy.
    rows = rows.where("is_overall or section <> 'accuracy' or total > 0")
    questions = F.array(*[F.lit(name) for name in spec.answer_columns])
    labels = F.array(*[F.lit(name) for name in fv.RELEVANCE_LABELS])
    n, std = F.col("n"), F.col("std")
    value = F.when(F.col("section") == "distribution", F.col("mean")).otherwise(ratio(n, F.col("total")))
    low, high = interval(F.col("mean"), std, n)
    return rows.select(
        F.when(F.col("is_overall"), "overall").otherwise("group").alias("scope"), "grp",
        "question_no", F.get(questions, F.col("question_no")).alias("question"), "section",
        "label_no", F.get(labels, F.col("label_no")).alias("label"),
        "n", "total", value.alias("value"), "std", low.alias("ci_low"), high.alias("ci_high"),
    )


def question_metrics(results: DataFrame, spec: EvalSpec) -> DataFrame:
    """The metrics table without the label distribution."""
    return evaluate(results, spec).where(F.col("section") != "distribution")


def four_decimals(value: Column) -> Column:
    """A number with four decimals, exact ties to even; ``nan`` when missing.

    ``format_number`` rounds the binary value correctly but for 0.00005,
    which lies just above the tie and is rounded down.
    """
    text = F.call_function("format_number", value, F.lit("0.0000"))
    text = F.when(value == 5e-5, "0.0001").when(value == -5e-5, "-0.0001").otherwise(text)
    return F.coalesce(text, F.lit(fv.MISSING_TEXT))


def _count_text(n: Column, total: Column, value: Column) -> Column:
    shown = F.concat(n.cast("string"), F.lit("/"), total.cast("string"), F.lit(" = "), four_decimals(value))
    return F.when(total > 0, shown).otherwise(fv.REPORT_NOTHING)


def report_lines(metrics: DataFrame, results_columns: list[str], spec: EvalSpec, input_path: str) -> DataFrame:
    """The text report as rows; ordered by all columns but ``text`` it reads
    from top to bottom.

    Headings are the only rows made on the driver.
    """
    block_of_labels = len(spec.targets)
    parts = {"refusal": 1, "accuracy": 2, "label_accuracy": 3, "distribution": 1}

    fixed = [(-1, 0, i, text) for i, text in enumerate([
        fv.REPORT_TITLE, fv.REPORT_INPUT.format(input_path), fv.REPORT_MODEL.format(spec.model_name), "",
    ])]
    for q, question in enumerate(spec.targets):
        fixed.append((q, 0, 0, fv.REPORT_QUESTION.format(question.name)))
        if question.name not in results_columns:
            fixed.append((q, 1, 0, fv.REPORT_NO_COLUMN.format(question.name)))
        else:
            fixed.append((q, 1, 0, fv.REPORT_REFUSAL))
            if question.gold_col and question.gold_col in results_columns:
                fixed += [(q, 2, 0, fv.REPORT_ACCURACY), (q, 3, 0, fv.REPORT_LABEL_ACCURACY)]
            else:
                fixed.append((q, 2, 0, fv.REPORT_NO_GOLD))
        fixed.append((q, 4, 0, ""))
    fixed += [(block_of_labels, 0, 0, fv.REPORT_LABELS), (block_of_labels, 1, 0, fv.REPORT_DISTRIBUTION)]
    group_type = metrics.schema["grp"].dataType
    headings = metrics.sparkSession.createDataFrame(
        fixed, "block_no int, part_no int, line_no int, text string"
    ).select(
        "block_no", "part_no", F.lit(0).alias("level"), F.lit(None).cast(group_type).alias("grp"), "line_no", "text"
    )

    indent = F.lit(fv.REPORT_INDENT)
    group_text = F.col("grp").cast("string")
    if isinstance(group_type, BooleanType):
        group_text = F.initcap(group_text)
    who = F.when(F.col("scope") == "overall", fv.REPORT_OVERALL).otherwise(group_text)
    counts = _count_text(F.col("n"), F.col("total"), F.col("value"))
    spread = F.when(F.col("n") == 0, fv.REPORT_NO_DATA).otherwise(F.concat(
        F.lit("mean="), four_decimals(F.col("value")), F.lit(", std="), four_decimals(F.col("std")),
        F.lit(", 95% CI=("), four_decimals(F.col("ci_low")), F.lit(", "), four_decimals(F.col("ci_high")), F.lit(")"),
    ))

    def line(number: Column, text: Column) -> Column:
        return F.struct(number.alias("line_no"), text.alias("text"))

    label_line = F.col("label_no") + 1
    lines = (
        F.when(F.col("section") == "label_accuracy",
               F.array(line(label_line, F.concat(indent, F.col("label"), F.lit(": "), counts))))
        .when(F.col("section") != "distribution", F.array(line(F.lit(1), F.concat(indent, who, F.lit(": "), counts))))
        .when(F.col("label_no") == 0, F.array(
            line(F.lit(0), F.concat(indent, who, F.lit(":"))),
            line(label_line, F.concat(indent, F.col("label"), F.lit(": "), spread))))
        .otherwise(F.array(line(label_line, F.concat(indent, F.col("label"), F.lit(": "), spread))))
    )
    part = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
    # The report gives accuracy by label overall only.
    shown = metrics.where((F.col("section") != "label_accuracy") | (F.col("scope") == "overall"))
    body = shown.select(
        F.coalesce("question_no", F.lit(block_of_labels)).alias("block_no"),
        part[F.col("section")].alias("part_no"),
        F.when(F.col("scope") == "overall", 1).otherwise(2).alias("level"),
        "grp", F.inline(lines),
    )
    return headings.unionByName(body)
