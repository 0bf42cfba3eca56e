"""One query per operator, each with the SQL that gives the same rows.

Every query runs over whole tables. Arrays are shown as text and computed
numbers are rounded, since engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import gradeframe as gf
from gradeframe import fixed_values as fv
from gradeframe.functions.labels import label_share, share_name
from gradeframe.sources.tables import scratch_path
from workload import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_LETTERS = "('A','B','C','D','E','F','G','H','I','J')"
_LABELS = "('High Relevance', 'Low Relevance', 'Irrelevant')"
_MARKERS = ", ".join(f"'{m}'" for m in fv.MISSING_MARKERS)
_SPACE = " || ".join(f"chr({ord(c)})" for c in fv.WHITE_SPACE)


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name], ORACLES[name] = fn, sql
        return fn
    return register


def sql_shown(labels: str) -> str:
    return f"array_to_string(list_transform({labels}, lambda x: coalesce(x, '-')), '|')"


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    doubles = [n for n, kind in df.dtypes if kind == "double"]
    return df.withColumns({n: F.round(n, digits) for n in doubles})


# --- sources and sinks --------------------------------------------------------

@query("items_scan", t.FIXTURE_SQL + f"""
select row_id, sentences, gold, grp, case when text not in ({_MARKERS}) then text end as note
from fx join documents on doc_id = row_id""")
def items_scan(spark, sf_dir):
    """Items with real, many-line text through CSV and back."""
    docs = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("note"))
    path = scratch_path(spark, "items-csv")
    made = t.items(spark, sf_dir).select("row_id", "sentences", "gold", "grp").join(docs, "row_id")
    gf.write_table(made, path, "csv")
    back = gf.read_items(spark, path, "csv")
    return back.withColumn("row_id", F.col("row_id").cast("long"))


def _width(results):
    """Labels of the row that has most."""
    return results.agg(F.max(F.size("labels"))).first()[0] or 1


@query("results_scan", t.RESULTS_SQL + f"""
select row_id, gold, grp, raw_text as "Raw_Response", answer as "LLM_answer",
  {sql_shown('list_filter(labels, lambda x: x is not null)')} as labels from facts""")
def results_scan(spark, sf_dir):
    """Wide results as the evaluation reads them."""
    path = scratch_path(spark, "results-wide")
    results = t.results(spark, sf_dir)
    gf.labels_to_wide(results, _width(results)).write.parquet(path)
    back = gf.read_results(spark, path)
    return back.select(
        "row_id", "gold", "grp", "Raw_Response", "LLM_answer",
        t.shown(gf.valid_labels(F.col("labels"))).alias("labels"),
    )


_CELLS = ["", "NA", "None", "nan", "null", "n/a", "#N/A", "<NA>", "na", "none", " NA", "Nil", "A"]


@query("normalize_missing", f"""
with c as (select doc_id, lang, text, [{", ".join(f"'{c}'" for c in _CELLS)}][cast(doc_id % {len(_CELLS)} as int) + 1] as cell from documents)
select doc_id, case when lang not in ({_MARKERS}) then lang end as lang, case when text not in ({_MARKERS}) then text end as text,
  case when cell not in ({_MARKERS}) then cell end as cell from c""")
def normalize_missing(spark, sf_dir):
    cells = F.array(*[F.lit(c) for c in _CELLS])
    docs = t.table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "text", F.get(cells, (F.col("doc_id") % len(_CELLS)).cast("int")).alias("cell")
    )
    return gf.normalize_missing(docs)


@query("preview_rows", "select doc_id, text, lang, source, n_chars from documents order by doc_id limit 3")
def preview_rows(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    return gf.preview(docs, 3, "doc_id")


@query("results_append", t.RESULTS_SQL + f"""
select row_id, raw_text as "Raw_Response", answer as "LLM_answer", {sql_shown('labels')} as labels, err as error from res""")
def results_append(spark, sf_dir):
    """Two runs into one table, the second with its columns in another order."""
    path = scratch_path(spark, "results")
    done = t.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"))
    results = t.results(spark, sf_dir)
    gf.append_results(results.join(done, "row_id", "left_semi"), path)
    rest = results.join(done, "row_id", "left_anti")
    gf.append_results(rest.select(*reversed(rest.columns)), path)
    return gf.existing_results(spark, path).select(
        "row_id", "Raw_Response", "LLM_answer", t.shown("labels").alias("labels"), "error"
    )


@query("processed_ids", "select distinct cast(l_orderkey as varchar) as id from lineitem")
def processed_ids(spark, sf_dir):
    """Each order counts once, however many lines it has."""
    return gf.processed_ids(t.table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("bind_roles", t.FIXTURE_SQL + """
select row_id as id, sentences, question_options as options, grp as "group", gold from fx""")
def bind_roles(spark, sf_dir):
    return gf.bind_roles(t.fixture(spark, sf_dir), t.SPEC)


# --- predicates ---------------------------------------------------------------

@query("valid_answers", t.RESULTS_SQL + ' select row_id, answer as "LLM_answer" from facts where ok')
def valid_answers(spark, sf_dir):
    return t.results(spark, sf_dir).where(gf.is_valid_answer(F.col("LLM_answer"))).select("row_id", "LLM_answer")


@query("refused_rows", t.RESULTS_SQL + " select row_id, grp from facts where not ok")
def refused_rows(spark, sf_dir):
    return t.results(spark, sf_dir).where(gf.is_refused(F.col("LLM_answer"))).select("row_id", "grp")


@query("correct_rows", t.RESULTS_SQL + ' select row_id, answer as "LLM_answer", gold from facts where correct')
def correct_rows(spark, sf_dir):
    rows = t.results(spark, sf_dir)
    return rows.where(gf.is_correct(F.col("LLM_answer"), F.col("gold"))).select("row_id", "LLM_answer", "gold")


@query("valid_labels", t.RESULTS_SQL + f" select row_id, {sql_shown('v')} as labels, len(v) as n from facts")
def valid_labels(spark, sf_dir):
    valid = t.results(spark, sf_dir).select("row_id", gf.valid_labels(F.col("labels")).alias("v"))
    return valid.select("row_id", t.shown("v").alias("labels"), F.size("v").cast("long").alias("n"))


@query("error_rows", t.RESULTS_SQL + """
select row_id, raw_text as "Raw_Response", answer as "LLM_answer", cast(len(labels) as bigint) as n_labels, err as error
from res where err is not null""")
def error_rows(spark, sf_dir):
    scored = gf.score_recorded(t.items(spark, sf_dir), t.responses(spark, sf_dir), t.SPEC)
    return scored.where(F.col("error").isNotNull()).select(
        "row_id", "Raw_Response", "LLM_answer", F.size("labels").cast("long").alias("n_labels"), "error"
    )


# --- joins and unions -----------------------------------------------------------

@query("resume_pending", t.FIXTURE_SQL + """
, i as (select *, case when row_id % 11 = 0 then null else row_id // 2 end as item_id from fx)
select row_id, cast(item_id as varchar) as item_id, question_options from i
where item_id is null or not exists (select 1 from labels l where l.doc_id = item_id)""")
def resume_pending(spark, sf_dir):
    """Items with repeated and missing ids; done are the ids of ``labels``."""
    items = t.items(spark, sf_dir).withColumn(
        "item_id", F.when(F.col("row_id") % 11 != 0, F.expr("row_id div 2"))
    )
    done = t.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "item_id")
    left = gf.pending(items, done, "item_id")
    return left.select("row_id", F.col("item_id").cast("string").alias("item_id"), "question_options")


@query("attach_responses", t.FIXTURE_SQL + f"""
, last as (select conv_id, arg_max(text, turn) as text from conversations where role = 'assistant' group by conv_id)
select row_id, coalesce(trim(text, {_SPACE}), '') as "Raw_Response",
  case when text is null then 'no response recorded' end as error
from fx left join last on conv_id = row_id""")
def attach_responses(spark, sf_dir):
    """The last assistant turn of a conversation as the response."""
    turns = t.table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumnRenamed("conv_id", "row_id")
    joined = gf.attach_responses(t.items(spark, sf_dir), turns, "row_id", "text", "turn")
    return joined.select("row_id", "Raw_Response", "error")


@query("results_union", t.RESULTS_SQL + """
, part as (select row_id, answer, grp from res where answer is not null)
select row_id, answer as "LLM_answer", grp from res union all select row_id, answer, grp from part""")
def results_union(spark, sf_dir):
    """A re-run without ids doubles the rows it scores again."""
    rows = t.results(spark, sf_dir).select("row_id", "LLM_answer", "grp")
    again = rows.where(F.col("LLM_answer").isNotNull()).select("grp", "LLM_answer", "row_id")
    return gf.results_union(rows, again)


# --- metrics --------------------------------------------------------------------

@query("refusal_overall", t.RESULTS_SQL + """
select count(*) filter (not ok) as refused, count(*) as total,
  round(count(*) filter (not ok) / count(*)::double, 9) as refusal_rate from facts""")
def refusal_overall(spark, sf_dir):
    return rounded(gf.refusal_rate(t.results(spark, sf_dir), "LLM_answer"))


@query("refusal_by_group", t.RESULTS_SQL + """
select grp, count(*) filter (not ok) as refused, count(*) as total,
  round(count(*) filter (not ok) / count(*)::double, 9) as refusal_rate
from facts where grp is not null group by grp""")
def refusal_by_group(spark, sf_dir):
    return rounded(gf.refusal_rate(t.results(spark, sf_dir), "LLM_answer", "grp"))


@query("accuracy_overall", t.RESULTS_SQL + """
select count(*) filter (correct) as correct, count(*) as valid,
  round(count(*) filter (correct) / nullif(count(*), 0)::double, 9) as accuracy from facts where ok""")
def accuracy_overall(spark, sf_dir):
    return rounded(gf.accuracy(t.results(spark, sf_dir), "LLM_answer", "gold"))


@query("accuracy_by_group", t.RESULTS_SQL + """
select grp, count(*) filter (correct) as correct, count(*) as valid,
  round(count(*) filter (correct) / count(*)::double, 9) as accuracy
from facts where ok and grp is not null group by grp""")
def accuracy_by_group(spark, sf_dir):
    return rounded(gf.accuracy(t.results(spark, sf_dir), "LLM_answer", "gold", "grp"))


_ANSWER_METRICS = """
, parts as (
  select 'overall' as scope, null as grp, ok, correct from facts
  union all select 'group', grp, ok, correct from facts where grp is not null)
select scope, grp, count(*) filter (not ok) as refused, count(*) as total,
  round(count(*) filter (not ok) / count(*)::double, 9) as refusal_rate,
  count(*) filter (correct) as correct, count(*) filter (ok) as valid,
  round(count(*) filter (correct) / nullif(count(*) filter (ok), 0)::double, 9) as accuracy
from parts group by scope, grp"""


@query("answer_metrics", t.RESULTS_SQL + _ANSWER_METRICS)
def answer_metrics(spark, sf_dir):
    return rounded(gf.answer_metrics(t.results(spark, sf_dir), "LLM_answer", "gold", "grp"))


def sql_mean_ci(value: str, digits: int = 9) -> str:
    half = f"1.96 * stddev_samp({value}) / sqrt(count({value}))"
    return f"""count({value}) as n, round(avg({value}), {digits}) as mean, round(stddev_samp({value}), {digits}) as std,
  round(avg({value}) - {half}, {digits}) as ci_low, round(avg({value}) + {half}, {digits}) as ci_high"""


@query("mean_ci", f"select l_returnflag, {sql_mean_ci('l_extendedprice', 4)} from lineitem group by l_returnflag")
def mean_ci(spark, sf_dir):
    return rounded(gf.mean_ci(t.table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag"), 4)


@query("mean_ci_overall", f"select {sql_mean_ci('value', 6)} from events")
def mean_ci_overall(spark, sf_dir):
    return rounded(gf.mean_ci(t.table(spark, sf_dir, "events"), "value"), 6)


_SHARES = """
, shares as (
  select grp, 0 as label_no, 'High Relevance' as label, s0 as share from done
  union all select grp, 1, 'Low Relevance', s1 from done
  union all select grp, 2, 'Irrelevant', s2 from done)"""


@query("relevance_dist_overall", t.RESULTS_SQL + _SHARES + f"""
select label_no, label, {sql_mean_ci('share')} from shares group by label_no, label""")
def relevance_dist_overall(spark, sf_dir):
    return rounded(gf.relevance_distribution(t.results(spark, sf_dir), "labels"))


@query("relevance_dist_by_group", t.RESULTS_SQL + _SHARES + f"""
select grp, label_no, label, {sql_mean_ci('share')} from shares where grp is not null group by grp, label_no, label""")
def relevance_dist_by_group(spark, sf_dir):
    return rounded(gf.relevance_distribution(t.results(spark, sf_dir), "labels", "grp"))


_DOMAIN = """
, dom as (select * from (values (0, 'High Relevance'), (1, 'Low Relevance'), (2, 'Irrelevant')) d(label_no, label))"""


@query("relevance_accuracy", t.RESULTS_SQL + _DOMAIN + """
select label_no, label, count(*) filter (correct) as correct, count(ok) as total,
  round(count(*) filter (correct) / nullif(count(ok), 0)::double, 9) as accuracy
from dom left join (select * from done where ok) on majority = label group by label_no, label""")
def relevance_accuracy(spark, sf_dir):
    return rounded(gf.relevance_accuracy(t.results(spark, sf_dir), "LLM_answer", "gold", "labels"))


@query("relevance_accuracy_by_group", t.RESULTS_SQL + _DOMAIN + """
, grps as (select distinct grp as g from done where grp is not null)
select g as grp, label_no, label, count(*) filter (correct) as correct, count(ok) as total,
  round(count(*) filter (correct) / nullif(count(ok), 0)::double, 9) as accuracy
from grps join dom on true left join (select * from done where ok) on majority = label and grp = g
group by g, label_no, label""")
def relevance_accuracy_by_group(spark, sf_dir):
    return rounded(gf.relevance_accuracy(t.results(spark, sf_dir), "LLM_answer", "gold", "labels", "grp"))


@query("headline_metrics", t.RESULTS_SQL + """
select count(*) as total_rows, round(count(*) filter (not ok) / count(*)::double, 9) as refusal_rate,
  round(count(*) filter (correct) / nullif(count(*) filter (ok), 0)::double, 9) as accuracy from facts""")
def headline_metrics(spark, sf_dir):
    return rounded(gf.headline(t.results(spark, sf_dir), "LLM_answer", "gold"))


@query("run_counters", t.RESULTS_SQL + """
select cast(count(*) - count(*) filter (err is not null and doc_id is null) as bigint) as processed,
  count(*) filter (err is not null and doc_id is null) as errors
from res left join labels on doc_id = row_id""")
def run_counters(spark, sf_dir):
    """A second run that skips the ids of ``labels``."""
    items = t.items(spark, sf_dir)
    done = t.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "row_id")
    todo = gf.pending(items, done, "row_id")
    return gf.run_counters(items, gf.score_recorded(todo, t.responses(spark, sf_dir), t.SPEC))


def _metrics_sql(source: str, questions: str, distribution: bool) -> str:
    """The metrics table in SQL over long facts
    (question_no, question, grp, ok, correct, majority)."""
    out = f"""
, q as ({questions}),
parts as (select 'overall' as scope, null as g, * from q
  union all select 'group', grp, * from q where grp is not null),
dom as (select * from (values (0, 'High Relevance'), (1, 'Low Relevance'), (2, 'Irrelevant')) d(label_no, label)),
m as (
  select scope, g as grp, question_no, question, 'refusal' as section, null::int as label_no, null as label,
    count(*) filter (not ok) as n, count(*) as total, null::double as mean, null::double as std
  from parts group by all
  union all
  select scope, g, question_no, question, 'accuracy', null, null, count(*) filter (correct), count(*) filter (ok), null, null
  from parts group by all having count(*) filter (ok) > 0
  union all
  select scope, g, question_no, question, 'label_accuracy', d.label_no, d.label,
    count(*) filter (correct and majority = d.label), count(*) filter (ok and majority = d.label), null, null
  from parts join dom d on true group by all"""
    if distribution:
        out += f"""
  union all
  select scope, g, null, null, 'distribution', label_no, label, count(share), count(*), avg(share), stddev_samp(share)
  from (
    select 'overall' as scope, null as g, label_no, label, case label_no when 0 then s0 when 1 then s1 else s2 end as share
    from {source} join dom on true
    union all
    select 'group', grp, label_no, label, case label_no when 0 then s0 when 1 then s1 else s2 end
    from {source} join dom on true where grp is not null)
  group by all"""
    return out + """)
, mt as (select scope, grp, question_no, question, section, label_no, label, n, total,
  case when section = 'distribution' then mean else n / nullif(total, 0)::double end as value, std,
  mean - 1.96 * std / sqrt(n) as ci_low, mean + 1.96 * std / sqrt(n) as ci_high from m)"""


_ROUNDED_METRICS = """
select * replace (coalesce(question_no, -1) as question_no, coalesce(label_no, -1) as label_no, round(value, 9) as value, round(std, 9) as std, round(ci_low, 9) as ci_low, round(ci_high, 9) as ci_high) from mt"""

_SINGLE = "select 0 as question_no, 'LLM_answer' as question, grp, ok, correct, majority from done"


def shown_metrics(metrics: DataFrame) -> DataFrame:
    """Rounded, with -1 for "no question" and "no label"."""
    numbers = {n: F.coalesce(F.col(n), F.lit(-1)) for n in ("question_no", "label_no")}
    return rounded(metrics.withColumns(numbers))


@query("metrics_table", t.RESULTS_SQL + _metrics_sql("done", _SINGLE, True) + _ROUNDED_METRICS)
def metrics_table(spark, sf_dir):
    return shown_metrics(gf.evaluate(t.results(spark, sf_dir), t.SPEC))


# The two questions of a multi response; labels and majority as in ``done``.
_MULTI_SQL = t.FIXTURE_SQL + f"""
, mraw as (
  select *, len(regexp_extract_all(sentences, '\\bS\\d+\\s*:|\\b\\d+\\.')) as n_sent,
    upper(trim(json_extract_string(multi_response, '$.Q1'))) as a1,
    upper(trim(json_extract_string(multi_response, '$.Q2'))) as a2,
    json_extract_string(multi_response, '$.Sentence_Relevance[*]') as listed
  from fx),
mres as (
  select row_id, grp, q1_gold, q2_gold,
    case when a1 in {_LETTERS} then a1 end as q1, case when a2 in {_LETTERS} then a2 end as q2,
    case when len(listed) = n_sent then list_transform(listed, lambda x: case when x in {_LABELS} then x end) else [] end as labels
  from mraw),
mcount as (
  select *, list_filter(labels, lambda x: x is not null) as v,
    len(list_filter(labels, lambda x: x = 'High Relevance')) as n0,
    len(list_filter(labels, lambda x: x = 'Low Relevance')) as n1,
    len(list_filter(labels, lambda x: x = 'Irrelevant')) as n2
  from mres),
mdone as (
  select *, case when len(v) > 0 then list_filter(v, lambda x: case x when 'High Relevance' then n0
      when 'Low Relevance' then n1 else n2 end = greatest(n0, n1, n2))[1] end as majority
  from mcount)"""

_TWO = """
select 0 as question_no, 'Q1' as question, grp, q1 is not null as ok, coalesce(q1 = q1_gold, false) as correct, majority from mdone
union all
select 1, 'Q2', grp, q2 is not null, coalesce(q2 = q2_gold, false), majority from mdone"""


@query("question_metrics", _MULTI_SQL + _metrics_sql("mdone", _TWO, False) + _ROUNDED_METRICS)
def question_metrics(spark, sf_dir):
    return shown_metrics(gf.question_metrics(t.multi_results(spark, sf_dir), t.MULTI_SPEC))


_F4 = "printf('%.4f', {})"


@query("report_lines", t.RESULTS_SQL + _metrics_sql("done", _SINGLE, True) + f"""
, texts as (
  select *, case when total > 0 then concat(n, '/', total, ' = ', printf('%.4f', value)) else 'N/A' end as counts,
    case when n = 0 then 'N/A (no data)' else concat('mean=', printf('%.4f', value), ', std=', coalesce(printf('%.4f', std), 'nan'),
      ', 95% CI=(', coalesce(printf('%.4f', ci_low), 'nan'), ', ', coalesce(printf('%.4f', ci_high), 'nan'), ')') end as spread,
    case when scope = 'overall' then 'Overall' else grp end as who,
    case when scope = 'overall' then 1 else 2 end as level
  from mt),
lines as (
  select -1 as block_no, 0 as part_no, 0 as level, null as grp, i as line_no, txt as "text"
  from (values (0, '=== Analysis Report ==='), (1, 'Input:  results'), (2, 'Model:  recorded'), (3, '')) h(i, txt)
  union all
  select b, p, 0, null, 0, txt from (values (0, 0, '--- LLM_answer ---'),
    (0, 1, '  Refusal Rate (answer not a valid letter):'), (0, 2, '  Accuracy:'),
    (0, 3, '  Accuracy by majority sentence-relevance label:'), (0, 4, ''),
    (1, 0, '--- Sentence Relevance Distribution ---'),
    (1, 1, '  Relevance Distribution (% per row, mean ± 95% CI):')) h(b, p, txt)
  union all
  select 0, case section when 'refusal' then 1 else 2 end, level, grp, 1, concat('    ', who, ': ', counts)
  from texts where section in ('refusal', 'accuracy')
  union all
  select 0, 3, level, grp, label_no + 1, concat('    ', label, ': ', counts)
  from texts where section = 'label_accuracy' and scope = 'overall'
  union all
  select 1, 1, level, grp, 0, concat('    ', who, ':') from texts where section = 'distribution' and label_no = 0
  union all
  select 1, 1, level, grp, label_no + 1, concat('    ', label, ': ', spread) from texts where section = 'distribution')
select * from lines""")
def report_lines(spark, sf_dir):
    results = t.results(spark, sf_dir)
    return gf.report_lines(gf.evaluate(results, t.SPEC), results.columns, t.SPEC, "results")


# --- text and label functions -----------------------------------------------------

_PADDED = "concat(chr(160), chr(9), ' ', text, chr(10), chr(12288))"


@query("strip_text", f"select doc_id, trim({_PADDED}, {_SPACE}) as stripped from documents")
def strip_text(spark, sf_dir):
    padded = F.concat(F.lit(" \t "), F.col("text"), F.lit("\n　"))
    return t.table(spark, sf_dir, "documents").select("doc_id", gf.strip(padded).alias("stripped"))


@query("sentence_count", """
with texts as (
  select 'document' as kind, doc_id as id, 0 as turn, text as txt from documents
  union all select 'page', page_id, 0, html from pages
  union all select 'turn', conv_id, turn, text from conversations)
select kind, id, cast(turn as bigint) as turn,
  cast(len(regexp_extract_all(txt, '\\bS\\d+\\s*:|\\b\\d+\\.')) as bigint) as n_sentences from texts""")
def sentence_count(spark, sf_dir):
    """Sentence marks in every text there is."""
    no_turn = F.lit(0).cast("long").alias("turn")
    docs = t.table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), no_turn, "text")
    pages = t.table(spark, sf_dir, "pages").select(F.lit("page"), "page_id", no_turn, "html")
    turns = t.table(spark, sf_dir, "conversations").select(F.lit("turn"), "conv_id", "turn", "text")
    return docs.union(pages).union(turns).select(
        "kind", "id", "turn", gf.sentence_count(F.col("text")).cast("long").alias("n_sentences")
    )


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_prompt(sentences: str, options: str) -> str:
    """The default prompt in SQL, put together from the text around its gaps."""
    head, rest = fv.DEFAULT_PROMPT.split("{options}")
    middle, tail = rest.split("{sentences}")
    tail = tail.replace("{{", "{").replace("}}", "}")

    def value(cell: str) -> str:
        return f"coalesce(trim({cell}, {_SPACE}), 'nan')"

    return f"concat({sql_text(head)}, {value(options)}, {sql_text(middle)}, {value(sentences)}, {sql_text(tail)})"


@query("render_prompt", f"""
select doc_id, {sql_prompt("d.text", "b.text")} as prompt from documents d left join benchmark b on item_id = doc_id""")
def render_prompt(spark, sf_dir):
    """Real text as sentences; most documents have no question."""
    asked = t.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("options"))
    docs = t.table(spark, sf_dir, "documents").join(asked, "doc_id", "left")
    return docs.select("doc_id", gf.render_prompt(fv.DEFAULT_PROMPT, F.col("text"), F.col("options")).alias("prompt"))


@query("extract_json", t.RESULTS_SQL + f"""
, found as (
  select 'response' as kind, row_id as id, response as txt from fx
  union all select 'event', event_id, props from events
  union all select 'page', page_id, html from pages
  union all select 'document', doc_id, text from documents),
cut as (select kind, id, nullif(regexp_extract(txt, '(?s)\\{{.*\\}}'), '') as body from found),
obj as (select kind, id, case when json_valid(body) then body end as js from cut)
select kind, id, js is not null as is_object, json_extract_string(js, '$.Answer') as answer_text,
  {sql_shown("case when json_type(js, '$.Sentence_Relevance') = 'ARRAY' then json_extract_string(js, '$.Sentence_Relevance[*]') end")} as listed
from obj""")
def extract_json(spark, sf_dir):
    """Responses, and every other text there is: JSON, pages, prose."""
    texts = t.responses(spark, sf_dir).select(F.lit("response").alias("kind"), F.col("row_id").alias("id"), "response")
    for kind, name, key, text in (
        ("event", "events", "event_id", "props"), ("page", "pages", "page_id", "html"),
        ("document", "documents", "doc_id", "text"),
    ):
        texts = texts.union(t.table(spark, sf_dir, name).select(F.lit(kind), key, text))
    read = texts.withColumn("o", gf.extract_json_object(F.col("response")))
    return read.select(
        "kind", "id", F.col("o").isNotNull().alias("is_object"), F.col("o.Answer").alias("answer_text"),
        t.shown(F.col("o.Sentence_Relevance")).alias("listed"),
    )


@query("answer_from_json", t.RESULTS_SQL + " select row_id, json_answer as answer from clean")
def answer_from_json(spark, sf_dir):
    read = t.responses(spark, sf_dir).withColumn("o", gf.extract_json_object(F.col("response")))
    return read.select("row_id", gf.answer_letter(F.col("o.Answer")).alias("answer"))


@query("answer_from_text", """
select conv_id, turn, upper(nullif(regexp_extract(text, '(?i)\\bAnswer:\\s*([A-J])\\b', 1), '')) as answer
from conversations
union all
select doc_id, -1, upper(nullif(regexp_extract(text || ' (answer: ' || substr('abcXYZ', cast(doc_id % 6 as int) + 1, 1) || ')',
  '(?i)\\bAnswer:\\s*([A-J])\\b', 1), '')) from documents""")
def answer_from_text(spark, sf_dir):
    """Turns of conversations, and documents with a marked letter at the end."""
    turns = t.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    letter = F.substring(F.lit("abcXYZ"), (F.col("doc_id") % 6).cast("int") + 1, 1)
    docs = t.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"),
        F.concat("text", F.lit(" (answer: "), letter, F.lit(")")).alias("text"),
    )
    return turns.unionByName(docs).select("conv_id", "turn", gf.answer_from_text(F.col("text")).alias("answer"))


@query("labels_from_text", t.RESULTS_SQL + f" select row_id, {sql_shown('t_list')} as labels from raw where response is not null")
def labels_from_text(spark, sf_dir):
    replies = t.responses(spark, sf_dir).where(F.col("response").isNotNull())
    return replies.select("row_id", t.shown(gf.labels_from_text(F.col("response"))).alias("labels"))


@query("clean_labels", t.RESULTS_SQL + f"""
select row_id, {sql_shown('json_labels')} as from_json, {sql_shown('text_labels')} as from_text from clean""")
def clean_labels(spark, sf_dir):
    made = t.fixture(spark, sf_dir).select(
        "row_id", gf.sentence_count(F.col("sentences")).alias("n"), F.coalesce("response", F.lit("")).alias("text")
    ).withColumn("o", gf.extract_json_object(F.col("text")))
    return made.select(
        "row_id",
        t.shown(gf.clean_labels(F.col("o.Sentence_Relevance"), F.col("n"))).alias("from_json"),
        t.shown(gf.clean_labels(gf.labels_from_text(F.col("text")), F.col("n"))).alias("from_text"),
    )


@query("parse_single", t.RESULTS_SQL + f"""
select row_id, answer as "LLM_answer", {sql_shown('labels')} as labels, cast(len(labels) as bigint) as n_labels from res""")
def parse_single(spark, sf_dir):
    made = t.fixture(spark, sf_dir).select("row_id", "sentences", "response")
    parsed = gf.parse_single(made, F.col("response"), gf.sentence_count(F.col("sentences")))
    return parsed.select("row_id", "LLM_answer", t.shown("labels").alias("labels"), F.size("labels").cast("long").alias("n_labels"))


@query("parse_multi", _MULTI_SQL + f"""
select row_id, q1 as "Q1", q2 as "Q2", {sql_shown('labels')} as labels from mres""")
def parse_multi(spark, sf_dir):
    made = t.fixture(spark, sf_dir).select("row_id", "sentences", "multi_response")
    parsed = gf.parse_multi(made, F.col("multi_response"), ["Q1", "Q2"], gf.sentence_count(F.col("sentences")))
    return parsed.select("row_id", "Q1", "Q2", t.shown("labels").alias("labels"))


_PLACES = "places as (select unnest(range(1, (select max(len(labels)) from res) + 1)) as i)"


@query("labels_to_wide", t.RESULTS_SQL + f""",
{_PLACES}
select row_id, concat('label_', i) as place, labels[i] as label from res, places""")
def labels_to_wide(spark, sf_dir):
    """A column per place, as many as the longest row needs; shown as one row per column."""
    results = t.results(spark, sf_dir).select("row_id", "labels")
    wide = gf.labels_to_wide(results, _width(results))
    return wide.unpivot(["row_id"], [n for n in wide.columns if n != "row_id"], "place", "label")


@query("labels_from_wide", t.RESULTS_SQL + f""",
{_PLACES},
padded as (select row_id, list(labels[i] order by i) as labels from res, places group by row_id)
select row_id, {sql_shown('labels')} as labels from padded""")
def labels_from_wide(spark, sf_dir):
    results = t.results(spark, sf_dir).select("row_id", "labels")
    wide = gf.labels_to_wide(results, _width(results))
    return gf.labels_from_wide(wide).select("row_id", t.shown("labels").alias("labels"))


@query("majority_label", t.RESULTS_SQL + " select row_id, majority from done")
def majority_label(spark, sf_dir):
    valid = t.results(spark, sf_dir).select("row_id", gf.valid_labels(F.col("labels")).alias("v"))
    return valid.select("row_id", gf.majority_label(F.col("v")).alias("majority"))


@query("label_shares", t.RESULTS_SQL + """
select row_id, round(coalesce(s0, 0), 9) as pct_high_relevance, round(coalesce(s1, 0), 9) as pct_low_relevance,
  round(coalesce(s2, 0), 9) as pct_irrelevant from done""")
def label_shares(spark, sf_dir):
    valid = t.results(spark, sf_dir).select("row_id", gf.valid_labels(F.col("labels")).alias("v"))
    return rounded(valid.select(
        "row_id", *[label_share(F.col("v"), name).alias(share_name(name)) for name in fv.RELEVANCE_LABELS]
    ))


@query("row_summary", t.RESULTS_SQL + """
select row_id as id, grp as "group", majority as majority_relevance,
  round(coalesce(s0, 0), 9) as pct_high_relevance, round(coalesce(s1, 0), 9) as pct_low_relevance,
  round(coalesce(s2, 0), 9) as pct_irrelevant, answer as "LLM_answer_answer", not ok as "LLM_answer_refused",
  answer is not distinct from trim(gold) as "LLM_answer_is_correct" from done""")
def row_summary(spark, sf_dir):
    return rounded(gf.row_summary(t.results(spark, sf_dir), t.SPEC))


# --- scoring and streams ------------------------------------------------------------

def make_counting_responder(spec):
    """A stand-in model: its reply depends on the length of the prompt only."""
    def respond(prompts):
        replies = []
        for prompt in prompts:
            n = len(prompt)
            if n % 13 == 0:
                raise ValueError("out of luck")
            letter = "ABCDEFGHIJKL"[n % 12]
            label = '"Low Relevance"' if n % 2 else '"High Relevance"'
            replies.append(f' {{"Answer": "{letter}", "Sentence_Relevance": [{", ".join([label] * (n % 8))}]}}\n')
        return replies
    return respond


@query("score_with_responder", t.FIXTURE_SQL + f"""
, p as (select *, length({sql_prompt("sentences", "question_options")}) as n,
    len(regexp_extract_all(sentences, '\\bS\\d+\\s*:|\\b\\d+\\.')) as n_sent from fx)
select row_id, case when n % 13 = 0 then 'ValueError: out of luck' end as error,
  case when n % 13 = 0 or n % 12 > 9 then null else substr('ABCDEFGHIJ', cast(n % 12 as int) + 1, 1) end as "LLM_answer",
  case when n % 13 = 0 or n % 8 <> n_sent then ''
    else array_to_string(list_transform(range(0, n % 8), lambda i: case when n % 2 = 1 then 'Low Relevance' else 'High Relevance' end), '|') end as labels
from p""")
def score_with_responder(spark, sf_dir):
    scored = gf.score(t.items(spark, sf_dir), t.SPEC, make_counting_responder)
    return scored.select("row_id", "error", "LLM_answer", t.shown("labels").alias("labels"))


@query("stream_score", t.RESULTS_SQL + f"""
select row_id, raw_text as "Raw_Response", answer as "LLM_answer", {sql_shown('labels')} as labels, err as error from res""")
def stream_score(spark, sf_dir):
    """Items arrive in files, then all of them once more: scored once each."""
    items = t.items(spark, sf_dir)
    recorded = t.responses(spark, sf_dir)
    root = scratch_path(spark, "stream-score")
    for arrival in ("first", "again"):
        items.write.mode("append").parquet(f"{root}/in")
        gf.stream_score(
            gf.read_stream(spark, f"{root}/in", items.schema), t.SPEC,
            lambda todo: gf.score_recorded(todo, recorded, t.SPEC, unique=True),
            f"{root}/out", f"{root}/progress", "items",
        ).trigger(availableNow=True).start().awaitTermination()
    return gf.read_stream_results(spark, f"{root}/out").select(
        "row_id", "Raw_Response", "LLM_answer", t.shown("labels").alias("labels"), "error"
    )


@query("stream_metrics", t.RESULTS_SQL + _ANSWER_METRICS)
def stream_metrics(spark, sf_dir):
    """Results arrive in files; the last state of the running metrics."""
    root = scratch_path(spark, "stream-metrics")
    results = t.results(spark, sf_dir).select("row_id", "grp", "gold", "LLM_answer")
    for half in (0, 1):
        results.where(F.col("grp").isNull() == F.lit(bool(half))).write.mode("append").parquet(f"{root}/in")
    gf.stream_metrics(
        gf.read_stream(spark, f"{root}/in", results.schema, files_per_batch=1),
        "LLM_answer", "gold", "grp", f"{root}/out", f"{root}/progress",
    ).trigger(availableNow=True).start().awaitTermination()
    return rounded(gf.read_stream_metrics(spark, f"{root}/out"))


@query("stream_evaluate", t.RESULTS_SQL + _metrics_sql("done", _SINGLE, True) + _ROUNDED_METRICS)
def stream_evaluate(spark, sf_dir):
    """Results arrive in files; the last state of the whole metrics table."""
    root = scratch_path(spark, "stream-evaluate")
    results = t.results(spark, sf_dir).select("row_id", "grp", "gold", "LLM_answer", "labels")
    for half in (0, 1):
        results.where(F.col("grp").isNull() == F.lit(bool(half))).write.mode("append").parquet(f"{root}/in")
        gf.stream_evaluate(gf.read_stream(spark, f"{root}/in", results.schema), t.SPEC, f"{root}/out", f"{root}/progress") \
            .trigger(availableNow=True).start().awaitTermination()
    return shown_metrics(gf.read_stream_metrics(spark, f"{root}/out"))


@query("metrics_refreshed", t.RESULTS_SQL + _metrics_sql("done", _SINGLE, True) + _ROUNDED_METRICS)
def metrics_refreshed(spark, sf_dir):
    """Results come in parts, with an evaluation after each that reads the new part only."""
    root = scratch_path(spark, "refreshed")
    results = t.results(spark, sf_dir).drop("error")
    for part in range(2):
        gf.append_part(results.where(F.pmod("row_id", F.lit(2)) == part), f"{root}/results", f"part-{part}", "row_id")
        metrics = gf.refresh_evaluation(spark, f"{root}/results", t.SPEC, f"{root}/out")
    return shown_metrics(metrics)


@query("part_append", t.RESULTS_SQL + f"""
select row_id, raw_text as "Raw_Response", answer as "LLM_answer", {sql_shown('labels')} as labels, err as error from res""")
def part_append(spark, sf_dir):
    """Two parts, one of them appended twice: it replaces itself."""
    path = scratch_path(spark, "parts")
    results = t.results(spark, sf_dir)
    for part in (0, 1, 0):
        gf.append_part(results.where(F.pmod("row_id", F.lit(2)) == part), path, f"part-{part}", "row_id")
    return gf.existing_results(spark, path).select(
        "row_id", "Raw_Response", "LLM_answer", t.shown("labels").alias("labels"), "error"
    )


@query("pending_indexed", t.FIXTURE_SQL + """
select row_id from fx where row_id not in (select doc_id from labels)""")
def pending_indexed(spark, sf_dir):
    """Open items against results in parts, by the index of their ids."""
    path = scratch_path(spark, "indexed")
    done = t.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"))
    for part in range(3):
        gf.append_part(done.where(F.pmod("row_id", F.lit(3)) == part), path, f"part-{part}", "row_id")
    return gf.pending_at(t.items(spark, sf_dir), path, "row_id").select("row_id")
