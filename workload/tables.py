"""Items, recorded responses and results derived from the given tables.

``documents`` gives one item per document: its lines are the sentences, and
labels and answers come by plain arithmetic on its id, in two SQL dialects that
yield the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeframe import EvalSpec, Question
from gradeframe.functions.response import parse_responses
from gradeframe.operators.resume import with_reply

_SPARK_BASE = """
select doc_id, source, n,
  array_join(labs, '", "') as labs_json,
  array_join(labs, '] [') as labs_marks,
  array_join(transform(pieces, (x, i) -> concat('S', i + 1, ': ', x)), ' ') as sentences
from (select *,
        transform(sequence(1, n), i -> case (doc_id * 7 + i * 3 + cast(floor(i / 4) as bigint)) % 4
          when 0 then 'High Relevance' when 1 then 'Low Relevance' when 2 then 'Irrelevant'
          else case when doc_id % 2 = 0 then 'Unsure' else 'Irrelevant' end end) as labs
      from (select doc_id, source, pieces, size(pieces) as n
            from (select doc_id, source,
                    filter(split(concat('note from ', source, '\\n', coalesce(text, '')), '\\n'), x -> x <> '') as pieces
                  from {documents})))
"""

_DUCKDB_BASE = """
select doc_id, source, n,
  array_to_string(labs, '", "') as labs_json,
  array_to_string(labs, '] [') as labs_marks,
  array_to_string(list_transform(pieces, lambda x, i: concat('S', i, ': ', x)), ' ') as sentences
from (select *,
        list_transform(range(1, n + 1), lambda i: case (doc_id * 7 + i * 3 + cast(floor(i / 4) as bigint)) % 4
          when 0 then 'High Relevance' when 1 then 'Low Relevance' when 2 then 'Irrelevant'
          else case when doc_id % 2 = 0 then 'Unsure' else 'Irrelevant' end end) as labs
      from (select doc_id, source, pieces, len(pieces)::int as n
            from (select doc_id, source,
                    list_filter(string_split(concat('note from ', source, chr(10), coalesce(text, '')), chr(10)), lambda x: x <> '') as pieces
                  from documents)))
"""

_COMMON = """
with base as (BASE),
k as (
  select *, doc_id % 9 as shape,
    substr('ABCDE', cast(1 + doc_id % 5 as int), 1) as gold0,
    substr('ABCDE', cast(1 + (doc_id + case when cast(floor(doc_id / 3) as bigint) % 10 < 6 then 0 else 1 end) % 5 as int), 1) as ans,
    substr('ABCDE', cast(1 + (doc_id + case when cast(floor(doc_id / 5) as bigint) % 4 = 0 then 2 else 0 end) % 5 as int), 1) as ans2
  from base),
f as (select *, concat('{"Answer": "', ans, '", "Sentence_Relevance": ["', labs_json, '"]}') as full_json from k),
fx as (
select doc_id as row_id,
  sentences,
  concat('Question ', doc_id, '? A) one B) two C) three D) four E) five') as question_options,
  case when doc_id % 23 = 0 then null when doc_id % 29 = 0 then lower(gold0) when doc_id % 31 = 0 then concat(' ', gold0) else gold0 end as gold,
  case when doc_id % 17 = 0 then null else source end as grp,
  case shape
    when 0 then full_json
    when 1 then concat('Sure, here it is: ', full_json, ' Hope it helps.')
    when 2 then concat('{"Answer": "', lower(ans), ' ", "Sentence_Relevance": ["Irrelevant", "Irrelevant", "Irrelevant", "Irrelevant", "Irrelevant", "Irrelevant", "Irrelevant", "Irrelevant"]}')
    when 3 then concat('answer: ', lower(ans), '. [', lower(labs_marks), ']')
    when 4 then 'I cannot answer this question.'
    when 5 then concat('{"Answer": "', ans, '", "Sentence_Relevance": ["Irre Answer: ', ans)
    when 6 then concat('{"Answer": "Z", "Sentence_Relevance": ["', labs_json, '"]}')
    when 7 then concat(full_json, ' and {note}')
    else null end as response,
  concat('{"Q1": "', ans, '", "Q2": "', case when doc_id % 6 = 0 then 'none' else lower(ans2) end, '", "Sentence_Relevance": ["', labs_json, '"]}') as multi_response,
  gold0 as q1_gold,
  gold0 as q2_gold
from f)
"""

# DuckDB's own reading of the responses, from the rules.
_LABELS = "('High Relevance', 'Low Relevance', 'Irrelevant')"
_LETTERS = "('A','B','C','D','E','F','G','H','I','J')"

_DUCKDB_PARSE = f"""
, body as (
  select *, len(regexp_extract_all(sentences, '\\bS\\d+\\s*:|\\b\\d+\\.')) as n_sent,
    coalesce(response, '') as txt,
    case when json_valid(nullif(regexp_extract(response, '(?s)\\{{.*\\}}'), ''))
      then regexp_extract(response, '(?s)\\{{.*\\}}') end as js
  from fx),
raw as (
  select *,
    upper(trim(json_extract_string(js, '$.Answer'))) as j_ans,
    upper(nullif(regexp_extract(txt, '(?i)\\bAnswer:\\s*([A-J])\\b', 1), '')) as t_ans,
    case when json_type(js, '$.Sentence_Relevance') = 'ARRAY'
      then json_extract_string(js, '$.Sentence_Relevance[*]') end as j_list,
    list_transform(regexp_extract_all(txt, '(?i)\\[(High Relevance|Low Relevance|Irrelevant)\\]', 1),
      lambda x: case lower(x) when 'high relevance' then 'High Relevance'
        when 'low relevance' then 'Low Relevance' else 'Irrelevant' end) as t_list
  from body),
clean as (
  select *,
    case when j_ans in {_LETTERS} then j_ans end as json_answer,
    case when len(j_list) = n_sent then list_transform(j_list,
      lambda x: case when trim(x) in {_LABELS} then trim(x) end) else [] end as json_labels,
    case when len(t_list) = n_sent then t_list else [] end as text_labels
  from raw),
res as (
  select row_id, sentences, question_options, gold, grp, txt as raw_text,
    case when response is null then 'no response recorded' end as err,
    coalesce(json_answer, t_ans) as answer,
    case when len(json_labels) > 0 then json_labels else text_labels end as labels
  from clean),
facts as (
  select *,
    coalesce(answer in {_LETTERS}, false) as ok,
    coalesce(answer in {_LETTERS} and answer = trim(gold), false) as correct,
    list_filter(labels, lambda x: x is not null) as v
  from res),
counted as (
  select *, len(v) as nv,
    len(list_filter(v, lambda x: x = 'High Relevance')) as n0,
    len(list_filter(v, lambda x: x = 'Low Relevance')) as n1,
    len(list_filter(v, lambda x: x = 'Irrelevant')) as n2
  from facts),
done as (
  select *,
    case when nv = 0 then null
      else list_filter(v, lambda x: case x when 'High Relevance' then n0 when 'Low Relevance' then n1 else n2 end
                                    = greatest(n0, n1, n2))[1] end as majority,
    n0 / nullif(nv, 0)::double as s0, n1 / nullif(nv, 0)::double as s1, n2 / nullif(nv, 0)::double as s2
  from counted)
"""

FIXTURE_SQL = _COMMON.replace("BASE", _DUCKDB_BASE)
RESULTS_SQL = FIXTURE_SQL + _DUCKDB_PARSE

SPEC = EvalSpec(id_col="row_id", group_col="grp", gold_col="gold", model_name="recorded")
MULTI_SPEC = EvalSpec(
    id_col="row_id", group_col="grp", questions=(Question("Q1", "q1_gold"), Question("Q2", "q2_gold")),
)
ITEM_COLUMNS = ["row_id", "sentences", "question_options", "gold", "grp"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, responses and gold answers side by side, one row per document."""
    base = _SPARK_BASE.replace("{documents}", f"parquet.`{sf_dir}/documents.parquet`")
    return spark.sql(_COMMON.replace("BASE", base) + " select * from fx")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir).select(*ITEM_COLUMNS)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir).select("row_id", "response")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored items: each response parsed beside its item."""
    replied = with_reply(fixture(spark, sf_dir), F.col("response"), F.lit("no response recorded"))
    return parse_responses(replied.select(*ITEM_COLUMNS, "Raw_Response", "error"), SPEC)


def multi_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored items with two questions each."""
    replied = with_reply(fixture(spark, sf_dir), F.col("multi_response"), F.lit("no response recorded"))
    kept = replied.select("row_id", "sentences", "grp", "q1_gold", "q2_gold", "Raw_Response", "error")
    return parse_responses(kept, MULTI_SPEC)


def shown(labels) -> F.Column:
    """A label array as text, so that engines agree on it; ``-`` for NULL."""
    return F.array_join(labels, "|", "-")
