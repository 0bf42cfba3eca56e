"""One query per operator over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeframe.llm import langid, license_scan, url_filter, warc
from gradeframe.llm.chat_format import AFTER_ROLE, BEGIN, END, NEXT, TRAINED, format_report
from gradeframe.llm.collocations import Collocations, collocations
from gradeframe.llm.common import documents, scratch
from gradeframe.llm.fertility import verdicts
from gradeframe.llm.knn import Voronoi, nearest
from gradeframe.llm.mixing import LEVELS, Mix, selection
from gradeframe.llm.near_dedup import NearDedup, near_duplicates
from gradeframe.llm.segmentation import Segmentation, digest_column
from gradeframe.llm.substring_dedup import removal_report
from gradeframe.llm.vector_codes import VectorCodes, code_report


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), NearDedup(shingle_words=2))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"[^\x20\x09-\x0D]+"

# Two sets with a similarity of 0.8 share one of the rarest fifth of either: only documents that do are compared.
_NEAR_SQL = f"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORDS}') as w from documents),
sets as materialized (
  select doc_id, case when len(w) = 0 then []::varchar[] when len(w) = 1 then w
    else list_distinct(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) end as s from d),
shingles as (select doc_id, len(s) as n, unnest(s) as shingle from sets),
counted as (select *, count(*) over (partition by shingle) as df from shingles),
ranked as (select *, row_number() over (partition by doc_id order by df, shingle) as place from counted),
rare as materialized (select doc_id, n, shingle from ranked where place <= n - (80 * n + 99) // 100 + 1),
pairs as (
  select distinct x.doc_id as a, y.doc_id as b from rare x join rare y on x.shingle = y.shingle
  where x.doc_id < y.doc_id and 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
shared as (
  select a, b, len(x.s) as na, len(y.s) as nb, len(list_intersect(x.s, y.s)) as n
  from pairs join sets x on x.doc_id = a join sets y on y.doc_id = b),
links as materialized (
  select a, b from shared where 100 * n >= 80 * (na + nb - n) union all select b, a from shared where 100 * n >= 80 * (na + nb - n)),
reached as (
  select a as doc_id, b as other from links
  union select reached.doc_id, links.b from reached join links on links.a = reached.other),
least as (select doc_id, min(other) as other from reached group by doc_id)
select sets.doc_id, len(s)::bigint as n_shingles, least(sets.doc_id, coalesce(other, sets.doc_id)) as component_id,
  least(sets.doc_id, coalesce(other, sets.doc_id)) = sets.doc_id as kept
from sets left join least on least.doc_id = sets.doc_id
"""


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captured, deduplicated = scratch(spark, "captured"), scratch(spark, "deduplicated")
    # One capture a minute, in the order of the ids.
    date = F.timestamp_seconds(F.lit(1_704_067_200) + 60 * F.coalesce("page_id", F.lit(0)))
    warc.write_archives(pages, captured, "page_id", "url", "html", date)
    warc.resolve_revisits(spark, captured, deduplicated)
    found = warc.resolved(warc.read_records(spark, deduplicated, payloads=False))
    return found.select(
        F.col("row_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


_WARC_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as payload_bytes, sha256(html) as payload_digest from p),
o as (select *, min(page_id) over (partition by payload_digest) as original from d)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when payload_bytes >= 100 and original <> page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and original <> page_id then original end as refers_to
from o
"""


# The lists of the query: hosts, registered domains and pages of the captures themselves, added and
# removed on days that their checksums give. The text is the same in both SQL dialects.
_DIGIT = "(instr('0123456789abcdef', substr(h, {}, 1)) - 1)"
_EVENT_PARTS = [
    # list, kind, salt, condition, later removal, later return
    ("case when {7} < 8 then 'malware' else 'adult' end", "host", "{1} < 4", "{4} < 8", "{4} < 3"),
    ("'policy'", "domain", "{1} < 8", "{4} < 12", "{4} < 4"),
    ("'takedown'", "page", "{1} < 1", "{4} < 4", "{4} < 2"),
]


def _digits(text: str) -> str:
    return text.format(*[_DIGIT.format(i) for i in range(9)])


def _events_sql(table: str) -> str:
    """Events (list, kind, value, action, n) from a table of hosts, registered domains and pages; n is a day number."""
    parts = []
    for name, column, chosen, removed, returned in _EVENT_PARTS:
        kind = "url" if column == "page" else "domain"
        keyed = f"(select distinct {column} as value, md5(concat('{column}:', {column})) as h from {table} where {column} is not null)"
        day = "16 * {2} + {3}"
        for action, condition, n in (
            ("add", chosen, day), ("remove", f"{chosen} and {removed}", day + " + 30 + 8 * {5}"),
            ("add", f"{chosen} and {returned}", day + " + 60 + 8 * {5} + {6}"),
        ):
            parts.append(_digits(f"select {name} as list, '{kind}' as kind, value, '{action}' as action, {n} as n from {keyed} x where {condition}"))
    return " union all ".join(parts)


def op3_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host = url_filter.host_of(F.col("url"))
    keys = pages.select(host.alias("host"), F.regexp_extract(host, r"([^.]+[.][^.]+)$", 1).alias("domain"),
                        F.element_at(url_filter.keys_of(F.col("url")), -1)["value"].alias("page"))
    keys = keys.withColumn("domain", F.when(F.col("domain") != "", F.col("domain")))
    events = spark.sql(_events_sql("@").replace("@", "{keys}"), keys=keys)
    start = F.lit("2024-01-01").cast("date")
    events = events.select("list", "kind", "value", "action", F.date_add(start, F.col("n").cast("int")).alias("at"))
    fetched = F.date_add(start, F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    return url_filter.match(pages, url_filter.validity(events), "page_id", "url", fetched).drop("url")


_URL_SQL = f"""
with p as (
  select page_id, url, date '2024-01-01' + ((page_id * 37) % 366)::int as fetched,
    nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)), '[.]$', ''), '') as host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path from pages),
k as (select *, host || path as page, nullif(regexp_extract(host, '([^.]+[.][^.]+)$', 1), '') as domain from p),
e as ({_events_sql("k")}),
days as (select list, kind, value, date '2024-01-01' + n::int as day, bool_and(action = 'add') as active from e group by all),
changes as (select * from (select *, coalesce(lag(active) over (partition by list, kind, value order by day), false) as before
  from days) where active <> before),
spans as (select list, kind, value, day as valid_from, valid_to from
  (select *, lead(day) over (partition by list, kind, value order by day) as valid_to from changes) where active),
keyed as (
  select page_id, fetched, 'domain' as kind, array_to_string(labels[i:], '.') as value
  from (select *, unnest(range(1, len(labels) + 1)) as i from (select *, string_split(host, '.') as labels from k where host is not null))
  union all select page_id, fetched, 'url', page from k where host is not null),
active as (select page_id, s.* from keyed join spans s using (kind, value)
  where valid_from <= fetched and (valid_to is null or fetched < valid_to)),
ranked as (select *, row_number() over (partition by page_id order by -length(value), list, kind, value, valid_from) as r,
  count(distinct list) over (partition by page_id) as lists from active)
select k.page_id, fetched, r is not null as blocked, coalesce(lists, 0)::int as n_lists, list, kind, value, valid_from, valid_to
from k left join (select * from ranked where r = 1) x on x.page_id = k.page_id
"""


def op4_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = digest_column(F.col("text"), F.col("doc_id"), Segmentation(seed=4))
    return documents(spark, sf_dir).select("doc_id", found.alias("found")).select("doc_id", "found.*")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(documents(spark, sf_dir))


_REPEATS_SQL = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') as w from documents),
k as (select doc_id, list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' '))) as keys from d where len(w) >= 50),
windows as materialized (select doc_id, unnest(keys) as window_key, unnest(range(1, len(keys) + 1)) as i from k),
firsts as (select window_key, min(doc_id) as first_id from windows group by window_key),
starts as (select doc_id, i from windows join firsts on firsts.window_key = windows.window_key where first_id < doc_id),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
marked as (select words.doc_id, words.i, word, starts.i is not null as begins
  from words left join starts on starts.doc_id = words.doc_id and starts.i = words.i),
judged as (select *, bool_or(begins) over (partition by doc_id order by i rows between 49 preceding and current row) as gone from marked),
kept as (
  select doc_id, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by i) filter (where not gone) as rest
  from judged group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(rest, '')) as kept_sha256
from d left join kept on kept.doc_id = d.doc_id
"""


def op6_token_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(documents(spark, sf_dir), band_col="lang")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, Voronoi())


_TOPK_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, v.vec_id,
    list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * v.v[i]))::bigint as score
  from v q join v on v.vec_id <> q.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 10
"""


# Targets of the mix. The domain of a source is its number modulo three.
DOMAINS = ("web", "books", "forum")
MIX = Mix(
    budget_percent=60, max_epochs=2, seed=17,
    weights=(
        {"web": 5, "books": 4, "forum": 3},
        {("web", "en"): 6, ("web", "de"): 2, ("web", "fr"): 2, ("web", "es"): 2, ("books", "en"): 3, ("forum", "es"): 0},
        {("web", "en", "src0"): 2, ("books", "en", "src1"): 4, ("forum", "en", "src2"): 3},
    ),
)


def source_domain():
    number = F.regexp_extract("source", r"([0-9]+)$", 1)
    names = F.array(*[F.lit(d) for d in DOMAINS])
    return F.when(number != "", F.get(names, number.cast("int") % len(DOMAINS)))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection(documents(spark, sf_dir), MIX, source_domain())


def _weight_sql(level: int) -> str:
    cases = []
    for key, value in MIX.weights[level].items():
        parts = key if isinstance(key, tuple) else (key,)
        cases.append("when " + " and ".join(f"{n} = '{v}'" for n, v in zip(LEVELS, parts)) + f" then {value}")
    return f"case {' '.join(cases)} else {MIX.default_weight} end"


def _split_sql(level: int) -> str:
    names, up = ", ".join(LEVELS[:level + 1]), ", ".join(LEVELS[:level]) or "1"
    given = (f"(select floor(sum(n_tokens) * {MIX.budget_percent} / 100)::bigint from d)" if level == 0
             else f"(select b.budget from budget{level - 1} b where "
                  + " and ".join(f"b.{n} is not distinct from s.{n}" for n in LEVELS[:level]) + ")")
    # Documents below a weight of 0 cannot be given.
    given_at_all = " and ".join(f"{_weight_sql(below)} > 0" for below in range(level + 1, len(LEVELS))) or "true"
    return f"""
size{level} as (
  select {names}, sum(case when {given_at_all} then n_tokens else 0 end) * {MIX.max_epochs} as capacity from d group by {names}),
node{level} as (select *, {_weight_sql(level)} as weight, {given} as given from size{level} s),
run{level} as (
  select *, given - coalesce(sum(capacity) over (partition by {up} order by capacity::double / weight, {names}
      rows between unbounded preceding and 1 preceding), 0) as remaining,
    sum(weight) over (partition by {up} order by capacity::double / weight, {names}
      rows between current row and unbounded following) as heavy
  from node{level} where weight > 0 and capacity > 0 and given is not null),
water{level} as (
  select *, max(case when capacity * heavy > remaining * weight then remaining::double / heavy::double end)
    over (partition by {up}) as water from run{level}),
budget{level} as (
  select {names}, case when capacity * heavy > remaining * weight then greatest(0, floor(weight * water))::bigint
    else capacity::bigint end as budget from water{level})"""


_MIX_SQL = f"""
with d as (
  select doc_id, case regexp_extract(source, '([0-9]+)$', 1)::int % {len(DOMAINS)}
      {' '.join(f"when {i} then '{n}'" for i, n in enumerate(DOMAINS))} end as domain,
    lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n_tokens
  from documents),
{_split_sql(0)}, {_split_sql(1)}, {_split_sql(2)},
leaf as (
  select domain, lang, source, sum(n_tokens) as tokens,
    coalesce((select b.budget from budget2 b where b.domain is not distinct from d.domain
      and b.lang is not distinct from d.lang and b.source is not distinct from d.source), 0) as budget
  from d group by all),
epochs as (
  select *, case when tokens > 0 then least({MIX.max_epochs}, budget // tokens) else 0 end as n_full from leaf),
placed as (
  select d.*, n_full, case when n_full < {MIX.max_epochs} then budget - n_full * tokens else 0 end as remaining,
    md5(concat('{MIX.seed}:', n_full + 1, ':', doc_id)) as place
  from d join epochs e on d.domain is not distinct from e.domain and d.lang is not distinct from e.lang
    and d.source is not distinct from e.source),
summed as (select *, sum(n_tokens) over (partition by domain, lang, source order by place) as upto from placed)
select doc_id, domain, lang, source, n_tokens::bigint as n_tokens,
  (n_full + case when remaining > 0 and upto <= remaining then 1 else 0 end)::int as copies
from summed
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = langid.is_held_out(F.col("doc_id"))
    model = langid.train(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"),
                        langid.language_column(F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", "found.*")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir), Collocations())


_COLLOCATION_SQL = f"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents),
words as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
sizes as (select unnest([1, 2, 3]) as k),
places as (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words, sizes where len(w) >= k),
f as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f from places group by all),
totals as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
candidates as (select lang, k as words, phrase, string_split(phrase, ' ') as w, f as a from f where k > 1 and f >= 10),
cuts as (select *, unnest(range(1, words)) as cut from candidates),
sides as (select lang, phrase, a, cut, array_to_string(w[1:cut], ' ') as head, array_to_string(w[cut + 1:words], ' ') as tail from cuts),
scored as (
  select s.lang, s.phrase, s.a, s.cut, x.f as l, y.f as r,
    ((1000000::hugeint * s.a * s.a) // (x.f::hugeint * y.f))::bigint as score
  from sides s join f x on x.lang = s.lang and x.phrase = s.head join f y on y.lang = s.lang and y.phrase = s.tail),
best as (select * from (select *, row_number() over (partition by lang, phrase order by score, cut) as c from scored) where c = 1),
inside as (
  select lang, array_to_string(w[i:i + 1], ' ') as phrase, max(a) as longer
  from (select *, unnest([1, 2]) as i from candidates where words = 3) group by all),
ranked as (
  select b.*, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank
  from best b left join inside i on i.lang = b.lang and i.phrase = b.phrase where i.longer is null or 100 * i.longer < 50 * a)
select ranked.lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score
from ranked join totals on totals.lang = ranked.lang where rank <= 2000
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), VectorCodes())


def _assign_sql(n: int) -> str:
    """Distance and index of the nearest entry of codebook n for each part."""
    return f"""
gap{n} as materialized (
  select x.vec_id, x.part, c.entry, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i]))) as gap
  from x join book{n} c on c.part = x.part),
near{n} as materialized (
  select vec_id, part, entry, gap from (select *, row_number() over (partition by vec_id, part order by gap, entry) as place from gap{n}) where place = 1)"""


def _round_sql(n: int) -> str:
    """Codebook n out of codebook n - 1."""
    return f"""{_assign_sql(n - 1)},
mean{n} as materialized (
  select part, entry, list(mean order by i) as v from (
    select a.part, entry, i, floor(sum(v[i])::double / count(*))::bigint as mean
    from (select a.part, entry, v, unnest(range(1, len(v) + 1)) as i from near{n - 1} a join x on x.vec_id = a.vec_id and x.part = a.part) a
    group by a.part, entry, i) group by part, entry),
book{n} as materialized (
  select b.part, b.entry, coalesce(m.v, b.v) as v from book{n - 1} b left join mean{n} m on m.part = b.part and m.entry = b.entry)"""


_CODES = VectorCodes()
_CODES_SQL = f"""
with kept as materialized (
  select vec_id, label, list_transform(embedding, lambda x: floor({_CODES.scale} * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
split as (select vec_id, v, len(v) // {_CODES.parts} as width, unnest(range(0, {_CODES.parts})) as part from kept),
x as materialized (select vec_id, part, v[part * width + 1:(part + 1) * width] as v from split),
book0 as materialized (
  select part, entry, v from (select part, v, row_number() over (partition by part order by vec_id) - 1 as entry from x) where entry < {_CODES.entries}),
{",".join(_round_sql(n) for n in range(1, _CODES.rounds + 1))},
{_assign_sql(_CODES.rounds)},
coded as (
  select vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' order by part) as code, sum(gap)::bigint as error from near{_CODES.rounds} group by vec_id),
labelled as (select coded.*, label from coded join kept on kept.vec_id = coded.vec_id),
books as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as codebooks_sha256 from book{_CODES.rounds})
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from labelled, books
"""


# A conversation whose texts look like the template.
_CONFUSING = "\\### Assistant: </turn> ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", _CONFUSING), (-7, 1, "assistant", _CONFUSING)], rows.schema)
    return format_report(rows.unionByName(planted))


def _occurrences_sql(text: str) -> str:
    return f"(length(text) - length(replace(text, '{text}', ''))) // {len(text)}"


_CHAT_SQL = f"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{_CONFUSING}' union all select -7, 1, 'assistant', '{_CONFUSING}'),
t as (
  select *, lag(role) over (partition by conv_id order by turn, role, text) as earlier,
    length(text) + {_occurrences_sql(chr(92))} + {_occurrences_sql(END.strip())} + {_occurrences_sql(NEXT)}
      + coalesce(list_sum(list_transform(regexp_extract_all(text, '##(#+)', 1), lambda x: len(x))), 0) as chars
  from r)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = '{TRAINED[0]}'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = '{TRAINED[0]}'), '')) as loss_sha256,
  sum(chars + case when earlier is null or earlier <> role then length(role) + {len(BEGIN + AFTER_ROLE + END)} else {len(NEXT)} end)::bigint
    as formatted_chars
from t group by conv_id
"""


QUERIES = {f.__name__: f for f in (
    op1_minhash_near_dedup,
    op2_warc_revisits,
    op3_url_lists,
    op4_sentencepiece_sampling,
    op5_substring_dedup,
    op6_token_fertility,
    op7_license_scan,
    op8_exact_topk,
    op9_source_mixing,
    op10_language_id,
    op11_phrase_collocations,
    op12_vector_codes,
    op13_chat_format,
)}

ORACLES: dict[str, str] = {"op1_minhash_near_dedup": _NEAR_SQL, "op5_substring_dedup": _REPEATS_SQL, "op2_warc_revisits": _WARC_SQL, "op3_url_lists": _URL_SQL, "op8_exact_topk": _TOPK_SQL,
                           "op9_source_mixing": _MIX_SQL, "op11_phrase_collocations": _COLLOCATION_SQL,
                           "op12_vector_codes": _CODES_SQL, "op13_chat_format": _CHAT_SQL}
