"""URL filtering against lists that change over time.

List entries come as dated events (added, removed). ``validity`` turns them into
intervals during which an entry is active, ``match`` joins every capture to the
entries that were active when it was fetched: by key (a domain for the host and
all domains above it, or host and path of the URL) and by date. The captures'
side of the join has one row per key of a capture, the lists' side one row per
interval; a host that most captures have is split by adaptive execution.

Cases: of events of one entry on one day a removal wins. Adding twice keeps the
first date; removing what is not active does nothing. An entry is active from
its date on and no more on the day of its removal. Captures with a NULL URL or
date match nothing, as do events with a NULL value or date. Rows that repeat are
judged alike. Host names are compared in lower case, without port, user and final dot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeframe.llm.common import staged

# Scheme, user, host.
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Host of a URL, NULL if it has none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.$", "")
    return F.when(host != "", host)


def keys_of(url: Column) -> Column:
    """What list entries a URL can match: (kind, value) for its domains and for host and path."""
    labels = F.split(host_of(url), r"\.")
    domains = F.transform(labels, lambda _, i: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("value")))
    page = F.struct(F.lit("url").alias("kind"), F.concat(host_of(url), F.regexp_extract(url, _PATH, 1)).alias("value"))
    return F.when(host_of(url).isNotNull(), F.array_append(domains, page))


def validity(events: DataFrame) -> DataFrame:
    """list, kind, value, valid_from, valid_to (NULL: still active) from events list, kind, value, action, at.

    ``action`` is "add" or "remove".
    """
    days = events.where("value is not null and at is not null").groupBy("list", "kind", "value", "at") \
        .agg(F.min(F.col("action") == "add").alias("active"))
    entry = Window.partitionBy("list", "kind", "value").orderBy("at")
    changes = days.withColumn("before", F.lag("active", 1, False).over(entry)).where("active != before")
    spans = changes.withColumn("valid_to", F.lead("at").over(entry)).where("active")
    return spans.select("list", "kind", "value", F.col("at").alias("valid_from"), "valid_to")


def match(captures: DataFrame, intervals: DataFrame, id_col: str, url_col: str, at: Column) -> DataFrame:
    """id, url, fetched, blocked, n_lists and the most specific active entry, one row per row.

    Most specific is the longest value, then the first by list and kind.
    """
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), at.alias("fetched"))
    keyed = rows.where("url is not null and fetched is not null").select("id", "url", "fetched", F.explode(keys_of(F.col("url"))).alias("k"))
    keyed = keyed.select("id", "url", "fetched", F.col("k.kind").alias("kind"), F.col("k.value").alias("value"))
    spans = staged(intervals, "intervals")
    active = keyed.join(spans, ["kind", "value"]).where(
        (F.col("valid_from") <= F.col("fetched")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))))
    order = F.struct((-F.length("value")).alias("l"), "list", "kind", "value", "valid_from", "valid_to")
    found = active.groupBy("id", "url", "fetched").agg(
        F.min(order).alias("entry"), F.size(F.collect_set("list")).alias("n_lists"))
    found = staged(found, "found").select(
        F.col("id").alias("fid"), F.col("url").alias("furl"), F.col("fetched").alias("fat"), "entry", "n_lists")
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("url") == F.col("furl"))
                       & (F.col("fetched") == F.col("fat")), "left")
    return joined.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "fetched", F.col("entry").isNotNull().alias("blocked"),
        F.coalesce("n_lists", F.lit(0)).alias("n_lists"), F.col("entry.list").alias("list"),
        F.col("entry.kind").alias("kind"), F.col("entry.value").alias("value"),
        F.col("entry.valid_from").alias("valid_from"), F.col("entry.valid_to").alias("valid_to"))
