"""Which rows are still to do, and where their responses come from.

Ids are compared as text. Rows with a missing id never match anything, so
they go round the join instead of through it: a shuffle by id would send all
of them to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions.text import strip
from gradeframe.sources.tables import staged
from gradeframe.spec import column, has_column

_KEY = "_gf_id"


def distinct_ids(df: DataFrame, id_col: str) -> DataFrame:
    """The ids of a table as text, each once (column ``id``)."""
    return df.where(column(id_col).isNotNull()).select(column(id_col).cast("string").alias("id")).distinct()


def processed_ids(existing: DataFrame, id_col: str, retry_errors: bool = False) -> DataFrame:
    """Distinct ids, as text, of rows already there (column ``id``).

    Rows in error count as done unless ``retry_errors``.
    """
    if retry_errors and has_column(existing, fv.ERROR):
        existing = existing.where(F.col(fv.ERROR).isNull())
    return distinct_ids(existing, id_col)


def pending(
    items: DataFrame, existing: DataFrame | None, id_col: str | None, retry_errors: bool = False,
    scratch: str | None = None,
) -> DataFrame:
    """The items whose id is not in the existing results.

    Without an id column nothing is skipped; a missing id is never skipped;
    repeated ids in the input are all kept or all skipped.

    The ids that are in both tables are worked out first, from the id columns
    alone, and staged. They are no more than the smaller table has: a few new
    items against a large table of results are then filtered by broadcast.
    """
    if existing is None or not has_column(existing, id_col):
        return items
    done = processed_ids(existing, id_col, retry_errors).join(distinct_ids(items, id_col), "id", "left_semi")
    done = staged(done.select(F.col("id").alias(_KEY)), "done-ids", scratch)
    named = items.where(column(id_col).isNotNull())
    left = named.join(done, column(id_col).cast("string") == F.col(_KEY), "left_anti")
    return left.unionByName(items.where(column(id_col).isNull()))


def attach_responses(
    items: DataFrame, responses: DataFrame, id_col: str, response_col: str = "response",
    attempt_col: str | None = None, unique: bool = False,
) -> DataFrame:
    """Add the recorded response of each item: ``Raw_Response`` and ``error``.

    Of several responses to an id the one with the highest attempt is taken
    (the greatest text where attempts tie or there are none); they are reduced
    to one per id before they are joined. ``unique`` says that ids do not
    repeat, which saves that step. An item without a response becomes an error
    row.
    """
    recorded = responses.where(column(id_col).isNotNull()).select(
        column(id_col).cast("string").alias(_KEY),
        column(response_col).cast("string").alias("_gf_text"),
        (column(attempt_col) if attempt_col else F.lit(0)).alias("_gf_attempt"),
    )
    if not unique:
        best = F.max(F.struct("_gf_attempt", "_gf_text"))["_gf_text"]
        wanted = distinct_ids(items, id_col).withColumnRenamed("id", _KEY)
        one_each = recorded.groupBy(_KEY).agg(best.alias("_gf_text")).join(wanted, _KEY, "left_semi")
        recorded = staged(one_each, "responses")
    named = items.where(column(id_col).isNotNull())
    joined = named.join(
        recorded.select(_KEY, "_gf_text"), column(id_col).cast("string") == F.col(_KEY), "left"
    ).drop(_KEY)
    nameless = items.where(column(id_col).isNull()).withColumn("_gf_text", F.lit(None).cast("string"))
    return with_reply(joined.unionByName(nameless), F.col("_gf_text"), F.lit("no response recorded")).drop("_gf_text")


def with_reply(df: DataFrame, response: Column, problem: Column) -> DataFrame:
    """Add ``Raw_Response`` (empty when there is none) and ``error``."""
    return df.withColumns({
        fv.RAW_RESPONSE: F.coalesce(strip(response), F.lit("")),
        fv.ERROR: F.when(response.isNull(), problem),
    })


def results_union(earlier: DataFrame, new: DataFrame) -> DataFrame:
    """Earlier and new results, columns by name, repeats kept."""
    return earlier.unionByName(new)


def settled_results(results: DataFrame, id_col: str) -> DataFrame:
    """Results without the error rows that a later retry replaced.

    Of an id whose tries all failed one error row stays; error rows without an
    id all stay.
    """
    failed = results.where(F.col(fv.ERROR).isNotNull())
    fine = results.where(F.col(fv.ERROR).isNull())
    left = pending(failed, fine, id_col)
    named = left.where(column(id_col).isNotNull()).dropDuplicates([id_col])
    return fine.unionByName(named).unionByName(left.where(column(id_col).isNull()))
