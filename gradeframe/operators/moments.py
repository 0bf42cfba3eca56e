"""Counts and moments that can be merged.

A moment of a value over some rows is its number, mean and sum of squared
deviations. Those of two sets of rows give those of both together, without a
difference of large sums, so the figures of all rows come from the figures of
groups, those of a table from its parts, and neither needs the rows again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.spec import column

# The rows of the overall figure are merged in so many parts before these are merged.
_PARTS = 64


def moment(value: Column) -> Column:
    """Number, mean and squared deviations of the values that are there, as an aggregate."""
    n = F.count(value)
    spread = F.coalesce(F.var_pop(value) * n, F.lit(0.0))
    return F.struct(n.alias("n"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), spread.alias("spread"))


def mean_of(moment: Column) -> Column:
    """NULL without values."""
    return F.when(moment["n"] > 0, moment["mean"])


def std_of(moment: Column) -> Column:
    """Sample standard deviation; NULL with fewer than two values."""
    return F.when(moment["n"] > 1, F.sqrt(moment["spread"] / (moment["n"] - 1)))


def _joined(a: Column, b: Column) -> Column:
    n = a["n"] + b["n"]
    away = b["mean"] - a["mean"]
    both = F.struct(
        n.alias("n"), (a["mean"] + away * b["n"] / n).alias("mean"),
        (a["spread"] + b["spread"] + away * away * a["n"] * b["n"] / n).alias("spread"))
    return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(both)


def _all_joined(name: str) -> Column:
    """A moment over several rows, as an aggregate; in a fixed order, for sums of doubles depend on it."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("spread"))
    return F.aggregate(F.sort_array(F.collect_list(column(name))), none, _joined)


def _merged(rows: DataFrame, keys: Sequence[str], counts: Sequence[str], moments: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        *[F.sum(column(n)).alias(n) for n in counts], *[_all_joined(n).alias(n) for n in moments])


def merged_with_overall(rows: DataFrame, counts: Sequence[str], moments: Sequence[str]) -> DataFrame:
    """``is_overall``, ``grp`` and the figures: one row per group and one over all rows.

    ``rows`` has figures per ``grp``, several rows of a group allowed; those of
    the missing group count overall only. What is doubled for the overall row are
    these rows, not the table's. Without rows there is an overall row of zeros.
    """
    names = [*counts, *moments]
    zero = rows.sparkSession.range(0, 1, 1, 1).select(
        F.lit(None).cast(rows.schema["grp"].dataType).alias("grp"),
        *[F.lit(0).cast(rows.schema[n].dataType).alias(n) for n in counts],
        *[F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("spread")).alias(n) for n in moments])
    rows = rows.select("grp", *[column(n) for n in names]).unionByName(zero)
    nobody = F.lit(None).cast(rows.schema["grp"].dataType)
    own = F.struct(F.lit(False).alias("is_overall"), F.col("grp").alias("grp"), F.lit(0).alias("part"))
    everyone = F.struct(F.lit(True).alias("is_overall"), nobody.alias("grp"), F.pmod(F.hash("grp"), F.lit(_PARTS)).alias("part"))
    ways = F.when(F.col("grp").isNull(), F.array(everyone)).otherwise(F.array(own, everyone))
    dealt = rows.withColumn("way", F.explode(ways)).select("way.*", *[column(n) for n in names])
    # Counts are added up before they are shuffled; moments are merged part by part first.
    parts = _merged(dealt, ["is_overall", "grp", "part"], counts, moments) if moments else dealt
    return _merged(parts, ["is_overall", "grp"], counts, moments)

