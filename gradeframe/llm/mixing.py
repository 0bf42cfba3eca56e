"""Mixing sources to target weights by budgets handed down a tree.

The tree is domain, language, source. A budget of tokens is split among the
children of each node by weight; a child never gets more than its subtree can
give, and what it cannot use goes to its siblings by their weights. What a subtree
can give is worked out from the leaves up: tokens times the most epochs of a leaf,
the sum over its children with a weight above 0 of any other node. So only what all
siblings together cannot use reaches the level above.

A leaf with a budget of ``b`` tokens gives all its documents ``b // tokens``
times and of the next epoch a prefix: in that epoch's own seeded order, the
documents whose running sum of tokens stays within the rest. The end of the
prefix is one order key per leaf. It is found from sums per leaf and order bucket
and a running sum within the one bucket in which the rest runs out, so a leaf
with most of the documents is spread over as many tasks as it has buckets.

Cases: NULL domain, language or source is a value of its own. A NULL or empty
text has no tokens; it is taken with full epochs and where it lies in the prefix.
Nodes without a given weight get ``default_weight``; a weight of 0 gives
nothing. Rows that share an id count each and are taken together. A budget
beyond what there is takes every document for the most epochs. Shares are
rounded down to whole tokens. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeframe.llm.common import staged

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """``weights`` has one map per level; its keys are the values from the domain down to that level."""

    budget_percent: int = 50
    # Takes the place of the share of all tokens.
    budget_tokens: int | None = None
    max_epochs: int = 2
    weights: tuple[Mapping, Mapping, Mapping] = ({}, {}, {})
    default_weight: int = 1
    seed: int = 0
    # Hex digits of the order key that name a bucket: 16 ** n buckets of a leaf.
    bucket_digits: int = 3


def word_count(text: Column) -> Column:
    """Tokens of a text: its words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(mix: Mix, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in the order of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), doc_id.cast("string")).cast("binary"))


def _weight(mix: Mix, level: int) -> Column:
    weight = F.lit(mix.default_weight)
    for key, value in mix.weights[level].items():
        parts = key if isinstance(key, tuple) else (key,)
        same = F.lit(True)
        for name, part in zip(LEVELS, parts):
            same = same & F.col(name).eqNullSafe(F.lit(part))
        weight = F.when(same, F.lit(int(value))).otherwise(weight)
    return weight.cast("long")


def _split(nodes: DataFrame, level: int) -> DataFrame:
    """Budget of each node of a level out of its parent's, ``given``.

    By capacity per weight, the first children fill up; the others share the
    rest in proportion. The rows are nodes of the tree, not documents.
    """
    up = [F.lit(0), *LEVELS[:level]]
    giving = nodes.where("weight > 0 and capacity > 0")
    order = Window.partitionBy(*up).orderBy(F.col("capacity") / F.col("weight"), *LEVELS[:level + 1])
    giving = giving.withColumns({
        "left": F.col("given") - F.coalesce(
            F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "heavy": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    is_open = F.col("capacity") * F.col("heavy") > F.col("left") * F.col("weight")
    # The first child that does not fill up has the highest level of those that do not.
    water = F.max(F.when(is_open, F.col("left").cast("double") / F.col("heavy"))).over(Window.partitionBy(*up))
    giving = giving.withColumn("water", water)
    share = F.greatest(F.lit(0), F.floor(F.col("weight") * F.col("water"))).cast("long")
    return giving.select(*LEVELS[:level + 1], F.when(is_open, share).otherwise(F.col("capacity")).alias("budget"))


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """domain, lang, source, tokens and budget of leaves with domain, lang, source and tokens."""
    total = mix.budget_tokens
    if total is None:
        total = (leaves.agg(F.sum("tokens")).first()[0] or 0) * mix.budget_percent // 100
    # From the leaves up: what a weight of 0 shuts off is no capacity of any level above.
    levels = [leaves.select(*LEVELS, (F.col("tokens") * mix.max_epochs).alias("capacity")).withColumn("weight", _weight(mix, len(LEVELS) - 1))]
    for level in reversed(range(len(LEVELS) - 1)):
        within = F.sum(F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0)).alias("capacity")
        levels.insert(0, levels[0].groupBy(*LEVELS[:level + 1]).agg(within).withColumn("weight", _weight(mix, level)))
    parents = None
    for level, nodes in enumerate(levels):
        names = list(LEVELS[:level + 1])
        if parents is None:
            nodes = nodes.withColumn("given", F.lit(total).cast("long"))
        else:
            up = parents.select(F.struct(*names[:-1]).alias("up"), F.col("budget").alias("given"))
            nodes = nodes.withColumn("up", F.struct(*names[:-1])).join(up, "up").drop("up")
        parents = _split(nodes, level)
    key = F.struct(*LEVELS).alias("leaf")
    return leaves.withColumn("leaf", key).join(parents.select(key, "budget"), "leaf", "left").select(
        *LEVELS, "tokens", F.coalesce("budget", F.lit(0)).alias("budget"))


def leaf_cuts(rows: DataFrame, mix: Mix) -> DataFrame:
    """leaf (struct), tokens, budget, full epochs and the last order key of the prefix.

    ``rows`` has id, domain, lang, source and n_tokens of each document.
    """
    leaf = F.struct(*LEVELS).alias("leaf")
    leaves = staged(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    full = F.when(F.col("tokens") > 0, F.least(F.lit(mix.max_epochs), F.floor(F.col("budget") / F.col("tokens"))))
    plan = leaf_budgets(leaves, mix).withColumn("full", F.coalesce(full, F.lit(0)).cast("int")) \
        .withColumn("rest", F.when(F.col("full") < mix.max_epochs, F.col("budget") - F.col("full") * F.col("tokens"))
                    .otherwise(F.lit(0)))
    plan = staged(plan.select(leaf, "tokens", "budget", "full", "rest"), "plan")
    keyed = rows.select(leaf, "id", "n_tokens").join(plan.where("rest > 0").select("leaf", "full", "rest"), "leaf") \
        .select("leaf", "n_tokens", "rest", order_key(mix, F.col("full") + 1, F.col("id")).alias("place"))
    keyed = keyed.withColumn("bucket", F.substring("place", 1, mix.bucket_digits))
    sums = keyed.groupBy("leaf", "bucket").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    running = Window.partitionBy("leaf").orderBy("bucket")
    crossed = sums.withColumn("upto", F.sum("n").over(running)).where("upto > rest") \
        .groupBy("leaf").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before")), "bucket").alias("b")) \
        .select("leaf", "b.*")
    crossed = staged(crossed, "crossed")
    inside = Window.partitionBy("leaf", "bucket").orderBy("place")
    last = keyed.join(crossed, ["leaf", "bucket"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside)) \
        .groupBy("leaf", "bucket").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("place"))).alias("place"))
    # The bare bucket name comes after all earlier buckets and before all keys of its own.
    cuts = last.select("leaf", F.coalesce("place", "bucket").alias("cut"))
    return staged(plan.join(cuts, "leaf", "left").select(
        "leaf", "tokens", "budget", "full", F.coalesce("cut", F.lit("")).alias("cut")), "cuts")


def copies(mix: Mix, doc_id: Column) -> Column:
    """How often a document is taken, given its leaf's full epochs and cut."""
    more = order_key(mix, F.col("full") + 1, doc_id) <= F.col("cut")
    return F.col("full") + F.when((F.col("full") < mix.max_epochs) & more, 1).otherwise(0)


def selection(
    docs: DataFrame, mix: Mix, domain: Column, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """id, domain, lang, source, n_tokens and copies (0 for documents that are left out), one row per row."""
    rows = docs.select(F.col(id_col).alias("id"), domain.alias("domain"), F.col(lang_col).alias("lang"),
                       F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("n_tokens"))
    rows = staged(rows, "tokens")
    cuts = leaf_cuts(rows, mix)
    taken = rows.withColumn("leaf", F.struct(*LEVELS)).join(cuts.select("leaf", "full", "cut"), "leaf")
    return taken.select(F.col("id").alias(id_col), *LEVELS, "n_tokens", copies(mix, F.col("id")).alias("copies"))


def mixed(
    docs: DataFrame, mix: Mix, domain: Column, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """The rows that are taken, each as often as it is taken, with all their columns.

    Texts do not move: each row looks up its leaf's epochs and cut.
    """
    rows = docs.select(F.col(id_col).alias("id"), domain.alias("domain"), F.col(lang_col).alias("lang"),
                       F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("n_tokens"))
    cuts = leaf_cuts(staged(rows, "tokens"), mix)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {n: names[docs.columns.index(n)] for n in (id_col, lang_col, source_col)}
    leaf = F.struct(domain.alias("domain"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    # Named by place: the documents may have columns of any names.
    plain = docs.select("*", leaf.alias("leaf")).toDF(*names, "leaf")
    taken = plain.join(cuts.select("leaf", "full", "cut"), "leaf").withColumn("times", copies(mix, F.col(at[id_col])))
    again = taken.where("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), "times")))
    return again.select(*names).toDF(*docs.columns)
