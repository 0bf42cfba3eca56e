"""Exact k nearest rows by inner product: a Voronoi join.

A bounded sample of vectors are pivots; every vector belongs to the cell of the
pivot nearest to it. Cells are summarised: rows, radius and the distances of the
k + 1 ids nearest to the pivot, of ids with one vector. With q.x = q.p + q.(x - p) and
|q.(x - p)| <= |q| |x - p| the summaries give each query a score that its k-th
best reaches at least, and so a least distance from the pivot (and a least norm)
that a row of a cell must have to be of use. Queries are grouped by their cells,
neighbouring cells together until a group has enough queries for a block;
a row is copied to a group only if some query of the group can use it, so at most once
per block of queries. Groups
are cut into blocks of queries and of rows, each block is solved by one matrix
product, and the best k per query are merged.

Components are floor(scale * x) as doubles, scores exact integers (products that
could exceed 2 ** 53 are added up in Python integers and kept within 64 bits).

Cases: vectors that are NULL or hold NULL or non-finite components take no part,
nor do rows with a NULL id. Only vectors of equal length are compared. A query
does not find rows with its own id. Equal scores go to the smaller id. Rows that
repeat an id and a vector are one row, dropped before anything is counted or
bounded; of an id with several vectors each score counts once. With fewer than k candidates all are
returned, without queries or candidates nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeframe.llm.common import staged

_SLACK = 1e-6
_EXACT = 2.0 ** 53


@dataclass(frozen=True)
class Voronoi:
    k: int = 10
    scale: int = 1024
    # Rows of the sample that are pivots; the index itself holds every row.
    pivots: int = 128
    block_rows: int = 20_000
    block_queries: int = 512


def usable(vector: Column) -> Column:
    """Whether all components are there and finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


def _matrix(column: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
    """The vectors of these rows, all of one length, as doubles."""
    part = column.take(pa.array(rows))
    return np.asarray(part.flatten(), np.float64).reshape(len(rows), size)


def _placed(job: Voronoi, pivots: dict[int, np.ndarray]):
    """Cell, distance from the pivot and norm of each vector. Lengths without a pivot have the origin as theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            sizes = np.asarray(pa.compute.list_value_length(vectors), np.int64)
            cell, distance, norm = (np.zeros(len(sizes), t) for t in (np.int64, float, float))
            scaled: list = [None] * len(sizes)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = np.floor(job.scale * _matrix(vectors, rows, int(size))) + 0.0  # no -0.0, so that equal vectors have equal bytes
                p = pivots.get(int(size), np.zeros((1, size)))
                gaps = np.stack([np.sqrt(((x - one) ** 2).sum(axis=1)) for one in p])
                best = gaps.argmin(axis=0)
                cell[rows] = size * (job.pivots + 1) + best
                distance[rows] = gaps[best, np.arange(len(rows))]
                norm[rows] = np.sqrt((x ** 2).sum(axis=1))
                for at, one in zip(rows, x):
                    scaled[at] = one.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cell), pa.array(distance), pa.array(norm), pa.array(scaled, pa.binary())],
                ["id", "asks", "cell", "distance", "norm", "vector"])

    return run


def query_groups(job: Voronoi, pivots: dict[int, np.ndarray], cells: list) -> dict[int, int]:
    """The group of each cell that has queries: cells whose pivots are near each other, ``block_queries`` queries at least."""
    groups: dict[int, int] = {}
    for size in {c.cell // (job.pivots + 1) for c in cells}:
        left = {c.cell: c.queries for c in cells if c.cell // (job.pivots + 1) == size and c.queries}
        p = pivots.get(size, np.zeros((1, size)))
        here, group, total = None, None, 0
        while left:
            # From pivot to nearest pivot.
            here = min(left) if here is None else min(
                left, key=lambda c: (float(((p[c % (job.pivots + 1)] - p[here % (job.pivots + 1)]) ** 2).sum()), c))
            if group is None or total >= job.block_queries:
                group, total = here, 0
            groups[here] = group
            total += left.pop(here)
    return groups


def _needs(job: Voronoi, pivots: dict[int, np.ndarray], cells: list, groups: dict[int, int]):
    """Per group and data cell the least distance and norm that any query of the batch needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, list] = {}
        for c in cells:
            by_size.setdefault(c.cell // (job.pivots + 1), []).append(c)
        for batch in batches:
            own = np.asarray(batch.column(0), np.int64)
            raw = batch.column(1).to_pylist()
            out: dict[tuple[int, int], tuple[float, float]] = {}
            for group in np.unique(own):
                size = int(group // (job.pivots + 1))
                q = np.stack([np.frombuffer(raw[i], np.float64) for i in np.flatnonzero(own == group)])
                length = np.sqrt((q ** 2).sum(axis=1))
                p = pivots.get(size, np.zeros((1, size)))
                there = by_size.get(size, [])
                near = q @ np.stack([p[c.cell % (job.pivots + 1)] for c in there]).T
                # Scores that rows are known to reach; one more than k, for the query may be one of them.
                lower = np.concatenate([near[:, [j]] - length[:, None] * np.array(c.nearest, float)[None, :]
                                        for j, c in enumerate(there)], axis=1)
                if lower.shape[1] > job.k:
                    least = np.sort(lower, axis=1)[:, -(job.k + 1)]
                    least = least - _SLACK * (1 + np.abs(least) + length)
                else:
                    least = np.full(len(q), -np.inf)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gap = np.where(length[:, None] > 0, (least[:, None] - near) / length[:, None], -np.inf)
                    norm = np.where(length > 0, least / length, -np.inf)
                gap = gap - _SLACK * (1 + np.abs(gap))
                for j, c in enumerate(there):
                    use = gap[:, j] <= c.radius
                    if use.any():
                        key = groups[int(group)], c.cell
                        before = out.get(key, (np.inf, np.inf))
                        out[key] = (min(before[0], float(gap[use, j].min())), min(before[1], float(norm[use].min()) - _SLACK))
            keys = list(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                 pa.array([out[k][0] for k in keys], pa.float64()), pa.array([out[k][1] for k in keys], pa.float64())],
                ["group", "cell", "least_distance", "least_norm"])

    return run


def _once(names: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The first row of each name and score, in the order of the rows."""
    order = np.lexsort((scores, names))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(names[order]) != 0) | (np.diff(scores[order]) != 0)
    return np.sort(order[first])


def _best(job: Voronoi):
    """The best k rows of a block for each of its queries."""

    def run(block: pa.Table) -> pa.Table:
        asks = np.asarray(block.column("asks").combine_chunks().to_numpy(zero_copy_only=False), bool)
        ids = block.column("id").combine_chunks()
        vectors = np.stack([np.frombuffer(v, np.float64) for v in block.column("vector").to_pylist()])
        order = np.argsort(np.asarray(pa.compute.rank(ids)), kind="stable")
        rows = order[~asks[order]]  # by id, so that the first of equal scores is the smallest id
        names = np.asarray(pa.compute.rank(ids, tiebreaker="dense"))
        data = vectors[rows]
        repeated = len(np.unique(names[rows])) < len(rows)
        answers: list[tuple[int, np.ndarray, list[int]]] = []
        exact = len(data) and np.abs(data).max(initial=0) * np.abs(vectors[asks]).max(initial=0) * max(1, data.shape[1]) < _EXACT
        for q in np.flatnonzero(asks) if len(rows) else ():
            mine = names[rows] != names[q]
            if exact:
                scores = data[mine] @ vectors[q]
                keep = _once(names[rows[mine]], scores) if repeated else np.arange(len(scores))
                if len(keep) > job.k:
                    edge = np.partition(scores[keep], len(keep) - job.k)[len(keep) - job.k]
                    keep = keep[scores[keep] >= edge]
                keep = keep[np.argsort(-scores[keep], kind="stable")]
                scores = scores[keep].astype(np.int64).tolist()
            else:
                own = [int(v) for v in vectors[q]]
                whole = [sum(a * int(b) for a, b in zip(own, row)) for row in data[mine]]
                keep = np.array(sorted(range(len(whole)), key=lambda i: -whole[i]), np.int64)
                scores = [min(max(whole[i], -2 ** 63), 2 ** 63 - 1) for i in keep]
            # Rows of one id with equal scores count once.
            hit = names[rows[mine][keep]]
            _, first = np.unique(np.stack([hit, np.unique(scores, return_inverse=True)[1]]), axis=1, return_index=True) \
                if len(hit) else (None, np.zeros(0, np.int64))
            chosen = np.sort(first)[:job.k]
            answers.append((q, rows[mine][keep][chosen], [scores[i] for i in chosen]))
        at = [a[0] for a in answers for _ in a[2]]
        hits = [i for a in answers for i in a[1]]
        return pa.table({
            "query_id": ids.take(pa.array(at, pa.int64())), "vec_id": ids.take(pa.array(hits, pa.int64())),
            "score": pa.array([s for a in answers for s in a[2]], pa.int64())})

    return run


def nearest(
    data: DataFrame, is_query: Column, job: Voronoi = Voronoi(), id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k best rows for each row that ``is_query`` holds for."""
    rows = data.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.col(vector_col).cast("array<double>").alias("vector"))
    id_type = rows.schema["id"].dataType.simpleString()
    # At most job.pivots vectors come to the driver.
    pivots: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(job.pivots).select("vector").collect():
        pivots.setdefault(len(r.vector), []).append(np.floor(job.scale * np.array(r.vector, np.float64)))
    pivots = {size: np.unique(np.stack(some), axis=0) for size, some in pivots.items()}
    placed = rows.mapInArrow(_placed(job, pivots), (
        f"id {id_type}, asks boolean, cell long, distance double, norm double, vector binary"))
    placed = staged(placed.groupBy("id", "vector").agg(
        F.max("asks").alias("asks"), *[F.first(c).alias(c) for c in ("cell", "distance", "norm")]), "placed")
    # The bounds count ids: a query leaves out all rows of its own id, and rows of one id may count once.
    single = placed.groupBy("id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("cell").alias("cell"), F.min("distance").alias("distance")).where("rows = 1")
    turn = Window.partitionBy("cell").orderBy("distance")
    near = single.select("cell", "distance").withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= job.k + 1)
    nearest_rows = near.groupBy("cell").agg(F.sort_array(F.collect_list("distance")).alias("nearest"))
    sizes = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"), F.max("distance").alias("radius"),
        F.sum(F.col("asks").cast("int")).alias("queries"))
    # One row per pivot (and per vector length without one), k + 1 distances each.
    cells = sizes.join(nearest_rows, "cell", "left") \
        .withColumn("nearest", F.coalesce("nearest", F.array().cast("array<double>"))).collect()
    groups = query_groups(job, pivots, cells)
    # As many rows as there are pivots at most.
    named = data.sparkSession.createDataFrame(sorted(groups.items()), "cell long, group long")
    needs = placed.where("asks").select("cell", "vector").mapInArrow(
        _needs(job, pivots, cells, groups), "group long, cell long, least_distance double, least_norm double")
    needs = staged(needs.groupBy("group", "cell").agg(
        F.min("least_distance").alias("least_distance"), F.min("least_norm").alias("least_norm")), "needs")
    sizes = staged(sizes.select("cell", "rows", "queries"), "sizes")
    blocks = needs.join(sizes.select("cell", "rows"), "cell").groupBy("group").agg(
        (F.floor(F.sum("rows") / job.block_rows) + 1).cast("int").alias("blocks")) \
        .join(sizes.join(F.broadcast(named), "cell").groupBy("group").agg(
            F.ceil(F.sum("queries") / (2 * job.block_queries)).cast("int").alias("turns")), "group")
    blocks = staged(blocks, "blocks")
    plan = needs.join(blocks, "group")
    # The plan has at most pivots ** 2 rows.
    copied = placed.join(F.broadcast(plan), "cell") \
        .where("distance >= least_distance and norm >= least_norm").select(
            "group", "id", F.lit(False).alias("asks"), "vector", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"),
            F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
    asked = placed.where("asks").join(F.broadcast(named), "cell").join(F.broadcast(blocks), "group").select(
        "group", "id", "asks", "vector", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("id", F.lit(1)), "turns").cast("int").alias("turn"))
    found = copied.unionByName(asked).groupBy("group", "block", "turn").applyInArrow(
        _best(job), f"query_id {id_type}, vec_id {id_type}, score long").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= job.k) \
        .select("query_id", "rank", "vec_id", "score")
