"""Vector compression by codebooks per part, fitted with LAESA pivots.

Vectors become whole numbers, floor(scale * x), and are cut into equal parts.
Each part position has a codebook. Its first entries are the parts of the kept
vectors with the smallest ids; each round assigns every part to the nearest
entry (squared Euclidean distance, ties to the lower index) and replaces each
entry by its parts' componentwise mean, rounded down; unused entries stay.

The nearest entry is found with fixed pivots (LAESA). The pivots of a part
position are far-apart entries of its first codebook. The distances from every
part to its pivots are computed once and stored with the vectors. Each round
needs only the few distances between pivots and entries; then |d(part, pivot) -
d(pivot, entry)| is a lower bound of d(part, entry) for every pivot. The entries
are tried by rising bound, in exact whole numbers, until the bound exceeds the
best distance found. Bounds are lowered by more than their rounding error, so no
entry that could win or tie is left out.

A round is one pass over the stored vectors; tasks send a sum and a count per
entry (parts x entries rows at most), and codebooks of that size are all that the
driver and the tasks hold. Errors per label are summed before they are joined back.

Cases: vectors that are NULL, empty, or hold NULL or non-finite components take no
part, nor do rows with a NULL id. All other vectors must have one length that the parts divide, and
components below 2 ** 28 after scaling, so that all distances are exact in 64
bits; else it is an error. With fewer kept rows than entries the codebook has
as many entries as there are rows. Rows that repeat an id are rows of their own,
ordered by their components. NULL labels are one label. Without rows the result
is empty. Only the three columns named are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradeframe.llm.common import staged, trimmed

# Relative rounding error of distances stored as 32-bit floats, with room.
_SLACK = 1e-6
_LARGEST = 1 << 28


@dataclass(frozen=True)
class VectorCodes:
    scale: int = 1024
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    pivots: int = 8
    # Vectors that a task compares at a time.
    block_rows: int = 4096


def whole_vectors(vectors: DataFrame, job: VectorCodes, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label and the scaled vector of the rows that take part."""
    x = F.col("vector")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & (F.size(x) > 0) & ~odd)
    # As a double first: the product must not be rounded to 32 bits.
    scaled = F.transform(x, lambda v: F.floor(v.cast("double") * job.scale))
    return rows.select("id", "label", scaled.alias("vector"))


def _checked(kept: DataFrame, job: VectorCodes) -> int:
    """The length of all vectors; 0 without rows."""
    longest = F.array_max(F.transform("vector", F.abs))
    found = kept.agg(F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high"),
                     F.max(longest).alias("largest")).first()
    if found["low"] is None:
        return 0
    if found["low"] != found["high"] or found["low"] % job.parts:
        raise ValueError(f"vectors have {found['low']} to {found['high']} components: they need one length that {job.parts} divides")
    if found["largest"] >= _LARGEST:
        raise ValueError(f"a component is {found['largest']} after scaling; distances are exact below {_LARGEST}")
    return found["low"]


def _first_codebooks(kept: DataFrame, job: VectorCodes, size: int) -> np.ndarray:
    """parts x entries x components, from the rows with the smallest ids."""
    rows = kept.select("id", "vector").orderBy("id", "vector").limit(job.entries).collect()
    whole = np.array([r["vector"] for r in rows], np.int64).reshape(len(rows), job.parts, size // job.parts)
    return whole.transpose(1, 0, 2).copy()


def _far_apart(codebooks: np.ndarray, count: int) -> np.ndarray:
    """Pivots per part: the first entry, then always the entry farthest from all pivots so far."""
    out = []
    for entries in codebooks:
        chosen = [0]
        nearest = ((entries - entries[0]) ** 2).sum(axis=1)
        while len(chosen) < min(count, len(entries)):
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, ((entries - entries[chosen[-1]]) ** 2).sum(axis=1))
        out.append(entries[chosen])
    return np.stack(out)


def _distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Euclidean distances, points x others."""
    return np.stack([np.sqrt(((points - one) ** 2).sum(axis=1).astype(np.float64)) for one in others], axis=1)


def _parts(column: pa.Array, parts: int) -> np.ndarray:
    """rows x parts x values of a list column whose lists have one length."""
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), parts, -1)


def _with_pivot_distances(job: VectorCodes, pivots: np.ndarray):
    """Adds the distances of each part to its pivots, once and for all rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _parts(batch.column("vector"), job.parts).astype(np.int64)
            gaps = np.stack([_distances(points[:, p], pivots[p]) for p in range(job.parts)], axis=1)
            per_row = gaps.shape[1] * gaps.shape[2]
            flat = pa.array(gaps.reshape(-1).astype(np.float32))
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * per_row)
            small = pa.array(points.reshape(-1).astype(np.int32))
            at = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (points.shape[1] * points.shape[2]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.ListArray.from_arrays(at, small), pa.ListArray.from_arrays(ends, flat)],
                ["id", "label", "vector", "gaps"])

    return run


def nearest_entries(points: np.ndarray, gaps: np.ndarray, entries: np.ndarray, pivots: np.ndarray
                    ) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry, its squared distance, and how many distances were evaluated.

    ``gaps`` are the stored distances points x pivots.
    """
    from_pivots = _distances(entries, pivots)
    bounds = np.zeros((len(points), len(entries)))
    for p in range(len(pivots)):
        here, there = gaps[:, [p]].astype(np.float64), from_pivots[:, p][None, :]
        np.maximum(bounds, np.abs(here - there) - _SLACK * (here + there), out=bounds)
    order = np.argsort(bounds, axis=1, kind="stable")
    least = np.square(np.take_along_axis(bounds, order, axis=1))
    best = np.full(len(points), np.iinfo(np.int64).max)
    index = np.zeros(len(points), np.int64)
    open_rows, evaluated, at = np.arange(len(points)), 0, 0
    while at < len(entries):
        # Bounds rise, so what is closed here stays closed.
        open_rows = open_rows[least[open_rows, at] <= best[open_rows]]
        if not len(open_rows):
            break
        tried = order[open_rows, at]
        exact = ((points[open_rows] - entries[tried]) ** 2).sum(axis=1)
        better = (exact < best[open_rows]) | ((exact == best[open_rows]) & (tried < index[open_rows]))
        best[open_rows[better]], index[open_rows[better]] = exact[better], tried[better]
        evaluated += len(open_rows)
        at += 1
    return index, best, evaluated


def _blocks(batch: pa.RecordBatch, job: VectorCodes) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for at in range(0, batch.num_rows, job.block_rows):
        block = batch.slice(at, job.block_rows)
        yield block, _parts(block.column("vector"), job.parts).astype(np.int64), _parts(block.column("gaps"), job.parts)


def _sums(job: VectorCodes, codebooks: np.ndarray, pivots: np.ndarray):
    """Per part and entry the componentwise sums and the count of the task's parts, and the distances evaluated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(codebooks.shape, np.int64)
        counts, evaluated = np.zeros(codebooks.shape[:2], np.int64), np.zeros(codebooks.shape[:2], np.int64)
        for batch in batches:
            for _, points, gaps in _blocks(batch, job):
                for p in range(job.parts):
                    index, _, tried = nearest_entries(points[:, p], gaps[:, p], codebooks[p], pivots[p])
                    np.add.at(sums[p], index, points[:, p])
                    counts[p] += np.bincount(index, minlength=codebooks.shape[1])
                    evaluated[p, 0] += tried
        used = np.argwhere((counts > 0) | (evaluated > 0))
        trimmed()
        yield pa.RecordBatch.from_arrays(
            [pa.array(used[:, 0].astype(np.int32)), pa.array(used[:, 1].astype(np.int32)),
             pa.array([sums[p, e].tolist() for p, e in used], pa.list_(pa.int64())),
             pa.array(counts[used[:, 0], used[:, 1]]), pa.array(evaluated[used[:, 0], used[:, 1]])],
            ["part", "entry", "sums", "n", "evaluated"])

    return run


def _next_codebooks(placed: DataFrame, job: VectorCodes, codebooks: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, int]:
    """Codebooks after one round, and the number of distances that were evaluated."""
    width = codebooks.shape[2]
    partial = placed.mapInArrow(_sums(job, codebooks, pivots),
                                "part int, entry int, sums array<long>, n long, evaluated long")
    added = partial.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.sum("evaluated").alias("evaluated"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    rows = added.collect()
    out = codebooks.copy()
    for row in rows:
        if row["n"]:
            out[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return out, sum(row["evaluated"] for row in rows)


def _codes(job: VectorCodes, codebooks: np.ndarray, pivots: np.ndarray):
    """Code (two hex digits per part) and squared error of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, points, gaps in _blocks(batch, job):
                found = [nearest_entries(points[:, p], gaps[:, p], codebooks[p], pivots[p]) for p in range(job.parts)]
                digits = np.stack([index for index, _, _ in found], axis=1).astype(np.uint8)
                codes = pa.array([row.tobytes().hex() for row in digits])
                error = pa.array(np.sum([squared for _, squared, _ in found], axis=0))
                yield pa.RecordBatch.from_arrays([block.column("id"), block.column("label"), codes, error],
                                                 ["id", "label", "code", "error"])
        trimmed()

    return run


def codebooks_digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


@dataclass(frozen=True)
class Encoded:
    """``rows``: id, label, code, error. ``evaluated``: distances per round, of rows x parts x entries."""

    rows: DataFrame
    codebooks: np.ndarray
    evaluated: tuple[int, ...]


def encode(vectors: DataFrame, job: VectorCodes = VectorCodes(), id_col: str = "vec_id", vector_col: str = "embedding",
           label_col: str = "label") -> Encoded:
    """Fit the codebooks and encode all vectors."""
    if not 1 <= job.entries <= 256:
        raise ValueError("a code has two hex digits per part: 1 to 256 entries")
    kept = staged(whole_vectors(vectors, job, id_col, vector_col, label_col), "vectors")
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    size = _checked(kept, job)
    if not size:
        none = kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return Encoded(none, np.zeros((job.parts, 0, 0), np.int64), ())
    codebooks = _first_codebooks(kept, job, size)
    pivots = _far_apart(codebooks, job.pivots)
    placed = staged(kept.mapInArrow(
        _with_pivot_distances(job, pivots),
        f"id {kinds['id']}, label {kinds['label']}, vector array<int>, gaps array<float>"), "placed")
    evaluated = []
    for _ in range(job.rounds):
        codebooks, tried = _next_codebooks(placed, job, codebooks, pivots)
        evaluated.append(tried)
    rows = placed.mapInArrow(_codes(job, codebooks, pivots),
                             f"id {kinds['id']}, label {kinds['label']}, code string, error long")
    return Encoded(staged(rows, "codes"), codebooks, tuple(evaluated))


def with_label_errors(rows: DataFrame) -> DataFrame:
    """Add the error summed over the rows of a label; NULL labels are one label."""
    sums = staged(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "labels") \
        .withColumnRenamed("label", "of")
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def code_report(vectors: DataFrame, job: VectorCodes = VectorCodes(), id_col: str = "vec_id", vector_col: str = "embedding",
                label_col: str = "label") -> DataFrame:
    """id, code, error, label_error and the digest of the codebooks, one row per kept row."""
    found = encode(vectors, job, id_col, vector_col, label_col)
    return with_label_errors(found.rows).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codebooks_digest(found.codebooks)).alias("codebooks_sha256"))
