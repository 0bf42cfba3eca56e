"""Near-duplicate groups: SuperMinHash, banding, exact verification, components.

1. Each document's set of word shingles gets a SuperMinHash signature: every
   element draws a seeded random order of the registers (Fisher-Yates) and gives
   the register that it ranks at place j the value j + r, r in [0, 1). Documents
   leave the loop as soon as all their registers are filled, because later ranks
   cannot lower them.
2. Documents with equal sets form one class; only its smallest id goes on.
3. Signatures are cut into bands; documents that share a band are in a bucket.
   With 40 bands of 5, two sets with a similarity of 0.8 share none with a
   probability of 1.2e-7.
4. Buckets are worked off without making all pairs. The smallest id of a bucket
   leads it and is compared with the members; documents found linked are one
   component. Pairs whose signatures are clearly too far apart (6 standard
   deviations) fall out, the others are confirmed on the full sets, made from
   words. A bucket whose members are in one component is done.
5. In the other buckets the documents outside the largest component are compared
   with everyone there, part by part (see ``_arenas``), again on the full sets.
   After that every pair of documents that share a bucket has been compared or
   is in one component.

Cases: documents without words (NULL, empty, blanks) are linked with nothing,
shingle count 0. With fewer words than a shingle has, the whole sequence is the
one shingle. Rows that share an id are one document and have the links of all
its rows. Rows with a NULL id form no group: component NULL, kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gradeframe.llm.common import mix, parts, staged, starts_of, trimmed, within, word_hashes
from gradeframe.llm.components import components

_GAMMA = np.uint64(0x9E3779B97F4A7C15)
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 400_000  # bytes of text


@dataclass(frozen=True)
class NearDedup:
    """Link two documents if ``of * shared >= least * united`` over their shingle sets."""

    shingle_words: int = 5
    least: int = 80
    of: int = 100
    bands: int = 40
    band_rows: int = 5
    # Limits of one part of an arena: shingles of its members, documents compared with them.
    part_shingles: int = 500_000
    part_queries: int = 256

    @property
    def registers(self) -> int:
        return self.bands * self.band_rows

    @property
    def least_estimate(self) -> float:
        share = self.least / self.of
        return max(0.0, share - 6 * math.sqrt(share * (1 - share) / self.registers))


def word_list(text: bytes) -> list[bytes]:
    """Words with A-Z in lower case."""
    return text.lower().split()


def shingle_set(text: bytes, size: int) -> frozenset:
    """The distinct shingles themselves, as tuples of words."""
    words = word_list(text)
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*[words[i:] for i in range(size)]))


def shingle_hashes(words: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, count per text) of the distinct shingles, sorted within each text."""
    counts = np.array([len(w) for w in words], np.int64)
    flat = word_hashes([w for part in words for w in part])
    pos, left = within(counts), np.repeat(counts, counts)
    with np.errstate(over="ignore"):
        acc = flat.copy()
        for step in range(1, size):
            there = pos + step < left
            at = np.flatnonzero(there)
            acc[at] = acc[at] * _FACTOR + flat[at + step]
    starts = (pos + size <= left) | ((pos == 0) & (left < size))
    text = np.repeat(np.arange(len(words)), counts)[starts]
    values = mix(acc[starts])
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[first], np.bincount(text[first], minlength=len(words))


def super_minhash(elements: np.ndarray, counts: np.ndarray, registers: int) -> np.ndarray:
    """Registers of each set, as rank << 32 | r; ``elements`` has the sets one after the other."""
    owner = np.repeat(np.arange(len(counts)), counts)
    table = np.full(len(counts) * registers, np.iinfo(np.uint64).max, np.uint64)
    order = None
    for rank in range(registers):
        with np.errstate(over="ignore"):
            draw = mix(elements + np.uint64(rank + 1) * _GAMMA)
        low = draw & np.uint64(0xFFFFFFFF)
        place = rank + ((low * np.uint64(registers - rank)) >> np.uint64(32)).astype(np.int64)
        value = (draw >> np.uint64(32)) | np.uint64(rank << 32)
        if order is None:
            register = place
        else:
            rows = np.arange(len(elements))
            register = order[rows, place].astype(np.int64)
            order[rows, place] = order[:, rank]
        np.minimum.at(table, owner * registers + register, value)
        open_sets = (table.reshape(len(counts), registers).max(axis=1) == np.iinfo(np.uint64).max) & (counts > 0)
        if not open_sets.any():
            break
        # Only elements of sets with unfilled registers go on.
        stay = open_sets[owner]
        if order is None:
            order = np.tile(np.arange(registers, dtype=np.uint16), (int(stay.sum()), 1))
            order[np.arange(len(order)), place[stay]] = 0
        elif not stay.all():
            order = order[stay]
        elements, owner = elements[stay], owner[stay]
    return table.reshape(len(counts), registers)


def _sketch(job: NearDedup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, texts in parts(batch.column(1), _CHUNK):
                elements, counts = shingle_hashes([word_list(t) for t in texts], job.shingle_words)
                table = mix(super_minhash(elements, counts, job.registers))
                at = starts_of(counts)
                digests = [xxhash.xxh3_128_digest(elements[i:j].tobytes()) for i, j in zip(at[:-1], at[1:])]
                keys = np.zeros((len(counts), job.bands), np.uint64)
                with np.errstate(over="ignore"):
                    keys += np.arange(1, job.bands + 1, dtype=np.uint64) * _GAMMA
                    for row in range(job.band_rows):
                        keys = mix(keys * _FACTOR + table[:, row::job.band_rows])
                offsets = pa.array(np.arange(len(counts) + 1, dtype=np.int32) * job.bands)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, end - start), pa.array(counts, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array([r.tobytes() for r in table.astype(np.uint8)], pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel())),
                ], ["id", "n", "digest", "signature", "bands"])
        trimmed()

    return run


def _estimate(job: NearDedup):
    @F.arrow_udf("double")
    def share(a: pa.Array, b: pa.Array) -> pa.Array:
        left = np.frombuffer(b"".join(a.to_pylist()), np.uint8).reshape(-1, job.registers)
        right = np.frombuffer(b"".join(b.to_pylist()), np.uint8).reshape(-1, job.registers)
        # One byte of each register is kept; unlike registers agree on it one time in 256.
        return pa.array(((left == right).mean(axis=1) - 1 / 256) / (1 - 1 / 256))

    return share


def _verify(job: NearDedup):
    @F.arrow_udf("boolean")
    def linked(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last, known = None, frozenset()
        for lefts, rights in texts:
            out = []
            for start, end, some in parts(rights, 4_000_000):
                own = lefts.slice(start, end - start).cast(pa.binary())
                for a, b in zip(own, some):
                    a = a.as_py() or b""
                    if a != last or last is None:
                        last, known = a, shingle_set(a, job.shingle_words)
                    other = shingle_set(b, job.shingle_words)
                    shared = len(known & other)
                    united = len(known) + len(other) - shared
                    out.append(united > 0 and job.of * shared >= job.least * united)
            yield pa.array(out, pa.bool_())
        trimmed()

    return linked


def _pairs_estimated(pairs: DataFrame, reps: DataFrame, job: NearDedup) -> DataFrame:
    """Pairs (a, b) whose signatures do not rule a link out, with the estimate."""
    left = reps.select(F.col("id").alias("a"), F.col("signature").alias("sa"), F.col("n").alias("na"))
    right = reps.select(F.col("id").alias("b"), F.col("signature").alias("sb"), F.col("n").alias("nb"))
    near = pairs.join(right, "b").join(left, "a") \
        .where(job.of * F.least("na", "nb") >= job.least * F.greatest("na", "nb"))
    return staged(near.select("a", "b", _estimate(job)("sa", "sb").alias("estimate"))
                  .where(F.col("estimate") >= job.least_estimate), "pairs")


def _confirmed(pairs: DataFrame, texts: DataFrame, job: NearDedup) -> DataFrame:
    """The pairs (a, b) that are links on their full sets."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a")
    return both.where(_verify(job)("ta", "tb")).select("a", "b").distinct()


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components, with both roots."""
    ra = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    rb = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    joined = pairs.join(ra, "a", "left").join(rb, "b", "left")
    return joined.select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")).where("ra != rb")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots after links (a, b) between old roots."""
    above = staged(components(links), "above")
    moved = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left") \
        .select("node", F.coalesce("top", "root").alias("root"))
    return staged(moved.unionByName(above.join(roots, "node", "left_anti")), "roots")


def _arena_links(job: NearDedup):
    """Links between components among the queries and members of one part of an arena, on their full sets."""

    def run(part: pa.Table) -> pa.Table:
        texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
        asks = np.array(part.column("asks").to_pylist(), bool)
        roots = part.column("root").to_pylist()
        elements, counts = shingle_hashes([word_list(t) for t in texts], job.shingle_words)
        at = starts_of(counts)
        queries, members = np.flatnonzero(asks), np.flatnonzero(~asks & (counts > 0))
        found: set = set()
        if len(members):
            held = np.concatenate([elements[at[m]:at[m + 1]] for m in members])
            names, place = np.unique(held, return_inverse=True)
            begin, sizes = starts_of(counts[members])[:-1], counts[members]
            for q in queries:
                own = elements[at[q]:at[q + 1]]
                spot = np.minimum(np.searchsorted(names, own), len(names) - 1)
                mark = np.zeros(len(names), np.int32)
                mark[spot[names[spot] == own]] = 1
                shared = np.add.reduceat(mark[place], begin)
                hits = members[job.of * shared >= job.least * (counts[q] + sizes - shared)]
                found |= {(roots[q], r) for r in {roots[m] for m in hits} if r != roots[q]}
        trimmed()
        kind = part.schema.field("root").type
        return pa.table({"a": pa.array([f[0] for f in found], kind), "b": pa.array([f[1] for f in found], kind)})

    return run


def _arenas(named: DataFrame, roots: DataFrame, reps: DataFrame, texts: DataFrame, job: NearDedup) -> DataFrame:
    """Links (a, b) between the roots of components that share a bucket.

    The component with most members in a bucket is its hub. All of the hub's
    documents and all outsiders of its buckets meet in one arena, where every
    outsider is compared with everyone. Large arenas are cut into parts by
    members and by outsiders; what leaves a part is a link per outsider and
    component, never the pairs compared.
    """
    sizes = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    hubs = sizes.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("hub"))
    outside = staged(named.join(staged(hubs, "hubs"), "key").where("root != hub").select("hub", "id", "root").distinct(),
                     "outside")
    own = outside.select("hub").distinct()
    inside = roots.select(F.col("root").alias("hub"), F.col("node").alias("id")).unionByName(
        own.join(roots, F.col("hub") == F.col("node"), "left_anti").select("hub", F.col("hub").alias("id")))
    inside = inside.join(own, "hub", "left_semi").select("hub", "id", F.col("hub").alias("root"), F.lit(False).alias("asks"))
    everyone = outside.withColumn("asks", F.lit(True)).unionByName(inside).join(reps.select("id", "n"), "id")
    everyone = staged(everyone, "arena")
    shape = everyone.groupBy("hub").agg(
        (F.floor(F.sum("n") / job.part_shingles) + 1).cast("int").alias("blocks"),
        (F.floor(F.sum(F.col("asks").cast("int")) / job.part_queries) + 1).cast("int").alias("turns"))
    everyone = everyone.join(staged(shape, "shape"), "hub")
    members = everyone.select(
        "hub", "id", "root", F.lit(False).alias("asks"), F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
    queries = everyone.where("asks").select(
        "hub", "id", "root", "asks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("id", F.lit(1)), "turns").cast("int").alias("turn"))
    id_type = named.schema["id"].dataType.simpleString()
    return members.unionByName(queries).join(texts, "id").groupBy("hub", "block", "turn").applyInArrow(
        _arena_links(job), f"a {id_type}, b {id_type}")


def _links(members: DataFrame, reps: DataFrame, texts: DataFrame, job: NearDedup) -> DataFrame:
    """(node, root) of the components over all buckets: members have key, id and the key's smallest id."""
    led = members.where("id != leader")
    near = _pairs_estimated(led.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), reps, job)
    # The likeliest pair of each document first: most others then lie within a component.
    first = near.groupBy("b").agg(F.max_by("a", "estimate").alias("a"))
    # Links are written before they are grouped, so that no task needs two Python workers at a time.
    roots = staged(components(staged(_confirmed(first, texts, job), "links")), "roots")
    rest = staged(_rooted(near, roots), "rest")
    if not rest.isEmpty():
        links = _confirmed(rest, texts, job).join(rest, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        roots = _merged(roots, staged(links, "links"))
    # Buckets that still hold more than one component, apart from the leader, which has met everyone.
    named = led.join(roots.withColumnRenamed("node", "id"), "id", "left") \
        .select("key", "id", F.coalesce("root", "id").alias("root"))
    several = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    named = staged(named.join(several.select("key"), "key", "left_semi"), "unresolved")
    if not named.isEmpty():
        roots = _merged(roots, staged(_arenas(named, roots, reps, texts, job), "links"))
    return roots


def near_duplicates(
    docs: DataFrame, job: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id, n_shingles, component_id (smallest id of the group) and kept, one row per row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    sketches = staged(rows.mapInArrow(
        _sketch(job), f"id {id_type}, n long, digest binary, signature binary, bands array<long>"), "sketches")
    named = sketches.where("n > 0 and id is not null")
    classes = staged(named.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    reps = sketches.join(classes.select("digest", F.col("rep").alias("id")), ["digest", "id"], "left_semi")
    # One row where rows repeat; a class has one signature.
    reps = staged(reps.select("id", "digest", "n", "signature", "bands").dropDuplicates(["id", "digest"]), "reps")
    buckets = reps.select(F.explode("bands").alias("key"), "id")
    shared = buckets.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("high")) \
        .where("leader != high").select("key", "leader")
    members = staged(buckets.join(staged(shared, "shared"), "key").distinct(), "members")
    wanted = staged(members.select("id").distinct(), "wanted")
    texts = staged(rows.join(wanted, "id", "left_semi"), "texts")
    roots = _links(members, reps, texts, job)
    rooted = classes.join(roots, classes["rep"] == roots["node"], "left") \
        .select("digest", F.coalesce("root", "rep").alias("root"))
    rooted = staged(rooted, "rooted")
    out = sketches.select("id", "n", "digest").join(rooted, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("id")))
    out = out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(
    docs: DataFrame, job: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row of each group of near duplicates, with all its columns.

    What is looked up are the ids that go, which are fewer than those that stay.
    An id with several rows stays if one of them is kept, with the row whose text
    has the least hash (of equal texts the least row as JSON). Rows with a NULL id all stay.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    found = near_duplicates(docs, job, id_col, text_col).where(F.col(id_col).isNotNull())
    special = found.groupBy(F.col(id_col).alias("id")).agg(
        F.bool_or("kept").alias("stays"), (F.count(F.lit(1)) > 1).alias("several")).where("several or not stays")
    special = staged(special, "special")
    plain = docs.toDF(*names)
    single = plain.join(special.select("id"), key == F.col("id"), "left_anti")
    again = plain.join(special.where("several and stays").select("id"), key == F.col("id"), "left_semi")
    least = F.min_by(F.struct(*names), F.struct(F.xxhash64(text), text, F.to_json(F.struct(*names))))
    again = again.groupBy(key.alias("id")).agg(least.alias("row")).select("row.*")
    return single.unionByName(again).select(*names).toDF(*docs.columns)
