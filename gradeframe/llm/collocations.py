"""Phrase collocations per language by dynamic itemset counting.

The texts are dealt to shards, which are scanned in a cycle. Words are counted
from the first scan on. As soon as both subphrases of a phrase (without its last
and without its first word) have reached the threshold in what was counted so
far, the phrase is activated, and it is counted from the next scan on for one
full cycle, whatever shard that starts with. So lengths are interleaved: common
pairs are counted while the words are not complete yet. The scans end a cycle
after the last activation.

A scan is a vectorised pass over bytes (lower case and separators by a lookup
table, words as dictionary codes, phrases as tuples of codes), which gives phrases
and counts per window of text; Spark adds them up. Words travel as text with a 64-bit hash,
phrases as the hashes of their words, which get their text back from the frequent words at the end.
That is exact, for the first cycle has every word: if two share a hash, counting starts anew under
another seed. The counts so far are one table dealt out by phrase; a scan's counts come to it without moving it, and
phrases that completed their cycle below the threshold leave it. Which phrases
reached the threshold, and in which scan, is told to the tasks by a table of
``filter_slots`` bytes, two per phrase, however large the corpus. A phrase that
falls on foreign slots is activated too early, which costs work and changes no
result: activation is the same for all tasks, every phrase with
enough occurrences is activated, and each is counted for exactly one cycle.

A candidate is scored by its weakest cut: count squared over the product of the
counts of both sides, in exact decimals. Candidates that lie in a longer one with
at least ``covered_percent`` of their count are dropped.

Cases: a NULL text is empty, a NULL language is ``und``. Empty texts and pieces
have no words. Very long texts are cut between pieces. Repeated rows count each.
Equal scores (after rounding down) go by count, then by the bytes of the phrase.
An empty table gives no rows. Only the two columns named are read, so other
columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gradeframe.llm.common import bucketed, remove, scratch, staged, starts_of, trimmed

NO_LANGUAGE = "und"
# A separator of pieces, a separator of words, and all else.
_PIECE, _BLANK, _WORD = 2, 1, 0
_NEVER = 255
_RANK_PARTS = 32
# Places of a window that are hashed at a time.
_PLACES = 1 << 17
# Slots in one of Spark's bitmaps.
_BITMAP = 1 << 15
_SEED = 42  # of Spark's xxhash64
# The five constants of XXH64.
_PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


@dataclass(frozen=True)
class Collocations:
    least: int = 10
    most_words: int = 3
    covered_percent: int = 50
    per_language: int = 2000
    # Parts of the corpus that are scanned in turn.
    shards: int = 4
    # Bytes of the table that tells the tasks what has reached the threshold; a power of two.
    filter_slots: int = 1 << 24
    window_bytes: int = 8 << 20

    def __post_init__(self):
        if self.least < 1 or self.most_words < 2 or not 1 <= self.shards * (self.most_words + 1) < _NEVER:
            raise ValueError("least is at least 1, most_words at least 2, and all scans must have numbers below 255")
        if self.filter_slots < 1 << 15 or self.filter_slots & (self.filter_slots - 1):
            raise ValueError("filter_slots is a power of two, at least 32768")


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    lower, kind = np.arange(256, dtype=np.uint8), np.full(256, _WORD, np.uint8)
    lower[ord("A"):ord("Z") + 1] += 32
    kind[list(b" \t")] = _BLANK
    kind[list(b".,;:!?\n\x0b\x0c\r")] = _PIECE
    return lower, kind


_LOWER, _KIND = _byte_tables()


def _windows(texts: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, end of each text within them) of stretches of about ``most`` bytes.

    A stretch ends with a text or at a separator of pieces; a text that is cut
    goes on in the next stretch. Every stretch names the ends of all texts,
    those outside of it at its first or after its last byte.
    """
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    start, last = int(ends[0]), int(ends[-1])
    while start < last:
        stop = min(start + most, last)
        while stop < last:
            following = np.flatnonzero(_KIND[data[stop:stop + most]] == _PIECE)
            text_end = ends[np.searchsorted(ends, stop)]
            cut = min(text_end, stop + following[0]) if len(following) else min(text_end, stop + most)
            stop = int(cut)
            if len(following) or cut == text_end:
                break
        yield data[start:stop], np.clip(ends[1:], start, stop) - start
        start = stop


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words in lower case, the number of the piece and of the text of each."""
    kind = _KIND[data]
    inside = kind == _WORD
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    # A word begins after a separator or at the beginning of a text, and ends before the next one's.
    begins, after = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    after[:-1] &= ~inside[1:] | edge[1:-1]
    pieces = np.flatnonzero(kind == _PIECE).astype(np.int32)
    at, last = np.flatnonzero(begins).astype(np.int32), np.flatnonzero(after).astype(np.int32)
    letters = _LOWER[data[inside]]
    del kind, inside, edge, begins, after
    offsets = starts_of(last + 1 - at)
    del last
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    # Numbers of places fit 32 bits: a window has some MB, a text at most 2 GB.
    text = np.searchsorted(ends.astype(np.int32), at, side="right").astype(np.int32)
    # Pieces end at separators and with their text.
    return words, np.searchsorted(pieces, at).astype(np.int32) + text, text


def _slots_of(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two slots of each phrase."""
    mask = np.uint64(size - 1)
    return (hashes & mask).astype(np.int64), (hashes >> np.uint64(32) & mask).astype(np.int64)


def _first_scans(hashes: np.ndarray, reached: np.ndarray) -> np.ndarray:
    """The scan after which each phrase counts as frequent: never too late, seldom too early."""
    low, high = _slots_of(hashes, len(reached))
    return np.maximum(reached[low], reached[high])


def _tallied(columns: Sequence[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct tuples of word ids below ``size``, their counts, and a row of each."""
    ids = columns[0]
    for column in columns[1:]:
        both = ids.astype(np.int64)
        both *= size
        both += column
        # Only the codes outlive a step: its keys and their dictionary are as large as a window's words.
        ids = np.asarray(pa.array(both).dictionary_encode().indices)
    counts = np.bincount(ids)
    row = np.empty(len(counts), np.int32)
    row[ids] = np.arange(len(ids), dtype=np.int32)
    return [column[row] for column in columns], counts, row


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def chained_hash(before: np.ndarray | np.uint64, value: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 makes of a long after what it made of the columns before it."""
    with np.errstate(over="ignore"):
        x = before + _PRIMES[4] + np.uint64(8)
        x = x ^ _rotated(value * _PRIMES[1], 31) * _PRIMES[0]
        x = _rotated(x, 27) * _PRIMES[0] + _PRIMES[3]
        x = (x ^ x >> np.uint64(33)) * _PRIMES[1]
        x = (x ^ x >> np.uint64(29)) * _PRIMES[2]
        return x ^ x >> np.uint64(32)


def _phrases(job: Collocations, data: np.ndarray, ends: np.ndarray, langs: pa.Array, scan: int, reached: np.ndarray, seed: int
             ) -> Iterator[tuple[list[np.ndarray], pa.Array | None, np.ndarray, np.ndarray]]:
    """(hashes of the words, text of single words, first scans, counts) of the active phrases of a window, length by length.

    The first has no hash: the number of words of each language.
    """
    words, piece, text = _words(data, ends)
    if not len(words):
        return
    spoken = langs.dictionary_encode()
    names = spoken.dictionary.cast(pa.large_binary())
    coded = words.dictionary_encode()
    size = len(coded.dictionary)
    # Words of a language, numbered from 0.
    codes = np.asarray(spoken.indices)[text].astype(np.int64) * size + np.asarray(coded.indices)
    counts = np.bincount(codes)
    present = np.flatnonzero(counts)
    number = np.zeros(len(counts), np.int32)
    number[present] = np.arange(len(present))
    ids, counts = number[codes], counts[present]
    del words, text, codes, number
    line = pa.scalar(b"\n", pa.large_binary())
    keys = pc.binary_join_element_wise(names.take(pa.array(present // size)), coded.dictionary.take(pa.array(present % size)), line)
    hashes = np.fromiter((xxhash.xxh64_intdigest(k, seed) for k in keys.to_pylist()), np.uint64, len(keys))
    if scan < job.shards:
        here, rows = np.unique(present // size, return_inverse=True)
        totals = pc.binary_join_element_wise(names.take(pa.array(here)), pa.scalar(b"", pa.large_binary()), line)
        yield [], totals, np.zeros(len(here), np.int64), np.bincount(rows, counts).astype(np.int64)
        yield [hashes], keys, np.zeros(len(keys), np.int64), counts
    # For phrases of one length: where they begin, their hash, and since when they are frequent.
    single = chained_hash(np.uint64(_SEED), hashes)
    place, here, since = np.arange(len(ids), dtype=np.int32), single[ids], _first_scans(single, reached)[ids].astype(np.int16)
    del keys, coded, counts, present
    for length in range(2, job.most_words + 1):
        known = since < scan
        follows = np.flatnonzero(known[:-1] & known[1:] & (np.diff(place) == 1)
                                 & (piece[place[:-1]] == piece[np.minimum(place[:-1] + length - 1, len(piece) - 1)])).astype(np.int32)
        del known
        if not len(follows):
            return
        # Scans have numbers below 255.
        starts = 1 + np.maximum(since[follows], since[follows + 1])
        place = place[follows]
        if length < job.most_words:
            here = here[follows]
        del follows
        active = np.flatnonzero(starts + job.shards > scan).astype(np.int32)
        if len(active):
            tuples, counts, row = _tallied([ids[place[active] + i] for i in range(length)], len(hashes))
            first = starts[active[row]]
            del active, row
            yield [hashes[column] for column in tuples], None, first, counts
            del tuples, counts, first
        if length < job.most_words:
            since = np.empty(len(place), np.int16)
            for at in range(0, len(place), _PLACES):
                part = slice(at, at + _PLACES)
                here[part] = chained_hash(here[part], hashes[ids[place[part] + length - 1]])
                # Not before it was counted: foreign marks may be older than its own words' are.
                since[part] = np.maximum(_first_scans(here[part], reached), starts[part])


def _scan(job: Collocations, scan: int, reached, seed: int):
    """Batches of (lang, text) to (k1, k2, ..., word, start, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.frombuffer(reached.value, np.uint8)
        for batch in batches:
            langs = batch.column(0).cast(pa.large_binary())
            for data, ends in _windows(batch.column(1), job.window_bytes):
                for hashes, words, starts, counts in _phrases(job, data, ends, langs, scan, slots, seed):
                    for at in range(0, len(counts), 50_000):
                        part = slice(at, at + 50_000)
                        size = len(counts[part])
                        columns = [pa.array(h[part].view(np.int64)) for h in hashes]
                        columns += [pa.nulls(size, pa.int64())] * (job.most_words - len(hashes))
                        word = pa.nulls(size, pa.string()) if words is None else words.slice(at, 50_000).cast(pa.string())
                        yield pa.RecordBatch.from_arrays(
                            [*columns, word, pa.array(starts[part].astype(np.int32)), pa.array(counts[part].astype(np.int64))],
                            [*_hash_names(job), "word", "start", "n"])
        trimmed()

    return run


def _hash_names(job: Collocations) -> list[str]:
    return [f"k{i}" for i in range(1, job.most_words + 1)]


def _bitmaps(size: int):
    """Batches of hashes to (part, bits): the marked ones of ``size`` slots, a bitmap for each part that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, bool)
        for batch in batches:
            for slots in _slots_of(np.asarray(batch.column(0)).view(np.uint64), size):
                held[slots] = True
        bits = np.packbits(held, bitorder="little").reshape(-1, _BITMAP // 8)
        del held
        parts = np.flatnonzero(bits.any(axis=1))
        for at in range(0, len(parts), 64):
            some = parts[at:at + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array([bits[p].tobytes() for p in some], pa.binary())], ["part", "bits"])
        trimmed()

    return run


def _mark(reached: np.ndarray, found: DataFrame, names: list[str], scan: int) -> bool:
    """Enter phrases that have reached the threshold after a scan; False if the table has all of them.

    What comes to the driver is a bitmap of the slots, 1/8 of the table at most.
    """
    # Hashes that are not there (of shorter phrases) leave the hash as it is.
    hashed = found.select(F.xxhash64(*names).alias("h"))
    # A task gives the bitmap of its phrases, whatever their number.
    bits = hashed.mapInArrow(_bitmaps(len(reached)), "part int, bits binary").groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits"))
    entered = False
    for row in bits.collect():
        marked = np.flatnonzero(np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")) + row["part"] * _BITMAP
        entered |= bool((reached[marked] > scan).any())
        reached[marked] = np.minimum(reached[marked], scan)
    return entered


def _dealt(docs: DataFrame, job: Collocations, text_col: str, lang_col: str) -> tuple[DataFrame, str]:
    """The texts, dealt to shards row by row, and their folder."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
                       F.col(text_col).alias("text")).where(F.length("text") > 0)
    path = scratch(docs.sparkSession, "shards")
    rows.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(job.shards)).cast("int")) \
        .write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema("lang string, text string, shard int").parquet(path), path


def _counted(shards: DataFrame, job: Collocations, seed: int) -> DataFrame | None:
    """k1, k2, ..., word, start, n after all scans; None if two words share a hash under this seed."""
    spark: SparkSession = shards.sparkSession
    tasks, names = int(spark.conf.get("spark.sql.shuffle.partitions")), _hash_names(job)
    key = [*names, "word"]
    schema = ", ".join([*[f"{n} long" for n in names], "word string", "start int", "n long"])
    reached = np.full(job.filter_slots, _NEVER, np.uint8)
    state, state_path, scan, last = None, None, 0, 0
    # Behind foreign marks each length may begin one scan after the one before it, without a new mark.
    while scan < job.shards or scan <= last + job.shards + job.most_words - 2:
        told = spark.sparkContext.broadcast(reached.tobytes())
        here = shards.where(F.col("shard") == scan % job.shards).select("lang", "text")
        # Counts per window are dealt out by phrase as the counts so far are; there both are added up.
        counted = here.mapInArrow(_scan(job, scan, told, seed), schema).repartition(tasks, *key)
        if state is not None:
            counted = state.unionByName(counted)
        counted = counted.groupBy(*key).agg(F.max("start").alias("start"), F.sum("n").alias("n"))
        # Words stay until all of them have been compared.
        under_way = (F.col("start") + job.shards - 1 > scan) | (F.col("word").isNotNull() & (scan < job.shards))
        counted = counted.where((F.col("n") >= job.least) | under_way)
        old_path, state_path = state_path, scratch(spark, "phrases")
        state = bucketed(counted, key, "phrases", state_path)
        if old_path:
            remove(spark, old_path)
        if scan == job.shards - 1 and not state.where("k1 is not null and word is not null").groupBy("k1").count().where("count > 1").isEmpty():
            remove(spark, state_path)
            return None
        # What completed its cycle earlier was entered then.
        counting = F.col("k1").isNotNull() & F.col(names[-1]).isNull() & (F.col("start") + job.shards > scan)
        if _mark(reached, state.where((F.col("n") >= job.least) & counting), names, scan):
            last = scan
        told.destroy()
        scan += 1
    return state


def phrase_counts(docs: DataFrame, job: Collocations = Collocations(), text_col: str = "text", lang_col: str = "lang"
                  ) -> DataFrame:
    """lang, phrase, words, f of all phrases up to ``most_words`` with f of at least ``least``; words = 0: all words of the language."""
    shards, texts_path = _dealt(docs, job, text_col, lang_col)
    seed, state = 0, None
    while state is None:
        state, seed = _counted(shards, job, seed), seed + 1
    remove(docs.sparkSession, texts_path)
    found = state.where(F.col("n") >= job.least)
    # A language may hold a line break, a word cannot.
    single = found.where("word is not null").select(
        "k1", F.col("word").substr(F.lit(1), F.length("word") - F.length(F.substring_index("word", "\n", -1)) - 1).alias("lang"),
        F.substring_index("word", "\n", -1).alias("phrase"), F.col("n").alias("f"))
    phrases = found.where("word is null")
    for i, name in enumerate(_hash_names(job)):
        text = single.where("k1 is not null").select(F.col("k1").alias(name), F.col("phrase").alias(f"w{i}"), *([] if i else ["lang"]))
        phrases = phrases.join(text, name, "inner" if i < 2 else "left")
    parts = [f"w{i}" for i in range(job.most_words)]
    # What is not there is left out.
    phrases = phrases.select("lang", F.concat_ws(" ", *parts).alias("phrase"),
                             F.array_size(F.array_compact(F.array(*parts))).alias("words"), F.col("n").alias("f"))
    return single.select("lang", "phrase", F.col("k1").isNotNull().cast("int").alias("words"), "f").unionByName(phrases)


def _cuts(candidates: DataFrame, known: DataFrame, job: Collocations) -> DataFrame:
    """lang, phrase, a, l, r, score of each candidate's lowest-scoring cut."""
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    split = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "words", F.col("f").alias("a"), cut).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice(split, 1, F.col("k")), " ").alias("head"),
        F.array_join(F.slice(split, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("tail"))
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    score = F.expr("(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * cast(1000000 as decimal(7,0)))"
                   " div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))").cast("long")
    cuts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", score)
    best = F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k"))
    return cuts.groupBy("lang", "phrase").agg(best.alias("best")).select("lang", "phrase", "best.*")


def collocations(docs: DataFrame, job: Collocations = Collocations(), text_col: str = "text", lang_col: str = "lang"
                 ) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    known = staged(phrase_counts(docs, job, text_col, lang_col), "frequent")
    candidates = known.where("words > 1")
    # Shorter phrases within each candidate, by length and place.
    parts = F.explode(F.expr(
        "flatten(transform(sequence(2, words - 1), m -> transform(sequence(0, words - m), i -> array_join(slice(split(phrase, ' '), i + 1, m), ' '))))"))
    covering = candidates.where("words > 2").select("lang", parts.alias("phrase"), "f") \
        .groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    scored = _cuts(candidates, known, job).join(covering, ["lang", "phrase"], "left") \
        .where(F.coalesce(100 * F.col("longer") < job.covered_percent * F.col("a"), F.lit(True)))
    totals = known.where("words = 0").select("lang", F.col("f").alias("n"))
    # A language's best are among the best of its parts: the last step has a bounded number of rows of each.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(_RANK_PARTS))
    in_part, whole = Window.partitionBy("lang", "part").orderBy(*order), Window.partitionBy("lang").orderBy(*order)
    best = scored.withColumn("part", part).withColumn("rank", F.row_number().over(in_part)).where(F.col("rank") <= job.per_language)
    ranked = best.withColumn("rank", F.row_number().over(whole).cast("long")).where(F.col("rank") <= job.per_language)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
