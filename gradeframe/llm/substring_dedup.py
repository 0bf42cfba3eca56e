"""Removal of passages that repeat from earlier documents, with a full-text index per shard.

A window is ``window_words`` consecutive words of one document. A word goes if
some window that covers it also starts in a document with a smaller id.

1. Each window has an anchor, the least hash of the runs of ``anchor_words``
   words in it. Equal windows have equal anchors, so runs of windows with one
   anchor (segments) can be looked at anchor by anchor. Anchors that occur in
   one document only fall out. In text that repeats itself (a run of one word) a
   segment would be as long as the run; it is cut into pieces of at most twice a window, counted
   from its beginning, so that runs of any lengths have the same few pieces.
2. Equal segments are reduced to the one with the smallest id before anything
   wide is moved. An anchor whose segments still hold more words than a shard
   is cut again, by the least hash under another seed, and at last by the hash of
   whole windows, of which equal ones are all that an anchor can have.
3. Segments go to shards by anchor. A shard builds a compressed FM-index over
   them and streams them through it: backward search over a wavelet matrix gives
   the matching statistics, and every window with a match of full length learns
   the smallest id among all rows of its suffix interval.
4. Stretches whose smallest id is below that of a document are that document's
   duplicate windows.

Words are compared as such; hashes only choose what is compared and name equal
segments (128 bits).

Cases: NULL and empty texts have no words. Texts shorter than a window keep all
their words. Rows that share an id are one document: they take nothing from each
other. Rows with a NULL id lose nothing and cause no removal. Repeats within one
document stay. Windows are judged on the input, not on what is left of it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.llm.common import bucketed, chunked, encoded, mix, parts, staged, starts_of, trimmed, within, word_hashes
from gradeframe.llm.fm_index import FMIndex

_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_CHUNK = 500_000  # bytes of text
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SEGMENTS = "start int, words int, anchor long, content long"


@dataclass(frozen=True)
class SubstringDedup:
    window_words: int = 50
    anchor_words: int = 8
    # Words of a shard, which one task indexes; some 400 bytes of memory each.
    shard_words: int = 300_000
    # Cuts of an anchor that stays too large; the last one goes by whole windows.
    most_cuts: int = 8


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` neighbours from each position on; shorter at the end."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        more = out.copy()
        more[:-step] = np.minimum(out[:-step], out[step:])
        out, have = more, have + step
    return out


def cut(hashes: np.ndarray, counts: np.ndarray, job: SubstringDedup, level: int):
    """Segments of pieces of text: (piece, start, words, anchor, content).

    ``hashes`` has the words of the pieces one after the other, ``counts`` their
    numbers. A segment is a longest run of windows with the same anchor, or a piece of it.
    """
    window = job.window_words
    gram_words = min(job.anchor_words, window) if level < job.most_cuts else window
    with np.errstate(over="ignore"):
        gram = hashes.copy()
        for step in range(1, gram_words):
            gram[:-step] = gram[:-step] * _FACTOR + hashes[step:] if step < len(gram) else gram[:-step]
        gram = mix(gram + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
        least = _sliding_least(gram, window - gram_words + 1)
        powers = np.full(len(hashes) + 1, _FACTOR, np.uint64)
        powers[:1] = 1
        powers = np.cumprod(powers)
        back = np.full(len(hashes) + 1, _INVERSE, np.uint64)
        back[:1] = 1
        back = np.cumprod(back)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes) * powers[:-1], dtype=np.uint64)))
    piece = np.repeat(np.arange(len(counts)), counts)
    base = starts_of(counts)
    at = np.flatnonzero(within(counts) + window <= np.repeat(counts, counts))
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (piece[at][1:] != piece[at][:-1]) | (least[at][1:] != least[at][:-1])
    first = np.flatnonzero(new)
    # Where no run of words comes twice within it, a segment has fewer windows than this.
    new |= within(np.diff(np.append(first, len(at)))) % (window + 1) == 0
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    start, end = at[first], at[last] + window
    with np.errstate(over="ignore"):
        content = mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
    return piece[start], start - base[piece[start]], end - start, least[start], content


def _segments(job: SubstringDedup, level: int):
    """Cut whole texts (level 0), or again the pieces (start, words, anchor) listed in a fourth column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in parts(batch.column(2), _CHUNK):
                pieces, row, offset, key = [], [], [], []
                for i in range(low, high):
                    words = texts[i - low].split()
                    for p in batch.column(3)[i].as_py() if level else ({"start": 0, "words": len(words), "anchor": 0},):
                        pieces.append(words[p["start"]:p["start"] + p["words"]])
                        row.append(i)
                        offset.append(p["start"])
                        key.append(p["anchor"])
                counts = np.array([len(p) for p in pieces], np.int64)
                piece, start, size, anchor, content = cut(
                    word_hashes([w for p in pieces for w in p]), counts, job, level)
                row, offset = np.array(row, np.int64)[piece], np.array(offset, np.int64)[piece]
                if level:
                    with np.errstate(over="ignore"):
                        anchor = mix(anchor + np.array(key, np.int64)[piece].view(np.uint64) * _FACTOR)
                where = pa.array(row)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(where), batch.column(1).take(where),
                    pa.array((start + offset).astype(np.int32)), pa.array(size.astype(np.int32)),
                    pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)),
                ], ["id", "row", "start", "words", "anchor", "content"])
        trimmed()

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the listed segments of each text."""
    for batch in batches:
        for low, high, texts in parts(batch.column(1), 2_000_000):
            out: list[tuple] = []
            for i in range(low, high):
                words = texts[i - low].split()
                out += [(i, p["anchor"], p["content"], b" ".join(words[p["start"]:p["start"] + p["words"]]))
                        for p in batch.column(2)[i].as_py()]
            for a, b in chunked([len(o[3]) for o in out], 8_000_000):
                part = out[a:b]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array([o[0] for o in part], pa.int64())),
                    pa.array([o[1] for o in part], pa.int64()), pa.array([o[2] for o in part], pa.int64()),
                    pa.array([o[3] for o in part], pa.binary()),
                ], ["id", "anchor", "content", "body"])


def _searched(job: SubstringDedup):
    """One shard: index its segments, stream them through, say which windows start in which smallest id."""

    def run(shard: pa.Table) -> pa.Table:
        bodies = [b.split() for b in shard.column("body").to_pylist()]
        sizes = np.array([len(b) for b in bodies], np.int64)
        codes, words = pd.factorize(np.array([w for b in bodies for w in b], dtype=object))
        symbols = codes.astype(np.int64) + 1
        starts = starts_of(sizes)
        del bodies, codes
        text = np.insert(symbols, starts[1:], 0)
        index = FMIndex(text, len(words) + 1, job.window_words)
        length, row = index.matching_statistics(symbols, starts)
        # Smallest id over each class of suffixes that share a whole window.
        ids = shard.column("id").combine_chunks()
        named = ids.dictionary_encode()
        names = named.dictionary.take(pa.compute.sort_indices(named.dictionary))
        place = np.empty(len(names), np.int64)
        place[pa.compute.sort_indices(named.dictionary).to_numpy()] = np.arange(len(names))
        owner = place[named.indices.to_numpy()]
        of, edges = index.classes(job.window_words)
        least = np.minimum.reduceat(np.repeat(owner, sizes + 1)[index.suffixes], edges[:-1])
        whole = np.flatnonzero(length >= job.window_words)
        segment = np.repeat(np.arange(len(sizes)), sizes)[whole]
        lowest = least[of[row[whole]]]
        new = np.ones(len(whole), bool)
        new[1:] = (segment[1:] != segment[:-1]) | (lowest[1:] != lowest[:-1]) | (whole[1:] != whole[:-1] + 1)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(whole)))
        segment, lowest, begin = segment[first], lowest[first], whole[first]
        at = pa.array(segment)
        del index, text, symbols, length, row, least, whole
        trimmed()
        return pa.table({
            "anchor": shard.column("anchor").take(at), "content": shard.column("content").take(at),
            "offset": pa.array((begin - starts[segment]).astype(np.int32)),
            "windows": pa.array(count.astype(np.int32)), "lowest": names.take(pa.array(lowest)),
        })

    return run


def _spread(segments: DataFrame) -> DataFrame:
    """The segments whose anchor occurs in more than one document."""
    shared = segments.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")) \
        .where("low != high").select("anchor")
    return segments.join(staged(shared, "shared"), "anchor", "left_semi").select(*segments.columns)


def _contents(segments: DataFrame) -> DataFrame:
    """One of equal segments, the one with the smallest id."""
    return segments.groupBy("anchor", "content").agg(F.min(F.struct("id", "row", "start", "words")).alias("s")) \
        .select("anchor", "content", "s.*")


def repeated_windows(rows: DataFrame, job: SubstringDedup) -> DataFrame:
    """(id, row, gone): for rows with repeats, the runs of windows that start in a smaller id.

    ``rows`` has id, row and text; ``row`` is a hash of the text, which tells
    rows that share an id apart.
    """
    rows = rows.where("id is not null and text is not null")
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, row long, {_SEGMENTS}"
    segments = _spread(staged(rows.mapInArrow(_segments(job, 0), schema), "segments"))
    parts: list[DataFrame] = []
    for level in range(1, job.most_cuts + 2):
        segments = staged(segments, "spread")
        contents = staged(_contents(segments), "contents")
        large = contents.groupBy("anchor").agg(F.sum("words").alias("n")).where(F.col("n") > job.shard_words)
        large = staged(large.select("anchor"), "large")
        # After the last cut an anchor has the windows of one content.
        if level > job.most_cuts or large.isEmpty():
            parts.append(segments)
            break
        parts.append(segments.join(large, "anchor", "left_anti").select(*segments.columns))
        hot = segments.join(large, "anchor", "left_semi")
        lists = hot.groupBy("id", "row").agg(F.collect_set(F.struct("start", "words", "anchor")).alias("pieces"))
        pieces = rows.join(staged(lists, "pieces"), ["id", "row"]).select("id", "row", "text", "pieces")
        segments = _spread(staged(pieces.mapInArrow(_segments(job, level), schema), "segments"))
    if len(parts) > 1:
        segments = parts[0]
        for part in parts[1:]:
            segments = segments.unionByName(part)
        contents = staged(_contents(segments), "contents")
    # The words of each different segment, from one text that has it.
    lists = contents.groupBy("id", "row").agg(F.collect_list(F.struct("anchor", "content", "start", "words")).alias("pieces"))
    bodies = rows.join(staged(lists, "lists"), ["id", "row"]).select("id", "text", "pieces") \
        .mapInArrow(_slices, f"id {id_type}, anchor long, content long, body binary")
    total = contents.agg(F.sum("words")).first()[0] or 0
    shards = int(total // job.shard_words) + 1
    found = bodies.withColumn("shard", F.pmod(F.col("anchor"), F.lit(shards))).groupBy("shard").applyInArrow(
        _searched(job), f"anchor long, content long, offset int, windows int, lowest {id_type}")
    found = staged(found.groupBy("anchor", "content").agg(
        F.collect_set(F.struct("offset", "windows", "lowest")).alias("runs")), "runs")
    # A document's own repeats: only runs that start in a smaller id.
    hits = segments.join(found, ["anchor", "content"])
    earlier = F.filter("runs", lambda r: r["lowest"] < F.col("id"))
    moved = F.transform(earlier, lambda r: F.struct((r["offset"] + F.col("start")).alias("at"), r["windows"].alias("windows")))
    gone = hits.select("id", "row", moved.alias("gone")).where(F.size("gone") > 0)
    return staged(gone.groupBy("id", "row").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")), "gone")


def _left(words: int, gone: list[dict], window: int) -> np.ndarray:
    """Which words stay."""
    edge = np.zeros(words + 1, np.int32)
    for run in gone:
        edge[run["at"]] += 1
        edge[run["at"] + run["windows"] + window - 1] -= 1
    return np.cumsum(edge[:-1]) == 0


def _joined(docs: DataFrame, job: SubstringDedup, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """docs under the names c0, c1, ... with the windows to remove as ``gone``.

    The texts are dealt out by id once; taking segments out of them and removing
    words from them both find them there.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    plain = bucketed(docs.toDF(*names).withColumn("row", F.xxhash64(text)), [key, "row"], "texts")
    gone = repeated_windows(plain.select(F.col(key).alias("id"), "row", F.col(text).alias("text")), job)
    return plain.join(gone.withColumnRenamed("id", key), [key, "row"], "left"), names


def _digest(window: int):
    @F.arrow_udf("n_words long, n_removed long, kept_sha256 string")
    def digest(texts: pa.Array, gone: pa.Array) -> pa.Array:
        total, removed, hashes = [], [], []
        for low, _, some in parts(texts, 4_000_000):
            for i, text in enumerate(some, low):
                words, runs = text.split(), gone[i].as_py()
                total.append(len(words))
                if runs:
                    words = [w for w, stay in zip(words, _left(len(words), runs, window)) if stay]
                removed.append(total[-1] - len(words))
                hashes.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pa.StructArray.from_arrays(
            [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(hashes, pa.string())],
            ["n_words", "n_removed", "kept_sha256"])

    return digest


def _without(window: int):
    @F.arrow_udf("string")
    def without(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for text, runs in zip(texts.to_pylist(), gone.to_pylist()):
            if runs and text:
                data = encoded([text])[0]
                spans = [m.span() for m in _WORD.finditer(data)]
                stay = _left(len(spans), runs, window)
                # A removed word goes with the blanks after it.
                ends = [s[0] for s in spans[1:]] + [len(data)]
                text = (data[:spans[0][0]] + b"".join(
                    data[s[0]:e] for s, e, keep in zip(spans, ends, stay) if keep)).decode("utf-8", "surrogatepass")
            out.append(text)
        return pa.array(out, pa.string())

    return without


def removal_report(
    docs: DataFrame, job: SubstringDedup = SubstringDedup(), id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id, n_words, n_removed and kept_sha256 (kept words joined by one space), one row per row."""
    rows, names = _joined(docs.select(id_col, text_col), job, id_col, text_col)
    return rows.select(F.col(names[0]).alias(id_col), _digest(job.window_words)(F.col(names[1]), F.col("gone")).alias("d")) \
        .select(id_col, "d.*")


def remove_repeats(
    docs: DataFrame, job: SubstringDedup = SubstringDedup(), id_col: str = "doc_id", text_col: str = "text",
    length_col: str | None = None,
) -> DataFrame:
    """docs with repeated passages taken out of the text; ``length_col`` is set to the new length of changed texts."""
    rows, names = _joined(docs, job, id_col, text_col)
    text = names[docs.columns.index(text_col)]
    rows = rows.withColumn(text, F.when(F.col("gone").isNull(), F.col(text)).otherwise(
        _without(job.window_words)(F.when(F.col("gone").isNotNull(), F.col(text)), F.col("gone"))))
    if length_col:
        length = names[docs.columns.index(length_col)]
        kind = rows.schema[length].dataType
        rows = rows.withColumn(length, F.when(F.col("gone").isNull(), F.col(length))
                               .otherwise(F.length(text).cast(kind)))
    return rows.select(*names).toDF(*docs.columns)
