"""CSV records that span lines, from files that are read in many tasks.

A line of a CSV file does not say whether it begins inside a quoted field. What a
block of lines does to that can be worked out for both cases without knowing
which holds: a block maps "outside" and "inside" to the state after its last
line. These maps are put one after the other per file, which gives every block
its state at the start, and then all blocks are cut into records at a time. What a
block begins or ends in the middle of, a few lines per block, is put together
afterwards.

The rules are those of Spark's own reader with ``"`` as quote and escape: a field
is quoted if it begins with a quote, a doubled quote stands for one, after a closing
quote everything up to the next comma or line end belongs to the field, and empty lines
are no records. (In fields with stray quotes Spark's own reader and its parser of single
records may differ in the value; where records begin and end they agree.) A file whose first line ends in CRLF has CRLF line ends; there
breaks within fields are read as LF. Files whose lines end in a bare CR are
not read this way (``split=False`` reads them).
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

cloudpickle.register_pickle_by_value(sys.modules["gradeframe"])

# The rest of a quoted field up to its closing quote, and what may follow that within the field.
_QUOTED = r'[^"]*(?:""[^"]*)*'
_CLOSED = _QUOTED + r'"(?!")[^,]*'
_FIELD = re.compile(r'"' + _CLOSED + r'(?:,|$)|[^",][^,]*(?:,|$)|,', re.S)
_REST = re.compile(_CLOSED + r'(?:,|$)', re.S)


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins inside or outside a quoted field ends inside of one."""
    at = 0
    if inside:
        rest = _REST.match(line)
        if not rest:
            return True
        at = rest.end()
    while at < len(line):
        field = _FIELD.match(line, at)
        # Only a quoted field that is not closed has no match.
        if not field:
            return True
        at = field.end()
    return False


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str], list[bool], bool]]:
    """(file and block, lines, whether they hold a quote, whether a block begins here) in the order of the file."""
    last = None
    for batch in batches:
        lines, files, starts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        quotes = pc.match_substring(lines, '"').to_pylist()
        places = list(zip(files.to_pylist(), starts))
        lines, at = lines.to_pylist(), 0
        while at < len(places):
            end = at + 1
            while end < len(places) and places[end] == places[at]:
                end += 1
            yield places[at], lines[at:end], quotes[at:end], places[at] != last
            last, at = places[at], end


def _state_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block the state after it for a begin outside and inside, and whether its first line ends in CR."""
    place, states, cr = None, [False, True], False

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([place[0]]), pa.array([place[1]], pa.int64()), pa.array([states[0]]), pa.array([states[1]]), pa.array([cr])],
            ["file", "block", "outside", "inside", "cr"])

    for here, lines, quotes, begins in _blocks(batches):
        if begins:
            if place is not None:
                yield row()
            place, states, cr = here, [False, True], lines[0].endswith("\r")
        for line, quoted in zip(lines, quotes):
            # A line without a quote changes nothing.
            if quoted:
                line = line.removesuffix("\r")
                after = {state: ends_inside(line, state) for state in set(states)}
                states = [after[state] for state in states]
    if place is not None:
        yield row()


def _records(inside_blocks: frozenset, cr_files: frozenset):
    """Cuts blocks into records. ``part``: 0 a whole record, 1 the beginning of one, 2 a stretch from within one, 3 the end of one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, int, int, str]] = []
        place, inside, held, from_before, number = None, False, [], False, 0

        def finish():
            # Lines that are left at the end of a block go on in the next, or the file ends.
            if held:
                rows.append((*place, number, 2 if from_before else 1, "\n".join(held)))

        def batch():
            columns = list(zip(*rows))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "block", "n", "part", "record"])
            rows.clear()
            return out

        for here, lines, quotes, begins in _blocks(batches):
            if begins:
                finish()
                place, number, held = here, 0, []
                inside = from_before = here in inside_blocks
            cr = here[0] in cr_files
            for line, quoted in zip(lines, quotes):
                bare = line.removesuffix("\r") if cr else line
                held.append(bare)
                if quoted:
                    inside = ends_inside(line.removesuffix("\r"), inside)
                if not inside:
                    record = "\n".join(held)
                    if record or from_before:
                        rows.append((*place, number, 3 if from_before else 0, record))
                        number += 1
                    held, from_before = [], False
            if len(rows) >= 4096:
                yield batch()
        finish()
        if rows:
            yield batch()

    return cut


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block, n and record (text) of all records of CSV files, header included.

    Records are ordered by block and n within a file. The files are read twice,
    block by block, in as many tasks as there are splits.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    maps = lines.mapInArrow(_state_maps, "file string, block long, outside boolean, inside boolean, cr boolean")
    # A row per block: the state before each, from the maps of all blocks before it.
    blocks = F.sort_array(F.collect_list(F.struct("block", "outside", "inside", "cr")))
    per_file = maps.groupBy("file").agg(blocks.alias("blocks"))
    start = F.struct(F.lit(False).alias("state"), F.array().cast("array<bigint>").alias("begin_inside"))
    walked = F.aggregate("blocks", start, lambda acc, b: F.struct(
        F.when(acc["state"], b["inside"]).otherwise(b["outside"]).alias("state"),
        F.when(acc["state"], F.concat(acc["begin_inside"], F.array(b["block"]))).otherwise(acc["begin_inside"]).alias("begin_inside")))
    found = per_file.select("file", walked["begin_inside"].alias("begin_inside"), F.get("blocks", F.lit(0))["cr"].alias("cr")) \
        .where("cr or size(begin_inside) > 0").collect()
    inside = frozenset((r["file"], b) for r in found for b in r["begin_inside"])
    parts = lines.mapInArrow(_records(inside, frozenset(r["file"] for r in found if r["cr"])),
                             "file string, block long, n long, part int, record string")
    # Parts of records: as many per file as it has blocks.
    order = Window.partitionBy("file").orderBy("block", "n")
    broken = parts.where("part > 0").withColumn("first", F.sum((F.col("part") == 1).cast("int")).over(order))
    joined = broken.groupBy("file", "first").agg(F.sort_array(F.collect_list(F.struct("block", "n", "record"))).alias("parts"))
    joined = joined.select("file", F.get("parts", F.lit(0))["block"].alias("block"), F.get("parts", F.lit(0))["n"].alias("n"),
                           F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    return parts.where("part = 0").select("file", "block", "n", "record").unionByName(joined.select("file", "block", "n", "record"))
