"""Archives: round trips, revisit resolution, odd payloads."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from gradeframe.llm import warc

LONG = "x" * 150
ROWS = [
    (1, "http://a/\r\nX: y", LONG), (2, None, LONG), (3, "u", "short"), (4, "u", "short"), (5, "u", None),
    (6, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9), (None, "u", LONG),
    (7, "u", LONG), (7, "u", LONG), (1, "q", LONG), (8, "é", "é\r\n\r\n" * 80), (9, "u", "y" * 3_000_000),
]


@pytest.fixture(scope="module")
def archives(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("warc")
    df = spark.createDataFrame([(*r, "no") for r in ROWS], "page_id long, url string, html string, digest string")
    a, b = f"file:{root}/a", f"file:{root}/b"
    warc.write_archives(df, a, "page_id", "url", "html", F.timestamp_seconds(F.lit(0)), records_per_file=3)
    warc.resolve_revisits(spark, a, b)
    return a, b, root


def test_archives_hold_what_was_written(spark, archives):
    got = {(r.row_id, bytes(r.payload)) for r in warc.read_records(spark, archives[0]).collect()}
    assert got == {(None if i is None else str(i), (html or "").encode()) for i, _, html in ROWS}


def test_revisits(spark, archives):
    got = sorted(((r.row_id, r.payload_bytes, r.record_type, r.refers_to)
                  for r in warc.resolved(warc.read_records(spark, archives[1], payloads=False)).collect()), key=str)
    want = []
    for i, _, html in ROWS:
        again = html == LONG and i != 1
        want.append((None if i is None else str(i), len((html or "").encode()), "revisit" if again else "response", "1" if again else None))
    assert got == sorted(want, key=str)


def test_resolving_twice_changes_nothing_and_references_hold(spark, archives):
    again = f"file:{archives[2]}/c"
    warc.resolve_revisits(spark, archives[1], again)
    first, second = ({(r.row_id, r.record_type, r.digest, r.refers_to_row) for r in warc.read_records(spark, p).collect()}
                     for p in (archives[1], again))
    assert first == second
    rows = warc.read_records(spark, again).collect()
    names = {r.record_id: r for r in rows}
    for r in rows:
        if r.record_type == "revisit":
            assert names[r.refers_to].row_id == r.refers_to_row and r.payload == b""


def test_parser_reads_plain_and_member_wise_archives():
    rnd, records = random.Random(1), []
    for i in range(40):
        block = bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 1, 5000, 70_000])))
        records.append(b"WARC/1.0\r\nWARC-Type: resource\r\nX-Row-ID: %d\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(block), block))
    for data in (b"".join(records), gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        got = list(warc._records(data))
        assert [int(f[b"x-row-id"]) for f, _ in got] == list(range(40))
        assert all(r.endswith(block + b"\r\n\r\n") for r, (_, block) in zip(records, got))
    with pytest.raises(ValueError, match="ends within"):
        list(warc._records(records[2][:-1000] + b"x"))


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(df, f"file:{tmp_path}/a", "page_id", "url", "html", F.timestamp_seconds(F.lit(0)))
    warc.resolve_revisits(spark, f"file:{tmp_path}/a", f"file:{tmp_path}/b")
    assert warc.resolved(warc.read_records(spark, f"file:{tmp_path}/b")).collect() == []
