"""CSV files with fields that span lines, read in many tasks, against the reader that takes one task per file."""

import csv
import random

import pytest
from hypothesis import given, settings, strategies as st

import gradeframe as gf
from gradeframe.sources.csv_records import ends_inside, read_records


@pytest.fixture(params=["40", "300", "134217728"])
def splits(spark, request):
    """Splits of some bytes, so that records and even fields span several of them."""
    keys = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def written(path, rows, end="\n", last_end=True, quoting=csv.QUOTE_MINIMAL):
    with open(path, "w", newline="", encoding="utf-8") as out:
        csv.writer(out, lineterminator=end, quoting=quoting).writerows(rows)
    if not last_end:
        text = path.read_bytes()
        path.write_bytes(text[:-len(end)])


def sample(seed, n=60):
    rnd = random.Random(seed)
    words = ["a", "", "x,y", 'he said "no"', '"', '""', "line\nbreak", "\n\n", "é😀", " b ", '{"Answer": "A",\n "x": [1]}', "NA", "long " * 30]
    return [["id", "a", "b"]] + [[str(i)] + [rnd.choice(words) + rnd.choice(["", "", rnd.choice(words)]) for _ in range(2)] for i in range(n)]


def shown(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("end,last_end,quoting", [("\n", True, csv.QUOTE_MINIMAL), ("\r\n", False, csv.QUOTE_MINIMAL), ("\n", False, csv.QUOTE_ALL)])
def test_equal_to_one_task_per_file(spark, tmp_path, splits, end, last_end, quoting):
    for n in range(3):
        written(tmp_path / f"{n}.csv", sample(n), end, last_end, quoting)
    got, want = (gf.read_table(spark, str(tmp_path), "csv", split=split) for split in (True, False))
    assert got.columns == want.columns and shown(got) == shown(want) and got.count() == 180
    kinds = {"id": "int"}
    assert shown(gf.read_items(spark, str(tmp_path), "csv", types=kinds)) == shown(gf.read_items(spark, str(tmp_path), "csv", types=kinds, split=False))


def test_one_file_makes_many_tasks(spark, tmp_path, splits):
    written(tmp_path / "a.csv", sample(1, 400))
    records = read_records(spark, str(tmp_path / "a.csv"))
    tasks = max(int(n) for n in [records.where("file is not null").rdd.getNumPartitions()])
    size = (tmp_path / "a.csv").stat().st_size
    assert tasks >= min(size // int(splits), 8)
    assert records.count() == 401
    first = records.where("block = 0 and n = 0").first()
    assert first["record"] == "id,a,b"


def test_short_and_long_rows_and_other_headers(spark, tmp_path, splits):
    (tmp_path / "short.csv").write_text('id,a,b\n1,"x\ny"\n\n2,p,q\n3,,\n')
    assert shown(gf.read_table(spark, str(tmp_path / "short.csv"), "csv")) == shown(gf.read_table(spark, str(tmp_path / "short.csv"), "csv", split=False))
    (tmp_path / "long.csv").write_text('id,a,b\n1,x,y\n2,p,"q\n",EXTRA\n')
    with pytest.raises(Exception, match="too many fields"):
        gf.read_table(spark, str(tmp_path / "long.csv"), "csv").collect()
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.csv").write_text("id,grp\n1,g\n")
    (tmp_path / "two" / "b.csv").write_text("grp,id\ng,2\n")
    with pytest.raises(Exception, match="header"):
        gf.read_table(spark, str(tmp_path / "two"), "csv").collect()
    (tmp_path / "none.csv").write_text("id,a\n")
    assert gf.read_table(spark, str(tmp_path / "none.csv"), "csv").collect() == []


def test_schema_with_types(spark, tmp_path, splits):
    (tmp_path / "t.csv").write_text('id,n,when\n1,10,"2024-01-01"\n2,,\n"3","7",2024-02-03\n')
    ddl = "id string, n int, when date"
    assert shown(gf.read_table(spark, str(tmp_path / "t.csv"), "csv", ddl)) == shown(gf.read_table(spark, str(tmp_path / "t.csv"), "csv", ddl, split=False))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(['"', '""', ",", "a", " ", "bc", '"x"', '","']), max_size=12).map("".join), st.booleans())
def test_state_of_a_line(line, inside):
    """Against a machine that goes character by character."""
    state, i = "quoted" if inside else "begin", 0
    while i < len(line):
        c = line[i]
        if state == "quoted":
            if c == '"':
                if line[i + 1:i + 2] == '"':
                    i += 1
                else:
                    state = "plain"
        elif c == ",":
            state = "begin"
        elif state == "begin" and c == '"':
            state = "quoted"
        else:
            state = "plain"
        i += 1
    assert ends_inside(line, inside) == (state == "quoted")


def test_lines_with_very_many_quotes():
    assert ends_inside('"' + 'a""' * 200_000, False) and not ends_inside('"' + 'a""' * 200_000 + '",x', False)
    assert not ends_inside(",".join(['"a"'] * 100_000), False)
