"""Every registered query against its SQL on the same tables."""

import math
import os

import duckdb
import pytest

from workload.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 6) if isinstance(value, float) else value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    ours = sorted_rows(got.columns, got.collect())
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    theirs = sorted_rows(columns, cursor.fetchall())
    assert sorted(got.columns) == sorted(columns)
    assert ours, "no rows to compare"
    assert len(ours) == len(theirs)
    for mine, other in zip(ours, theirs):
        assert mine == other
        assert [type(v) for v in mine] == [type(v) for v in other]


def test_known_values_at_sf001(spark):
    """Figures that both engines give."""
    sf_dir = "/root/testdata/sf0.01"
    head = QUERIES["headline_metrics"](spark, sf_dir).first()
    assert (head.total_rows, head.refusal_rate, head.accuracy) == (1000, 0.444, round(313 / 556, 9))
    high = QUERIES["relevance_dist_overall"](spark, sf_dir).where("label_no = 0").first()
    assert high.n == 375
    assert high["mean"] == pytest.approx(0.300849068, abs=2e-9)
    assert high["std"] == pytest.approx(0.122495777, abs=2e-9)
    missing = QUERIES["metrics_table"](spark, sf_dir).where("section = 'refusal'").groupBy("scope").sum("n", "total").collect()
    totals = {r.scope: (r["sum(n)"], r["sum(total)"]) for r in missing}
    assert totals["overall"] == (444, 1000) and totals["group"] == (444 - 27, 1000 - 59)
