"""Lists that change over time against a walk through their events."""

import datetime
import random

from pyspark.sql import functions as F

from gradeframe.llm import url_filter as uf

DAY = datetime.date(2024, 1, 1)
EVENTS = "list string, kind string, value string, action string, at date"


def active(events, key, at):
    """Lists on which a key is active on a day, by replaying events day by day."""
    out = set()
    for name in {e[0] for e in events}:
        days = {}
        for e in events:
            if e[:3] == (name, *key) and e[4] is not None and e[4] <= at:
                days[e[4]] = days.get(e[4], True) and e[3] == "add"
        state = False
        for day in sorted(days):
            state = days[day]
        if state:
            out.add(name)
    return out


def test_matches_replayed_events(spark):
    rnd = random.Random(2)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "x.org", "com"]
    events = [(rnd.choice(["l1", "l2"]), "domain", rnd.choice(hosts), rnd.choice(["add", "remove"]),
               DAY + datetime.timedelta(rnd.randrange(30))) for _ in range(60)]
    events += [("l3", "url", "x.org/p/q", "add", DAY + datetime.timedelta(5)), ("l1", "domain", None, "add", DAY), ("l1", "domain", "x.org", "add", None)]
    captures = [(i, rnd.choice(["http://", "HTTPS://u:p@"]) + rnd.choice(["A.com", "b.a.com.", "c.b.a.com:80", "x.org", "y.net"])
                 + rnd.choice(["", "/p/q?x#y", "/z"]), rnd.randrange(30)) for i in range(150)]
    frame = spark.createDataFrame([(i, u, DAY + datetime.timedelta(d), "own") for i, u, d in captures],
                                  "page_id long, url string, day date, list string")
    got = uf.match(frame, uf.validity(spark.createDataFrame(events, EVENTS)), "page_id", "url", F.col("day")).collect()
    assert len(got) == 150
    for r in got:
        host = r.url.split("//")[1].split("@")[-1].split("/")[0].split(":")[0].lower().rstrip(".")
        labels = host.split(".")
        keys = [("domain", ".".join(labels[i:])) for i in range(len(labels))]
        path = r.url.split("//")[1].partition("/")[2].split("?")[0]
        keys.append(("url", host + ("/" + path if path else "")))
        hits = {k: active(events, k, r.fetched) for k in keys}
        assert r.n_lists == len(set().union(*hits.values())), r
        assert r.blocked == any(hits.values())
        if r.blocked:
            assert len(r.value) == max(len(k[1]) for k, on in hits.items() if on) and r.list in hits[r.kind, r.value]


def test_odd_rows(spark):
    events = [("l", "domain", "a.com", "add", DAY), ("l", "domain", "a.com", "add", DAY + datetime.timedelta(1)),
              ("l", "domain", "a.com", "remove", DAY + datetime.timedelta(2)), ("l", "domain", "b.com", "remove", DAY),
              ("l", "domain", "b.com", "add", DAY)]
    spans = uf.validity(spark.createDataFrame(events, EVENTS))
    assert [tuple(r) for r in spans.collect()] == [("l", "domain", "a.com", DAY, DAY + datetime.timedelta(2))]
    rows = [(1, None, DAY), (2, "", DAY), (3, "no url", DAY), (4, "http://a.com/" + "p" * 100_000, DAY), (4, "http://a.com/" + "p" * 100_000, DAY),
            (None, "http://a.com", DAY), (5, "http://a.com", None), (6, "http:///x", DAY), (7, "http://a.com", DAY + datetime.timedelta(2))]
    frame = spark.createDataFrame(rows, "page_id long, url string, day date")
    got = uf.match(frame, spans, "page_id", "url", F.col("day")).collect()
    assert sorted((str(r.page_id), r.blocked) for r in got) == sorted(
        [("1", False), ("2", False), ("3", False), ("4", True), ("4", True), ("None", True), ("5", False), ("6", False), ("7", False)])
    assert uf.match(frame.limit(0), spans, "page_id", "url", F.col("day")).collect() == []
    nothing = spark.createDataFrame([], EVENTS)
    assert not any(r.blocked for r in uf.match(frame, uf.validity(nothing), "page_id", "url", F.col("day")).collect())
