import datetime as dt
import random

import duckdb
import pytest

from cairn.llm import url_lists

D = "/root/testdata/sf0.01"


def test_query_matches_sql(spark):
    duckdb.sql(f"create or replace view pages as select * from '{D}/pages.parquet'")
    q = url_lists.op2_query(spark, D)
    want = duckdb.sql(url_lists.OP2_SQL)
    assert sorted(want.columns) == sorted(q.columns)
    got = sorted((tuple(str(r[c]).lower() for c in want.columns) for r in q.collect()))
    assert got == sorted(tuple(str(x).lower() for x in r) for r in want.fetchall())
    assert any("true" in r for r in got) and len(got) == 250


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


EVENTS = [
    ("block", "domain", "x.com", "add", day(10)), ("block", "domain", "x.com", "remove", day(20)), ("block", "domain", "x.com", "add", day(30)), ("block", "domain", "x.com", "add", day(40)),
    ("allow", "path", "a.x.com/ok/", "add", day(0)), ("block", "host", "y.com", "remove", day(1)), ("block", "host", "y.com", "add", day(5)), ("block", "host", "y.com", "remove", day(5)),
    ("block", "host", "z.com", "add", day(3)), ("block", "host", "z.com", "add", day(3)), ("block", None, "z.com", "add", day(3)), ("block", "host", "z.com", "remove", None),
]
CASES = [
    ("http://A.X.com:80/p", 10, True), ("http://a.x.com/p", 19, True), ("http://a.x.com/p", 20, False), ("https://x.com", 35, True), ("https://x.com", 9, False), ("http://notx.com", 15, False),
    ("http://a.x.com/ok/p?q", 15, False), ("http://a.x.com/ok", 15, True), ("http://user@x.com/#f", 12, True), ("http://y.com/", 6, False), ("http://z.com/", 3, True), ("http://w.z.com/", 9, False),
    (None, 5, False), ("not a url", 5, False), ("http://z.com/", None, False), ("http://z.com/" + "long/" * 3000, 4, True),
]


@pytest.mark.parametrize("most", [100_000, 0])
def test_intervals_specificity_and_odd_rows(spark, monkeypatch, most):
    monkeypatch.setattr(url_lists, "BROADCAST_ROWS", most)
    monkeypatch.setattr(url_lists, "HOT_ROWS", 1)
    events = spark.createDataFrame(EVENTS, "list string, kind string, key string, action string, day date")
    rows = [(i, u, None if n is None else day(n), "c", i) for i, (u, n, _) in enumerate(CASES)]
    rows += [rows[0]] * 3 + [(None, CASES[0][0], day(10), None, None)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched date, kind string, list int")
    got = url_lists.filter_urls(captures, events).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.blocked == CASES[r.page_id or 0][2], r
    assert url_lists.filter_urls(captures.limit(0), events).collect() == []
    assert not any(r.blocked or r.n_active for r in url_lists.filter_urls(captures, events.limit(0)).collect())


@pytest.mark.parametrize("span", [3, 400])
def test_as_of_by_brute_force(spark, monkeypatch, span):
    monkeypatch.setattr(url_lists, "SPAN_DAYS", span)
    rng = random.Random(span)
    events = [(rng.choice(["block", "allow", "other"]), "host", rng.choice(["a", "b", "c"]), rng.choice(["add", "add", "remove"]), day(rng.randrange(300))) for _ in range(400)]
    times = [("host", k, day(rng.randrange(-20, 330))) for k in "abcd" for _ in range(60)]
    listed = url_lists.intervals(spark.createDataFrame(events, "list string, kind string, key string, action string, day date"))
    got = url_lists.active_entries(spark.createDataFrame(sorted(set(times)), "kind string, key string, fetched date"), listed)
    want = set()
    for name in ("block", "allow", "other"):
        for _, k, t in set(times):
            since = None
            for _, _, _, action, at in sorted((e for e in set(events) if e[0] == name and e[2] == k and e[4] <= t), key=lambda e: (e[4], e[3])):
                since = (since or at) if action == "add" else None
            if since:
                want.add(("host", k, t, name, since))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100


def test_no_python_in_the_plan(spark):
    plan = url_lists.op2_query(spark, D)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
