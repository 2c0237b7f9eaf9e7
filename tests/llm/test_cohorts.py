import zlib
from datetime import datetime, timedelta

import duckdb
import pytest

from geomill.llm import queries
from geomill.llm.cohorts import retention

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, state string, at string, due string"
CLIENTS = "client_id long, city string, start0 string"
KNOWN = datetime(2024, 3, 1)
T = datetime(2024, 2, 27, 22, 0, 0, 1)


def crc(n):
    return zlib.crc32(str(n).encode())


def plain(clicks, clients, days=3):
    """A row-by-row count."""
    city = {}
    for c, name, _ in clients:
        if c is not None and name is not None:
            city[c] = max(city.get(c, ""), name)
    rows = [r for r in dict.fromkeys(clicks) if r[1] is not None and r[3] is not None]
    due = lambda r: None if r[2] is None else r[2] + timedelta(days=crc(r[0]) % 100 if r[0] is not None and crc(r[0]) % 3 == 0 else 0)
    starts, cells = {}, {}
    known = lambda s, r: s == 1 or (due(r) is not None and due(r) < KNOWN)
    for s in (0, 1):
        for r in rows:
            if known(s, r) and r[4] == "purchase":
                starts[s, r[3]] = min(r[1], starts.get((s, r[3]), r[1]))
    group = lambda t: (t - datetime(1970, 1, 1)) // timedelta(days=days)
    for s in (0, 1):
        for r in rows:
            start = starts.get((s, r[3]))
            if start and known(s, r) and r[1] >= start:
                users, cents = cells.setdefault((s, city.get(r[3], ""), group(start), (r[1] - start) // timedelta(days=days)), (set(), []))
                users.add(r[3])
                cents.append(0 if r[5] is None else int((100 * r[5] + 0.5) // 1))
    both = {c for s, c in starts if s == 0 and group(starts[0, c]) != group(starts[1, c])}
    return sorted((*k, len(u), sum(map(crc, u)), len(u & both), sum(cents)) for k, (u, cents) in cells.items())


def click(i, ts, client=1, kind="view", value=1.0, arrived="ts", props="{}"):
    return (i, ts, ts if arrived == "ts" else arrived, client, kind, value, props, "x", "x", "x")


def rows_of(df):
    return sorted(map(tuple, df.select("state", "segment", "cohort", "period", "users", "users_crc32", "moved", "cents").collect()))


LATE = next(i for i in range(1000) if crc(i) % 3 == 0 and crc(i) % 100 > 20)
IN_TIME = next(i for i in range(1000) if crc(i) % 3 and crc(i) % 100 > 20)


@pytest.mark.parametrize("days", [1, 3])
def test_odd_rows(spark, days):
    us = timedelta(microseconds=1)
    clicks = [
        click(LATE, T, 1, "purchase"),  # unknown in state 0, which starts later: moved
        click(IN_TIME, T + timedelta(days=4), 1, "purchase", -0.125, arrived=T),
        click(IN_TIME + 10_000, T + timedelta(days=days) - us, 2, None, None),
        click(IN_TIME + 10_000, T + timedelta(days=days) - us, 2, None, None),  # the same row
        click(IN_TIME + 10_000, T + timedelta(days=days) - us, 2, None, None, props="{ }"),  # differs
        click(50, T, 2, "purchase", 0.005),
        click(51, T + timedelta(days=days), 2, "view", 10.555),  # the next period begins
        click(52, T - us, 2),  # before the start
        click(53, None, 2, "purchase"),
        click(54, T, None, "purchase"),
        click(None, T, 3, "purchase", None),
        click(55, T, 4, "purchase", arrived=None),
        click(56, T, 5, "view"),  # no purchase
        click(57, datetime(1969, 12, 30, 5), 6, "purchase"),
        *[click(1000 + i, T + timedelta(hours=7 * i), 7, "purchase" if i % 5 == 0 else "view", i / 7) for i in range(300)],  # a hot client
    ]
    clients = [(1, "b", "x"), (2, "a", "x"), (2, "c", "x"), (3, None, "x"), (7, "ä", "x"), (None, "n", "x")]
    got = rows_of(retention(spark.createDataFrame(clicks, SCHEMA).repartition(3), spark.createDataFrame(clients, CLIENTS), cohort_days=days, period_days=days))
    assert got == plain(clicks, clients, days)
    assert {r[6] for r in got if r[1] == "b"} == {1}


def test_values_that_are_no_cents(spark):
    clicks = [click(1, T, 1, "purchase", v) for v in (float("nan"), float("inf"), -float("inf"), 1e300)]
    assert [r[-1] for r in rows_of(retention(spark.createDataFrame(clicks, SCHEMA), spark.createDataFrame([], CLIENTS)))] == [0] * len({crc(1) % 3 == 0, True})


def test_other_zones_and_empty(spark):
    assert retention(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], CLIENTS)).collect() == []
    clicks = [click(i, datetime(2024, 3, 30, 12) + timedelta(hours=12 * i), 1, "purchase") for i in range(12)]  # over a change of clocks
    df, clients = spark.createDataFrame(clicks, SCHEMA), spark.createDataFrame([(1, "a", "x")], CLIENTS)
    want = plain(clicks, [(1, "a", "x")])
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert rows_of(retention(df, clients)) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("clicks", "clients"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(f"SELECT state, segment, cohort, period, users, users_crc32, moved, cents FROM ({queries.ORACLES['op12_cohort_retention']})").fetchall()
    assert rows_of(queries.op12_cohort_retention(spark, sf)) == sorted(want)


def test_plan_merges_and_splits(spark, sf):
    """Nothing is broadcast, and the clicks meet the starts with one exchange on either side."""
    plan = queries.op12_cohort_retention(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert "partial_sum(cents" in plan.split("SortMergeJoin")[0]
