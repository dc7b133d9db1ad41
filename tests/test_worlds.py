"""The event factor with and without knowledge stamps; turnover and slices against loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import factor

MEMBER = "trade_date date, symbol string, q int, fwd_ret double"
EVENT = "event_id long, event_time timestamp_ntz, available_at timestamp_ntz, symbols array<string>, score double"
START = dt.date(2024, 1, 1)


def market(spark, n, names):
    days = [START + dt.timedelta(i) for i in range(n)]
    sessions = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "trade_date date, session_idx int")
    forward = spark.createDataFrame([(d, s, 0.001 * (k - 4) + 0.002 * (i % 3)) for i, d in enumerate(days) for k, s in enumerate(names)], "trade_date date, symbol string, fwd_ret double")
    return days, sessions, forward


def test_turnover_against_a_loop_with_days_that_a_slice_misses(spark):
    rng = random.Random(5)
    held = {(i, q): set(rng.sample("abcdefgh", rng.randint(1, 5))) for i in range(12) for q in range(3) if not (q == 1 and i in (0, 4, 5)) and i != 7}
    rows = [(START + dt.timedelta(i), s, q, 0.01 * len(names)) for (i, q), names in held.items() for s in names]
    days = sorted({i for i, _ in held})
    want = {}
    for (i, q), now in held.items():
        at = days.index(i)
        was = held.get((days[at - 1], q), set()) if at else set()
        want[START + dt.timedelta(i), q] = (len(now), round(len(now - was) / len(now), 6), round(len(was - now) / len(was), 6) if was else 0.0)
    members = spark.createDataFrame(rows, MEMBER)
    assert {(r.trade_date, r.q): (r.size, r.bought, r.sold) for r in factor.turnover(members).collect()} == want
    two = members.withColumn("world", F.lit("a")).unionByName(members.where("trade_date > DATE '2024-01-03'").withColumn("world", F.lit("b")))
    both = factor.turnover(two, ("world",)).collect()
    assert {(r.trade_date, r.q): (r.size, r.bought, r.sold) for r in both if r.world == "a"} == want
    assert all(r.bought == 1 and r.sold == 0 for r in both if r.world == "b" and r.trade_date == dt.date(2024, 1, 4))


def test_worlds_without_a_lag_are_alike(spark):
    names = [f"{i:06d}" for i in range(10)]
    days, sessions, forward = market(spark, 6, names)
    at = [dt.datetime.combine(d, dt.time(10)) for d in days]
    events = spark.createDataFrame([(i * 10 + k, t, t, [s], float((k * 7 + i) % 10)) for i, t in enumerate(at) for k, s in enumerate(names)], EVENT)
    metrics = factor.world_metrics(events, sessions, forward, 5)
    got = {r.metric: r for r in factor.world_deltas(metrics).collect()}
    assert set(got) == {"days", "final_equity", "total_return", "annual_return", "max_drawdown", "sharpe", "win_rate", "ic_days", "ic_mean", "icir"}
    assert all(r.pit == r.non_pit and r.delta in (0.0, None) for r in got.values()) and got["days"].pit == 6
    assert [tuple(r) for r in factor.look_ahead(events, sessions).collect()] == [(0, 60, 60)]


def test_a_report_known_late_moves_a_session_and_one_never_known_has_none(spark):
    names = [f"{i:06d}" for i in range(5)]
    days, sessions, forward = market(spark, 4, names)
    at = lambda i, h: dt.datetime.combine(days[0] + dt.timedelta(i), dt.time(h))
    rows = [(k, at(1, 10), at(1, 16), [s], float(k)) for k, s in enumerate(names)]  # known after the cutoff: a session later
    rows += [(90, at(3, 10), at(3, 16), ["000000"], 1.0), (91, at(0, 9), None, ["000000"], None)]  # never known
    events = spark.createDataFrame(rows, EVENT)
    assert {(r.sessions_early, r.n, r.scored) for r in factor.look_ahead(events, sessions).collect()} == {(1, 5, 5), (None, 2, 1)}
    panel = factor.event_panel(factor.in_both_worlds(events), sessions, "stamp", ("world",)).where("symbol = '000001'").collect()
    assert {(r.world, r.trade_date) for r in panel} == {("pit", days[2]), ("non_pit", days[1])}
    got = {(r.world, r.metric): r.value for r in factor.world_metrics(events, sessions, forward, 5).collect()}
    assert got["pit", "days"] == got["non_pit", "days"] == 1 and got["pit", "ic_mean"] == pytest.approx(1.0) and got["pit", "sharpe"] is None


def test_a_world_without_events_has_no_metrics(spark):
    _, sessions, forward = market(spark, 3, ["000001"])
    none = spark.createDataFrame([], EVENT)
    assert factor.world_metrics(none, sessions, forward).count() == 0 and factor.look_ahead(none, sessions).count() == 0


def test_deltas_are_null_where_a_world_lacks_the_metric(spark):
    rows = [("pit", "sharpe", None), ("non_pit", "sharpe", 1.0), ("pit", "final_equity", 1000.0), ("non_pit", "final_equity", 1100.0), ("pit", "win_rate", 0.5), ("non_pit", "win_rate", 0.4), ("pit", "days", 3.0)]
    got = {r.metric: (r.delta, r.unit) for r in factor.world_deltas(spark.createDataFrame(rows, "world string, metric string, value double")).collect()}
    assert got == {"sharpe": (None, "abs"), "final_equity": (0.1, "ratio"), "win_rate": (-10.0, "pp"), "days": (None, "abs")}
