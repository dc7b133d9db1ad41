"""Pools that are never formed: ranks, slices and counters from values and legs, where several bars share a symbol and day."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidegauge import catalog
from tidegauge.operators import factor, series

START = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(11)
    days = [START + dt.timedelta(i) for i in range(14)]
    rows = [(f"{s:06d}", d, p, p + 1, p - 1, rng.choice([9.0, 10.0, 11.0, p])) for s in range(6) for d in days for p in [rng.choice([8.0, 10.0, 10.5, 13.0, 14.0]) for _ in range(s % 4)]]
    bars = spark.createDataFrame(rows, "symbol string, trade_date date, open double, high double, low double, close double")
    sessions = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "trade_date date, session_idx int")
    values = factor.price_panel(bars, 2)
    return values.cache(), factor.return_legs(bars, sessions).cache(), factor.forward_returns(bars, sessions).cache()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_counts_of_legs_are_those_of_returns(sides):
    values, legs, forward = sides
    want = {(r.trade_date, r.symbol): (r.f, r.ok) for r in forward.groupBy("trade_date", "symbol").agg(F.count("*").alias("f"), F.count_if(F.abs("fwd_ret") <= 0.3).alias("ok")).collect()}
    assert {(r.trade_date, r.symbol): (r.f, r.ok) for r in legs.collect()} == want and any(f > ok > 0 for f, ok in want.values())
    for least in (1, 20, 30):
        got = factor.pool_counters(values, legs, least).first()
        assert tuple(got) == tuple(factor.pool_counters(values, forward, least).first())
    met = values.join(forward, ["trade_date", "symbol"], "left")
    assert (got.dropped_no_price, got.dropped_extreme) == (met.where("fwd_ret IS NULL").count(), met.where("abs(fwd_ret) > 0.3").count())


def test_rank_ic_of_legs_is_that_of_the_pool(sides):
    values, legs, forward = sides
    for least in (3, 25):
        want = rows(factor.rank_ic(factor.pools(values, forward, least)), "trade_date", "n", "ic")
        assert want and rows(factor.rank_ic_of_legs(values, legs, least), "trade_date", "n", "ic") == want


def test_the_plan_of_rank_ic_does_not_pair_values_with_returns(sides):
    values, legs, _ = sides
    plan = factor.rank_ic_of_legs(values, legs)._jdf.queryExecution().optimizedPlan().toString()
    assert "o1s" in plan and "fwd_ret" not in plan


def test_slices_of_legs_are_those_of_the_pool(sides):
    values, legs, forward = sides
    pool = factor.pools(values, forward, 10)
    members, got = factor.quantile_members(pool), factor.members_of_legs(values, legs, 10)
    want = rows(members.groupBy("trade_date", "q", "symbol").count(), "trade_date", "q", "symbol", "count")
    assert rows(got.groupBy("trade_date", "q", "symbol").agg(F.sum("n").alias("count")), "trade_date", "q", "symbol", "count") == want
    paid = F.sum(F.col("fwd_ret").cast("decimal(28,10)"))
    assert rows(got.groupBy("trade_date", "symbol").agg(F.sum("paid").alias("p")), "trade_date", "symbol", "p") == rows(members.groupBy("trade_date", "symbol").agg(paid.alias("p")), "trade_date", "symbol", "p")
    assert rows(factor.turnover(got), "trade_date", "q", "size", "bought", "sold") == rows(factor.turnover(members), "trade_date", "q", "size", "bought", "sold")


def test_turnover_counts_a_repeated_name_per_pair(spark):
    """Two rows of a name that had three the day before stayed six times, as the SQL's join has it."""
    row = lambda day, name, times: [(START + dt.timedelta(day), name, 0, 0.01)] * times
    members = spark.createDataFrame(row(0, "a", 3) + row(0, "b", 1) + row(1, "a", 2) + row(1, "c", 6), "trade_date date, symbol string, q int, fwd_ret double")
    assert [tuple(r)[2:] for r in factor.turnover(members).orderBy("trade_date").collect()] == [(4, 1.0, 0.0), (8, 0.25, -0.5)]


def test_aligned_curves_are_numbered_before_they_are_paired(spark):
    rng = random.Random(5)
    days = [START + dt.timedelta(i) for i in range(9)]
    rows = [(f"{s:06d}", d, kind, rng.choice([9.0, 10.25, 11.5, p])) for s in range(5) for d in days for kind in ("qfq", "raw", "hfq") for p in [8.0 + rng.random() for _ in range(rng.randrange(s + 1))]]
    bars = spark.createDataFrame([*rows, (None, days[0], "qfq", 1.0), (None, days[0], "raw", 1.0)], "symbol string, trade_date date, adjustment string, close double")
    want = []
    for symbol in sorted({r[0] for r in rows}):
        closes = lambda d, kind: sorted(r[3] for r in rows if r[:3] == (symbol, d, kind))  # noqa: B023, E731
        gaps = [round(x - y, 6) for d in days for x in closes(d, "qfq") for y in closes(d, "raw")]
        want += [(symbol, i, gap) for i, gap in enumerate(gaps)]
    got = sorted(tuple(r) for r in series.aligned_gaps(bars, "qfq", "raw").collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-6)
    asked = catalog.QUERIES["c12_aligned_curves"](spark, "/root/testdata/sf0.001")
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.rindex("Generate") < plan.index("Window")
