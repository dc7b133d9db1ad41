"""Series and changes where several bars share a symbol and day: rows go by what they hold, not by how they lie."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import market, series

START = dt.date(2024, 1, 1)
SHAPE = "symbol string, adjustment string, trade_date date, open double, high double, low double, close double, volume double, amount double"


@pytest.fixture(scope="module")
def bars(spark):
    rng = random.Random(23)
    rows = []
    for s in range(4):
        for i in range(30):
            for _ in range(1 + rng.randrange(s + 1)):
                p = [round(8 + 4 * rng.random(), 2) for _ in range(4)]
                rows.append((f"60000{s}", "qfq", START + dt.timedelta(i), p[0], max(p), min(p), p[3], float(rng.randrange(1, 50)), round(1000 * rng.random(), 2)))
    return rows


CASES = {
    "moving_average": lambda b: series.moving_average(b, 4).select("symbol", "trade_date", "close", "ma"),
    "crosses": lambda b: series.crosses(b, 2, 5),
    "channel": lambda b: series.channel(b, 3),
    "volume_breakouts": lambda b: series.volume_breakouts(b, 4, 1.1),
    "with_change": lambda b: market.with_change(b).select("symbol", "trade_date", "close", "prev_close", "change_pct"),
    "day_closes": lambda b: market.day_closes(b, b.select("trade_date").distinct(), START + dt.timedelta(20), "qfq"),
    "grid_crosses": lambda b: series.grid_crosses(b, [2], [3, 5]),
}


@pytest.mark.parametrize("case", CASES)
def test_rows_do_not_hang_on_how_bars_lie(spark, bars, case):
    found = []
    for rows in (bars, bars[::-1], sorted(bars, key=lambda r: -r[6]), sorted(bars, key=lambda r: r[7])):
        frame = spark.createDataFrame(rows, SHAPE).coalesce(1)
        found.append(sorted(map(repr, CASES[case](frame).collect())))
    assert found[0] and all(f == found[0] for f in found)


def test_means_that_cross_meet_on_symbol_and_day(spark, bars):
    now, was = {}, {}
    for symbol in {r[0] for r in bars}:
        own = sorted((r for r in bars if r[0] == symbol), key=lambda r: (r[2], r[6]))
        closes = [r[6] for r in own]
        for n in (2, 3, 5):
            means = [round(sum(closes[k - n + 1 : k + 1]) / n, 8) if k + 1 >= n else None for k in range(len(closes))]
            for k, r in enumerate(own):
                now.setdefault((symbol, r[2], n), []).append(means[k])
                was.setdefault((symbol, r[2], n), []).append(means[k - 1] if k else None)
    want = {}
    for fast in (2, 5):
        for slow in (3, 5):
            golden = death = 0
            for symbol, day, n in now:
                if n == fast and fast < slow:
                    for a0, a1 in zip(was[symbol, day, fast], now[symbol, day, fast], strict=True):
                        for b0, b1 in zip(was[symbol, day, slow], now[symbol, day, slow], strict=True):
                            if None not in (a0, a1, b0, b1):
                                golden += a0 <= b0 and a1 > b1
                                death += a0 >= b0 and a1 < b1
            want[fast, slow] = (golden, death) if fast < slow else (None, None)
    got = series.grid_crosses(spark.createDataFrame(bars, SHAPE), [2, 5], [3, 5]).orderBy("cell").collect()
    assert [r.cell for r in got] == [0, 1, 2, 3] and {(r.fast, r.slow): (r.golden, r.death) for r in got} == want
    assert all(r.golden is None for r in series.grid_crosses(spark.createDataFrame([], SHAPE), [2], [3]).collect())


def test_the_order_of_bars_takes_the_columns_that_are_there(spark, bars):
    frame = spark.createDataFrame(bars, SHAPE)
    assert market.in_order(frame) == ["trade_date", "close", "open", "high", "low", "volume", "amount"]
    assert market.in_order(frame.select("symbol", "trade_date", F.lit(1).alias("level"))) == ["trade_date"]
