"""Affordable lots as a column against a search by halving, in whole lots."""

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import rules
from tidegauge.plans import model_queries


def most_lots(cash, price, costs):
    """The largest number of whole lots whose price and fee fit, by halving an interval."""
    due = lambda lots: lots * 100 * price + (max(lots * 100 * price * costs.commission_rate, costs.commission_min) if costs.fees and lots else 0.0)
    low, high = 0, int(cash / price / 100) + 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if due(mid) <= cash else (low, mid)
    return low * 100


@pytest.mark.parametrize("costs", [rules.Costs(), rules.Costs(commission_rate=0.01, commission_min=50.0), rules.Costs(fees=False)])
def test_large_cash_low_prices_and_edges(spark, costs):
    cash = [0.0, 4.99, 105.0, 1005.0, 1004.99, 20_005.0, 20_000.0, 1_000_000.0, 1_024_519.3, 5_000_000.0, 123_456_789.01]
    rows = [(c, p) for c in cash for p in (0.5, 0.9, 1.0, 2.0, 3.33, 10.0, 50.0, 1999.99)]
    out = spark.createDataFrame(rows, "cash double, price double").select("cash", "price", rules.affordable_lots(F.col("cash"), F.col("price"), costs).alias("lots")).collect()
    assert [(r.cash, r.price, r.lots) for r in out] == [(r.cash, r.price, most_lots(r.cash, r.price, costs)) for r in out]
    if costs == rules.Costs():
        assert {(r.cash, r.price): r.lots for r in out}[1_000_000.0, 1.0] == 999_700


def test_all_rows_of_lineitem(spark):
    rows = model_queries.B.table(spark, "/root/testdata/sf0.01", "lineitem").select((F.col("l_extendedprice") * 10).alias("cash"), F.col("l_quantity").alias("price"))
    out = rows.select("cash", "price", rules.affordable_lots(F.col("cash"), F.col("price")).alias("lots")).collect()
    wrong = [r for r in out if r.lots != most_lots(r.cash, r.price, rules.Costs())]
    assert len(out) > 50_000 and any(r.cash * 0.00025 > 5 for r in out)
    assert not wrong, (len(wrong), wrong[:3])
