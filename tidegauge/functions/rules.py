"""Trading rules and costs as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# Daily limits by board, costs, lot size, half a tick.
BOARD_LIMITS = {
    0.10: ("000", "001", "002", "003", "600", "601", "603", "605"),
    0.20: ("300", "301", "302", "688", "689"),
    0.30: ("920",),
}
TICK = 0.005
LOT = 100
PERIODS_PER_YEAR = 252


@dataclass(frozen=True)
class Costs:
    commission_rate: float = 0.00025
    commission_min: float = 5.0
    stamp_tax_rate: float = 0.0005
    slippage_bps: float = 5.0
    fees: bool = True
    slippage: bool = True


def board_limit(symbol: Column) -> Column:
    """The daily limit as a fraction; null where the board isn't known."""
    out = F.lit(None).cast("double")
    for pct, prefixes in BOARD_LIMITS.items():
        out = F.when(F.substring(symbol, 1, 3).isin(*prefixes), F.lit(pct)).otherwise(out)
    return F.when(symbol.rlike("^[0-9]{6}$"), out)


def band(prev_close: Column, pct: Column) -> tuple[Column, Column]:
    """Limit-up and limit-down prices: in decimals, half a cent goes up."""
    base, ratio = prev_close.cast("decimal(20,6)"), pct.cast("decimal(6,4)")
    cent = lambda x: F.round(x, 2).cast("double")
    return cent(base * (F.lit(1).cast("decimal(6,4)") + ratio)), cent(base * (F.lit(1).cast("decimal(6,4)") - ratio))


def limit_state(close: Column, up: Column, down: Column) -> Column:
    """up, down or inside; ``skipped`` where a price or the band is missing, or the close is beyond the band."""
    return (
        F.when(close.isNull() | up.isNull(), "skipped")
        .when(F.abs(close - up) <= TICK, "up")
        .when(F.abs(close - down) <= TICK, "down")
        .when((close > up + TICK) | (close < down - TICK), "skipped")
        .otherwise("inside")
    )


def order_block(side: Column, open_: Column, high: Column, low: Column, suspended: Column, up: Column, down: Column, entry_idx: Column, idx: Column) -> Column:
    """Why an order can't be filled at a bar's open (suspended, limit_up, limit_down, t1), or null; in this order."""
    at = lambda p, q: F.abs(p - q) <= TICK
    return (
        F.when(suspended | (open_ <= 0), "suspended")
        .when((side == "buy") & at(open_, up) & at(low, up), "limit_up")
        .when((side == "sell") & at(open_, down) & at(high, down), "limit_down")
        .when((side == "sell") & (entry_idx == idx), "t1")
    )


def fees(side: Column, qty: Column, price: Column, costs: Costs = Costs()) -> Column:
    paid = qty * price
    charged = F.greatest(paid * costs.commission_rate, F.lit(costs.commission_min)) + F.when(side == "sell", paid * costs.stamp_tax_rate).otherwise(F.lit(0.0))
    return F.when(qty > 0, charged).otherwise(F.lit(0.0))


def affordable_lots(cash: Column, price: Column, costs: Costs = Costs()) -> Column:
    """The most whole lots that cash pays for: the closed form of rate and minimum, then a lot more or fewer as the sums round."""
    paid = costs if costs.fees else replace(costs, commission_rate=0.0, commission_min=0.0)
    most = F.least((cash - paid.commission_min) / price, cash / (price * (1 + paid.commission_rate)))
    near = (F.floor(most / LOT) * LOT).cast("long")
    fits = lambda q: q * price + fees(F.lit("buy"), q, price, paid) <= cash
    tried = F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: near - i * LOT)
    return F.when(price > 0, F.coalesce(F.get(F.filter(tried, lambda q: (q > 0) & fits(q)), F.lit(0)), F.lit(0))).otherwise(F.lit(0)).cast("long")


def bar_cutoff(trade_date: Column) -> Column:
    """The decision instant of a daily bar: 15:00 of its day, as local time without a zone."""
    return (trade_date.cast("timestamp_ntz") + F.expr("INTERVAL '15' HOUR")).cast("timestamp_ntz")
