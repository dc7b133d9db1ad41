"""Per-symbol series: moving windows, RSI, curves, drawdown, moments, Sharpe ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import PERIODS_PER_YEAR, Costs
from .market import in_order

_EXACT = "decimal(28,8)"


def _own(rows: DataFrame):
    return Window.partitionBy("symbol").orderBy(*in_order(rows))


def moving_average(bars: DataFrame, n: int) -> DataFrame:
    """ma: mean of the last n closes, null before there are n."""
    w = _own(bars).rowsBetween(-n + 1, 0)
    mean = F.sum(F.col("close").cast(_EXACT)).over(w).cast("double") / n
    return bars.withColumn("ma", F.when(F.count("close").over(w) == n, F.round(mean, 8)))


def crosses(bars: DataFrame, fast: int, slow: int) -> DataFrame:
    """Bars where the fast mean crosses the slow one: cross is golden or death; needs slow + 1 bars."""
    slows = moving_average(bars, slow).withColumnRenamed("ma", "slow")
    both = moving_average(slows, fast).withColumnRenamed("ma", "fast")
    was = both.withColumn("fast0", F.lag("fast").over(_own(both))).withColumn("slow0", F.lag("slow").over(_own(both)))
    cross = F.when((F.col("fast0") <= F.col("slow0")) & (F.col("fast") > F.col("slow")), "golden").when((F.col("fast0") >= F.col("slow0")) & (F.col("fast") < F.col("slow")), "death")
    return was.withColumn("cross", F.when(F.col("slow0").isNotNull(), cross)).where("cross IS NOT NULL").select("symbol", "trade_date", "fast", "slow", "cross")


def channel(bars: DataFrame, n: int) -> DataFrame:
    """Breakouts: close above the highest high (long) or below the lowest low (exit) of the n bars before."""
    w = _own(bars).rowsBetween(-n, -1)
    out = bars.withColumn("top", F.max("high").over(w)).withColumn("floor", F.min("low").over(w)).withColumn("n", F.count("high").over(w)).where(F.col("n") == n)
    return out.withColumn("signal", F.when(F.col("close") > F.col("top"), "long").when(F.col("close") < F.col("floor"), "exit")).where("signal IS NOT NULL").select("symbol", "trade_date", "close", "top", "floor", "signal")


def parameter_cells(spark: SparkSession, axes: dict[str, list[int]], most: int = 100) -> DataFrame:
    """(cell, one column per axis): the product of at most two axes, the first slowest; more than ``most`` cells raise."""
    if not 1 <= len(axes) <= 2:
        raise ValueError("one or two axes")
    size = 1
    for values in axes.values():
        if not values or any(isinstance(v, bool) or not isinstance(v, int) or v < 1 for v in values):
            raise ValueError(f"an axis needs whole numbers from 1 on, not {values!r}")
        size *= len(values)
    if size > most:
        raise ValueError(f"{size} cells, at most {most} are allowed")
    cells = spark.range(1).select(F.lit(0).cast("long").alias("cell"))
    for name, values in axes.items():
        axis = F.posexplode(F.array(*map(F.lit, values)))
        cells = cells.select("*", axis.alias("at", name)).withColumn("cell", F.col("cell") * len(values) + F.col("at")).drop("at")
    return cells


def grid_crosses(bars: DataFrame, fasts: list[int], slows: list[int]) -> DataFrame:
    """(cell, fast, slow, golden, death): how often means cross, over all symbols, for every pair of lengths; a cell whose fast isn't below its slow has nulls.

    Means meet on symbol and day: where several bars share these, each one's fast mean meets each one's slow mean. All means
    come from one sort of the bars. Pairs are made and counted in place, once for all cells, which are columns of a row until then.
    """
    cells = parameter_cells(bars.sparkSession, {"fast": fasts, "slow": slows})
    means = bars.where(F.col("symbol").isNotNull() & F.col("trade_date").isNotNull()).select("symbol", "trade_date", "close")
    lengths = sorted({*fasts, *slows})
    for n in lengths:
        means = moving_average(means, n).withColumnRenamed("ma", f"now_{n}")
    for n in lengths:
        means = means.withColumn(f"was_{n}", F.lag(f"now_{n}").over(_own(means)))
    days = means.groupBy("symbol", "trade_date").agg(F.collect_list(F.struct(*[f"{at}_{n}" for n in lengths for at in ("now", "was")])).alias("bars"))
    met = days.select("bars", F.explode("bars").alias("a")).select("a", F.explode("bars").alias("b"))
    golden = lambda f, s: (F.col(f"a.was_{f}") <= F.col(f"b.was_{s}")) & (F.col(f"a.now_{f}") > F.col(f"b.now_{s}"))
    death = lambda f, s: (F.col(f"a.was_{f}") >= F.col(f"b.was_{s}")) & (F.col(f"a.now_{f}") < F.col(f"b.now_{s}"))
    none = F.lit(None).cast("long")
    each = lambda what: F.array(*[F.count_if(what(f, s)) if f < s else none for f in fasts for s in slows])
    counted = met.agg(F.count("*").alias("pairs"), each(golden).alias("goldens"), each(death).alias("deaths"))
    of_cell = lambda c: F.when(F.col("pairs") > 0, F.get(c, F.col("cell").cast("int")))
    return cells.crossJoin(F.broadcast(counted)).select("cell", "fast", "slow", of_cell("goldens").alias("golden"), of_cell("deaths").alias("death"))


def gated(signals: DataFrame, buy: Column) -> DataFrame:
    """Signals that a position lets through: symbol, trade_date, action (buy only when flat, sell only when holding).

    ``signals`` (symbol, trade_date, …) are buys where ``buy`` holds, else sells. Among them a signal counts exactly where
    it departs from the one before it, and the first one if it is a buy: whatever repeats finds the position taken
    already. So a window does it, without a walk through the account.
    """
    told = signals.select("symbol", "trade_date", buy.alias("buy"))
    was = F.lag("buy").over(Window.partitionBy("symbol").orderBy("trade_date"))
    kept = told.withColumn("kept", F.coalesce(F.col("buy") != was, F.col("buy"))).where("kept")
    return kept.select("symbol", "trade_date", F.when(F.col("buy"), "buy").otherwise("sell").alias("action"))


def volume_breakouts(bars: DataFrame, n: int, k: float) -> DataFrame:
    """Bars that close above their open on a volume over k times the mean of the n bars before."""
    w = _own(bars).rowsBetween(-n, -1)
    seen = bars.withColumn("n", F.count("volume").over(w)).withColumn("mean_volume", F.round(F.sum(F.col("volume").cast(_EXACT)).over(w).cast("double") / n, 6))
    return seen.where((F.col("n") == n) & (F.col("volume") > k * F.col("mean_volume")) & (F.col("close") > F.col("open"))).select("symbol", "trade_date", "volume", "mean_volume")


def wilder_rsi(bars: DataFrame, period: int) -> DataFrame:
    """Last RSI of each symbol: means over the first ``period`` changes, then smoothed one by one; without losses 100.

    The smoothing is a fold over a symbol's closes in order (an array per symbol: a bar a day).
    """
    series = bars.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("trade_date", "close"))).alias("s"))
    c = F.transform("s", lambda x: x["close"])
    moves = F.zip_with(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: a - b)
    part = lambda sign: F.transform("d", lambda x: F.greatest(sign * x, F.lit(0.0)))
    mean = lambda xs: F.aggregate(F.slice(xs, 1, period), F.lit(0.0), lambda a, x: a + x) / period
    smooth = lambda xs: F.aggregate(F.slice(xs, period + 1, 1 << 30), mean(xs), lambda a, x: (a * (period - 1) + x) / period)
    out = series.withColumn("d", moves).where(F.size("d") >= period).withColumn("gain", smooth(part(F.lit(1.0)))).withColumn("loss", smooth(part(F.lit(-1.0))))
    return out.select("symbol", F.round(F.when(F.col("loss") == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.col("gain") / F.nullif(F.col("loss"), F.lit(0.0)))), 4).alias("rsi"))


def drawdowns(rows: DataFrame, value: str = "close") -> DataFrame:
    """The deepest fall from a peak of each symbol, as a fraction."""
    peak = F.max(value).over(_own(rows).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("dd", (peak - F.col(value)) / F.nullif(peak, F.lit(0.0))).groupBy("symbol").agg(F.round(F.max("dd"), 6).alias("max_drawdown"))


def curve(returns: DataFrame, order: str, value: str, initial: float = 1000.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Levels from fractions per day: ``initial`` times the product so far; a null day is flat. One row a day (and curve, with ``by``)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return returns.select(*by, order, F.round(F.product(1 + F.coalesce(F.col(value), F.lit(0.0))).over(w) * initial, 4).alias("level"))


def moments(rows: DataFrame, by: str, value: Column) -> DataFrame:
    """n, mean, sample sd, population skewness and raw kurtosis per group, unrounded; skewness and kurtosis are null without variance."""
    x = rows.select(by, value.alias("x")).where("x IS NOT NULL")
    agg = x.groupBy(by).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.stddev_pop("x").alias("spread"), F.skewness("x").alias("skew"), F.kurtosis("x").alias("excess"))
    varies = F.col("spread") > 1e-15
    return agg.select(by, "n", "mean", "sd", F.when(varies, F.col("skew")).alias("skew"), F.when(varies, F.col("excess") + 3).alias("kurt"))


def sharpe(mean: Column, sd: Column, n: Column, periods: int = PERIODS_PER_YEAR) -> Column:
    """Annual Sharpe ratio; fewer than two periods, or none that vary: null."""
    return F.when((n >= 2) & (sd > 0), mean / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(float(periods))))


def annual_return(total: Column, n: Column, periods: int = PERIODS_PER_YEAR) -> Column:
    """(1 + total) ** (periods / n) - 1; a total loss is -1; no bars: null."""
    return F.when(n > 0, F.when(1 + total <= 0, F.lit(-1.0)).otherwise(F.pow(1 + total, periods / F.nullif(n, F.lit(0))) - 1))


def curve_metrics(levels: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Per curve: n levels, total and annual return (over n - 1 periods), deepest drawdown, annual Sharpe ratio (sample deviation; steps from zero or less don't count)."""
    w = Window.partitionBy(by).orderBy(order)
    peak = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.lag(value).over(w)
    steps = levels.select(by, order, F.col(value).alias("v"), F.when(before > 0, F.col(value) / before - 1).alias("r"), ((peak - F.col(value)) / F.nullif(peak, F.lit(0.0))).alias("dd"))
    a = steps.groupBy(by).agg(F.count("v").alias("n"), F.min_by("v", order).alias("a"), F.max_by("v", order).alias("b"), F.max("dd").alias("dd"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.count("r").alias("k"))
    total = F.col("b") / F.nullif(F.col("a"), F.lit(0.0)) - 1
    return a.select(by, "n", F.round(total, 6).alias("total"), F.round(annual_return(total, F.col("n") - 1), 6).alias("annual"), F.round("dd", 6).alias("max_drawdown"), F.round(sharpe(F.col("mean"), F.col("sd"), F.col("k")), 4).alias("sharpe"))


# Rational approximations of the normal distribution (Hart 1968) and of its quantile (Acklam 2003).
_CDF_TOP = (220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 0.0352624965998911)
_CDF_LOW = (440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 0.0883883476483184)
_Q_TOP = (2.506628277459239, -30.66479806614716, 138.3577518672690, -275.9285104469687, 220.9460984245205, -39.69683028665376)
_Q_LOW = (1.0, -13.28068155288572, 66.80131188771972, -155.6989798598866, 161.5858368580409, -54.47609879822406)
_TAIL_TOP = (2.938163982698783, 4.374664141464968, -2.549732539343734, -2.400758277161838, -0.3223964580411365, -0.007784894002430293)
_TAIL_LOW = (1.0, 3.754408661907416, 2.445134137142996, 0.3224671290700398, 0.007784695709041462)
_GAMMA = 0.5772156649015329


def _once(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _power_series(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x + c
    return out


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution, to about 1e-15 within seven deviations."""
    tail = lambda z: F.exp(-z * z / 2) * _power_series(z, _CDF_TOP) / _power_series(z, _CDF_LOW)
    return _once(x, lambda v: _once(_once(F.least(F.abs(v), F.lit(7.0)), tail), lambda t: F.when(v > 0, 1 - t).otherwise(t)))


def normal_quantile(p: Column) -> Column:
    """Its inverse for 0 < p < 1: an approximation and one step of Halley's method."""
    middle = lambda q: q * _once(q * q, lambda r: _power_series(r, _Q_TOP) / _power_series(r, _Q_LOW))
    tail = lambda q: _once(F.sqrt(-2 * F.ln(0.5 - F.abs(q))), lambda r: _power_series(r, _TAIL_TOP) / _power_series(r, _TAIL_LOW))
    near = lambda q: F.when(F.abs(q) <= 0.47575, middle(q)).when(q < 0, tail(q)).otherwise(-tail(q))
    step = lambda x, q: _once((normal_cdf(x) - 0.5 - q) * 2.5066282746310002 * F.exp(x * x / 2), lambda s: x - s / (1 + x * s / 2))
    return _once(p - 0.5, lambda q: _once(near(q), lambda x: step(x, q)))


def luck(variance: Column, trials: Column) -> Column:
    """The per-period Sharpe ratio that the best of so many trials without skill is expected to show; under two: null; all alike: 0."""
    n = F.greatest(trials.cast("double"), F.lit(2.0))
    blend = (1 - _GAMMA) * normal_quantile(1 - 1 / n) + _GAMMA * normal_quantile(1 - 1 / (n * 2.718281828459045))
    return F.when(trials >= 2, F.when(variance > 0, F.sqrt(variance) * blend).otherwise(F.lit(0.0)))


def beyond_luck(ratio: Column, expected: Column, skew: Column, kurt: Column, n: Column) -> Column:
    """The chance that a per-period Sharpe ratio is above ``expected``, allowing for skewness and raw kurtosis; null where it has no meaning."""
    spread = 1 - skew * ratio + (kurt - 1) / 4 * ratio * ratio
    return F.when((n >= 2) & (spread > 0), normal_cdf((ratio - expected) * F.sqrt((n - 1).cast("double")) / F.sqrt(spread)))


def rank_trials(trials: DataFrame) -> DataFrame:
    """Trials (cell, n, mean, sd, skew, kurt) of :func:`moments` → the best one: cell, sharpe, sr0, dsr, trials.

    Ratios are per period; the trials' variance is that of the population of valid ones. Of equal ones the first cell is best.
    """
    per = trials.withColumn("sr", F.when((F.col("sd") > 0) & (F.col("n") >= 2), F.col("mean") / F.nullif(F.col("sd"), F.lit(0.0)))).where("sr IS NOT NULL")
    first = F.struct(-F.col("sr"), "cell")
    one = per.agg(F.min_by(F.struct("cell", "sr", "skew", "kurt", "n"), first).alias("b"), F.var_pop("sr").alias("v"), F.count("*").alias("trials")).where("b IS NOT NULL").select("b.*", "trials", luck(F.col("v"), F.col("trials")).alias("sr0"))
    return one.select("cell", F.round("sr", 8).alias("sharpe"), F.round("sr0", 8).alias("sr0"), F.round(beyond_luck(F.col("sr"), F.col("sr0"), F.col("skew"), F.col("kurt"), F.col("n")), 8).alias("dsr"), "trials")


def hold_curve(bars: DataFrame, cash: float, costs: Costs = Costs()) -> DataFrame:
    """Per symbol, what ``cash`` in its first close (fractional shares, one buy at cost) is worth at each close; a first close of zero or less: the cash."""
    first = F.min_by("close", "trade_date").over(Window.partitionBy("symbol"))
    paid = first * (1 + (costs.slippage_bps / 10_000 if costs.slippage else 0.0))
    spent = cash * (1 - (costs.commission_rate if costs.fees else 0.0))
    return bars.select("symbol", "trade_date", F.when(first > 0, spent / F.nullif(paid, F.lit(0.0)) * F.col("close")).otherwise(F.lit(float(cash))).alias("level"))


def aligned_gaps(bars: DataFrame, one: str, other: str) -> DataFrame:
    """Closes of two adjustments (priced bars) that meet on symbol and day, less one another: symbol, i, gap; i counts a symbol's pairs from 0 by day, then bar by bar of ``one``, both by close.

    Where many bars share a symbol and day there are far more pairs than bars. So days are counted before they are paired,
    and the pairs are neither shuffled nor sorted.
    """
    closes = lambda kind: F.array_sort(F.collect_list(F.when(F.col("adjustment") == kind, F.col("close"))))
    dealt = bars.where(F.col("adjustment").isin(one, other) & F.col("symbol").isNotNull() & F.col("trade_date").isNotNull()).select("symbol", "trade_date", "adjustment", "close").repartition("symbol")
    days = dealt.groupBy("symbol", "trade_date").agg(closes(one).alias("xs"), closes(other).alias("ys"))
    pairs = F.size("xs").cast("long") * F.size("ys")
    placed = days.withColumn("before", F.coalesce(F.sum(pairs).over(_own(days).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    left = placed.select("symbol", "before", "ys", F.posexplode("xs").alias("a", "x"))
    met = left.select("symbol", (F.col("before") + F.col("a").cast("long") * F.size("ys")).alias("before"), "x", F.posexplode("ys").alias("b", "y"))
    return met.select("symbol", (F.col("before") + F.col("b")).alias("i"), F.round(F.col("x") - F.col("y"), 6).alias("gap"))


def performance(levels: DataFrame, by: str, order: str, value: str, initial: float, benchmark_return: Column | None = None) -> DataFrame:
    """Per curve: n, total and annual return against ``initial``, deepest drawdown, Sharpe ratio, annual volatility, excess over a benchmark."""
    w = Window.partitionBy(by).orderBy(order)
    before, peak = F.lag(value).over(w), F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    steps = levels.select(by, order, F.col(value).alias("v"), F.when(before > 0, F.col(value) / before - 1).alias("r"), ((peak - F.col(value)) / F.nullif(peak, F.lit(0.0))).alias("dd"))
    a = steps.groupBy(by).agg(F.count("*").alias("n"), F.max_by("v", order).alias("last"), F.max("dd").alias("dd"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.count("r").alias("k"))
    total = F.col("last") / initial - 1
    out = a.select(by, "n", F.round(total, 6).alias("total"), F.round(annual_return(total, F.col("n")), 6).alias("annual"), F.round("dd", 6).alias("max_drawdown"), F.round(sharpe(F.col("mean"), F.col("sd"), F.col("k")), 4).alias("sharpe"), F.round(F.when(F.col("k") >= 2, F.col("sd") * (PERIODS_PER_YEAR**0.5)), 6).alias("volatility"))
    return out if benchmark_return is None else out.withColumn("excess", F.round(F.col("total") - benchmark_return, 6))


def market_numbers(bars: DataFrame, window: int) -> DataFrame:
    """Per symbol over its last ``window`` bars: bars, window_return, high, low, volatility (annual), ma20, momentum20, amount20."""
    order = Window.partitionBy("symbol").orderBy("trade_date")
    newest = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    last = bars.withColumn("r", F.col("close") / F.lag("close").over(order) - 1).withColumn("k", F.row_number().over(newest)).where(F.col("k") <= window)
    at = lambda k, c="close": F.max(F.when(F.col("k") == k, F.col(c)))
    recent = lambda c: F.avg(F.when(F.col("k") <= 20, F.col(c)))
    return last.groupBy("symbol").agg(
        F.count("*").alias("bars"), F.round(at(1) / at(window) - 1, 6).alias("window_return"), F.max("high").alias("high"), F.min("low").alias("low"), F.round(F.stddev_samp(F.when(F.col("k") < window, F.col("r"))) * (PERIODS_PER_YEAR**0.5), 6).alias("volatility"),
        F.round(recent("close"), 6).alias("ma20"), F.round(at(1) / at(21) - 1, 6).alias("momentum20"), F.round(recent("amount"), 0).alias("amount20"),
    )
