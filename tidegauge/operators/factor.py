"""Factor evaluation: panels, pools, rank IC, quantile portfolios, turnover, spread."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .market import priced, session_buckets
from .series import curve, performance

#: Further columns that keep panels apart, such as the world of :func:`in_both_worlds`; all of a report comes from one plan then.
Keys = tuple[str, ...]
MAX_RETURN = 0.30
_EXACT = "decimal(28,10)"


def _mean(value, places: int = 8):
    return F.round(F.sum(F.col(value).cast(_EXACT)).cast("double") / F.count(value), places)


def event_panel(events: DataFrame, sessions: DataFrame, stamp: str = "available_at", by: Keys = ()) -> DataFrame:
    """(by …, trade_date, symbol, value): the mean score of a symbol's events that a session is the first to see."""
    scored = session_buckets(events.where("score IS NOT NULL"), sessions, stamp).where("session IS NOT NULL")
    return scored.select(*by, F.col("session").alias("trade_date"), F.explode("symbols").alias("symbol"), "score").groupBy(*by, "trade_date", "symbol").agg(_mean("score").alias("value"))


def panel_counters(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """rows_seen, dropped_no_value, dropped_no_day."""
    found = session_buckets(events, sessions)
    return found.agg(F.count("*").alias("rows_seen"), F.count_if(F.col("score").isNull()).alias("dropped_no_value"), F.count_if(F.col("score").isNotNull() & F.col("session").isNull()).alias("dropped_no_day"))


def price_panel(bars: DataFrame, lookback: int = 20, direction: int = 1) -> DataFrame:
    """(trade_date, symbol, value): the change since ``lookback`` of the symbol's own priced bars; absent where there are fewer.

    Bars of one symbol and day are taken in order of their close, so that reruns agree.
    """
    w = Window.partitionBy("symbol").orderBy("trade_date", "close")
    back = F.lag("close", lookback).over(w)
    return priced(bars).withColumn("value", F.round(direction * (F.col("close") / F.nullif(back, F.lit(0.0)) - 1), 8)).where("value IS NOT NULL").select("trade_date", "symbol", "value")


def forward_returns(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """(trade_date, symbol, fwd_ret): open of the market's session after next over that of the next; a halted symbol has none."""
    opens = priced(bars).where("open > 0").join(F.broadcast(sessions), "trade_date").select("symbol", "session_idx", "open")  # a row per trading day
    one = opens.select("symbol", (F.col("session_idx") - 1).alias("session_idx"), F.col("open").alias("o1"))
    two = opens.select("symbol", (F.col("session_idx") - 2).alias("session_idx"), F.col("open").alias("o2"))
    return one.join(two, ["symbol", "session_idx"]).join(F.broadcast(sessions), "session_idx").select("trade_date", "symbol", F.round(F.col("o2") / F.col("o1") - 1, 8).alias("fwd_ret"))


def _return(o2, o1):
    return F.round(o2 / o1 - 1, 8)


def return_legs(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """What :func:`forward_returns` pairs, unpaired: (trade_date, symbol, o1s, o2s, f, ok), a row per day and symbol.

    o1s are the opens of the next session, o2s those of the one after; f counts the returns they make, ok those of at most
    30 %. Where many bars share a symbol and day there are far more returns than bars. Quotients and rounding are
    monotone: where the ends are within the bound, so is every return, and only other days try each.
    """
    opens = priced(bars).where("open > 0").join(F.broadcast(sessions), "trade_date")  # a row per trading day
    leg = lambda k: F.struct((F.col("session_idx") - k).alias("session_idx"), *[F.when(F.lit(k) == j, F.col("open")).alias(f"o{j}") for j in (1, 2)])
    legs = opens.select("symbol", F.inline(F.array(leg(1), leg(2)))).groupBy("symbol", "session_idx").agg(F.collect_list("o1").alias("o1s"), F.collect_list("o2").alias("o2s"))
    met = legs.where((F.size("o1s") > 0) & (F.size("o2s") > 0)).join(F.broadcast(sessions), "session_idx")
    least, most = (_return(f(b), g(a)) for f, g, a, b in ((F.array_min, F.array_max, "o1s", "o2s"), (F.array_max, F.array_min, "o1s", "o2s")))
    plain = ~F.isnan(F.array_max("o1s")) & ~F.isnan(F.array_max("o2s"))
    f = F.size("o1s").cast("long") * F.size("o2s")
    each = F.aggregate("o1s", F.lit(0).cast("long"), lambda n, a: n + F.size(F.filter("o2s", lambda b: F.abs(_return(b, a)) <= MAX_RETURN)))
    return met.select("trade_date", "symbol", "o1s", "o2s", f.alias("f"), F.when(plain & (least >= -MAX_RETURN) & (most <= MAX_RETURN), f).otherwise(each).alias("ok"))


def pools(values: DataFrame, forward: DataFrame, min_pool: int = 20, by: Keys = ()) -> DataFrame:
    """(by …, trade_date, symbol, value, fwd_ret): values with a return of at most 30 %, of days with at least ``min_pool`` of them."""
    met = values.join(forward, ["trade_date", "symbol"]).where(F.abs("fwd_ret") <= MAX_RETURN)
    return met.withColumn("n", F.count("*").over(Window.partitionBy(*by, "trade_date"))).where(F.col("n") >= min_pool).drop("n")


def pool_counters(values: DataFrame, forward: DataFrame, min_pool: int = 20) -> DataFrame:
    """dropped_no_price, dropped_extreme, skipped_thin_days, skipped_no_forward_days; ``forward`` has returns, or their counts as :func:`return_legs`.

    Both sides are counted by day and symbol before they meet.
    """
    if "ok" in forward.columns:
        counts = forward.select("trade_date", "symbol", "f", "ok", (F.col("f") - F.col("ok")).alias("x"), F.lit(0).cast("long").alias("none"))
    else:
        size = F.abs("fwd_ret")
        counts = forward.groupBy("trade_date", "symbol").agg(F.count("fwd_ret").alias("f"), F.count_if(size <= MAX_RETURN).alias("ok"), F.count_if(size > MAX_RETURN).alias("x"), F.count_if(F.col("fwd_ret").isNull()).alias("none"))
    held = values.groupBy("trade_date", "symbol").agg(F.count("*").alias("v"))
    of = lambda c, absent=0: F.sum(F.col("v") * F.coalesce(c, F.lit(absent)))
    days = held.join(counts, ["trade_date", "symbol"], "left").groupBy("trade_date").agg(of("ok").alias("n"), of("f").alias("f"), of("none", 1).alias("no_price"), of("x").alias("extreme"))
    return days.agg(
        F.sum("no_price").alias("dropped_no_price"), F.sum("extreme").alias("dropped_extreme"), F.count_if((F.col("f") > 0) & (F.col("n") < min_pool)).alias("skipped_thin_days"), F.count_if(F.col("f") == 0).alias("skipped_no_forward_days")
    )


def _weighted(values: DataFrame, legs: DataFrame, min_pool: int) -> DataFrame:
    """:func:`pools` unpaired: (trade_date, symbol, value, ok, n), a row per value; it stands for ``ok`` rows of the day's ``n``."""
    met = values.join(legs.select("trade_date", "symbol", "ok"), ["trade_date", "symbol"]).where("ok > 0")
    return met.withColumn("n", F.sum("ok").over(Window.partitionBy("trade_date"))).where(F.col("n") >= min_pool)


def average_rank(value: str, day: str = "trade_date", by: Keys = ()):
    """Rank within the day; ties share the mean of their places."""
    w = Window.partitionBy(*by, day)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, day, value)) - 1) / 2


def rank_ic(pool: DataFrame, by: Keys = ()) -> DataFrame:
    """Spearman's correlation per day: by …, trade_date, n, ic; under three names or without variance there is none."""
    ranked = pool.withColumn("rx", average_rank("value", by=by)).withColumn("ry", average_rank("fwd_ret", by=by))
    product = lambda a, b, name: F.sum(F.col(a) * F.col(b)).alias(name)
    s = ranked.groupBy(*by, "trade_date").agg(
        F.count("*").alias("n"), F.sum("rx").alias("sx"), F.sum("ry").alias("sy"), product("rx", "ry", "sxy"), product("rx", "rx", "sxx"), product("ry", "ry", "syy")
    )
    return _correlation(s, by)


def _correlation(s: DataFrame, by: Keys = ()) -> DataFrame:
    cov, vx, vy = (F.col("n") * F.col(a) - F.col(b) * F.col(c) for a, b, c in (("sxy", "sx", "sy"), ("sxx", "sx", "sx"), ("syy", "sy", "sy")))
    scored = s.withColumn("ic", F.round(cov / F.nullif(F.sqrt(vx * vy), F.lit(0.0)), 6))
    return scored.where("n >= 3 AND ic IS NOT NULL").select(*by, "trade_date", "n", "ic")


#: Bands that returns are dealt over, each ranked by itself: this many to a return of 1.
RETURN_BANDS = 1000


def rank_ic_of_legs(values: DataFrame, legs: DataFrame, min_pool: int = 20) -> DataFrame:
    """:func:`rank_ic` of the pool that ``values`` and :func:`return_legs` make, which is never formed.

    A value stands for as many rows as its day and symbol have returns, a return for as many as they have values. Ranks
    come from such weights, and the products from a symbol's sum of ranks, which each of its returns carries. Returns are
    ranked within bands of a day; a band's sums move up by the weights of those below it.
    """
    day = Window.partitionBy("trade_date")
    upto, tied = F.sum("ok").over(day.orderBy("value")), F.sum("ok").over(Window.partitionBy("trade_date", "value"))
    ranked = _weighted(values, legs, min_pool).withColumn("rx", upto - tied / 2 + 0.5)
    by_symbol = ranked.groupBy("trade_date", "symbol").agg(F.count("*").alias("u"), F.sum("rx").alias("a"))
    x = ranked.groupBy("trade_date").agg(F.max("n").alias("n"), F.sum(F.col("ok") * F.col("rx")).alias("sx"), F.sum(F.col("ok") * F.col("rx") * F.col("rx")).alias("sxx"))
    ones = legs.where("ok > 0").join(by_symbol, ["trade_date", "symbol"]).select("trade_date", "u", "a", F.explode("o1s").alias("o1"), "o2s")
    pairs = ones.select("trade_date", "u", "a", "o1", F.explode("o2s").alias("o2")).select("trade_date", "u", "a", _return(F.col("o2"), F.col("o1")).alias("y")).where(F.abs("y") <= MAX_RETURN)
    dealt = pairs.withColumn("band", F.floor(F.col("y") * RETURN_BANDS).cast("int")).repartition("trade_date", "band")
    places = dealt.groupBy("trade_date", "band", "y").agg(F.sum("u").alias("u"), F.sum("a").alias("a"))
    inner = F.sum("u").over(Window.partitionBy("trade_date", "band").orderBy("y")) - F.col("u") / 2 + 0.5
    u, r, a = F.col("u"), F.col("r"), F.col("a")
    bands = places.withColumn("r", inner).groupBy("trade_date", "band").agg(F.sum(u).alias("u"), F.sum(a).alias("a"), F.sum(u * r).alias("ur"), F.sum(u * r * r).alias("urr"), F.sum(a * r).alias("ar"))
    below = F.coalesce(F.sum("u").over(day.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    b = F.col("below")
    y = bands.withColumn("below", below).groupBy("trade_date").agg(
        F.sum(b * u + F.col("ur")).alias("sy"), F.sum(b * b * u + 2 * b * F.col("ur") + F.col("urr")).alias("syy"), F.sum(b * a + F.col("ar")).alias("sxy")
    )
    return _correlation(x.join(y, "trade_date"))


def ic_summary(ic: DataFrame, by: Keys = ()) -> DataFrame:
    """by …, days, mean, sd (0 for one day), icir, t, positive_days."""
    a = ic.groupBy(*by).agg(
        F.count("*").alias("days"), F.avg(F.col("ic").cast("decimal(20,6)")).cast("double").alias("mean"), F.coalesce(F.stddev_samp("ic"), F.lit(0.0)).alias("sd"), F.count_if(F.col("ic") > 0).alias("positive_days")
    )
    icir = F.col("mean") / F.nullif(F.col("sd"), F.lit(0.0))
    t = F.round(icir * F.sqrt(F.col("days").cast("double")), 4)
    return a.select(*by, "days", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round(icir, 4).alias("icir"), t.alias("t"), "positive_days")


def quantile_members(pool: DataFrame, quantiles: int = 5, by: Keys = ()) -> DataFrame:
    """The pool with its slice 0..q-1: n // q names each in order of value and symbol, the rest in the top one."""
    w = Window.partitionBy(*by, "trade_date")
    size = F.floor(F.count("*").over(w) / quantiles)
    numbered = pool.withColumn("rn", F.row_number().over(w.orderBy("value", "symbol")) - 1).withColumn("size", size)
    return numbered.where("size > 0").withColumn("q", F.least(F.expr("rn div size"), F.lit(quantiles - 1))).drop("rn", "size")


def members_of_legs(values: DataFrame, legs: DataFrame, min_pool: int = 20, quantiles: int = 5) -> DataFrame:
    """:func:`quantile_members` of the pool that ``values`` and :func:`return_legs` make, counted: trade_date, symbol, q, n (rows), paid (the sum of their returns).

    A value's rows follow each other, so it goes to the slices that its stretch of the day's places meets. Where a stretch
    meets more than one, its returns are dealt by a hash of their opens, for value and symbol leave that order open.
    """
    w = Window.partitionBy("trade_date").orderBy("value", "symbol").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = _weighted(values, legs, min_pool).withColumn("end", F.sum("ok").over(w)).withColumn("start", F.col("end") - F.col("ok"))
    sized = placed.withColumn("size", F.expr(f"n div {quantiles}")).where("size > 0")
    slice_of = lambda place: F.least(F.expr(f"({place}) div size"), F.lit(quantiles - 1).cast("long"))
    met = sized.select("trade_date", "symbol", "ok", "start", "end", "size", F.explode(F.sequence(slice_of("start"), slice_of("end - 1"))).alias("q"))
    first = F.greatest(F.col("start"), F.col("q") * F.col("size"))
    upto = F.when(F.col("q") < quantiles - 1, F.least(F.col("end"), (F.col("q") + 1) * F.col("size"))).otherwise(F.col("end"))
    parts = met.select("trade_date", "symbol", "ok", F.col("q").cast("int").alias("q"), (first - F.col("start")).alias("skip"), (upto - first).alias("n"))
    units = lambda b, a: F.round(_return(b, a) * 10**8).try_cast("long")  # noqa: E731  returns have eight digits, or are none
    bound = F.round(F.lit(MAX_RETURN) * 10**8).cast("long")
    total = F.aggregate("o1s", F.lit(0).cast("long"), lambda s, a: F.aggregate("o2s", s, lambda t, b: t + F.when(F.abs(units(b, a)) <= bound, units(b, a)).otherwise(F.lit(0).cast("long"))))
    sums = legs.select("trade_date", "symbol", "o1s", "o2s", total.alias("total"))
    drawn = F.flatten(F.transform("o1s", lambda a: F.transform("o2s", lambda b: F.struct(F.xxhash64(a, b).alias("at"), units(b, a).alias("u")))))
    each = F.array_sort(F.filter(drawn, lambda r: F.abs(r["u"]) <= bound))
    own = F.aggregate(F.slice(each, (F.col("skip") + 1).cast("int"), F.col("n").cast("int")), F.lit(0).cast("long"), lambda s, r: s + r["u"])
    paid = F.when(F.col("n") == F.col("ok"), F.col("total")).otherwise(own)
    return parts.join(sums, ["trade_date", "symbol"]).select("trade_date", "symbol", "q", "n", (paid.cast("decimal(20,0)") * F.lit("0.00000001").cast("decimal(8,8)")).cast(_EXACT).alias("paid"))


def _slices(members: DataFrame, by: Keys = ()) -> DataFrame:
    """Per day and slice: size, paid (the sum of its returns), stayed (its rows with one of the same name the day before, counted per pair of them) and size0 (how many it held then; null: none).

    A name remembers when its slice last held it, and how often; what a slice kept is counted from these days, so members are
    counted by name once and never joined with themselves. Only rows of (day, slice, last day) go on.
    """
    n, paid = (F.sum("n"), F.sum("paid")) if "n" in members.columns else (F.count("*"), F.sum(F.col("fwd_ret").cast(_EXACT)))
    names = members.groupBy(*by, "q", "symbol", "trade_date").agg(n.alias("n"), paid.alias("paid"))
    own = Window.partitionBy(*by, "q", "symbol").orderBy("trade_date")
    last = names.withColumn("last", F.lag("trade_date").over(own)).withColumn("pairs", F.col("n") * F.lag("n").over(own))
    parts = last.groupBy(*by, "q", "trade_date", "last").agg(F.sum("n").alias("size"), F.sum("pairs").alias("n"), F.sum("paid").alias("paid"))
    days = parts.groupBy(*by, "q", "trade_date").agg(F.sum("size").alias("size"), F.sum("paid").alias("paid"), F.collect_list(F.struct("last", "n")).alias("held"))
    number = F.date_diff("trade_date", F.lit("1970-01-01").cast("date"))
    before = F.max("trade_date").over(Window.partitionBy(*by).orderBy(number).rangeBetween(Window.unboundedPreceding, -1))  # rows are days and slices
    line = Window.partitionBy(*by, "q").orderBy("trade_date")
    known = days.withColumn("before", before).withColumn("size0", F.when(F.lag("trade_date").over(line) == F.col("before"), F.lag("size").over(line)))
    kept = F.filter("held", lambda h: h["last"] == F.col("before"))
    return known.withColumn("stayed", F.aggregate(kept, F.lit(0).cast("long"), lambda a, h: a + h["n"])).drop("held", "before")


def _with_turnover(slices: DataFrame) -> DataFrame:
    bought = (F.col("size") - F.col("stayed")) / F.col("size")
    sold = F.coalesce((F.col("size0") - F.col("stayed")) / F.nullif(F.col("size0"), F.lit(0)), F.lit(0.0))
    return slices.withColumn("bought", F.round(bought, 6)).withColumn("sold", F.round(sold, 6))


def turnover(members: DataFrame, by: Keys = ()) -> DataFrame:
    """Per day and slice: size, bought (entered / size), sold (left / size of the day before); the first day buys all."""
    return _with_turnover(_slices(members, by)).select(*by, "trade_date", "q", "size", "bought", "sold")


def quantile_portfolios(members: DataFrame, buy_rate: float = 0.00075, sell_rate: float = 0.00125, by: Keys = ()) -> DataFrame:
    """Equal-weight slices per day: gross mean return, net of costs in proportion to what was bought and sold."""
    gross = F.round(F.col("paid").cast("double") / F.col("size"), 8)
    net = F.round(F.col("gross") - F.col("bought") * buy_rate - F.col("sold") * sell_rate, 8)
    return _with_turnover(_slices(members, by)).withColumn("gross", gross).select(*by, "trade_date", "q", "gross", "size", "bought", "sold", net.alias("net"))


def long_short(portfolios: DataFrame, quantiles: int = 5, buy_rate: float = 0.00075, sell_rate: float = 0.00125, by: Keys = ()) -> DataFrame:
    """Top less bottom per day: spread, and net with the short leg's costs mirrored."""
    of = lambda q: F.max(F.when(F.col("q") == q, F.struct("gross", "net", "bought", "sold")))
    both = portfolios.groupBy(*by, "trade_date").agg(of(quantiles - 1).alias("top"), of(0).alias("low")).where("top IS NOT NULL AND low IS NOT NULL")
    spread = F.round(F.col("top.gross") - F.col("low.gross"), 8)
    net = F.round(F.col("top.net") - F.col("low.gross") - F.col("low.bought") * sell_rate - F.col("low.sold") * buy_rate, 8)
    return both.select(*by, "trade_date", spread.alias("spread"), net.alias("net_spread"))


def spread_test(spread: DataFrame) -> DataFrame:
    """days, mean and t of the spread."""
    a = spread.agg(F.count("*").alias("days"), F.avg(F.col("spread").cast("decimal(20,8)")).cast("double").alias("m"), F.stddev_samp("spread").alias("sd"))
    return a.select("days", F.round("m", 6).alias("mean"), F.round(F.col("m") / F.nullif(F.col("sd"), F.lit(0.0)) * F.sqrt(F.col("days").cast("double")), 3).alias("t"))


def tear_sheet(pool: DataFrame, quantiles: int = 5, by: Keys = ()) -> DataFrame:
    """(by …, part, q, days, mean, t) of a pool: the rank IC (part ic), the top less the bottom slice (spread), and each slice after costs (slice, q).

    The pool is read once for the ranks and once for the slices.
    """
    return report(rank_ic(pool, by), quantile_portfolios(quantile_members(pool, quantiles, by), by=by), quantiles, by)


def report(ic: DataFrame, portfolios: DataFrame, quantiles: int = 5, by: Keys = ()) -> DataFrame:
    """:func:`tear_sheet` from the rank IC and the slices of each day."""

    def test(rows: DataFrame, value: str, part: str, *keys: str) -> DataFrame:
        a = rows.groupBy(*by, *keys).agg(F.count("*").alias("days"), F.avg(F.col(value).cast("decimal(20,8)")).cast("double").alias("m"), F.stddev_samp(value).alias("sd"))
        t = F.round(F.col("m") / F.nullif(F.col("sd"), F.lit(0.0)) * F.sqrt(F.col("days").cast("double")), 3)
        q = F.col("q").cast("int") if "q" in keys else F.lit(-1)
        return a.select(*by, F.lit(part).alias("part"), q.alias("q"), "days", F.round("m", 6).alias("mean"), t.alias("t"))

    out = test(ic, "ic", "ic").unionByName(test(long_short(portfolios, quantiles, by=by), "spread", "spread"))
    return out.unionByName(test(portfolios, "net", "slice", "q"))


#: The stamp by which an event counts in each world: when it was known, or (the mistake to be measured) when it happened.
WORLDS = {"pit": "available_at", "non_pit": "event_time"}


def in_both_worlds(events: DataFrame) -> DataFrame:
    """Every event once per world, with the world's stamp: one scan, in which the world is a key like any other."""
    worlds = [F.struct(F.lit(world).alias("world"), F.col(stamp).alias("stamp")) for world, stamp in WORLDS.items()]
    return events.select("*", F.inline(F.array(*worlds)))


def look_ahead(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """How many sessions too early a world without knowledge stamps would use events: sessions_early (null: never known in a session), n, scored.

    The direct evidence: both sessions are looked up in small tables along one scan of the events.
    """
    index = lambda day, name: F.broadcast(sessions.select(F.col("trade_date").alias(day), F.col("session_idx").alias(name)))
    known = session_buckets(events, sessions, WORLDS["pit"]).withColumnRenamed("session", "__known")
    both = session_buckets(known, sessions, WORLDS["non_pit"]).withColumnRenamed("session", "__happened")
    met = both.join(index("__known", "__a"), "__known", "left").join(index("__happened", "__b"), "__happened", "left")
    early = (F.col("__a") - F.col("__b")).alias("sessions_early")
    return met.where("__happened IS NOT NULL").groupBy(early).agg(F.count("*").alias("n"), F.count("score").alias("scored"))


def world_metrics(events: DataFrame, sessions: DataFrame, forward: DataFrame, min_pool: int = 20, quantiles: int = 5) -> DataFrame:
    """(world, metric, value) of the event factor in both worlds: its rank IC, and the curve that its net spread compounds to from 1,000.

    Panel, pools, slices and curves of both worlds are one plan with the world as a key. A world without a day with a pool
    has no rows; a null value means that the metric doesn't exist (a ratio of one day, say).
    """
    by = ("world",)
    pool = pools(event_panel(in_both_worlds(events), sessions, "stamp", by), forward, min_pool, by)
    ic = ic_summary(rank_ic(pool, by), by)
    spread = long_short(quantile_portfolios(quantile_members(pool, quantiles, by), by=by), quantiles, by=by)
    levels = curve(spread, "trade_date", "net_spread", by=by)
    wins = F.round(F.avg((F.col("net_spread") > 0).cast("double")), 6)
    told = performance(levels, "world", "trade_date", "level", 1000.0, F.lit(0.0)).join(spread.groupBy("world").agg(wins.alias("win_rate")), "world")
    final = F.round((1 + F.col("total")) * 1000, 4)
    of_curve = {"days": F.col("n"), "final_equity": final, "total_return": F.col("total"), "annual_return": F.col("annual"), "max_drawdown": F.col("max_drawdown"), "sharpe": F.col("sharpe"), "win_rate": F.col("win_rate")}
    of_ic = {"ic_days": F.col("days"), "ic_mean": F.col("mean"), "icir": F.col("icir")}
    long = lambda rows, metrics: rows.select("world", F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in metrics.items()])))
    return long(told, of_curve).unionByName(long(ic, of_ic))


#: Shares differ in percentage points, levels as a ratio, everything else plainly.
_IN_POINTS = ("total_return", "annual_return", "max_drawdown", "win_rate")


def world_deltas(metrics: DataFrame) -> DataFrame:
    """(metric, pit, non_pit, delta, unit): non_pit against pit, null where either is null; unit is ``pp``, ``ratio`` (final equity) or ``abs``.

    The final equity is compared as a ratio, for it is above zero wherever a curve survives, while returns may be near zero; those differ in points.
    """
    of = lambda world: F.max(F.when(F.col("world") == world, F.col("value"))).alias(world)
    both = metrics.groupBy("metric").agg(of("pit"), of("non_pit"))
    unit = F.when(F.col("metric") == "final_equity", "ratio").when(F.col("metric").isin(*_IN_POINTS), "pp").otherwise("abs")
    gap = F.col("non_pit") - F.col("pit")
    delta = F.when(F.col("unit") == "ratio", F.col("non_pit") / F.nullif(F.col("pit"), F.lit(0.0)) - 1).when(F.col("unit") == "pp", gap * 100).otherwise(gap)
    return both.withColumn("unit", unit).select("metric", "pit", "non_pit", F.round(delta, 6).alias("delta"), "unit")
