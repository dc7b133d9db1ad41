"""Orders, fills and round trips: limit bands, the event feed of bars, pairing, marking, attribution, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from .market import priced


def bands(raw_bars: DataFrame) -> DataFrame:
    """(symbol, trade_date, up, down) from the raw close before; the first bar, or an unknown board, has none."""
    prev = F.lag("close").over(Window.partitionBy("symbol").orderBy("trade_date"))
    up, down = rules.band(F.col("prev"), rules.board_limit(F.col("symbol")))
    return priced(raw_bars).withColumn("prev", prev).select("symbol", "trade_date", up.alias("up"), down.alias("down"))


def fed_events(bars: DataFrame, events: DataFrame, stamp: str = "available_at") -> DataFrame:
    """(event_id, symbol, trade_date): the first priced bar *of its own symbol* that sees an event (stamp not after its 15:00).

    An event of a closed or halted day waits for the symbol's next bar; one after its last bar has none and is left out.
    Bars and events of a symbol are one sorted run, read from its end: no range join.
    """
    marks = priced(bars).select("symbol", rules.bar_cutoff(F.col("trade_date")).alias("t"), F.lit(1).alias("bar"), "trade_date", F.lit(None).cast("long").alias("event_id"))
    asked = events.select(F.explode("symbols").alias("symbol"), F.col(stamp).alias("t"), F.lit(0).alias("bar"), F.lit(None).cast("date").alias("trade_date"), F.col("event_id").cast("long").alias("event_id")).where("t IS NOT NULL")
    back = Window.partitionBy("symbol").orderBy(F.desc("t"), F.desc("bar"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    met = marks.unionByName(asked).withColumn("first_bar", F.last("trade_date", ignorenulls=True).over(back))
    return met.where("bar = 0 AND first_bar IS NOT NULL").select("event_id", "symbol", F.col("first_bar").alias("trade_date"))


def fed_bars(bars: DataFrame, events: DataFrame, stamp: str = "available_at") -> DataFrame:
    """Bars that are the first to see some event: symbol, trade_date, n events, best decoded score of the bullish ones (null: none)."""
    seen = fed_events(bars, events, stamp).join(events.select(F.col("event_id").cast("long").alias("event_id"), "direction", "score"), "event_id")
    return seen.groupBy("symbol", "trade_date").agg(F.count("*").alias("n"), F.max(F.when(F.col("direction") == "bullish", F.col("score"))).alias("bullish"))


def trips(fills: DataFrame, by: tuple[str, ...] = ("account", "symbol")) -> DataFrame:
    """Fills (id, trade_date, side, qty, price, fees) → round trips: a sell closes the buy right before it.

    In order of date, buys first, then id; a later buy takes the place of one that is open, a sell without a buy is none.
    The sell's own quantity, price and fees make the proceeds; the trip's qty and cost are those of the buy.
    """
    w = Window.partitionBy(*by).orderBy("trade_date", F.when(F.col("side") == "buy", 0).otherwise(1), "id")
    now = F.struct("side", "trade_date", "qty", "price", "fees", "id")
    seen = fills.withColumn("prev", F.lag(now).over(w)).withColumn("next", F.lead("side").over(w))
    cost = F.col("prev.price") * F.col("prev.qty") + F.col("prev.fees")
    pnl = F.col("price") * F.col("qty") - F.col("fees") - cost
    closed = seen.where("side = 'sell' AND prev.side = 'buy'").select(
        *by, F.col("prev.id").alias("entry_id"), F.col("id").alias("exit_id"), F.col("prev.trade_date").alias("entry_date"), F.col("trade_date").alias("exit_date"), F.col("prev.qty").alias("qty"),
        F.round(cost, 4).alias("cost"), F.round(pnl, 4).alias("pnl"), F.round(pnl / F.nullif(cost, F.lit(0.0)), 6).alias("return_pct"),
    )
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    opened = seen.where("side = 'buy' AND next IS NULL").select(
        *by, F.col("id").alias("entry_id"), nothing("long", "exit_id"), F.col("trade_date").alias("entry_date"), nothing("date", "exit_date"), "qty",
        F.round(F.col("price") * F.col("qty") + F.col("fees"), 4).alias("cost"), nothing("double", "pnl"), nothing("double", "return_pct"),
    )
    return closed.unionByName(opened)


def marked(paired: DataFrame, closes: DataFrame) -> DataFrame:
    """Open trips with their floating pnl at the last close (symbol, close) that the caller took at its decision day; without one it stays null."""
    close = closes.select("symbol", F.col("close").alias("last_close")).where("last_close > 0")
    met = paired.join(close, "symbol", "left")
    floating = F.when(F.col("exit_id").isNull(), F.col("last_close") * F.col("qty") - F.col("cost"))
    pnl = F.coalesce("pnl", F.round(floating, 4))
    return met.withColumn("pnl", pnl).withColumn("return_pct", F.coalesce("return_pct", F.round(floating / F.nullif(F.col("cost"), F.lit(0.0)), 6))).drop("last_close")


def to_settle(paired: DataFrame, stored: DataFrame) -> DataFrame:
    """What of ``paired`` has to be written: trips that ``stored`` (entry_id, exit_id, as_of) lacks, or has as open with another close or an earlier ``as_of``; closed ones are final."""
    was = stored.select(F.col("entry_id"), F.col("exit_id").alias("was_exit"), F.col("as_of").alias("was_as_of"), F.lit(True).alias("known"))
    met = paired.join(was, "entry_id", "left")
    stale = F.col("known").isNull() | (F.col("was_exit").isNull() & (F.col("exit_id").isNotNull() | (F.col("was_as_of") < F.col("as_of"))))
    return met.where(stale).drop("was_exit", "was_as_of", "known")


def trip_alpha(closed: DataFrame, daily: DataFrame, sessions: DataFrame) -> DataFrame:
    """Closed trips with the market's compounded return over the sessions from entry to exit, and alpha in percentage points."""
    level = F.product(1 + F.coalesce(F.col("avg_pct"), F.lit(0.0)) / 100).over(Window.orderBy("session_idx").rowsBetween(Window.unboundedPreceding, 0))
    levels = daily.join(sessions, "trade_date").withColumn("level", level).withColumn("before", F.coalesce(F.lag("level").over(Window.orderBy("session_idx")), F.lit(1.0)))  # a row per session
    entry = levels.select(F.col("trade_date").alias("entry_date"), "before")
    exit_ = levels.select(F.col("trade_date").alias("exit_date"), "level")
    both = closed.join(entry, "entry_date").join(exit_, "exit_date")
    market = F.col("level") / F.col("before") - 1
    return both.select(*closed.columns, F.round(market, 6).alias("market_return"), F.round((F.col("return_pct") - market) * 100, 2).alias("alpha_pp"))


def attribution(paired: DataFrame, key) -> DataFrame:
    """Trips per key: trips, closed, wins, realised pnl."""
    return paired.groupBy(key).agg(F.count("*").alias("trips"), F.count("exit_id").alias("closed"), F.count_if(F.col("exit_id").isNotNull() & (F.col("pnl") > 0)).alias("wins"), F.coalesce(F.sum(F.when(F.col("exit_id").isNotNull(), F.col("pnl")).cast("decimal(28,4)")), F.lit(0)).cast("double").alias("realised"))


def signal_attribution(paired: DataFrame, sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """Trips by what drove their buys: kind (direction or industry), name, trips, closed, wins, realised.

    ``sources`` (entry_id, event_id) says which event led to a buy, ``evidence`` (event_id, direction, industries) what
    that was. A trip without a known event counts as ``no_event``, one without a direction as ``unknown``; an event of
    several industries counts for each.
    """
    met = paired.join(sources, "entry_id", "left").join(evidence.withColumn("known", F.lit(True)), "event_id", "left")
    direction = met.select(F.lit("direction").alias("kind"), F.when(F.col("known").isNull(), "no_event").otherwise(F.coalesce("direction", F.lit("unknown"))).alias("name"), "exit_id", "pnl")
    industry = met.where("known").select(F.lit("industry").alias("kind"), F.explode("industries").alias("name"), "exit_id", "pnl")
    return direction.unionByName(industry).groupBy("kind", "name").agg(
        F.count("*").alias("trips"), F.count("exit_id").alias("closed"), F.count_if(F.col("exit_id").isNotNull() & (F.col("pnl") > 0)).alias("wins"), F.coalesce(F.sum(F.when(F.col("exit_id").isNotNull(), F.col("pnl")).cast("decimal(28,4)")), F.lit(0)).cast("double").alias("realised")
    )


def rejects(items: DataFrame) -> DataFrame:
    """Rejected orders per code: code, n; those without a code aren't counted."""
    return items.where("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("n"))


def best_cell(cells: DataFrame) -> DataFrame:
    """The cell with the best Sharpe ratio among those that ran (status ok), then the best total return, then the first; none has one: no row."""
    return cells.where("status = 'ok' AND sharpe IS NOT NULL").orderBy(F.desc("sharpe"), F.desc_nulls_last("total_return"), "cell").limit(1)


def gate_buys(orders: DataFrame, costs: rules.Costs = rules.Costs(), max_position: float = 0.2, max_gross: float = 0.8, max_drawdown: float = 0.2) -> DataFrame:
    """Risk gates on proposed buys: action (block, cap or pass), reason (the gate, null for pass) and allowed shares.

    ``orders`` have qty, budget, price, equity, market_value, symbol_value, pending, drawdown (a fraction, may be null),
    has_position, stop_loss_pending. Hard gates come first: position_open, stop_loss_pending, drawdown (also without any
    equity). Then the smaller room of concentration and gross_exposure, and the budget, are spent on whole lots with their
    fees; less than one lot is a block, less than asked for a cap;
    what passes gets all lots that the budget pays for.
    """
    room = lambda share, taken: F.greatest(F.col("equity") * share - taken, F.lit(0.0))
    of_symbol, of_all = room(max_position, F.col("symbol_value")), room(max_gross, F.col("market_value") + F.col("pending"))
    hard = F.when(F.col("has_position"), "position_open").when(F.col("stop_loss_pending"), "stop_loss_pending").when((F.col("equity") <= 0) | (F.col("drawdown") >= max_drawdown), "drawdown")
    gate = F.when(of_symbol <= of_all, "concentration").otherwise("gross_exposure")
    told = orders.withColumn("hard", hard).withColumn("gate", gate).withColumn("lots", rules.affordable_lots(F.least("budget", of_symbol, of_all), F.col("price"), costs))
    blocked = F.col("hard").isNotNull() | (F.col("lots") < rules.LOT)
    action = F.when(blocked, "block").when(F.col("lots") < F.col("qty"), "cap").otherwise("pass")
    told = told.withColumn("action", action)
    return told.withColumn("allowed", F.when(F.col("action") == "block", F.lit(0)).otherwise(F.col("lots")).cast("long")).withColumn("reason", F.when(F.col("action") != "pass", F.coalesce("hard", "gate"))).drop("hard", "gate", "lots")


#: The namespace of identifiers made from addresses, as RFC 9562 gives it (a fixed value).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def decision_ids(decisions: DataFrame) -> DataFrame:
    """Decisions with an id that follows from account, day, symbol and side (a version-5 UUID): a SHA-1 with two fields set."""
    name = F.concat_ws("|", "account", F.col("decided_on").cast("string"), "symbol", "side")
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(part(17, 1), 16, 10).cast("int") % 4 + 1))
    return decisions.withColumn("decision_id", F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12)))
