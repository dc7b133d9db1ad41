"""Bar and event queries: scans, cross-sections, breadth, sectors, feeds, as-of joins, name rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules

PRICES = ("open", "high", "low", "close")
SORT_KEYS = ("symbol", "close", "volume", "amount", "change_pct")


def priced(bars: DataFrame) -> DataFrame:
    """Bars that take part: all four prices are there."""
    keep = F.lit(True)
    for c in PRICES:
        keep &= F.col(c).isNotNull()
    return bars.where(keep)


def in_order(bars: DataFrame) -> list[str]:
    """What a symbol's bars are ordered by: the day, and where several have one day, the close and what else there is, so that reruns agree."""
    return ["trade_date", *[c for c in ("close", "open", "high", "low", "volume", "amount") if c in bars.columns]]


def of_adjustment(bars: DataFrame, adjust: str | None) -> DataFrame:
    """One adjustment's bars; None: all."""
    return bars if adjust is None else bars.where(F.col("adjustment") == adjust)


def symbol_bars(bars: DataFrame, symbols: list[str], start=None, end=None, adjust: str = "qfq") -> DataFrame:
    """Priced bars of some symbols in an inclusive window; no symbols, no rows."""
    out = priced(of_adjustment(bars, adjust)).where(F.col("symbol").isin(*symbols) if symbols else F.lit(False))
    out = out if start is None else out.where(F.col("trade_date") >= F.lit(start).cast("date"))
    return out if end is None else out.where(F.col("trade_date") <= F.lit(end).cast("date"))


def visible(events: DataFrame, as_of, pit: bool = True) -> DataFrame:
    """Events known at ``as_of``, inclusive; a null stamp is never visible. Without ``pit`` the event's own time counts."""
    return events.where(F.col("available_at" if pit else "event_time") <= F.lit(as_of).cast("timestamp_ntz"))


def of_symbols(events: DataFrame, symbols: list[str], start=None, end=None) -> DataFrame:
    """Events that name any of the symbols, in an inclusive window of event_time; a row stays one row."""
    out = events.where(F.arrays_overlap("symbols", F.array(*[F.lit(s) for s in symbols])) if symbols else F.lit(False))
    out = out if start is None else out.where(F.col("event_time") >= F.lit(start).cast("timestamp_ntz"))
    return out if end is None else out.where(F.col("event_time") <= F.lit(end).cast("timestamp_ntz"))


def page(rows: DataFrame, keys: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of an order that ends in a unique key."""
    return rows.orderBy(*keys).offset(offset).limit(limit)


def latest_date(bars: DataFrame, adjust: str = "qfq") -> DataFrame:
    return priced(of_adjustment(bars, adjust)).agg(F.max("trade_date").alias("trade_date"))


def with_change(bars: DataFrame) -> DataFrame:
    """Priced bars with prev_close and change_pct (percent, six digits), over each symbol's own priced bars; stored ones are taken as they are."""
    if {"prev_close", "change_pct"} <= set(bars.columns):
        return priced(bars)
    w = Window.partitionBy("symbol", "adjustment").orderBy(*in_order(bars))
    prev = F.lag("close").over(w)
    return priced(bars).withColumn("prev_close", prev).withColumn("change_pct", F.round((F.col("close") / F.nullif(prev, F.lit(0.0)) - 1) * 100, 6))


def on_day(bars: DataFrame, trade_date) -> DataFrame:
    """The bars of one day; where the table is stored by year, only that year's files are read."""
    day = F.lit(trade_date).cast("date")
    return bars.where((F.col("trade_date") == day) & (F.col("year") == F.year(day)) if "year" in bars.columns else F.col("trade_date") == day)


def cross_section(changed: DataFrame, trade_date, sort: str = "change_pct", descending: bool = True, limit: int = 50, offset: int = 0, among: DataFrame | None = None) -> DataFrame:
    """One day's rows by a whitelisted key, nulls last both ways, then by symbol; ``among`` (symbol) restricts them."""
    if sort not in SORT_KEYS:
        raise ValueError(f"can't sort by {sort!r}")
    day = on_day(changed, trade_date)
    day = day if among is None else day.join(among, "symbol", "left_semi")
    key = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return page(day, [key, F.col("symbol").asc()], limit, offset)


def breadth(changed: DataFrame) -> DataFrame:
    """Per day: total, up, down, flat, without_pct, amount."""
    pct = F.col("change_pct")
    return changed.groupBy("trade_date").agg(
        F.count("*").alias("total"),
        F.count_if(pct > 0).alias("up"),
        F.count_if(pct < 0).alias("down"),
        F.count_if(pct == 0).alias("flat"),
        F.count_if(pct.isNull()).alias("without_pct"),
        F.sum(F.col("amount").cast("decimal(38,2)")).cast("double").alias("amount"),
    )


def tags(events: DataFrame) -> DataFrame:
    """(industry, symbol) of events, each pair once: every industry of an event with every symbol of it."""
    return events.select(F.explode("industries").alias("industry"), "symbols").select("industry", F.explode("symbols").alias("symbol")).distinct()


def sector_performance(changed: DataFrame, events: DataFrame, trade_date, as_of, min_symbols: int = 3) -> DataFrame:
    """Per industry, of its symbols' bars on a day: n, amount, avg_pct, median_pct; tags are those known at ``as_of``."""
    day = on_day(changed, trade_date).where(F.col("change_pct").isNotNull()).select("symbol", "change_pct", "amount")
    met = tags(visible(events, as_of)).join(day, "symbol")
    out = met.groupBy("industry").agg(
        F.count("*").alias("n"),
        F.sum(F.col("amount").cast("decimal(38,2)")).cast("double").alias("amount"),
        F.round(F.sum(F.col("change_pct").cast("decimal(28,6)")).cast("double") / F.count("*"), 4).alias("avg_pct"),
        F.round(F.median("change_pct"), 4).alias("median_pct"),
    )
    return out.where(F.col("n") >= min_symbols).orderBy(F.desc("avg_pct"), F.desc("n"), "industry")


def symbol_ranks(changed: DataFrame, trade_date) -> DataFrame:
    """Rank on a day by change and amount, nulls last: symbol, rank, total, percentile = (total - rank + 1) / total."""
    day = on_day(changed, trade_date)
    w = Window.partitionBy("trade_date").orderBy(F.col("change_pct").desc_nulls_last(), F.col("amount").desc_nulls_last())
    ranked = day.select("symbol", "trade_date", F.rank().over(w).alias("rank"), F.count("*").over(Window.partitionBy("trade_date")).alias("total"))
    return ranked.select("symbol", "rank", "total", F.round((F.col("total") - F.col("rank") + 1) / F.col("total"), 6).alias("percentile"))


def event_days(events: DataFrame, high: float = 80.0) -> DataFrame:
    """Per calendar day and type: events and those of high importance; days without events are absent."""
    return events.groupBy(F.to_date("event_time").alias("day"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("importance_score") >= high).alias("n_high"))


def market_daily(changed: DataFrame, bound: float = 30.0) -> DataFrame:
    """Equal-weight mean change per day of those within the bound, and how many were kept and dropped."""
    pct = F.col("change_pct")
    kept = pct.isNotNull() & (F.abs(pct) <= bound)
    return changed.groupBy("trade_date").agg(
        F.round(F.sum(F.when(kept, pct.cast("decimal(28,6)"))).cast("double") / F.nullif(F.count_if(kept), F.lit(0)), 6).alias("avg_pct"),
        F.count_if(kept).alias("kept"),
        F.count_if(pct.isNotNull() & ~kept).alias("dropped"),
    )


def coverage(rows: DataFrame, day: Column) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def session_buckets(events: DataFrame, sessions: DataFrame, stamp: str = "available_at") -> DataFrame:
    """Events with the first session whose 15:00 is not before the stamp; those after the last session, or without a stamp, have none (null).

    A forward as-of join without a range join: each stamp's day is one bucket, looked up in a table of calendar days
    that the sessions fill backwards. The table has a row per day of the calendar, whatever the number of events.
    """
    day = F.when(F.col(stamp) <= rules.bar_cutoff(F.to_date(stamp)), F.to_date(stamp)).otherwise(F.date_add(F.to_date(stamp), 1))
    ends = sessions.select("trade_date", F.lag("trade_date").over(Window.orderBy("trade_date")).alias("before"))
    first = F.date_add(F.coalesce("before", F.date_sub("trade_date", 0)), F.when(F.col("before").isNull(), 0).otherwise(1))
    days = ends.select(F.col("trade_date").alias("session"), F.explode(F.sequence(first, F.col("trade_date"))).alias("__day"))
    first_session = sessions.agg(F.min("trade_date").alias("__first"))
    due = events.join(F.broadcast(first_session), F.lit(True)).withColumn("__due", F.when(F.col(stamp).isNotNull(), F.greatest(day, "__first")))  # one row
    return due.join(days, F.col("__due") == F.col("__day"), "left").drop("__due", "__day", "__first")


def closes_through(bars: DataFrame, through, adjust: str = "qfq") -> DataFrame:
    """Each symbol's last close at or before a date; only the close must be there."""
    rows = of_adjustment(bars, adjust).where(F.col("close").isNotNull() & (F.col("trade_date") <= F.lit(through).cast("date")))
    return rows.groupBy("symbol").agg(F.max(F.struct("trade_date", "close")).alias("m")).select("symbol", "m.trade_date", "m.close")


def day_closes(bars: DataFrame, sessions: DataFrame, trade_date, adjust: str = "raw") -> DataFrame:
    """A day's closes with those of the session before; a symbol that didn't trade then has none."""
    at = sessions.where(F.col("trade_date") <= F.lit(trade_date).cast("date")).orderBy(F.desc("trade_date")).limit(2)
    two = priced(of_adjustment(bars, adjust)).join(F.broadcast(at), "trade_date")  # two sessions
    w = Window.partitionBy("symbol").orderBy(*in_order(two))
    return two.withColumn("prev_close", F.lag("close").over(w)).where(F.col("trade_date") == F.lit(trade_date).cast("date")).select("symbol", "close", "prev_close")


def limit_counts(closes: DataFrame) -> DataFrame:
    """How many closes are at the limits: up, down, judged, skipped."""
    up, down = rules.band(F.col("prev_close"), rules.board_limit(F.col("symbol")))
    state = rules.limit_state(F.col("close"), up, down)
    return closes.select(state.alias("s")).agg(*[F.count_if(F.col("s") == s).alias(s) for s in ("up", "down", "skipped")], F.count_if(F.col("s") != "skipped").alias("judged"))


def name_rows(observed: DataFrame) -> DataFrame:
    """(symbol, name, seen_at) → the dictionary: symbol, name, count, first_seen, last_seen."""
    return observed.groupBy("symbol", "name").agg(F.count("*").alias("count"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))


def primary_names(dictionary: DataFrame) -> DataFrame:
    """The most frequent name of each symbol; then the one seen last, then the one seen first earliest, then by name."""
    return _named(dictionary, "count", "last_seen")


def names_as_of(dictionary: DataFrame, as_of) -> DataFrame:
    """The name in force: of those seen first at or before ``as_of``, the one seen last, then the more frequent, then the one seen first earliest, then by name."""
    return _named(dictionary.where(F.col("first_seen") <= F.lit(as_of).cast("timestamp_ntz")), "last_seen", "count")


def _named(dictionary: DataFrame, *order: str) -> DataFrame:
    early = F.timestamp_diff("MICROSECOND", F.col("first_seen").cast("timestamp_ntz"), F.lit("2200-01-01").cast("timestamp_ntz"))
    return dictionary.groupBy("symbol").agg(F.max(F.struct(*order, early.alias("early"), "name")).alias("m")).select("symbol", "m.name")


def warned_symbols(dictionary: DataFrame) -> DataFrame:
    """Symbols whose most frequent name is a risk warning."""
    from ..functions.text import is_st

    return primary_names(dictionary).where(is_st(F.col("name"))).select("symbol")


def matched_symbols(named: DataFrame, query: str) -> DataFrame:
    """(symbol, name) whose code begins with a query or whose name contains it."""
    return named.where(F.col("symbol").startswith(query) | F.contains(F.col("name"), F.lit(query)))


def event_detail(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """(event_id, day) → the event of that id on that day, or, where the day is null, the id's latest; ids without one are left out."""
    asked = wanted.select(F.col("event_id").alias("asked"), F.col("day").alias("asked_day"))
    met = events.join(asked, (F.col("event_id") == F.col("asked")) & (F.col("asked_day").isNull() | (F.to_date("event_time") == F.col("asked_day"))))
    newest = Window.partitionBy("asked", "asked_day").orderBy(F.desc("event_time"), F.desc("available_at"))
    return met.withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn", "asked").withColumnRenamed("asked_day", "day")


def events_by_id(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """All rows of the events whose id ``wanted`` (event_id, day) has, on the days asked for."""
    keys = wanted.select("event_id", "day").distinct()
    return events.withColumn("day", F.to_date("event_time")).join(keys, ["event_id", "day"], "left_semi")


def month_window(end: Column, months: int) -> Column:
    """The first day of a window that ends at ``end``: so many months before, at the month's end if it is shorter."""
    return F.add_months(end, -months)


def truncated_feed(rows: DataFrame, stamp: str, key: str, limit: int) -> DataFrame:
    """The newest ``limit`` rows in ascending order, each with ``truncated``: whether there were more."""
    newest = rows.orderBy(F.desc(stamp), F.desc(key)).limit(limit + 1).withColumn("nth", F.row_number().over(Window.orderBy(F.desc(stamp), F.desc(key))))  # limit + 1 rows
    return newest.withColumn("truncated", F.max("nth").over(Window.partitionBy()) > limit).where(F.col("nth") <= limit).orderBy(stamp, key).drop("nth")


def tag_coverage(day_bars: DataFrame, events: DataFrame, as_of) -> DataFrame:
    """How many of a day's priced symbols have any industry tag known at ``as_of``: total, covered."""
    tagged = visible(events, as_of).where(F.size("industries") > 0).select(F.explode("symbols").alias("symbol")).distinct().withColumn("tagged", F.lit(1))
    return priced(day_bars).join(tagged, "symbol", "left").agg(F.count("*").alias("total"), F.count("tagged").alias("covered"))


def delisting_evidence(stopped: DataFrame, events: DataFrame, strong: str, weak: str) -> DataFrame:
    """Stopped symbols (symbol, last_day) from the events' first day on, with their best title: symbol, last_day, title, strength.

    Strength 2: the title has ``strong``, 1: it has ``weak``; no such title: null (unexplained). Ties go by title.
    """
    first = events.agg(F.min(F.to_date("event_time")).alias("first_day"))  # one row
    candidates = stopped.join(F.broadcast(first), F.col("last_day") >= F.col("first_day")).select("symbol", "last_day")
    strength = F.when(F.contains(F.col("title"), F.lit(strong)), 2).when(F.contains(F.col("title"), F.lit(weak)), 1)
    told = events.select(F.explode("symbols").alias("symbol"), "title", strength.alias("strength")).where("strength IS NOT NULL").groupBy("symbol").agg(F.max(F.struct("strength", "title")).alias("m"))
    return candidates.join(told, "symbol", "left").select("symbol", "last_day", "m.title", "m.strength")


def resolved_evidence(snapshots: DataFrame, corpus: DataFrame) -> DataFrame:
    """Snapshots (owner, event_id, day, content_hash) against the corpus (event_id, day, content_hash): per (event_id, day) found, revised and the owners in order."""
    held = snapshots.groupBy("event_id", "day").agg(F.max("content_hash").alias("was"), F.array_sort(F.collect_set("owner")).alias("owners"))  # owners of one event
    now = corpus.select("event_id", "day", F.col("content_hash").alias("now"), F.lit(True).alias("there"))
    return held.join(now, ["event_id", "day"], "left").select("event_id", "day", F.col("there").isNotNull().alias("found"), F.coalesce(F.col("was") != F.col("now"), F.lit(False)).alias("revised"), "owners")


def capped_payload(hits: DataFrame, by: str, rank: str, body: str, most_bytes: int) -> DataFrame:
    """The best hits of each query whose bodies together have at most ``most_bytes``, with ``dropped``: whether the lowest ranks had to go."""
    w = Window.partitionBy(by)
    run = F.sum(F.octet_length(body)).over(w.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    sized = hits.withColumn("bytes", run).withColumn("dropped", F.max("bytes").over(w) > most_bytes)
    return sized.where(F.col("bytes") <= most_bytes)


def date_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Dates that only one side has: trade_date, side."""
    a, b = left.select("trade_date").distinct().withColumn("a", F.lit(1)), right.select("trade_date").distinct().withColumn("b", F.lit(1))
    return a.join(b, "trade_date", "full_outer").where("a IS NULL OR b IS NULL").select("trade_date", F.when(F.col("a").isNull(), "right").otherwise("left").alias("side"))


def merged_evidence(rows: DataFrame, roles: list[str]) -> DataFrame:
    """Evidence of several roles, each (event_id, day) once: by the first role in order; ``copies`` counts the others."""
    order = F.array_position(F.array(*[F.lit(r) for r in roles]), F.col("role"))
    return rows.groupBy("event_id", "day").agg(F.min_by("role", order).alias("role"), (F.count("*") - 1).alias("copies"))


def delisted(bars: DataFrame, days: int = 30) -> DataFrame:
    """Symbols whose last priced bar is over ``days`` before the data's end: symbol, last_day."""
    last = priced(bars).groupBy("symbol").agg(F.max("trade_date").alias("last_day"))
    end = last.agg(F.max("last_day").alias("end"))  # one row
    return last.join(F.broadcast(end), F.date_add("last_day", days) < F.col("end")).select("symbol", "last_day")
