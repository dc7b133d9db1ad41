"""Which days a run covers: lookups in the market's sessions, and windows with their defaults and what is wrong with them.

Nothing here asks the driver: bounds are one-row aggregates inside the plan, sessions a table with a row per trading day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _calendar(sessions: DataFrame) -> DataFrame:
    """One row: the sessions as a sorted array, for lookups by position. It has an entry per trading day, whatever the market's size."""
    return sessions.agg(F.array_sort(F.collect_set("trade_date")).alias("__days"))


def placed(rows: DataFrame, day: str, sessions: DataFrame, guard: bool = True) -> DataFrame:
    """``rows`` with the sessions around ``day``: on_or_before and before_idx, on_or_after and after_idx (from 0), and the calendar for :func:`shifted`.

    A day outside the calendar raises, for a guess about days that nobody froze would be worse; without ``guard`` it has nulls.
    """
    upto = F.size(F.filter("__days", lambda d: d <= F.col(day)))
    held = F.array_contains("__days", F.col(day))
    out_of_range = F.concat(F.lit("outside the calendar: "), F.col(day).cast("string"))
    inside = (F.col(day) >= F.element_at("__days", 1)) & (F.col(day) <= F.element_at("__days", -1))
    known = F.when(inside | F.col(day).isNull(), F.col(day)).otherwise(F.raise_error(out_of_range).cast("date")) if guard else F.when(inside, F.col(day))
    met = rows.crossJoin(F.broadcast(_calendar(sessions))).withColumn("__day", known)
    before = F.when(F.col("__day").isNotNull(), upto - 1)
    found = met.withColumn("before_idx", before.cast("long")).withColumn("after_idx", F.when(held, F.col("before_idx")).otherwise(F.col("before_idx") + 1)).drop("__day")
    return found.withColumn("on_or_before", shifted("before_idx", 0)).withColumn("on_or_after", shifted("after_idx", 0))


def shifted(index: str, n: int) -> Column:
    """The session ``n`` after (or, below zero, before) that of ``index``; null beyond the calendar."""
    at = F.col(index) + n
    return F.when(at >= 0, F.get("__days", at.cast("int")))


def run_windows(asked: DataFrame, bars: DataFrame, events: DataFrame | None = None, padding: int = 60) -> DataFrame:
    """``asked`` (symbol, start, end; both may be null) → symbol, start, end, padded_start, problem.

    The end is the symbol's last bar unless asked for; the start its first bar or, where ``events`` matter, its first event
    if that is later. Indicators look back to padded_start, ``padding`` days before the first day. problem is null,
    ``no_bars``, ``before_corpus`` (asked to start before the first event or bar of all) or ``empty`` (starts after it ends).
    """
    of_bars = bars.groupBy("symbol").agg(F.min("trade_date").alias("first_bar"), F.max("trade_date").alias("last_bar"))
    met = asked.join(of_bars, "symbol", "left")
    corpus = bars.agg(F.min("trade_date").alias("corpus_start"))
    if events is not None:
        first = events.select(F.explode("symbols").alias("symbol"), F.to_date("event_time").alias("day")).groupBy("symbol").agg(F.min("day").alias("first_event"))
        met = met.join(first, "symbol", "left")
        corpus = corpus.crossJoin(events.agg(F.min(F.to_date("event_time")).alias("e"))).select(F.greatest("corpus_start", "e").alias("corpus_start"))
    else:
        met = met.withColumn("first_event", F.lit(None).cast("date"))
    met = met.crossJoin(F.broadcast(corpus))
    start, end = F.coalesce("start", F.greatest("first_bar", "first_event")), F.coalesce("end", "last_bar")
    problem = F.when(F.col("first_bar").isNull(), "no_bars").when(F.col("start") < F.col("corpus_start"), "before_corpus").when(start > end, "empty")
    padded = F.date_sub(F.coalesce("start", "first_bar"), padding)
    return met.select("symbol", start.alias("start"), end.alias("end"), padded.alias("padded_start"), problem.alias("problem"))


def factor_windows(asked: DataFrame, bars: DataFrame, events: DataFrame, longest: int = 750) -> DataFrame:
    """``asked`` (…, start, end; both may be null) with the window resolved, and problem in place of an error.

    Defaults are the first day of events and the last day of bars. problem is null, ``before_corpus``, ``after_bars``,
    ``reversed`` or ``too_long`` (over ``longest`` days), the first that holds.
    """
    bounds = events.agg(F.min(F.to_date("event_time")).alias("__first")).crossJoin(bars.agg(F.max("trade_date").alias("__last")))
    met = asked.crossJoin(F.broadcast(bounds)).withColumn("start", F.coalesce("start", "__first")).withColumn("end", F.coalesce("end", "__last"))
    problem = F.when(F.col("start") < F.col("__first"), "before_corpus").when(F.col("end") > F.col("__last"), "after_bars").when(F.col("start") > F.col("end"), "reversed").when(F.date_diff("end", "start") > longest, "too_long")
    return met.withColumn("problem", problem).drop("__first", "__last")
