"""Data quality: each check is a row (id, level, failing); one that can't run doesn't hide the others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .market import PRICES, date_differences, with_change

STEP_TOLERANCE, STEP_BOUND, ENVELOPE = 0.011, 31.0, 0.10
LEVELS = ("info", "warn", "error")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, and how many."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def null_counts(bars: DataFrame) -> DataFrame:
    """Nulls per column in one pass, and rows that traded without a price."""
    return bars.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in (*PRICES, "volume", "amount")], F.count_if((F.col("volume") > 0) & F.col("close").isNull()).alias("traded_unpriced"))


def unpriced(bars: DataFrame) -> DataFrame:
    """Bars without a close per adjustment: unpriced, symbols, first_day, last_day; an adjustment without such bars is absent."""
    return bars.where("close IS NULL").groupBy("adjustment").agg(F.count("*").alias("unpriced"), F.count_distinct("symbol").alias("symbols"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"))


def partition_differences(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Days (date, rows) of a manifest against the partitions found: date, state (missing, extra or mismatched)."""
    told, there = manifest.select("date", F.col("rows").alias("told")), found.select("date", F.col("rows").alias("there"))
    state = F.when(F.col("there").isNull(), "missing").when(F.col("told").isNull(), "extra").when(F.col("told") != F.col("there"), "mismatched")
    return told.join(there, "date", "full_outer").select("date", state.alias("state")).where("state IS NOT NULL")


def freshness(last_seen: DataFrame, now, warn_days: int, error_days: int) -> DataFrame:
    """(scope, last_day) → scope, age in days at ``now``, level: ok, warn from ``warn_days``, error from ``error_days`` or without a day."""
    age = F.date_diff(F.lit(now).cast("date"), F.col("last_day"))
    return last_seen.select("scope", age.alias("age"), F.when(age.isNull() | (age >= error_days), "error").when(age >= warn_days, "warn").otherwise("ok").alias("level"))


def day_count_differences(index: DataFrame, corpus: DataFrame) -> DataFrame:
    """Documents per day in an index and in the corpus where they differ: day, indexed, there."""
    a, b = index.groupBy("day").agg(F.count("*").alias("indexed")), corpus.groupBy("day").agg(F.count("*").alias("there"))
    both = a.join(b, "day", "full_outer").select("day", F.coalesce("indexed", F.lit(0)).alias("indexed"), F.coalesce("there", F.lit(0)).alias("there"))
    return both.where("indexed <> there")


def value_distribution(rows: DataFrame, value: str, by: str, known: tuple[str, ...]) -> DataFrame:
    """Rows per value and group, and whether the value is a known one."""
    return rows.groupBy(value, by).agg(F.count("*").alias("n")).withColumn("known", F.coalesce(F.col(value).isin(*known), F.lit(False)))


def steps(bars: DataFrame, skip: int = 5) -> DataFrame:
    """Per adjustment: judged, inconsistent (the change from the close before departs from the stored change_pct by over STEP_TOLERANCE), beyond_1pp (by over 1), beyond.

    beyond counts adjusted (qfq) changes over STEP_BOUND after a symbol's first ``skip`` bars with a change, when no limit
    holds yet; other adjustments have 0 there. Raw prices are counted too, though nobody judges them.
    """
    w = Window.partitionBy("symbol", "adjustment").orderBy("trade_date")
    before = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.abs((F.col("close") / F.nullif(before, F.lit(0.0)) - 1) * 100 - F.col("change_pct"))
    seen = bars.withColumn("gap", gap).withColumn("rn", F.count("change_pct").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    far = (F.col("adjustment") == "qfq") & (F.col("rn") > skip) & (F.abs("change_pct") > STEP_BOUND)
    return seen.groupBy("adjustment").agg(F.count("gap").alias("judged"), F.count_if(F.col("gap") > STEP_TOLERANCE).alias("inconsistent"), F.count_if(F.col("gap") > 1).alias("beyond_1pp"), F.count_if(far).alias("beyond"))


def envelope(bars: DataFrame, adjust: str = "qfq") -> DataFrame:
    """Days whose number of symbols fell by over a tenth: trade_date, n, before. One row a day in the window."""
    days = bars.where(F.col("adjustment") == adjust).groupBy("trade_date").agg(F.count_distinct("symbol").alias("n"))
    return days.withColumn("before", F.lag("n").over(Window.orderBy("trade_date"))).where(F.col("n") < F.col("before") * (1 - ENVELOPE))


def thinnest_day(bars: DataFrame) -> DataFrame:
    days = bars.groupBy("trade_date").agg(F.count_distinct("symbol").alias("n"))
    return days.agg(F.min(F.struct("n", "trade_date")).alias("m")).select("m.trade_date", "m.n")


def event_gaps(events: DataFrame, sessions: DataFrame, excused: DataFrame | None = None) -> DataFrame:
    """Calendar days without events between the first and the last: day, kind (trading or natural); ``excused`` days (day) are no gaps."""
    days = events.select(F.to_date("event_time").alias("day")).distinct()
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    trading = sessions.select(F.col("trade_date").alias("day"), F.lit(1).alias("t"))
    gaps = span.join(days, "day", "left_anti")
    gaps = gaps if excused is None else gaps.join(excused, "day", "left_anti")
    return gaps.join(trading, "day", "left").select("day", F.when(F.col("t").isNull(), "natural").otherwise("trading").alias("kind"))


def shard_differences(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Files (file, sha256, rows) of a manifest against those found: file, state (missing, extra or mismatched); equal ones are left out."""
    a, b = manifest.alias("a"), found.alias("b")
    same = F.col("a.sha256").eqNullSafe(F.col("b.sha256")) & F.col("a.rows").eqNullSafe(F.col("b.rows"))
    state = F.when(F.col("b.file").isNull(), "missing").when(F.col("a.file").isNull(), "extra").when(~same, "mismatched")
    met = a.join(b, F.col("a.file") == F.col("b.file"), "full")
    return met.select(F.coalesce("a.file", "b.file").alias("file"), state.alias("state")).where("state IS NOT NULL")


def one_word_boards(bars: DataFrame) -> DataFrame:
    """Bars whose four prices are one, away from the close before: symbol, trade_date, close, prev_close."""
    flat = (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close"))
    return with_change(bars).where(flat & (F.col("close") != F.col("prev_close"))).select("symbol", "trade_date", "close", "prev_close")


# Known trading states and directions, and how long a direction's text may be.
STATUSES, DIRECTIONS, DIRECTION_LENGTH = ("traded", "no_turnover_observed", "suspended"), ("bullish", "bearish", "neutral"), 12


def suite(bars: DataFrame, events: DataFrame, sessions: DataFrame, calendar: DataFrame) -> dict[str, tuple[str, Callable[[], DataFrame]]]:
    """Checks by id: the level of a failure, and a row with the count of what fails (failing), maybe with a level and a note of its own.

    ``bars`` have change_pct and trading_status, ``events`` dedup_key and content_hash. ``calendar`` (trade_date) is a source of
    its own, not the bars' days. What counts rows of bars or of events alone is :func:`one_pass`.
    """
    n = lambda df: df.agg(F.count("*").alias("failing"))
    day = F.to_date("event_time").alias("day")
    by_key = lambda: duplicates(events.where("dedup_key IS NOT NULL").select(day, "dedup_key"), ["day", "dedup_key"])
    by_pair = lambda: duplicates(events, ["event_id", "content_hash"])
    judged = F.when(F.col("adjustment") == "raw", F.col("beyond")).otherwise(F.col("beyond") + F.col("inconsistent"))
    states = lambda: value_distribution(bars, "trading_status", "adjustment", STATUSES).where("NOT known")
    symbols = lambda: events.select(F.explode("symbols").alias("s")).distinct().where("NOT s RLIKE '^[0-9]{6}$'")
    return {
        "B2": ("error", lambda: n(duplicates(bars, ["symbol", "adjustment", "trade_date"]))),
        "B5": ("warn", lambda: steps(bars).agg(F.sum(judged).alias("failing"))),
        "B6": ("warn", lambda: n(states())),
        "B7": ("warn", lambda: n(envelope(bars))),
        "B8": ("error", lambda: n(date_differences(calendar, sessions))),
        "E2": ("error", lambda: n(by_key().select("n").unionByName(by_pair().select("n")))),
        "E5": ("warn", lambda: n(symbols())),
        "E6": ("info", lambda: n(events.groupBy("event_id").agg(F.count_distinct(F.to_date("event_time")).alias("d")).where("d > 1"))),
        "E7": ("info", lambda: n(event_gaps(events, sessions))),
    }


def one_pass(bars: DataFrame, events: DataFrame) -> DataFrame:
    """(id, level, failing, note) of the checks that only count rows: B3 and B4 in one scan of bars, E3 and E4 in one of events.

    E4 is an error if a mapped direction (direction_norm) isn't a known one, and a warning if only a direction's text is too long.
    E5's note, the share of events without symbols, is part of E3's row: it comes from the same scan.
    """
    of_bars = bars.agg(F.count_if((F.col("volume") > 0) & F.col("close").isNull()).alias("B3"), F.count_if(F.col("close").isNull()).alias("B4"))
    unmapped = F.col("direction_norm").isNotNull() & ~F.col("direction_norm").isin(*DIRECTIONS)
    of_events = events.agg(
        F.count_if(F.col("available_at").isNull() | (F.col("available_at") < F.col("event_time"))).alias("E3"),
        F.count_if(unmapped).alias("bad"), F.count_if(F.length("direction") > DIRECTION_LENGTH).alias("dirty"),
        F.count("*").alias("n"), F.count_if(F.size("symbols") == 0).alias("empty"),
    )
    row = lambda id_, level, failing, note="": F.struct(F.lit(id_).alias("id"), F.when(failing > 0, level).otherwise("ok").alias("level"), failing.alias("failing"), F.lit(note).alias("note") if isinstance(note, str) else note.alias("note"))
    listed = lambda df, *rows: df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    without = F.concat(F.col("empty").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" events have no symbols"))
    four = row("E4", F.when(F.col("bad") > 0, "error").otherwise("warn"), F.col("bad") + F.col("dirty"))
    return listed(of_bars, row("B3", F.lit("error"), F.col("B3")), row("B4", F.lit("info"), F.col("B4"))).unionByName(listed(of_events, row("E3", F.lit("error"), F.col("E3"), without), four))


def run_suite(checks: dict[str, tuple[str, Callable[[], DataFrame]]]) -> DataFrame:
    """(id, level, failing): level is ``ok`` without failures; a check that raises when it is built is an error with failing -1."""
    out, broken, spark = None, [], None
    for name, (level, make) in checks.items():
        try:
            found = make()
        except Exception as e:  # noqa: BLE001  one failing check never hides the others
            broken.append((name, "error", -1, str(e)[:200]))
            continue
        spark = found.sparkSession
        row = found.select(F.lit(name).alias("id"), F.coalesce(F.col("failing"), F.lit(0)).cast("long").alias("failing")).select("id", F.when(F.col("failing") > 0, level).otherwise("ok").alias("level"), "failing", F.lit("").alias("note"))
        out = row if out is None else out.unionByName(row)
    if broken and spark is not None:
        out = out.unionByName(spark.createDataFrame(broken, "id string, level string, failing long, note string"))
    return out


def severity(found: DataFrame) -> DataFrame:
    """The worst level of a run: error over warn over info over ok."""
    order = F.array_position(F.array(F.lit("ok"), *[F.lit(x) for x in LEVELS]), F.col("level"))
    return found.agg(F.max_by("level", order).alias("level"), F.count_if(F.col("level") != "ok").alias("n"))
