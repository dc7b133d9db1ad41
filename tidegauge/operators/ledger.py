"""What the ledger of runs and the calendar tell: lines that can't be read, runs of failures, what stands still.

Everything is judged from stored rows, never by asking a source: a source that can't be reached would look like one
without gaps. Where there is nothing to judge by, the level is ``info`` and the figure null, for that is no standstill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def entries(lines: DataFrame) -> DataFrame:
    """(line_no, text) → line_no, bad, scope, started_at, day, state, archive_last, of all lines that aren't blank.

    A line is bad if it isn't a JSON object; its fields are null. Entries of older kinds lack keys: no scope gives ``?``,
    any other key null. Days that aren't dates are null.
    """
    scope = lambda v: F.coalesce(F.try_variant_get(v, "$.scope", "string"), F.lit("?"))
    of = lambda v, key: F.try_variant_get(v, f"$.{key}", "string")
    day = lambda v, key: of(v, key).try_cast("date").alias(key)
    unless = lambda v, c, name: F.when(_is_object(v), c).alias(name)

    def fields(v):
        told = (unless(v, scope(v), "scope"), unless(v, of(v, "started_at"), "started_at"), unless(v, day(v, "day"), "day"), unless(v, of(v, "state"), "state"), unless(v, day(v, "archive_last"), "archive_last"))
        return F.struct((~_is_object(v)).alias("bad"), *told)

    # A generator, for what is asked of a line's fields must not make the line be parsed again.
    return lines.where(F.col("text").rlike(r"\S")).select("line_no", F.inline(F.transform(F.array(F.try_parse_json("text")), fields)))


def _is_object(v):
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def health(found: DataFrame) -> DataFrame:
    """One row: runs, bad, first_bad (line), scopes, level; a bad line is an error, no line at all (no ledger) a warning."""
    a = found.agg(F.count_if(~F.col("bad")).alias("runs"), F.count_if("bad").alias("bad"), F.min(F.when(F.col("bad"), F.col("line_no"))).alias("first_bad"), F.count_distinct("scope").alias("scopes"))
    return a.withColumn("level", F.when(F.col("bad") > 0, "error").when(F.col("runs") == 0, "warn").otherwise("info"))


def archive_stalls(found: DataFrame, now, warn_days: int = 7) -> DataFrame:
    """Per scope the archive's end as the last entry (by line) that tells it has it: scope, archive_last, line_no, stalled_days, level (warn over ``warn_days``)."""
    told = F.col("archive_last").isNotNull()
    last = found.where(~F.col("bad")).groupBy("scope").agg(F.max_by("archive_last", F.when(told, F.col("line_no"))).alias("archive_last"), F.max(F.when(told, F.col("line_no"))).alias("line_no"))
    days = last.withColumn("stalled_days", F.date_diff(F.lit(now).cast("date"), "archive_last"))
    return days.withColumn("level", F.when(F.col("stalled_days") > warn_days, "warn").otherwise("info"))


def _calendar(sessions: DataFrame) -> DataFrame:
    """One row: the sessions as an array, an entry per trading day, whatever the market's size."""
    return F.broadcast(sessions.agg(F.array_sort(F.collect_set("trade_date")).alias("__days")))


def _held(first, last):
    return F.size(F.filter("__days", lambda d: (d >= first) & (d <= last)))


def sessions_behind(boundaries: DataFrame, sessions: DataFrame, now, warn_sessions: int) -> DataFrame:
    """(…, last_day) with expected (the last session not after ``now``), behind and level (warn over ``warn_sessions``).

    behind counts the sessions from last_day through expected, less one: 0 where last_day is the expected session or
    later, null without a last_day. Give what is stored to see how far it lags, and what the source offers to see whether the source does.
    """
    upto = F.filter("__days", lambda d: d <= F.lit(now).cast("date"))
    met = boundaries.crossJoin(_calendar(sessions)).withColumn("expected", F.try_element_at(upto, F.lit(-1)))
    count = F.greatest(_held(F.col("last_day"), F.col("expected")) - 1, F.lit(0))
    behind = F.when(F.col("last_day").isNotNull() & F.col("expected").isNotNull(), F.when(F.col("expected") > F.col("last_day"), count).otherwise(0))
    return met.withColumn("behind", behind).withColumn("level", F.when(F.col("behind") > warn_sessions, "warn").otherwise("info")).drop("__days")


def runway(sessions: DataFrame, now, warn_days: int = 60) -> DataFrame:
    """One row: first_day and last_day of the frozen calendar, runway_days from ``now`` to its end, level (warn below ``warn_days``, error without a calendar)."""
    ends = sessions.agg(F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"))
    left = ends.withColumn("runway_days", F.date_diff("last_day", F.lit(now).cast("date")))
    return left.withColumn("level", F.when(F.col("last_day").isNull(), "error").when(F.col("runway_days") < warn_days, "warn").otherwise("info"))


def day_states(found: DataFrame) -> DataFrame:
    """(scope, day, state): how a day's last entry (by line) ended; bad lines and entries without day or state don't count."""
    told = found.where(~F.col("bad") & F.col("day").isNotNull() & F.col("state").isNotNull())
    return told.groupBy("scope", "day").agg(F.max_by("state", "line_no").alias("state"))


def failure_runs(states: DataFrame, sessions: DataFrame, bad_states: tuple[str, ...] = ("failed", "empty")) -> DataFrame:
    """Stretches of a scope's days that ended alike and badly: scope, state, first_day, last_day, days, sessions (trading days from first to last), open (no later day).

    Days that nobody ran don't break a stretch. Rows are days of a scope, however many runs they had.
    """
    line = Window.partitionBy("scope").orderBy("day")
    starts = F.coalesce(F.col("state") != F.lag("state").over(line), F.lit(True)).cast("int")
    numbered = states.withColumn("last", F.lead("day").over(line).isNull()).withColumn("starts", starts).withColumn("run", F.sum("starts").over(line))
    runs = numbered.where(F.col("state").isin(*bad_states)).groupBy("scope", "run", "state").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"), F.max("last").alias("open"))
    held = runs.crossJoin(_calendar(sessions)).withColumn("sessions", _held(F.col("first_day"), F.col("last_day")))
    return held.select("scope", "state", "first_day", "last_day", "days", "sessions", "open")


def empty_days(states: DataFrame) -> DataFrame:
    """Days that the ledger knows to have had nothing: no gaps in :func:`quality.event_gaps`."""
    return states.where("state = 'empty'").select("day").distinct()
