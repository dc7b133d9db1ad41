"""The ledger of runs, stalls and the calendar's end over the shared tables, each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import market as M
from ..operators import quality as Q
from ..sources import bindings as B
from .market_queries import BARS, EVENTS, SESSIONS, with_

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "1998-09-01"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """A run per order, as a line of JSON: some are cut off, blank or no object, some lack keys."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    keyed = lambda key, value: F.concat(F.lit(f'"{key}": "'), value.cast("string"), F.lit('"'))
    state = F.element_at(F.array(F.lit("failed"), F.lit("empty"), F.lit("ok")), (k % 3 + 1).cast("int"))
    parts = [
        keyed("started_at", day), keyed("day", F.when(k % 17 == 0, F.lit("soon")).otherwise(day.cast("string"))), keyed("state", state),
        F.when(k % 13 != 0, keyed("scope", F.col("o_orderpriority"))), F.when(k % 4 != 0, keyed("archive_last", F.date_sub(day, (k % 10).cast("int")))),
    ]
    text = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    broken = F.when(k % 97 == 0, F.expr("left(text, length(text) - 1)")).when(k % 89 == 0, F.lit("  ")).when(k % 83 == 0, F.lit("[3]")).otherwise(F.col("text"))
    return B.table(spark, d, "orders").withColumn("text", text).select(k.alias("line_no"), broken.alias("text"))


_ENTRIES = """en AS (SELECT o_orderkey AS line_no, bad, CASE WHEN NOT bad THEN CASE WHEN o_orderkey % 13 = 0 THEN '?' ELSE o_orderpriority END END AS scope, CASE WHEN NOT bad AND o_orderkey % 17 <> 0 THEN o_orderdate::DATE END AS day,
    CASE WHEN NOT bad THEN ['failed', 'empty', 'ok'][(o_orderkey % 3 + 1)::INT] END AS state, CASE WHEN NOT bad AND o_orderkey % 4 <> 0 THEN o_orderdate::DATE - (o_orderkey % 10)::INT END AS archive_last
    FROM (SELECT *, o_orderkey % 97 = 0 OR (o_orderkey % 83 = 0 AND o_orderkey % 89 <> 0) AS bad FROM orders) WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 <> 0)"""
_STATES = "ds AS (SELECT scope, day, arg_max(state, line_no) AS state FROM en WHERE NOT bad AND day IS NOT NULL GROUP BY ALL)"


def _entries(spark, d):
    return L.entries(_lines(spark, d))


def _sessions(spark, d):
    return B.calendar(spark, d)


@query(with_(_ENTRIES) + "SELECT count_if(NOT bad) AS runs, count_if(bad) AS bad, min(line_no) FILTER (bad) AS first_bad, count(DISTINCT scope) AS scopes, CASE WHEN count_if(bad) > 0 THEN 'error' WHEN count(*) = 0 THEN 'warn' ELSE 'info' END AS level FROM en")
def l16_ledger_health(spark: SparkSession, d: str) -> DataFrame:
    return L.health(_entries(spark, d))


@query(
    with_(_ENTRIES)
    + f"""SELECT scope, archive_last, line_no, date_diff('day', archive_last, DATE '{NOW}') AS stalled_days, CASE WHEN date_diff('day', archive_last, DATE '{NOW}') > 60 THEN 'warn' ELSE 'info' END AS level
    FROM (SELECT scope, arg_max(archive_last, line_no) AS archive_last, max(line_no) AS line_no FROM en WHERE NOT bad AND archive_last IS NOT NULL GROUP BY scope)"""
)
def l16_archive_stalls(spark: SparkSession, d: str) -> DataFrame:
    return L.archive_stalls(_entries(spark, d), NOW, 60)


@query(
    with_(BARS, SESSIONS)
    + f""", b AS (SELECT symbol, max(trade_date) FILTER (close IS NOT NULL AND volume > 100) AS last_day FROM bars WHERE adjustment = 'qfq' GROUP BY symbol), x AS (SELECT max(trade_date) AS expected FROM ses WHERE trade_date <= DATE '{NOW}'),
    c AS (SELECT symbol, last_day, expected, CASE WHEN last_day IS NOT NULL THEN greatest((SELECT count(*) FROM ses WHERE trade_date BETWEEN last_day AND expected) - 1, 0) END AS behind FROM b, x)
    SELECT symbol, last_day, expected, behind, CASE WHEN behind > 2 THEN 'warn' ELSE 'info' END AS level FROM c"""
)
def l16_sessions_behind(spark: SparkSession, d: str) -> DataFrame:
    """Symbols by how many sessions their last busy bar lies back."""
    b = M.of_adjustment(B.bars(spark, d), "qfq")
    last = b.groupBy("symbol").agg(F.max(F.when(F.col("close").isNotNull() & (F.col("volume") > 100), F.col("trade_date"))).alias("last_day"))
    return L.sessions_behind(last, _sessions(spark, d), NOW, 2)


@query(with_(BARS, SESSIONS) + f"SELECT min(trade_date) AS first_day, max(trade_date) AS last_day, date_diff('day', DATE '{NOW}', max(trade_date)) AS runway_days, CASE WHEN date_diff('day', DATE '{NOW}', max(trade_date)) < 60 THEN 'warn' ELSE 'info' END AS level FROM ses")
def l16_calendar_runway(spark: SparkSession, d: str) -> DataFrame:
    return L.runway(_sessions(spark, d), NOW)


@query(
    with_(BARS, SESSIONS, _ENTRIES, _STATES)
    + """, s AS (SELECT *, lead(day) OVER w IS NULL AS last, coalesce(state <> lag(state) OVER w, true) AS starts FROM ds WINDOW w AS (PARTITION BY scope ORDER BY day)),
    r AS (SELECT *, sum(starts::INT) OVER (PARTITION BY scope ORDER BY day) AS run FROM s),
    g AS (SELECT scope, run, state, min(day) AS first_day, max(day) AS last_day, count(*) AS days, bool_or(last) AS open FROM r WHERE state <> 'ok' GROUP BY ALL)
    SELECT scope, state, first_day, last_day, days, (SELECT count(*) FROM ses WHERE trade_date BETWEEN first_day AND last_day) AS sessions, open FROM g"""
)
def l16_failure_runs(spark: SparkSession, d: str) -> DataFrame:
    return L.failure_runs(L.day_states(_entries(spark, d)), _sessions(spark, d))


@query(
    with_(BARS, SESSIONS, EVENTS, _ENTRIES, _STATES)
    + """, dd AS (SELECT DISTINCT event_time::DATE AS day FROM ev WHERE event_type = 'signup'), sp AS (SELECT unnest(range((SELECT min(day) FROM dd), (SELECT max(day) FROM dd) + 1, INTERVAL 1 DAY))::DATE AS day)
    SELECT day, CASE WHEN day IN (SELECT trade_date FROM ses) THEN 'trading' ELSE 'natural' END AS kind FROM sp WHERE day NOT IN (SELECT day FROM dd) AND day NOT IN (SELECT day FROM ds WHERE state = 'empty')"""
)
def l15_excused_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Days without events, but for those of which the ledger knows that there were none."""
    none = L.empty_days(L.day_states(_entries(spark, d)))
    return Q.event_gaps(B.events(spark, d).where("event_type = 'signup'"), _sessions(spark, d), none)
