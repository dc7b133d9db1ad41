"""The event factor with and without knowledge stamps, over the shared tables, each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import factor as I
from ..operators import market as M
from ..sources import bindings as B
from .market_queries import BARS, EVENTS, SESSIONS, with_
from .model_queries import _FWD

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Names that a day needs: the given events name few symbols a session.
MIN_POOL = 5


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


_WORLDS = """bw AS (SELECT ev.*, world, CASE world WHEN 'pit' THEN available_at ELSE event_time END AS stamp FROM ev, (VALUES ('pit'), ('non_pit')) AS w(world)),
bd AS (SELECT *, CASE WHEN stamp <= stamp::DATE + INTERVAL 15 HOUR THEN stamp::DATE ELSE stamp::DATE + 1 END AS due FROM bw),
bs AS (SELECT bd.*, s.trade_date AS session FROM bd LEFT JOIN (SELECT DISTINCT due, (SELECT min(trade_date) FROM ses WHERE trade_date >= due) AS trade_date FROM bd) s USING (due))"""
_POOL = f"""val AS (SELECT world, session AS trade_date, symbol, round(sum(score::DECIMAL(28,10))::DOUBLE / count(*), 8) AS value
    FROM (SELECT world, session, score, unnest(symbols) AS symbol FROM bs WHERE session IS NOT NULL AND score IS NOT NULL) GROUP BY ALL),
pl AS (SELECT * FROM (SELECT world, trade_date, symbol, value, fwd_ret, count(*) OVER (PARTITION BY world, trade_date) AS n FROM val JOIN fwd USING (trade_date, symbol) WHERE abs(fwd_ret) <= 0.3) WHERE n >= {MIN_POOL})"""
_IC = """rk AS (SELECT world, trade_date, rank() OVER (PARTITION BY world, trade_date ORDER BY value) + (count(*) OVER (PARTITION BY world, trade_date, value) - 1) / 2 AS rx,
    rank() OVER (PARTITION BY world, trade_date ORDER BY fwd_ret) + (count(*) OVER (PARTITION BY world, trade_date, fwd_ret) - 1) / 2 AS ry FROM pl),
ic AS (SELECT world, trade_date, round((count(*) * sum(rx * ry) - sum(rx) * sum(ry)) / nullif(sqrt((count(*) * sum(rx * rx) - sum(rx) * sum(rx)) * (count(*) * sum(ry * ry) - sum(ry) * sum(ry))), 0), 6) AS ic FROM rk GROUP BY ALL HAVING count(*) >= 3),
ii AS (SELECT world, count(*) AS ic_days, avg(ic::DECIMAL(20,6))::DOUBLE AS m, coalesce(stddev_samp(ic), 0) AS sd FROM ic WHERE ic IS NOT NULL GROUP BY world)"""
_CURVES = """mem AS (SELECT world, trade_date, symbol, fwd_ret, least((row_number() OVER (PARTITION BY world, trade_date ORDER BY value, symbol) - 1) // (n // 5), 4) AS q FROM pl),
pd AS (SELECT world, trade_date, row_number() OVER (PARTITION BY world ORDER BY trade_date) AS i FROM (SELECT DISTINCT world, trade_date FROM mem)),
m2 AS (SELECT i, mem.* FROM mem JOIN pd USING (world, trade_date)),
sz AS (SELECT world, i, trade_date, q, count(*) AS size, round(sum(fwd_ret::DECIMAL(28,10))::DOUBLE / count(*), 8) AS gross FROM m2 GROUP BY ALL),
sy AS (SELECT a.world, a.i, a.q, count(b.symbol) AS stayed FROM m2 a LEFT JOIN m2 b ON b.world = a.world AND b.i = a.i - 1 AND b.q = a.q AND b.symbol = a.symbol GROUP BY ALL),
tu AS (SELECT sz.*, round((sz.size - stayed) / sz.size, 6) AS bought, round(coalesce((p.size - stayed) / p.size, 0), 6) AS sold
    FROM sz JOIN sy USING (world, i, q) LEFT JOIN sz p ON p.world = sz.world AND p.i = sz.i - 1 AND p.q = sz.q),
po AS (SELECT *, round(gross - bought * 0.00075 - sold * 0.00125, 8) AS net FROM tu),
ls AS (SELECT a.world, a.trade_date, round(a.net - b.gross - b.bought * 0.00125 - b.sold * 0.00075, 8) AS net_spread FROM po a JOIN po b ON a.world = b.world AND a.trade_date = b.trade_date AND a.q = 4 AND b.q = 0),
lv AS (SELECT world, trade_date, net_spread, round(product(1 + net_spread) OVER (PARTITION BY world ORDER BY trade_date ROWS UNBOUNDED PRECEDING) * 1000, 4) AS level FROM ls),
st AS (SELECT *, CASE WHEN lag(level) OVER w > 0 THEN level / lag(level) OVER w - 1 END AS r, 1 - level / max(level) OVER w AS dd FROM lv WINDOW w AS (PARTITION BY world ORDER BY trade_date)),
cu AS (SELECT world, count(*) AS n, arg_max(level, trade_date) / 1000.0 - 1 AS total, max(dd) AS dd, avg(r) AS mean, stddev_samp(r) AS sd, count(r) AS k, avg(CASE WHEN net_spread > 0 THEN 1.0 ELSE 0.0 END) AS wins FROM st GROUP BY world)"""
_METRICS = """mt AS (SELECT world, unnest([{'m': 'days', 'v': n::DOUBLE}, {'m': 'final_equity', 'v': round((1 + round(total, 6)) * 1000, 4)}, {'m': 'total_return', 'v': round(total, 6)},
    {'m': 'annual_return', 'v': round(CASE WHEN total <= -1 THEN -1 ELSE (1 + total) ** (252.0 / n) - 1 END, 6)}, {'m': 'max_drawdown', 'v': round(dd, 6)},
    {'m': 'sharpe', 'v': CASE WHEN k >= 2 AND sd > 0 THEN round(mean / sd * sqrt(252.0), 4) END}, {'m': 'win_rate', 'v': round(wins, 6)}]) AS s FROM cu
UNION ALL SELECT world, unnest([{'m': 'ic_days', 'v': ic_days::DOUBLE}, {'m': 'ic_mean', 'v': round(m, 6)}, {'m': 'icir', 'v': round(m / nullif(sd, 0), 4)}]) FROM ii)"""
_ALL = (BARS, SESSIONS, EVENTS, _FWD, _WORLDS, _POOL, _IC, _CURVES, _METRICS)


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    b = M.of_adjustment(B.bars(spark, d), "qfq")
    sessions = B.sessions(b)
    return I.world_metrics(B.events(spark, d), sessions, I.forward_returns(b, sessions), MIN_POOL)


@query(with_(*_ALL) + "SELECT world, s.m AS metric, s.v AS value FROM mt")
def i18_world_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d)


@query(
    with_(*_ALL)
    + """, b AS (SELECT s.m AS metric, max(s.v) FILTER (world = 'pit') AS pit, max(s.v) FILTER (world = 'non_pit') AS non_pit FROM mt GROUP BY ALL)
    SELECT metric, pit, non_pit, CASE WHEN metric = 'final_equity' THEN 'ratio' WHEN metric IN ('total_return', 'annual_return', 'max_drawdown', 'win_rate') THEN 'pp' ELSE 'abs' END AS unit,
      round(CASE WHEN metric = 'final_equity' THEN non_pit / nullif(pit, 0) - 1 WHEN metric IN ('total_return', 'annual_return', 'max_drawdown', 'win_rate') THEN (non_pit - pit) * 100 ELSE non_pit - pit END, 6) AS delta FROM b"""
)
def i18_pit_delta(spark: SparkSession, d: str) -> DataFrame:
    return I.world_deltas(_metrics(spark, d))


@query(
    with_(BARS, SESSIONS, EVENTS, _WORLDS)
    + """, x AS (SELECT event_id, any_value(score) AS score, max(session_idx) FILTER (world = 'pit') AS a, max(session_idx) FILTER (world = 'non_pit') AS b FROM bs LEFT JOIN ses ON session = ses.trade_date GROUP BY event_id)
    SELECT a - b AS sessions_early, count(*) AS n, count(score) AS scored FROM x WHERE b IS NOT NULL GROUP BY ALL"""
)
def i18_look_ahead(spark: SparkSession, d: str) -> DataFrame:
    return I.look_ahead(B.events(spark, d), B.calendar(spark, d))
