"""Quality, state and curve queries over the shared tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import factor as I
from ..operators import market as M
from ..operators import quality as Q
from ..operators import retrieval as J
from ..operators import series as S
from ..operators import state as N
from ..sources import bindings as B
from .market_queries import _CHANGED, AS_OF, BARS, EVENTS, SESSIONS, with_
from .model_queries import _DENSE, _FACTOR, MIN_POOL, _queries_of, _sides

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _qfq(spark, d):
    return M.of_adjustment(B.bars(spark, d), "qfq")


@query(
    with_(BARS)
    + """, f AS (SELECT symbol, trade_date, CASE WHEN count(close) OVER a = 5 THEN round(CAST(sum(close::DECIMAL(28,8)) OVER a AS DOUBLE) / 5, 8) END AS fast, CASE WHEN count(close) OVER b = 20 THEN round(CAST(sum(close::DECIMAL(28,8)) OVER b AS DOUBLE) / 20, 8) END AS slow
      FROM priced WHERE adjustment = 'qfq' WINDOW a AS (PARTITION BY symbol ORDER BY trade_date ROWS 4 PRECEDING), b AS (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING)),
    g AS (SELECT *, lag(fast) OVER w AS f0, lag(slow) OVER w AS s0 FROM f WINDOW w AS (PARTITION BY symbol ORDER BY trade_date))
    SELECT symbol, trade_date, fast, slow, CASE WHEN fast > slow THEN 'golden' ELSE 'death' END AS "cross" FROM g WHERE s0 IS NOT NULL AND ((f0 <= s0 AND fast > slow) OR (f0 >= s0 AND fast < slow))"""
)
def e10_mean_crosses(spark: SparkSession, d: str) -> DataFrame:
    return S.crosses(M.priced(_qfq(spark, d)), 5, 20)


@query(
    with_(BARS)
    + """, c AS (SELECT symbol, trade_date, close, close / lag(close) OVER w - 1 AS r, 1 - close / max(close) OVER w AS dd FROM priced WHERE adjustment = 'qfq' WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
    m AS (SELECT symbol, count(*) AS n, arg_max(close, trade_date) / arg_min(close, trade_date) - 1 AS total, max(dd) AS dd, avg(r) AS mean, stddev_samp(r) AS sd, count(r) AS k FROM c GROUP BY symbol)
    SELECT symbol, n, round(total, 6) AS total, CASE WHEN n > 1 THEN round(CASE WHEN total <= -1 THEN -1 ELSE (1 + total) ** (252.0 / (n - 1)) - 1 END, 6) END AS annual, round(dd, 6) AS max_drawdown,
      CASE WHEN k >= 2 AND sd > 0 THEN round(mean / sd * sqrt(252.0), 4) END AS sharpe FROM m"""
)
def i9_curve_metrics(spark: SparkSession, d: str) -> DataFrame:
    return S.curve_metrics(M.priced(_qfq(spark, d)), "symbol", "trade_date", "close")


@query(
    with_(*_FACTOR[:4])
    + """, j AS (SELECT trade_date, fwd_ret, coalesce(abs(fwd_ret) <= 0.3, false) AS ok FROM val LEFT JOIN fwd USING (trade_date, symbol) WHERE value IS NOT NULL),
    dy AS (SELECT trade_date, count_if(ok) AS n, count(fwd_ret) AS f, count_if(fwd_ret IS NULL) AS np, count_if(abs(fwd_ret) > 0.3) AS x FROM j GROUP BY trade_date)
    SELECT sum(np)::BIGINT AS dropped_no_price, sum(x)::BIGINT AS dropped_extreme, count_if(f > 0 AND n < 20) AS skipped_thin_days, count_if(f = 0) AS skipped_no_forward_days FROM dy"""
)
def i4_pool_counters(spark: SparkSession, d: str) -> DataFrame:
    return I.pool_counters(*_sides(spark, d), MIN_POOL)


@query(with_(EVENTS) + f"SELECT event_type, count(*) AS late, min(available_at) AS first_late FROM ev WHERE available_at > TIMESTAMP '{AS_OF}' GROUP BY event_type")
def j15_late_evidence(spark: SparkSession, d: str) -> DataFrame:
    return J.late_evidence(B.events(spark, d), AS_OF).groupBy("event_type").agg(F.count("*").alias("late"), F.min("available_at").alias("first_late"))


@query(
    with_(_DENSE)
    + """, z AS (SELECT query_id, doc_id, rank AS r0, CASE WHEN query_id % 100 = 0 OR doc_id % 7 > 0 THEN doc_id % 7 END AS s FROM de),
    y AS (SELECT *, bool_or(s IS NULL AND r0 <= 10) OVER (PARTITION BY query_id) AS fell FROM z)
    SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY r0 > 10, CASE WHEN NOT fell AND r0 <= 10 THEN s END DESC NULLS LAST, r0) AS rank, fell AS fell_back FROM y"""
)
def j5_reranked(spark: SparkSession, d: str) -> DataFrame:
    q, docs = _queries_of(spark, d)
    score = F.when((F.col("query_id") % 100 == 0) | (F.col("doc_id") % 7 > 0), F.col("doc_id") % 7)
    return J.reranked(J.dense(q, docs, 20), score, 10).select("query_id", "doc_id", "rank", "fell_back")


_SHARDS = """li AS (SELECT 'day-' || strftime(l_shipdate, '%Y-%m-%d') AS file, count(*) AS rows, sha256((sum(l_orderkey % 7) % 3)::BIGINT::VARCHAR) AS h FROM lineitem GROUP BY ALL),
od AS (SELECT 'day-' || strftime(o_orderdate, '%Y-%m-%d') AS file, count(*) AS rows, sha256((sum(o_orderkey % 7) % 3)::BIGINT::VARCHAR) AS h FROM orders GROUP BY ALL)"""


@query(with_(_SHARDS) + "SELECT coalesce(li.file, od.file) AS file, CASE WHEN od.file IS NULL THEN 'missing' WHEN li.file IS NULL THEN 'extra' ELSE 'mismatched' END AS state FROM li FULL JOIN od ON li.file = od.file WHERE li.file IS NULL OR od.file IS NULL OR li.rows <> od.rows OR li.h <> od.h")
def g2_shard_differences(spark: SparkSession, d: str) -> DataFrame:
    def files(name: str, stamp: str, key: str) -> DataFrame:
        file = F.concat(F.lit("day-"), F.date_format(stamp, "yyyy-MM-dd")).alias("file")
        return B.table(spark, d, name).groupBy(file).agg(F.count("*").alias("rows"), F.sha2((F.sum(F.col(key) % 7) % 3).cast("string"), 256).alias("sha256"))

    return Q.shard_differences(files("lineitem", "l_shipdate", "l_orderkey"), files("orders", "o_orderdate", "o_orderkey"))


@query(with_(BARS) + "SELECT adjustment, count(*) AS unpriced, count(DISTINCT symbol) AS symbols, min(trade_date) AS first_day, max(trade_date) AS last_day FROM bars WHERE close IS NULL GROUP BY adjustment")
def l4_unpriced(spark: SparkSession, d: str) -> DataFrame:
    return Q.unpriced(B.bars(spark, d))


@query(
    with_(BARS)
    + """, c AS (SELECT symbol, adjustment, trade_date, (close / lag(close) OVER w - 1) * 100 AS now FROM priced WINDOW w AS (PARTITION BY symbol, adjustment ORDER BY trade_date)),
    t AS (SELECT *, round(now, 6) + CASE month(trade_date) WHEN 3 THEN 0.02 WHEN 7 THEN 2.0 ELSE 0 END::DOUBLE AS told, row_number() OVER (PARTITION BY symbol, adjustment ORDER BY trade_date) AS rn FROM c WHERE now IS NOT NULL)
    SELECT adjustment, count(*) AS judged, count_if(abs(now - told) > 0.011) AS inconsistent, count_if(abs(now - told) > 1) AS beyond_1pp, count_if(adjustment = 'qfq' AND rn > 5 AND abs(told) > 31) AS beyond FROM t GROUP BY adjustment"""
)
def l5_steps(spark: SparkSession, d: str) -> DataFrame:
    off = F.when(F.month("trade_date") == 3, 0.02).when(F.month("trade_date") == 7, 2.0).otherwise(0.0)
    return Q.steps(B.bars(spark, d).withColumn("change_pct", F.col("change_pct") + off))


@query(with_(BARS) + "SELECT * FROM (SELECT trade_date, n, lag(n) OVER (ORDER BY trade_date) AS before FROM (SELECT trade_date, count(DISTINCT symbol) AS n FROM bars WHERE adjustment = 'qfq' GROUP BY trade_date)) WHERE n < before * 0.9")
def l7_envelope(spark: SparkSession, d: str) -> DataFrame:
    return Q.envelope(B.bars(spark, d))


@query(
    with_(BARS, SESSIONS, EVENTS)
    + """, dd AS (SELECT DISTINCT event_time::DATE AS day FROM ev WHERE event_type = 'signup'), sp AS (SELECT unnest(range((SELECT min(day) FROM dd), (SELECT max(day) FROM dd) + 1, INTERVAL 1 DAY))::DATE AS day)
    SELECT day, CASE WHEN day IN (SELECT trade_date FROM ses) THEN 'trading' ELSE 'natural' END AS kind FROM sp WHERE day NOT IN (SELECT day FROM dd)"""
)
def l15_event_gaps(spark: SparkSession, d: str) -> DataFrame:
    return Q.event_gaps(B.events(spark, d).where("event_type = 'signup'"), B.calendar(spark, d))


@query(with_(BARS, _CHANGED) + "SELECT symbol, trade_date, close, prev_close FROM qc WHERE open = high AND high = low AND low = close AND close <> prev_close")
def l19_one_word_boards(spark: SparkSession, d: str) -> DataFrame:
    return Q.one_word_boards(_qfq(spark, d))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS slot FROM orders WHERE o_orderstatus = 'O'")
def e8_slots(spark: SparkSession, d: str) -> DataFrame:
    o = B.table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderdate")
    return N.slots(o, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT o_custkey, count(*) AS used FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1996-06-01' - 29 AND DATE '1996-06-01' GROUP BY o_custkey")
def n5_used_in_window(spark: SparkSession, d: str) -> DataFrame:
    return N.used_in_window(B.table(spark, d, "orders"), "o_custkey", "o_orderdate", "1996-06-01", 30)


@query("SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey LIMIT 25")
def n2_claim_order(spark: SparkSession, d: str) -> DataFrame:
    o = B.table(spark, d, "orders")
    tasks = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"), F.col("o_orderdate").alias("available_at"), F.col("o_orderdate").alias("created_at"))
    return N.claim_order(tasks, 25).select("id", "priority")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT -1 - o_orderkey, 'new' FROM orders WHERE o_orderkey % 9 = 0")
def n6_upserted(spark: SparkSession, d: str) -> DataFrame:
    old = B.table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    new = old.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("new").alias("status"))
    more = old.where("o_orderkey % 9 = 0").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit("new").alias("status"))
    return N.upserted(old, new.unionByName(more), ["o_orderkey"])


@query("SELECT o_orderkey, o_orderstatus AS status FROM orders UNION ALL SELECT -1 - o_orderkey, 'new' FROM orders WHERE o_orderkey % 9 = 0")
def n1_inserted_once(spark: SparkSession, d: str) -> DataFrame:
    old = B.table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    again = old.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("new").alias("status"))
    more = old.where("o_orderkey % 9 = 0").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit("new").alias("status"))
    return N.inserted_once(old, again.unionByName(more), ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_quantity DESC) = 1")
def n10_newest_version(spark: SparkSession, d: str) -> DataFrame:
    return N.newest_version(B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_linenumber")
