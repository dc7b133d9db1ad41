"""Bar and event queries over the shared tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import market as M
from ..operators import quality as Q
from ..operators import series as S
from ..sources import bindings as B
from ..sources import lake

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

DAY, AS_OF = "1996-06-01", "1996-06-01 15:00:00"
_CHANGED = "chg AS (SELECT *, lag(close) OVER w AS prev_close, round((close / nullif(lag(close) OVER w, 0) - 1) * 100, 6) AS change_pct FROM priced WINDOW w AS (PARTITION BY symbol, adjustment ORDER BY trade_date)),\nqc AS (SELECT * FROM chg WHERE adjustment = 'qfq')"
_BUCKETS = """due AS (SELECT *, CASE WHEN available_at <= available_at::DATE + INTERVAL 15 HOUR THEN available_at::DATE ELSE available_at::DATE + 1 END AS due FROM ev),
bk AS (SELECT due.*, (SELECT min(ses.trade_date) FROM ses WHERE ses.trade_date >= due.due) AS session FROM due)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().strip(",") for c in ctes) + "\n"


BARS, EVENTS, SESSIONS = B.BARS_SQL, B.EVENTS_SQL, B.SESSIONS_SQL
_QFQ = "adjustment = 'qfq'"


def _bars(spark, d):
    return B.bars(spark, d)


def _qfq(spark, d):
    return M.of_adjustment(B.bars(spark, d), "qfq")


def _changed(spark, d):
    return M.with_change(_qfq(spark, d))


@query(with_(BARS) + f"SELECT symbol, trade_date, open, high, low, close FROM priced WHERE {_QFQ} AND symbol IN ('600001', '000001') AND trade_date BETWEEN DATE '1994-01-01' AND DATE '1996-12-01'")
def a5_multi_symbol_bars(spark: SparkSession, d: str) -> DataFrame:
    return M.symbol_bars(_bars(spark, d), ["600001", "000001"], "1994-01-01", "1996-12-01").select("symbol", "trade_date", *M.PRICES)


@query(with_(EVENTS) + "SELECT event_id, event_time, event_type FROM ev WHERE list_has_any(symbols, ['600001', '300002']) AND event_time >= TIMESTAMP '1993-01-01'")
def a7_multi_symbol_events(spark: SparkSession, d: str) -> DataFrame:
    return M.of_symbols(B.events(spark, d), ["600001", "300002"], "1993-01-01").select("event_id", "event_time", "event_type")


@query(with_(EVENTS) + "SELECT event_id, event_time, direction FROM ev WHERE list_contains(symbols, '600001') ORDER BY event_time DESC, event_id DESC LIMIT 20 OFFSET 5")
def a8_event_page(spark: SparkSession, d: str) -> DataFrame:
    return M.page(M.of_symbols(B.events(spark, d), ["600001"]), [F.desc("event_time"), F.desc("event_id")], 20, 5).select("event_id", "event_time", "direction")


@query(with_(EVENTS) + "SELECT user_key, event_id, event_time FROM (SELECT symbols[1] AS user_key, event_id, event_time, row_number() OVER (PARTITION BY symbols[1] ORDER BY event_time DESC, event_id DESC) AS rn FROM ev) WHERE rn = 1")
def a10_latest_event_per_symbol(spark: SparkSession, d: str) -> DataFrame:
    first = B.events(spark, d).select(F.element_at("symbols", 1).alias("user_key"), "event_id", "event_time")
    return first.groupBy("user_key").agg(F.max(F.struct("event_time", "event_id")).alias("m")).select("user_key", "m.event_id", "m.event_time")


@query(
    with_(EVENTS)
    + """SELECT event_id, 'T' || event_id AS title, direction AS direction_norm, list_aggregate(list_sort(list_distinct(symbols)), 'string_agg', ',') AS symbols, CASE WHEN event_id % 9 = 0 THEN NULL ELSE score END AS confidence
    FROM ev WHERE event_type IN ('purchase', 'view', 'error')"""
)
def a11_archive_flatten(spark: SparkSession, d: str) -> DataFrame:
    e = B.events(spark, d)
    word = F.when(F.col("direction") == "bullish", F.lit(" 利多 ")).when(F.col("direction") == "bearish", F.lit("hawkish")).when(F.col("direction") == "neutral", F.lit("中性"))
    stocks = F.transform("symbols", lambda s: F.struct(F.concat(s, F.lit(".SH")).alias("code"), F.lit("x").alias("name"))).cast("array<struct<code:string,name:string>>")
    foreign = F.array(F.struct(F.lit("0700.HK").alias("code"), F.lit("y").alias("name")))
    payload = F.to_json(F.struct(F.concat(F.lit("T"), F.col("event_id")).alias("title"), word.alias("direction"), F.when(F.col("event_id") % 9 != 0, F.col("score")).alias("confidence"), "industries", F.concat(stocks, foreign).alias("stocks")))
    archive = e.select("event_id", "event_type", "event_time", "available_at", payload.alias("payload_json"))
    flat = lake.flatten_archive(archive, ("purchase", "view", "error"))
    return flat.select("event_id", "title", "direction_norm", F.array_join("symbols", ",").alias("symbols"), "confidence")


@query(with_(EVENTS) + f"SELECT event_type, count(*) AS n, max(available_at) AS last_seen FROM ev WHERE available_at <= TIMESTAMP '{AS_OF}' GROUP BY event_type")
def b3_visible_events(spark: SparkSession, d: str) -> DataFrame:
    return M.visible(B.events(spark, d), AS_OF).groupBy("event_type").agg(F.count("*").alias("n"), F.max("available_at").alias("last_seen"))


@query(with_(BARS) + f"SELECT max(trade_date) AS trade_date FROM priced WHERE {_QFQ}")
def b13_latest_date(spark: SparkSession, d: str) -> DataFrame:
    return M.latest_date(_bars(spark, d))


@query(
    with_(BARS, _CHANGED, EVENTS)
    + f"""SELECT industry, count(*) AS n, sum(amount::DECIMAL(38,2))::DOUBLE AS amount, round(sum(change_pct::DECIMAL(28,6))::DOUBLE / count(*), 4) AS avg_pct, round(median(change_pct), 4) AS median_pct
    FROM (SELECT DISTINCT industry, symbol FROM (SELECT unnest(industries) AS industry, symbols FROM ev WHERE available_at <= TIMESTAMP '{AS_OF}') t, LATERAL (SELECT unnest(t.symbols) AS symbol) u)
    JOIN qc USING (symbol) WHERE trade_date = DATE '{DAY}' AND change_pct IS NOT NULL GROUP BY industry HAVING count(*) >= 3"""
)
def c1_sector_performance(spark: SparkSession, d: str) -> DataFrame:
    return M.sector_performance(_changed(spark, d), B.events(spark, d), DAY, AS_OF)


@query(with_(BARS, SESSIONS, EVENTS, _BUCKETS) + "SELECT session, count(*) AS n, count(DISTINCT event_id) AS ids FROM bk GROUP BY session")
def c7_event_sessions(spark: SparkSession, d: str) -> DataFrame:
    b = _bars(spark, d)
    return M.session_buckets(B.events(spark, d), B.sessions(b)).groupBy("session").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query(with_(BARS) + f"SELECT symbol, max(trade_date) AS trade_date, max_by(close, trade_date) AS close FROM bars WHERE {_QFQ} AND close IS NOT NULL AND trade_date <= DATE '{DAY}' GROUP BY symbol")
def c8_closes_through(spark: SparkSession, d: str) -> DataFrame:
    return M.closes_through(_bars(spark, d), DAY)


_NAMES = with_(EVENTS) + "obs AS (SELECT symbols[1] AS symbol, event_type || (event_id % 3) AS name, available_at AS seen_at FROM ev),\ndic AS (SELECT symbol, name, count(*) AS count, min(seen_at) AS first_seen, max(seen_at) AS last_seen FROM obs GROUP BY ALL)\n"
_NAMES = _NAMES.replace("FROM events)\nobs", "FROM events),\nobs")


def _dictionary(spark, d):
    e = B.events(spark, d)
    return M.name_rows(e.select(F.element_at("symbols", 1).alias("symbol"), F.concat("event_type", F.col("event_id") % 3).alias("name"), F.col("available_at").alias("seen_at")))


@query(_NAMES + f"SELECT symbol, arg_max(name, {{'a': last_seen, 'b': count, 'd': -epoch_us(first_seen), 'c': name}}) AS name FROM dic WHERE first_seen <= TIMESTAMP '{AS_OF}' GROUP BY symbol")
def c9_name_as_of(spark: SparkSession, d: str) -> DataFrame:
    return M.names_as_of(_dictionary(spark, d), AS_OF)


@query(_NAMES + "SELECT * FROM dic")
def d11_name_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return _dictionary(spark, d)


@query(_NAMES + "SELECT symbol, arg_max(name, {'a': count, 'b': last_seen, 'd': -epoch_us(first_seen), 'c': name}) AS name FROM dic GROUP BY symbol")
def d12_primary_names(spark: SparkSession, d: str) -> DataFrame:
    return M.primary_names(_dictionary(spark, d))


_CLOSES = f"""two AS (SELECT trade_date FROM (SELECT DISTINCT trade_date FROM bars) WHERE trade_date <= DATE '{DAY}' ORDER BY 1 DESC LIMIT 2),
cl AS (SELECT * FROM (SELECT symbol, trade_date, close, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS prev_close FROM priced WHERE adjustment = 'raw' AND trade_date IN (SELECT trade_date FROM two)) WHERE trade_date = DATE '{DAY}')"""


@query(with_(BARS, _CLOSES) + "SELECT symbol, close, prev_close FROM cl")
def c11_day_closes(spark: SparkSession, d: str) -> DataFrame:
    b = _bars(spark, d)
    return M.day_closes(b, B.sessions(b), DAY)


@query(
    with_(BARS, _CLOSES)
    + """, lim AS (SELECT *, CASE WHEN substr(symbol, 1, 3) IN ('600', '000') THEN 0.10 ELSE 0.20 END::DECIMAL(6,4) AS pct FROM cl),
    bd AS (SELECT *, round(prev_close::DECIMAL(20,6) * (1 + pct), 2)::DOUBLE AS up, round(prev_close::DECIMAL(20,6) * (1 - pct), 2)::DOUBLE AS down FROM lim),
    st AS (SELECT CASE WHEN close IS NULL OR up IS NULL THEN 'skipped' WHEN abs(close - up) <= 0.005 THEN 'up' WHEN abs(close - down) <= 0.005 THEN 'down' WHEN close > up + 0.005 OR close < down - 0.005 THEN 'skipped' ELSE 'inside' END AS s FROM bd)
    SELECT count(*) FILTER (s = 'up') AS up, count(*) FILTER (s = 'down') AS down, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s <> 'skipped') AS judged FROM st"""
)
def d18_limit_hits(spark: SparkSession, d: str) -> DataFrame:
    b = _bars(spark, d)
    return M.limit_counts(M.day_closes(b, B.sessions(b), DAY))


@query("SELECT DISTINCT l_shipdate::DATE AS trade_date, 'left' AS side FROM lineitem WHERE l_shipdate::DATE NOT IN (SELECT o_orderdate::DATE FROM orders) UNION ALL SELECT DISTINCT o_orderdate::DATE, 'right' FROM orders WHERE o_orderdate::DATE NOT IN (SELECT l_shipdate::DATE FROM lineitem)")
def c19_calendar_difference(spark: SparkSession, d: str) -> DataFrame:
    return M.date_differences(B.table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("trade_date")), B.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("trade_date")))


@query("SELECT c.c_custkey, c.c_name, count(o.o_orderkey) AS used, coalesce(sum(o.o_totalprice::DECIMAL(18,2)), 0)::DOUBLE AS spent FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY ALL")
def c5_usage_by_user(spark: SparkSession, d: str) -> DataFrame:
    used = B.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("used"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spent"))
    return B.table(spark, d, "customer").join(used, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("spent", F.lit(0.0)).alias("spent"))


@query(with_(BARS, _CHANGED) + "SELECT trade_date, count(*) AS total, count(*) FILTER (change_pct > 0) AS up, count(*) FILTER (change_pct < 0) AS down, count(*) FILTER (change_pct = 0) AS flat, count(*) FILTER (change_pct IS NULL) AS without_pct, sum(amount::DECIMAL(38,2))::DOUBLE AS amount FROM qc GROUP BY trade_date")
def d1_breadth(spark: SparkSession, d: str) -> DataFrame:
    return M.breadth(_changed(spark, d))


@query(with_(EVENTS) + "SELECT event_time::DATE AS day, event_type, count(*) AS n, count(*) FILTER (importance_score >= 80) AS n_high FROM ev GROUP BY ALL")
def d3_event_days(spark: SparkSession, d: str) -> DataFrame:
    return M.event_days(B.events(spark, d))


_DAILY = "dly AS (SELECT trade_date, round(sum(change_pct::DECIMAL(28,6)) FILTER (abs(change_pct) <= 30)::DOUBLE / nullif(count(*) FILTER (abs(change_pct) <= 30), 0), 6) AS avg_pct, count(*) FILTER (abs(change_pct) <= 30) AS kept, count(*) FILTER (abs(change_pct) > 30) AS dropped FROM qc GROUP BY trade_date)"


@query(with_(BARS, _CHANGED, _DAILY) + "SELECT * FROM dly")
def d4_market_daily(spark: SparkSession, d: str) -> DataFrame:
    return M.market_daily(_changed(spark, d))


@query(with_(BARS, _CHANGED, _DAILY) + "SELECT trade_date, round(exp(sum(ln(1 + coalesce(avg_pct, 0) / 100)) OVER (ORDER BY trade_date)) * 1000, 4) AS level FROM dly")
def e15_market_curve(spark: SparkSession, d: str) -> DataFrame:
    return S.curve(M.market_daily(_changed(spark, d)).withColumn("r", F.col("avg_pct") / 100), "trade_date", "r")


@query(with_(EVENTS) + "SELECT count(*) AS rows, min(event_time)::DATE AS first_day, max(event_time)::DATE AS last_day FROM ev")
def d5_coverage(spark: SparkSession, d: str) -> DataFrame:
    return M.coverage(B.events(spark, d), F.to_date("event_time"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def d9_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return Q.duplicates(B.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(with_(BARS) + "SELECT min({'n': n, 'trade_date': trade_date}).trade_date AS trade_date, min(n) AS n FROM (SELECT trade_date, count(DISTINCT symbol) AS n FROM bars GROUP BY trade_date)")
def d8_thinnest_day(spark: SparkSession, d: str) -> DataFrame:
    return Q.thinnest_day(_bars(spark, d))


@query(with_(BARS) + "SELECT count_if(open IS NULL) AS null_open, count_if(high IS NULL) AS null_high, count_if(low IS NULL) AS null_low, count_if(close IS NULL) AS null_close, count_if(volume IS NULL) AS null_volume, count_if(amount IS NULL) AS null_amount, count_if(volume > 0 AND close IS NULL) AS traded_unpriced FROM bars")
def d24_null_counts(spark: SparkSession, d: str) -> DataFrame:
    return Q.null_counts(_bars(spark, d))


@query(with_(BARS, _CHANGED) + f"SELECT symbol, rank() OVER (ORDER BY change_pct DESC NULLS LAST, amount DESC NULLS LAST) AS rank, count(*) OVER () AS total, round((count(*) OVER () - rank() OVER (ORDER BY change_pct DESC NULLS LAST, amount DESC NULLS LAST) + 1) / count(*) OVER (), 6) AS percentile FROM qc WHERE trade_date = DATE '{DAY}'")
def e2_symbol_ranks(spark: SparkSession, d: str) -> DataFrame:
    return M.symbol_ranks(_changed(spark, d), DAY)


@query(with_(BARS) + "SELECT symbol, trade_date, CASE WHEN count(close) OVER w = 10 THEN round(CAST(sum(close::DECIMAL(28,8)) OVER w AS DOUBLE) / 10, 8) END AS ma FROM priced WHERE adjustment = 'qfq' WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS 9 PRECEDING)")
def e10_moving_average(spark: SparkSession, d: str) -> DataFrame:
    return S.moving_average(M.priced(_qfq(spark, d)), 10).select("symbol", "trade_date", "ma")


@query(
    with_(BARS)
    + """, m AS (SELECT symbol, trade_date, close, max(high) OVER w AS top, min(low) OVER w AS floor, count(high) OVER w AS n FROM priced WHERE adjustment = 'qfq' WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
    SELECT symbol, trade_date, close, top, floor, CASE WHEN close > top THEN 'long' ELSE 'exit' END AS signal FROM m WHERE n = 10 AND (close > top OR close < floor)"""
)
def e11_channel_breakouts(spark: SparkSession, d: str) -> DataFrame:
    return S.channel(M.priced(_qfq(spark, d)), 10)


@query(
    with_(BARS)
    + """, m AS (SELECT symbol, trade_date, open, close, volume, count(volume) OVER w AS n, round(CAST(sum(volume::DECIMAL(28,8)) OVER w AS DOUBLE) / 10, 6) AS mean_volume FROM priced WHERE adjustment = 'qfq' WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
    SELECT symbol, trade_date, volume, mean_volume FROM m WHERE n = 10 AND volume > 1.5 * mean_volume AND close > open"""
)
def e12_volume_breakouts(spark: SparkSession, d: str) -> DataFrame:
    return S.volume_breakouts(M.priced(_qfq(spark, d)), 10, 1.5)


@query()
def e13_wilder_rsi(spark: SparkSession, d: str) -> DataFrame:
    return S.wilder_rsi(M.priced(_qfq(spark, d)), 14)


@query(with_(BARS) + "SELECT symbol, round(max((peak - close) / peak), 6) AS max_drawdown FROM (SELECT symbol, close, max(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS peak FROM priced WHERE adjustment = 'qfq') GROUP BY symbol")
def e14_drawdowns(spark: SparkSession, d: str) -> DataFrame:
    return S.drawdowns(M.priced(_qfq(spark, d)))


@query(with_(BARS, _CHANGED) + "SELECT symbol, count(*) AS n, round(any_value(m), 6) AS mean, round(stddev_samp(x), 6) AS sd, CASE WHEN avg(d * d) > 0 THEN round(avg(d * d * d) / avg(d * d) ** 1.5, 5) END AS skew, CASE WHEN avg(d * d) > 0 THEN round(avg(d * d * d * d) / avg(d * d) ** 2, 5) END AS kurt FROM (SELECT symbol, change_pct AS x, avg(change_pct) OVER (PARTITION BY symbol) AS m, change_pct - avg(change_pct) OVER (PARTITION BY symbol) AS d FROM qc WHERE change_pct IS NOT NULL) GROUP BY symbol")
def i11_moments(spark: SparkSession, d: str) -> DataFrame:
    m = S.moments(_changed(spark, d), "symbol", F.col("change_pct"))
    return m.select("symbol", "n", *[F.round(c, k).alias(c) for c, k in (("mean", 6), ("sd", 6), ("skew", 5), ("kurt", 5))])


@query(with_(BARS, _CHANGED) + f"SELECT symbol, close, volume, change_pct FROM qc WHERE trade_date = DATE '{DAY}' ORDER BY change_pct DESC NULLS LAST, symbol LIMIT 20 OFFSET 3")
def f1_cross_section(spark: SparkSession, d: str) -> DataFrame:
    return M.cross_section(_changed(spark, d), DAY, limit=20, offset=3).select("symbol", "close", "volume", "change_pct")


@query(with_(EVENTS) + "SELECT event_id, importance_score FROM ev WHERE event_time::DATE BETWEEN DATE '1994-01-01' AND DATE '1994-12-31' AND event_type IN ('purchase', 'view') AND importance_score >= 10 ORDER BY importance_score DESC NULLS LAST, event_id LIMIT 25")
def f2_event_feed(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("event_time")
    rows = B.events(spark, d).where(day.between(F.lit("1994-01-01").cast("date"), F.lit("1994-12-31").cast("date")) & F.col("event_type").isin("purchase", "view") & (F.col("importance_score") >= 10))
    return M.page(rows, [F.desc_nulls_last("importance_score"), F.asc("event_id")], 25).select("event_id", "importance_score")


@query("SELECT event_id, event_type, sha256(strftime(ts, '%Y-%m-%d') || '|' || event_id) AS key FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY sha256(strftime(ts, '%Y-%m-%d') || '|' || event_id)) <= 10")
def f6_hash_ordered_sample(spark: SparkSession, d: str) -> DataFrame:
    e = B.table(spark, d, "events").select("event_id", "event_type", F.sha2(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("|"), F.col("event_id")), 256).alias("key"))
    return e.withColumn("rn", F.row_number().over(Window.partitionBy("event_type").orderBy("key"))).where("rn <= 10").drop("rn")


@query(
    with_(EVENTS)
    + """, r AS (SELECT event_id, event_time::DATE AS day, unnest(CASE WHEN event_id % 3 = 0 THEN ['news', 'policy'] WHEN event_id % 4 = 0 THEN ['factor', 'policy', 'news'] ELSE ['policy'] END) AS role FROM ev)
    SELECT event_id, day, arg_min(role, list_position(['news', 'policy', 'factor'], role)) AS role, count(*) - 1 AS copies FROM r GROUP BY event_id, day"""
)
def g4_merged_evidence(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("news"), F.lit("policy"))).when(F.col("event_id") % 4 == 0, F.array(F.lit("factor"), F.lit("policy"), F.lit("news"))).otherwise(F.array(F.lit("policy")))
    return M.merged_evidence(B.events(spark, d).select("event_id", F.to_date("event_time").alias("day"), F.explode(role).alias("role")), ["news", "policy", "factor"])


@query("SELECT event_id, event_type, json_extract_string(props, '$.k')::DOUBLE AS score FROM events")
def h5_factor_score(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import factor_score

    return B.events(spark, d).select("event_id", "event_type", factor_score(F.col("factor_scores")).alias("score"))


@query(with_(BARS) + "SELECT DISTINCT symbol, CASE WHEN substr(symbol, 1, 3) IN ('600', '000') THEN 0.1 ELSE 0.2 END::DOUBLE AS pct FROM bars WHERE length(symbol) = 6")
def h9_board_limits(spark: SparkSession, d: str) -> DataFrame:
    return _bars(spark, d).select("symbol").distinct().select("symbol", rules.board_limit(F.col("symbol")).alias("pct")).where("pct IS NOT NULL")


@query("SELECT l_orderkey, l_linenumber, l_returnflag, round(greatest(l_quantity * 100 * l_extendedprice * 0.00025::DOUBLE, 5.0::DOUBLE) + CASE WHEN l_returnflag = 'R' THEN l_quantity * 100 * l_extendedprice * 0.0005::DOUBLE ELSE 0 END, 6) AS fees FROM lineitem WHERE l_quantity > 0")
def h14_fees(spark: SparkSession, d: str) -> DataFrame:
    side = F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy")
    return B.table(spark, d, "lineitem").where("l_quantity > 0").select("l_orderkey", "l_linenumber", "l_returnflag", F.round(rules.fees(side, F.col("l_quantity") * 100, F.col("l_extendedprice")), 6).alias("fees"))


@query(with_(BARS) + "SELECT symbol, max(trade_date) AS last_day FROM priced GROUP BY symbol HAVING max(trade_date) + 30 < (SELECT max(trade_date) FROM priced)")
def i19_delisted(spark: SparkSession, d: str) -> DataFrame:
    return M.delisted(_bars(spark, d))


@query(
    with_(BARS, SESSIONS, EVENTS)
    + """, ch AS (SELECT symbol, adjustment, trade_date, round((close / lag(close) OVER w - 1) * 100, 6) AS pct, (close / lag(close) OVER w - 1) * 100 AS now FROM priced WINDOW w AS (PARTITION BY symbol, adjustment ORDER BY trade_date)),
    c AS (SELECT *, row_number() OVER (PARTITION BY symbol, adjustment ORDER BY trade_date) AS rn FROM ch WHERE pct IS NOT NULL),
    n AS (SELECT trade_date, count(DISTINCT symbol) AS n FROM bars WHERE adjustment = 'qfq' GROUP BY trade_date), n2 AS (SELECT n, lag(n) OVER (ORDER BY trade_date) AS b FROM n),
    cal AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS trade_date, 1 AS m FROM orders),
    dd AS (SELECT DISTINCT event_time::DATE AS day FROM ev), sp AS (SELECT unnest(range((SELECT min(day) FROM dd), (SELECT max(day) FROM dd) + 1, INTERVAL 1 DAY))::DATE AS day),
    e2 AS (SELECT *, event_type || '|' || symbols[1] || '|' || hour(event_time) AS dedup_key, event_type || score AS content_hash, CASE WHEN event_id % 500 = 0 THEN repeat('x', 13) ELSE direction END AS told FROM ev),
    f(id, bad, failing) AS (
      SELECT 'B2', 'error', (SELECT count(*) FROM (SELECT 1 FROM bars GROUP BY symbol, adjustment, trade_date HAVING count(*) > 1))
      UNION ALL SELECT 'B3', 'error', (SELECT count(*) FROM bars WHERE volume > 0 AND close IS NULL)
      UNION ALL SELECT 'B4', 'info', (SELECT count(*) FROM bars WHERE close IS NULL)
      UNION ALL SELECT 'B5', 'warn', (SELECT count_if(adjustment = 'qfq' AND rn > 5 AND abs(pct) > 31) + count_if(adjustment <> 'raw' AND abs(now - pct) > 0.011) FROM c)
      UNION ALL SELECT 'B6', 'warn', (SELECT count(*) FROM (SELECT DISTINCT adjustment FROM bars WHERE volume > 400))
      UNION ALL SELECT 'B7', 'warn', (SELECT count(*) FROM n2 WHERE n < b * 0.9)
      UNION ALL SELECT 'B8', 'error', (SELECT count(*) FROM cal FULL JOIN ses USING (trade_date) WHERE cal.m IS NULL OR ses.session_idx IS NULL)
      UNION ALL SELECT 'E2', 'error', (SELECT count(*) FROM (SELECT 1 FROM e2 GROUP BY event_time::DATE, dedup_key HAVING count(*) > 1)) + (SELECT count(*) FROM (SELECT 1 FROM e2 GROUP BY event_id, content_hash HAVING count(*) > 1))
      UNION ALL SELECT 'E3', 'error', (SELECT count(*) FROM ev WHERE available_at IS NULL OR available_at < event_time)
      UNION ALL SELECT 'E4', 'warn', (SELECT count(*) FROM e2 WHERE length(told) > 12)
      UNION ALL SELECT 'E5', 'warn', (SELECT count(DISTINCT s) FROM (SELECT unnest(symbols) AS s FROM ev) WHERE NOT regexp_full_match(s, '[0-9]{6}'))
      UNION ALL SELECT 'E6', 'info', (SELECT count(*) FROM (SELECT 1 FROM ev GROUP BY event_id HAVING count(DISTINCT event_time::DATE) > 1))
      UNION ALL SELECT 'E7', 'info', (SELECT count(*) FROM sp WHERE day NOT IN (SELECT day FROM dd)))
    SELECT id, CASE WHEN failing > 0 THEN bad ELSE 'ok' END AS level, failing FROM f"""
)
def l18_health_suite(spark: SparkSession, d: str) -> DataFrame:
    b = _bars(spark, d).withColumn("trading_status", F.when(F.col("volume") > 400, "new").otherwise("traded"))
    calendar = B.table(spark, d, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("trade_date"))
    key = F.concat_ws("|", "event_type", F.col("symbols")[0], F.hour("event_time").cast("string"))
    e = B.events(spark, d).withColumns({"dedup_key": key, "content_hash": F.concat("event_type", F.col("score").cast("string")), "direction_norm": F.col("direction")})
    e = e.withColumn("direction", F.when(F.col("event_id") % 500 == 0, F.repeat(F.lit("x"), 13)).otherwise(F.col("direction")))
    return Q.run_suite(Q.suite(b, e, B.sessions(b), calendar)).unionByName(Q.one_pass(b, e)).select("id", "level", "failing")
