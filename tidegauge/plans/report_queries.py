"""Lookups, feeds, evidence, attribution, freshness and text rules over the shared tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import factor as I
from ..operators import market as M
from ..operators import quality as Q
from ..operators import series as S
from ..operators import state as N
from ..operators import trades as K
from ..sources import bindings as B
from ..sources import lake
from .market_queries import _CHANGED, _NAMES, _dictionary, AS_OF, BARS, DAY, EVENTS, with_
from .model_queries import _FACTOR, _IC, _MEMBERS, _PORT, _TRIPS, _TURN, MIN_POOL, _members, _order_fills, _sides

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _qfq(spark, d):
    return M.of_adjustment(B.bars(spark, d), "qfq")


def _table(name):
    return lambda spark, d: B.table(spark, d, name)


@query(with_(EVENTS) + "SELECT event_id, event_time::DATE AS day, event_type FROM ev WHERE event_id % 37 = 0 AND event_id % 2 = 0")
def a9_events_by_id(spark: SparkSession, d: str) -> DataFrame:
    e = B.events(spark, d)
    wanted = e.where("event_id % 37 = 0").select("event_id", F.when(F.col("event_id") % 2 == 0, F.to_date("event_time")).otherwise(F.date_add(F.to_date("event_time"), 1)).alias("day"))
    return M.events_by_id(e, wanted).select("event_id", "day", "event_type")


@query(
    with_(EVENTS)
    + """, e AS (SELECT event_id % 500 AS id, event_time, available_at, event_type, importance_score FROM ev), w AS (SELECT DISTINCT id, CASE WHEN id % 2 = 0 THEN min(event_time::DATE) END AS day FROM e GROUP BY id)
    SELECT w.id AS event_id, w.day, e.event_time FROM w JOIN e ON e.id = w.id AND (w.day IS NULL OR e.event_time::DATE = w.day) QUALIFY row_number() OVER (PARTITION BY w.id, w.day ORDER BY e.event_time DESC, e.available_at DESC) = 1"""
)
def a10_event_detail(spark: SparkSession, d: str) -> DataFrame:
    e = B.events(spark, d).withColumn("event_id", F.col("event_id") % 500)
    wanted = e.groupBy("event_id").agg(F.min(F.to_date("event_time")).alias("day")).withColumn("day", F.when(F.col("event_id") % 2 == 0, F.col("day")))
    return M.event_detail(e, wanted).select("event_id", "day", "event_time")


@query(with_(BARS) + "SELECT adjustment, year(trade_date)::INT AS year, count(*) AS rows, count(DISTINCT symbol) AS symbols, min(trade_date) AS first_day, max(trade_date) AS last_day FROM bars GROUP BY ALL")
def a13_shard_stats(spark: SparkSession, d: str) -> DataFrame:
    return lake.shard_stats(B.bars(spark, d)).drop("fingerprint")


@query(
    r"""WITH n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '%') WHEN 1 THEN replace(p_name, ' ', '_') ELSE replace(p_name, ' ', '\') END AS name,
      CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '%') WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN replace(p_name, ' ', '\') ELSE replace(p_name, ' ', 'x') END AS other FROM part)
    SELECT p_partkey, contains(lower(other), lower(substr(name, 2, 12))) AS hit FROM n"""
)
def b8_escaped_contains(spark: SparkSession, d: str) -> DataFrame:
    """Names with %, _ and the escape itself, asked for in names that have the same or another mark in those places."""
    marked = lambda by, marks: F.replace("p_name", F.lit(" "), F.element_at(F.array(*map(F.lit, marks)), (F.col("p_partkey") % by + 1).cast("int")))
    p = B.table(spark, d, "part").select("p_partkey", marked(3, ["%", "_", "\\"]).alias("name"), marked(4, ["%", "_", "\\", "x"]).alias("other"))
    asked = p.withColumn("asked", F.concat(F.lit("%"), text.like_escaped(F.substring("name", 2, 12)), F.lit("%")))
    return asked.select("p_partkey", F.expr("other ILIKE asked ESCAPE '\\\\'").alias("hit"))


@query(_NAMES + "SELECT symbol, name FROM dic WHERE starts_with(symbol, '3000') OR contains(name, 'err')")
def b12_matched_symbols(spark: SparkSession, d: str) -> DataFrame:
    names = _dictionary(spark, d)
    return M.matched_symbols(names, "3000").unionByName(M.matched_symbols(names, "err")).select("symbol", "name").distinct()


@query("SELECT o_orderkey, (o_orderdate::DATE - INTERVAL 1 MONTH)::DATE AS month, (o_orderdate::DATE - INTERVAL 6 MONTH)::DATE AS half FROM orders")
def b16_month_windows(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return B.table(spark, d, "orders").select("o_orderkey", M.month_window(day, 1).alias("month"), M.month_window(day, 6).alias("half"))


@query(with_(BARS, EVENTS) + f", t AS (SELECT DISTINCT unnest(symbols) AS symbol FROM ev WHERE available_at <= TIMESTAMP '{AS_OF}' AND len(industries) > 0), px AS (SELECT symbol FROM priced WHERE adjustment = 'qfq' AND trade_date = DATE '{DAY}') SELECT count(*) AS total, count_if(symbol IN (SELECT symbol FROM t)) AS covered FROM px")
def c4_tag_coverage(spark: SparkSession, d: str) -> DataFrame:
    return M.tag_coverage(M.on_day(_qfq(spark, d), DAY), B.events(spark, d), AS_OF)


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7")
def c6_own_decisions(spark: SparkSession, d: str) -> DataFrame:
    accounts = B.table(spark, d, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return B.table(spark, d, "orders").join(accounts, "o_custkey").select("o_orderkey", "c_name")


@query(
    with_(BARS)
    + """, f AS (SELECT symbol, trade_date, close, first_value(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS f FROM priced WHERE adjustment = 'qfq')
    SELECT symbol, trade_date, round(1000000.0 * (1 - 0.00025) / (f * (1 + 5.0 / 10000)) * close, 4) AS level FROM f"""
)
def i14_hold_curve(spark: SparkSession, d: str) -> DataFrame:
    return S.hold_curve(M.priced(_qfq(spark, d)), 1_000_000.0).withColumn("level", F.round("level", 4))


@query(
    with_(BARS)
    + """, a AS (SELECT symbol, trade_date, close AS x FROM priced WHERE adjustment = 'qfq'), b AS (SELECT symbol, trade_date, close AS y FROM priced WHERE adjustment = 'raw')
    SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS i, round(x - y, 6) AS gap FROM a JOIN b USING (symbol, trade_date)"""
)
def c12_aligned_curves(spark: SparkSession, d: str) -> DataFrame:
    return S.aligned_gaps(M.priced(B.bars(spark, d)), "qfq", "raw")


@query(
    with_(BARS)
    + """, c AS (SELECT symbol, trade_date, close AS v, CASE WHEN lag(close) OVER w > 0 THEN close / lag(close) OVER w - 1 END AS r, 1 - close / max(close) OVER w AS dd FROM priced WHERE adjustment = 'qfq' WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
    m AS (SELECT symbol, count(*) AS n, arg_max(v, trade_date) / 50.0 - 1 AS total, max(dd) AS dd, avg(r) AS mean, stddev_samp(r) AS sd, count(r) AS k FROM c GROUP BY symbol)
    SELECT symbol, n, round(total, 6) AS total, round(CASE WHEN total <= -1 THEN -1 ELSE (1 + total) ** (252.0 / n) - 1 END, 6) AS annual, round(dd, 6) AS max_drawdown, CASE WHEN k >= 2 AND sd > 0 THEN round(mean / sd * sqrt(252.0), 4) END AS sharpe,
      CASE WHEN k >= 2 THEN round(sd * sqrt(252.0), 6) END AS volatility, round(round(total, 6) - 0.02, 6) AS excess FROM m"""
)
def i16_performance(spark: SparkSession, d: str) -> DataFrame:
    return S.performance(M.priced(_qfq(spark, d)), "symbol", "trade_date", "close", 50.0, F.lit(0.02))


_SNAP = """, s AS (SELECT event_id % 3000 AS event_id, event_time::DATE AS day, event_type AS owner, md5((event_id % 5)::VARCHAR) AS h FROM ev), c AS (SELECT event_id, event_time::DATE AS day, md5((event_id % 4)::VARCHAR) AS h FROM ev WHERE event_id < 2000)"""


@query(with_(EVENTS) + _SNAP + " SELECT s.event_id, s.day, bool_or(c.event_id IS NOT NULL) AS found, coalesce(max(s.h) <> max(c.h), false) AS revised, array_to_string(list_sort(list_distinct(list(owner))), ',') AS owners FROM s LEFT JOIN c ON s.event_id = c.event_id AND s.day = c.day GROUP BY s.event_id, s.day")
def c13_resolved_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = B.events(spark, d).withColumn("day", F.to_date("event_time"))
    snapshots = e.select((F.col("event_id") % 3000).alias("event_id"), "day", F.col("event_type").alias("owner"), F.md5((F.col("event_id") % 5).cast("string")).alias("content_hash"))
    corpus = e.where("event_id < 2000").select("event_id", "day", F.md5((F.col("event_id") % 4).cast("string")).alias("content_hash"))
    return M.resolved_evidence(snapshots, corpus).withColumn("owners", F.array_join("owners", ","))


_CLOSED = "count(*) AS trips, count(exit_id) AS closed, count_if(exit_id IS NOT NULL AND pnl > 0) AS wins, coalesce(sum(CASE WHEN exit_id IS NOT NULL THEN pnl END::DECIMAL(28,4)), 0)::DOUBLE AS realised"


@query(
    with_(_TRIPS, EVENTS)
    + f""", m AS (SELECT tr.exit_id, tr.pnl, ev.event_id, ev.direction, ev.industries FROM tr LEFT JOIN ev ON ev.event_id = tr.entry_id % 20000),
    k AS (SELECT 'direction' AS kind, CASE WHEN event_id IS NULL THEN 'no_event' ELSE coalesce(direction, 'unknown') END AS name, exit_id, pnl FROM m UNION ALL SELECT 'industry', unnest(industries), exit_id, pnl FROM m WHERE event_id IS NOT NULL)
    SELECT kind, name, {_CLOSED} FROM k GROUP BY kind, name"""
)
def d16_signal_attribution(spark: SparkSession, d: str) -> DataFrame:
    paired = K.trips(_order_fills(spark, d))
    sources = paired.select("entry_id", (F.col("entry_id") % 20000).alias("event_id")).distinct()
    return K.signal_attribution(paired, sources, B.events(spark, d).select("event_id", "direction", "industries"))


@query(_NAMES + "SELECT symbol FROM (SELECT symbol, arg_max('*ST' || CASE WHEN name LIKE 'error%' THEN '样' ELSE 'x' END, {'a': count, 'b': last_seen, 'd': -epoch_us(first_seen), 'c': '*ST' || CASE WHEN name LIKE 'error%' THEN '样' ELSE 'x' END}) AS n FROM dic GROUP BY symbol) WHERE n = '*ST样'")
def d13_warned_symbols(spark: SparkSession, d: str) -> DataFrame:
    named = _dictionary(spark, d).withColumn("name", F.concat(F.lit("*ST"), F.when(F.col("name").startswith("error"), "样").otherwise("x")))
    return M.warned_symbols(named)


@query("SELECT l_shipmode AS code, count(*) AS n FROM (SELECT CASE WHEN l_linenumber % 3 > 0 THEN 'c' || (l_partkey % 5) END AS l_shipmode FROM lineitem) WHERE l_shipmode IS NOT NULL GROUP BY ALL")
def d14_rejects(spark: SparkSession, d: str) -> DataFrame:
    return K.rejects(B.table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.lit("c"), F.col("l_partkey") % 5)).alias("code")))


_TITLES = "t AS (SELECT event_id, (['公司股份回购进展', '股东减持计划', '业绩预增公告', '签订重大合同', '收到问询函', 'nothing of note'])[(event_id % 6 + 1)::INT] AS title, industries FROM ev)"


def _titled(spark, d):
    titles = F.array(*[F.lit(t) for t in ("公司股份回购进展", "股东减持计划", "业绩预增公告", "签订重大合同", "收到问询函", "nothing of note")])
    return B.events(spark, d).withColumn("title", F.element_at(titles, (F.col("event_id") % 6 + 1).cast("int")))


@query(with_(EVENTS, _TITLES) + "SELECT coalesce((['股份回购', '股东减持', '业绩预增', '中标与合同', '诉讼与监管', NULL])[(event_id % 6 + 1)::INT], '-') AS category, coalesce((['利多', '利空', '利多', '利多', '利空', NULL])[(event_id % 6 + 1)::INT], '-') AS direction, count(*) AS n FROM t GROUP BY ALL")
def d19_title_counts(spark: SparkSession, d: str) -> DataFrame:
    c = _titled(spark, d).select(text.title_class(F.col("title")).alias("c"))
    return c.groupBy(F.coalesce("c.category", F.lit("-")).alias("category"), F.coalesce("c.direction", F.lit("-")).alias("direction")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def d20_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, coalesce(used, 0) AS used, count(*) OVER () AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS used FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' GROUP BY 1) ON o_custkey = c_custkey WHERE contains(lower(c_name), '00') ORDER BY used DESC, c_custkey LIMIT 20 OFFSET 10")
def d21_usage_page(spark: SparkSession, d: str) -> DataFrame:
    used = N.used_between(B.table(spark, d, "orders"), "o_custkey", "o_orderdate", "1995-01-01", "1996-12-31")
    return N.usage_page(B.table(spark, d, "customer").select("c_custkey", "c_name"), used.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "c_name", "00", 20, 10)


@query("SELECT l_returnflag AS mode, round(avg(coalesce(CASE WHEN l_partkey % 4 > 0 THEN l_discount END, 0)), 6) AS mean FROM lineitem GROUP BY ALL")
def d22_metric_means(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("mode")).agg(F.round(F.avg(F.coalesce(F.when(F.col("l_partkey") % 4 > 0, F.col("l_discount")), F.lit(0.0))), 6).alias("mean"))


@query("SELECT l_linestatus AS part, count(*) AS judged, round(avg(l_tax), 6) AS mean FROM lineitem WHERE l_suppkey % 3 > 0 GROUP BY ALL")
def d23_judged_means(spark: SparkSession, d: str) -> DataFrame:
    return N.judged_means(B.table(spark, d, "lineitem").withColumn("score", F.when(F.col("l_suppkey") % 3 > 0, F.col("l_tax"))), F.col("l_linestatus").alias("part"), "score")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, o_orderstatus IN ('O', 'F') AS known FROM orders GROUP BY ALL")
def d25_status_distribution(spark: SparkSession, d: str) -> DataFrame:
    return Q.value_distribution(B.table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", ("O", "F"))


_FEED = "SELECT event_type, event_id, event_time, (SELECT count(*) FROM ev WHERE event_type = '{0}') > {1} AS truncated FROM (SELECT * FROM ev WHERE event_type = '{0}' ORDER BY event_time DESC, event_id DESC LIMIT {1})"


@query(with_(EVENTS) + _FEED.format("error", 40) + " UNION ALL " + _FEED.format("signup", 5000))
def f3_truncated_feed(spark: SparkSession, d: str) -> DataFrame:
    """A feed that has more than its limit, and one that hasn't unless the table is large."""
    feed = lambda kind, limit: M.truncated_feed(B.events(spark, d).where(F.col("event_type") == kind), "event_time", "event_id", limit).select("event_type", "event_id", "event_time", "truncated")
    return feed("error", 40).unionByName(feed("signup", 5000))


@query("SELECT l_orderkey * 10 + l_linenumber AS cell, l_discount AS sharpe FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber < 5 ORDER BY l_discount DESC, l_tax DESC NULLS LAST, cell LIMIT 1")
def f5_best_cell(spark: SparkSession, d: str) -> DataFrame:
    c = B.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cell"), F.when(F.col("l_linenumber") < 5, F.col("l_discount")).alias("sharpe"), F.col("l_tax").alias("total_return"), F.when(F.col("l_returnflag") == "N", "ok").otherwise("failed").alias("status"))
    return K.best_cell(c).select("cell", "sharpe")


@query("WITH r AS (SELECT source, doc_id, sum(octet_length(encode(coalesce(text, '')))) OVER (PARTITION BY source ORDER BY doc_id) AS bytes FROM documents) SELECT source, doc_id, max(bytes) OVER (PARTITION BY source) > 20000 AS dropped FROM r QUALIFY bytes <= 20000")
def f9_capped_payload(spark: SparkSession, d: str) -> DataFrame:
    return M.capped_payload(B.table(spark, d, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("text")), "source", "doc_id", "text", 20_000).select("source", "doc_id", "dropped")


@query("SELECT coalesce(a.day, b.day) AS day, coalesce(a.n, 0) AS indexed, coalesce(b.n, 0) AS there FROM (SELECT l_shipdate::DATE AS day, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) a FULL JOIN (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1) b ON a.day = b.day WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def g3_index_differences(spark: SparkSession, d: str) -> DataFrame:
    day = lambda name, c: B.table(spark, d, name).withColumn("day", F.col(c).cast("date"))
    return Q.day_count_differences(day("lineitem", "l_shipdate").where("l_linenumber = 1"), day("orders", "o_orderdate"))


@query(with_(BARS) + "SELECT DISTINCT trade_date FROM bars")
def g5_trade_dates(spark: SparkSession, d: str) -> DataFrame:
    return M.of_adjustment(B.bars(spark, d), None).select("trade_date").distinct()


@query("SELECT doc_id, substr(text, greatest(1, instr(text, 'the ') - 5), instr(text, 'the ') + 4 + 5 - greatest(1, instr(text, 'the ') - 5)) AS snippet FROM documents WHERE instr(text, 'the ') > 0")
def h17_phrase_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = B.table(spark, d, "documents").select("doc_id", F.explode(text.phrase_hits(F.col("text"), ("the ", "no such phrase anywhere"), 5)).alias("h"))
    return hits.select("doc_id", "h.snippet")


@query(with_(EVENTS, _TITLES) + "SELECT event_id, '【标题】' || title || chr(10) || '【类型】kind 【重要度】' || '7.0' || CASE WHEN len(industries) > 0 THEN ' 【行业】' || array_to_string(industries, '/') ELSE '' END || chr(10) || 's' AS body FROM t")
def h18_embedding_text(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    body = text.embedding_text(F.col("title"), F.lit(" s "), F.col("industries"), F.array(F.lit(" ")), F.lit("kind"), F.lit(None).cast("timestamp_ntz"), none, F.lit(7.0))
    return _titled(spark, d).select("event_id", body.alias("body"))


@query(
    with_(BARS)
    + """, l AS (SELECT symbol, trade_date, close, high, low, amount, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS k, close / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS r FROM priced WHERE adjustment = 'qfq')
    SELECT symbol, round(max(close) FILTER (k = 1) / max(close) FILTER (k = 60) - 1, 6) AS window_return, max(high) AS high, min(low) AS low, round(stddev_samp(r) FILTER (k < 60) * sqrt(252.0), 6) AS volatility, round(avg(close) FILTER (k <= 20), 6) AS ma20,
      round(max(close) FILTER (k = 1) / max(close) FILTER (k = 21) - 1, 6) AS momentum20, round(avg(amount) FILTER (k <= 20), 0) AS amount20 FROM l WHERE k <= 60 GROUP BY symbol HAVING count(*) >= 60"""
)
def h19_market_numbers(spark: SparkSession, d: str) -> DataFrame:
    return S.market_numbers(M.priced(_qfq(spark, d)), 60).where("bars >= 60").drop("bars")


@query("SELECT page_id, CASE WHEN lower(trim(u)) LIKE 'http://%' OR lower(trim(u)) LIKE 'https://%' THEN trim(u) END AS safe FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '  ' || url || ' ' WHEN 1 THEN 'x' || url ELSE url END AS u FROM pages)")
def h22_safe_urls(spark: SparkSession, d: str) -> DataFrame:
    url, k = F.col("url"), F.col("page_id") % 3
    told = F.when(k == 0, F.concat(F.lit("  "), url, F.lit(" "))).when(k == 1, F.concat(F.lit("x"), url)).otherwise(url)
    return B.table(spark, d, "pages").select("page_id", text.safe_url(told).alias("safe"))


@query("SELECT p_partkey, (p_partkey % 3 = 0 AND length(p_name) >= 8) OR p_partkey % 5 = 0 OR p_partkey % 7 = 0 AS leak FROM part")
def h24_leaks(spark: SparkSession, d: str) -> DataFrame:
    asked = F.when(F.col("p_partkey") % 5 == 0, "what of 600123 now").when(F.col("p_partkey") % 7 == 0, "news of 2024-03").when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("? "), F.substring("p_name", 1, 8))).otherwise("who knows")
    return B.table(spark, d, "part").select("p_partkey", text.leaks(asked, F.col("p_name")).alias("leak"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate::DATE + INTERVAL 57599 SECOND WHEN 1 THEN o_orderdate::DATE + INTERVAL 1 HOUR END AS at FROM orders")
def h25_as_of(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    told = F.when(F.col("o_orderkey") % 3 == 0, day).when(F.col("o_orderkey") % 3 == 1, F.concat(day, F.lit("T09:00:00"))).otherwise("no day")
    return B.table(spark, d, "orders").select("o_orderkey", text.as_of(told).alias("at"))


@query(with_(*_FACTOR, _IC, _MEMBERS, _TURN, _PORT) + """, z AS (SELECT count(*) AS days, avg(ic::DECIMAL(20,6))::DOUBLE AS m, coalesce(stddev_samp(ic), 0) AS sd, count_if(ic > 0) AS positive_days FROM ic WHERE ic IS NOT NULL),
    ls AS (SELECT round(a.gross - b.gross, 8) AS spread FROM po a JOIN po b ON a.trade_date = b.trade_date AND a.q = 4 AND b.q = 0)
    SELECT 'ic' AS part, -1 AS q, days, round(m, 6) AS mean, round(m / nullif(sd, 0) * sqrt(days), 3) AS t FROM z
    UNION ALL SELECT 'spread', -1, count(*), round(avg(spread::DECIMAL(20,8))::DOUBLE, 6), round(avg(spread::DECIMAL(20,8))::DOUBLE / nullif(stddev_samp(spread), 0) * sqrt(count(*)), 3) FROM ls
    UNION ALL SELECT 'slice', q, count(*), round(avg(net::DECIMAL(20,8))::DOUBLE, 6), round(avg(net::DECIMAL(20,8))::DOUBLE / nullif(stddev_samp(net), 0) * sqrt(count(*)), 3) FROM po GROUP BY q""")
def i10_tear_sheet(spark: SparkSession, d: str) -> DataFrame:
    return I.report(I.rank_ic_of_legs(*_sides(spark, d), MIN_POOL), I.quantile_portfolios(_members(spark, d)))


@query(
    with_(BARS, EVENTS)
    + """, st AS (SELECT symbol, max(trade_date) AS last_day FROM priced GROUP BY symbol HAVING max(trade_date) + 30 < (SELECT max(trade_date) + 60 FROM priced)),
    t AS (SELECT unnest(symbols) AS symbol, CASE WHEN event_id % 9 = 0 THEN '进入退市整理期' WHEN event_id % 2 = 0 THEN '退市风险 ' || (event_id % 4) ELSE 'x' END AS title FROM ev),
    b AS (SELECT symbol, max({'s': CASE WHEN contains(title, '退市整理期') THEN 2 ELSE 1 END, 't': title}) AS m FROM t WHERE contains(title, '退市') GROUP BY symbol)
    SELECT st.symbol, last_day, m.t AS title, m.s AS strength FROM st LEFT JOIN b USING (symbol) WHERE last_day >= (SELECT min(event_time)::DATE FROM ev)"""
)
def i20_delisting_evidence(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(F.col("event_id") % 9 == 0, "进入退市整理期").when(F.col("event_id") % 2 == 0, F.concat(F.lit("退市风险 "), F.col("event_id") % 4)).otherwise("x")
    return M.delisting_evidence(M.delisted(B.bars(spark, d), -30), B.events(spark, d).withColumn("title", title), "退市整理期", "退市")


@query(with_(EVENTS, _TITLES) + "SELECT event_id, strftime(event_time, '%Y-%m-%dT%H:%M:%S') AS at, len(symbols) AS n FROM ev WHERE event_time::DATE = DATE '1994-03-05'")
def j8_index_payload(spark: SparkSession, d: str) -> DataFrame:
    day = B.events(spark, d).where(F.to_date("event_time") == F.lit("1994-03-05").cast("date"))
    return day.select("event_id", F.struct(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss").alias("event_time"), "symbols").alias("payload")).select("event_id", F.col("payload.event_time").alias("at"), F.size("payload.symbols").cast("long").alias("n"))


@query("SELECT doc_id, row_number() OVER (ORDER BY length(coalesce(text, '')), doc_id) - 1 AS place, (row_number() OVER (ORDER BY length(coalesce(text, '')), doc_id) - 1) // 32 AS batch FROM documents")
def j9_length_batches(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import retrieval as J

    return J.length_batches(B.table(spark, d, "documents"), "text", "doc_id", 32)


@query(with_(EVENTS) + "SELECT event_time::DATE AS day, count(*) AS n FROM ev GROUP BY ALL")
def j13_day_facets(spark: SparkSession, d: str) -> DataFrame:
    return B.events(spark, d).groupBy(F.to_date("event_time").alias("day")).agg(F.count("*").alias("n"))


@query(
    with_(BARS, _TRIPS)
    + """, p AS (SELECT (l.n % 10)::VARCHAR AS symbol, 40.0 + l.n AS close FROM range(1, 8) l(n)), m AS (SELECT tr.*, p.close FROM tr LEFT JOIN p USING (symbol))
    SELECT account, symbol, entry_id, exit_id, round(coalesce(pnl, close * qty - cost), 2) AS pnl, round(coalesce(return_pct, (close * qty - cost) / nullif(cost, 0)), 6) AS return_pct FROM m"""
)
def k21_marked_trips(spark: SparkSession, d: str) -> DataFrame:
    closes = spark.range(1, 8).select((F.col("id") % 10).cast("string").alias("symbol"), (F.col("id") + 40.0).alias("close"))
    m = K.marked(K.trips(_order_fills(spark, d)), closes)
    return m.select("account", "symbol", "entry_id", "exit_id", F.round("pnl", 2).alias("pnl"), "return_pct")


@query(with_(_TRIPS) + ", s AS (SELECT entry_id, CASE WHEN entry_id % 3 > 0 THEN exit_id END AS was, entry_id % 5 AS as_of FROM tr WHERE entry_id % 7 > 0) SELECT tr.entry_id FROM tr LEFT JOIN s USING (entry_id) WHERE s.entry_id IS NULL OR (was IS NULL AND (exit_id IS NOT NULL OR s.as_of < 3))")
def k22_to_settle(spark: SparkSession, d: str) -> DataFrame:
    paired = K.trips(_order_fills(spark, d)).withColumn("as_of", F.lit(3).cast("long"))
    stored = paired.where("entry_id % 7 > 0").select("entry_id", F.when(F.col("entry_id") % 3 > 0, F.col("exit_id")).alias("exit_id"), (F.col("entry_id") % 5).alias("as_of"))
    return K.to_settle(paired, stored).select("entry_id")


@query(with_(_TRIPS) + "SELECT account, symbol, entry_id, exit_date, pnl FROM tr WHERE symbol = '3' AND pnl < 0 ORDER BY exit_date DESC, entry_id DESC LIMIT 25")
def k23_lessons(spark: SparkSession, d: str) -> DataFrame:
    t = K.trips(_order_fills(spark, d)).where("symbol = '3' AND pnl < 0")
    return M.page(t, [F.desc("exit_date"), F.desc("entry_id")], 25).select("account", "symbol", "entry_id", "exit_date", "pnl")


@query("WITH a AS (SELECT strftime(l_shipdate, '%Y-%m') AS date, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT strftime(o_orderdate, '%Y-%m') AS date, count(*) AS n FROM orders GROUP BY 1) SELECT coalesce(a.date, b.date) AS date, CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'extra' ELSE 'mismatched' END AS state FROM a FULL JOIN b ON a.date = b.date WHERE a.n IS DISTINCT FROM b.n")
def l9_partition_differences(spark: SparkSession, d: str) -> DataFrame:
    days = lambda name, c: B.table(spark, d, name).groupBy(F.date_format(c, "yyyy-MM").alias("date")).agg(F.count("*").alias("rows"))
    return Q.partition_differences(days("lineitem", "l_shipdate"), days("orders", "o_orderdate"))


@query("SELECT o_orderpriority AS scope, date_diff('day', max(o_orderdate)::DATE, DATE '1998-09-01') AS age, CASE WHEN date_diff('day', max(o_orderdate)::DATE, DATE '1998-09-01') >= 40 THEN 'error' WHEN date_diff('day', max(o_orderdate)::DATE, DATE '1998-09-01') >= 10 THEN 'warn' ELSE 'ok' END AS level FROM orders GROUP BY 1")
def l16_freshness(spark: SparkSession, d: str) -> DataFrame:
    last = B.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("scope")).agg(F.max(F.col("o_orderdate").cast("date")).alias("last_day"))
    return Q.freshness(last, "1998-09-01", 10, 40)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 >= 2 THEN 'skip' WHEN s_nationkey % 3 = s_suppkey % 3 THEN 'up_to_date' ELSE 'refresh' END AS decision FROM supplier")
def m3_refresh_decisions(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "supplier").select("s_suppkey", lake.refresh_decision(F.col("s_suppkey") % 4, F.lit(2), F.col("s_nationkey") % 3, F.col("s_suppkey") % 3).alias("decision"))


@query()
def m7_window_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return lake.window_fingerprint(lake.shard_stats(B.bars(spark, d)), "1994-01-01", "1995-06-01")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 1 OR o_orderstatus <> 'O' THEN o_orderstatus ELSE 'done' END AS status, CASE WHEN o_orderkey % 4 = 1 AND o_orderstatus = 'O' THEN 100 ELSE 0 END AS done FROM orders")
def n3_finished_tasks(spark: SparkSession, d: str) -> DataFrame:
    o = B.table(spark, d, "orders")
    tasks = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise(F.col("o_orderstatus")).alias("status"), (F.col("o_orderkey") % 3).alias("token"), F.lit(0).alias("done"))
    ends = o.where("o_orderkey % 4 = 1").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("token"), F.lit("done").alias("to"), F.lit(100).alias("progress"))
    late = o.where("o_orderkey % 4 = 2").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3 + 1).alias("token"), F.lit("failed").alias("to"), F.lit(100).alias("progress"))
    out = N.finished(tasks, ends.unionByName(late))
    return out.select("id", F.when(F.col("status") == "running", "O").otherwise(F.col("status")).alias("status"), "done")


@query("SELECT c_custkey, c_acctbal, o_orderkey AS newest FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 50 = 0 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def n9_account_reads(spark: SparkSession, d: str) -> DataFrame:
    newest = B.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("newest"))
    return B.table(spark, d, "customer").where("c_custkey % 50 = 0").select("c_custkey", "c_acctbal").join(newest, "c_custkey")
