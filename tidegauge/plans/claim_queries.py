"""Claims, states, position gates and session algebra over the shared tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims as C
from ..operators import market as M
from ..operators import series as S
from ..operators import windows as W
from ..sources import bindings as B
from .market_queries import BARS, EVENTS, SESSIONS, with_

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """A report per order: what it says of itself, and five blocks some of which claim something else."""
    o = B.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_totalprice").alias("t"))
    k = F.col("o_orderkey")
    number = lambda p: F.to_json(F.create_map(p, F.when(k % 7 == 0, F.col("t") + 1).otherwise(F.col("t"))))
    path = F.when(k % 11 == 0, F.lit("summary.deep.none")).otherwise(F.lit("summary.deep.total"))
    cust = F.col("o_custkey").cast("string")
    body = F.concat(
        F.lit('{"summary":{"deep":{"total":'), F.col("t").cast("string"), F.lit('},"priority":"'), F.col("o_orderpriority"), F.lit('"},"evidence":[{"event_id":"'), cust, F.lit('","day":"d"}],"blocks":[{"id":"n","kind":"fact","numbers":'),
        number(path), F.lit('},{"id":"e","kind":"fact","evidence":["'), F.when(k % 5 == 0, F.lit("0")).otherwise(cust), F.lit('|d"]},{"id":"i","kind":"inference"'), F.when(k % 13 == 0, F.lit(',"numbers":{"summary.deep.total":1}')).otherwise(F.lit("")),
        F.lit('},{"id":"k","kind":"'), F.when(k % 17 == 0, F.lit("rumour")).otherwise("inference"), F.lit('"},{"id":"s","kind":"fact","numbers":{"summary.priority":"'), F.when(k % 19 == 0, F.lit("none")).otherwise(F.col("o_orderpriority")), F.lit('"}}]}'),
    )
    return o.select("o_orderkey", F.parse_json(body).alias("body"))


@query(
    """SELECT o_orderkey, 'n' AS block, CASE WHEN o_orderkey % 11 = 0 THEN 'missing_path' ELSE 'different_number' END AS problem, CASE WHEN o_orderkey % 11 = 0 THEN 'summary.deep.none' ELSE 'summary.deep.total' END AS path FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 7 = 0
    UNION ALL SELECT o_orderkey, 'e', 'unknown_evidence', '0|d' FROM orders WHERE o_orderkey % 5 = 0 AND o_custkey <> 0
    UNION ALL SELECT o_orderkey, 'i', 'inference_with_numbers', NULL FROM orders WHERE o_orderkey % 13 = 0
    UNION ALL SELECT o_orderkey, 'k', 'bad_kind', 'rumour' FROM orders WHERE o_orderkey % 17 = 0
    UNION ALL SELECT o_orderkey, 's', 'different_number', 'summary.priority' FROM orders WHERE o_orderkey % 19 = 0"""
)
def k25_claim_problems(spark: SparkSession, d: str) -> DataFrame:
    return C.claim_problems(_reports(spark, d), "body", "o_orderkey")


@query(
    """WITH a AS (SELECT o_orderkey, {'flag': o_orderstatus, 'deep': {'z': o_custkey, 'a': o_orderpriority}} AS v FROM orders)
    SELECT o_orderkey, sha256('{"deep":{"a":"' || v.deep.a || '","z":' || v.deep.z || '},"flag":"' || v.flag || '"}') AS digest FROM a"""
)
def h23_nested_digest(spark: SparkSession, d: str) -> DataFrame:
    o = B.table(spark, d, "orders")
    deep = F.struct(F.col("o_custkey").alias("z"), F.col("o_orderpriority").alias("a")).alias("deep")
    return o.select("o_orderkey", C.canonical_digest(F.to_json(F.struct(F.col("o_orderstatus").alias("flag"), deep))).alias("digest"))


@query(
    """SELECT o_orderkey, 'deep.status' AS path, '"' || o_orderstatus || '"' AS old, '"done"' AS new FROM orders WHERE o_orderkey % 3 = 0
    UNION ALL SELECT o_orderkey, 'customer', o_custkey::VARCHAR, NULL FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey, 'deep.more.client', NULL, o_custkey::VARCHAR FROM orders WHERE o_orderkey % 4 = 0"""
)
def k17_state_changes(spark: SparkSession, d: str) -> DataFrame:
    o, k = B.table(spark, d, "orders"), F.col("o_orderkey")
    state = lambda status, customer, more: o.select("o_orderkey", F.parse_json(F.to_json(F.struct(customer.alias("customer"), F.struct(status.alias("status"), more.alias("more")).alias("deep")))).alias("state"))
    none = F.lit(None).cast("long")
    before = state(F.col("o_orderstatus"), F.col("o_custkey"), F.struct(none.alias("client")))
    moved = F.when(k % 4 == 0, F.col("o_custkey"))
    after = state(F.when(k % 3 == 0, "done").otherwise(F.col("o_orderstatus")), F.when(k % 4 != 0, F.col("o_custkey")), F.when(moved.isNotNull(), F.struct(moved.alias("client"))))
    found = C.changes(before, after, "state", ["o_orderkey"])
    return found.where("path <> 'deep.more'")


@query("SELECT o_custkey, true AS lossless, count(*) AS n_positions, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS cash, max(o_orderdate) AS updated FROM orders GROUP BY o_custkey")
def k17_state_round_trip(spark: SparkSession, d: str) -> DataFrame:
    o = B.table(spark, d, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,4)"))
    one = F.struct("o_orderkey", "price", F.col("o_totalprice").alias("mark"), "o_orderdate", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("note"))
    states = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(one)).alias("positions"), F.sum("price").alias("cash"), F.max("o_orderdate").alias("updated"))  # of one account
    back = states.withColumn("back", C.state_of(C.state_json("positions", "cash", "updated"), states.select("positions", "cash", "updated").schema))
    return back.select("o_custkey", F.struct("positions", "cash", "updated").eqNullSafe(F.col("back")).alias("lossless"), F.size("back.positions").cast("long").alias("n_positions"), F.col("back.cash").cast("double").alias("cash"), F.col("back.updated").alias("updated"))


_GATED = """, k AS (SELECT *, lag(buy) OVER (PARTITION BY symbol ORDER BY trade_date) AS was FROM s)
SELECT symbol, trade_date, CASE WHEN buy THEN 'buy' ELSE 'sell' END AS action FROM k WHERE CASE WHEN was IS NULL THEN buy ELSE buy <> was END"""


@query(
    with_(BARS)
    + """, f AS (SELECT symbol, trade_date, round(avg(close) OVER a, 8) AS fast, round(avg(close) OVER b, 8) AS slow, count(*) OVER b AS n FROM priced WHERE adjustment = 'qfq'
      WINDOW a AS (PARTITION BY symbol ORDER BY trade_date ROWS 4 PRECEDING), b AS (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING)),
    g AS (SELECT *, lag(fast) OVER w AS f0, lag(slow) OVER w AS s0, lag(n) OVER w AS n0 FROM f WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
    s AS (SELECT symbol, trade_date, fast > slow AS buy FROM g WHERE n0 = 20 AND ((f0 <= s0 AND fast > slow) OR (f0 >= s0 AND fast < slow)))"""
    + _GATED
)
def k7_gated_crosses(spark: SparkSession, d: str) -> DataFrame:
    return S.gated(S.crosses(M.priced(M.of_adjustment(B.bars(spark, d), "qfq")), 5, 20), F.col("cross") == "golden")


@query(
    with_(BARS)
    + """, c AS (SELECT symbol, trade_date, close, max(high) OVER w AS top, min(low) OVER w AS bottom, count(high) OVER w AS n FROM priced WHERE adjustment = 'qfq' WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
    s AS (SELECT symbol, trade_date, close > top AS buy FROM c WHERE n = 10 AND (close > top OR close < bottom))"""
    + _GATED
)
def k9_gated_channel(spark: SparkSession, d: str) -> DataFrame:
    return S.gated(S.channel(M.priced(M.of_adjustment(B.bars(spark, d), "qfq")), 10), F.col("signal") == "long")


_MEAN = "round(CAST(sum(close::DECIMAL(28,8)) OVER (PARTITION BY symbol ORDER BY trade_date ROWS {} PRECEDING) AS DOUBLE) / {}, 8) AS m{}"


@query(
    with_(BARS)
    + f""", m AS (SELECT symbol, trade_date, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS rn, {", ".join(_MEAN.format(n - 1, n, n) for n in (3, 5, 10, 20))} FROM priced WHERE adjustment = 'qfq'),
    l AS (SELECT symbol, trade_date, rn, unnest([{{'n': 3, 'm': m3}}, {{'n': 5, 'm': m5}}, {{'n': 10, 'm': m10}}, {{'n': 20, 'm': m20}}], recursive := true) FROM m),
    v AS (SELECT symbol, trade_date, n, CASE WHEN rn >= n THEN m END AS m, lag(CASE WHEN rn >= n THEN m END) OVER (PARTITION BY symbol, n ORDER BY trade_date) AS p FROM l),
    c AS (SELECT (i - 1) * 3 + j - 1 AS cell, [3, 10][i] AS fast, [5, 10, 20][j] AS slow FROM range(1, 3) AS a(i), range(1, 4) AS b(j)),
    k AS (SELECT fast, slow, count_if(f.p <= s.p AND f.m > s.m) AS golden, count_if(f.p >= s.p AND f.m < s.m) AS death FROM c JOIN v f ON f.n = fast JOIN v s ON s.n = slow AND s.symbol = f.symbol AND s.trade_date = f.trade_date WHERE fast < slow GROUP BY ALL)
    SELECT cell, fast, slow, golden, death FROM c LEFT JOIN k USING (fast, slow)"""
)
def c17_grid_crosses(spark: SparkSession, d: str) -> DataFrame:
    return S.grid_crosses(M.priced(M.of_adjustment(B.bars(spark, d), "qfq")), [3, 10], [5, 10, 20])


@query(
    with_(BARS, SESSIONS, EVENTS)
    + """, e AS (SELECT event_id, event_time::DATE AS day FROM ev WHERE event_time::DATE BETWEEN (SELECT min(trade_date) FROM ses) AND (SELECT max(trade_date) FROM ses)),
    p AS (SELECT event_id, day, (SELECT max(session_idx) FROM ses WHERE trade_date <= day) AS i, (SELECT min(session_idx) FROM ses WHERE trade_date >= day) AS j FROM e)
    SELECT event_id, day, a.trade_date AS on_or_before, b.trade_date AS on_or_after, c.trade_date AS shifted, j - i AS between FROM p JOIN ses a ON a.session_idx = i JOIN ses b ON b.session_idx = j LEFT JOIN ses c ON c.session_idx = i - 3"""
)
def i21_session_lookups(spark: SparkSession, d: str) -> DataFrame:
    sessions = B.calendar(spark, d)
    days = B.events(spark, d).select("event_id", F.to_date("event_time").alias("day"))
    span = sessions.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    inside = days.crossJoin(F.broadcast(span)).where("day BETWEEN a AND b").drop("a", "b")
    found = W.placed(inside, "day", sessions)
    return found.select("event_id", "day", "on_or_before", "on_or_after", W.shifted("before_idx", -3).alias("shifted"), (F.col("after_idx") - F.col("before_idx")).alias("between"))


@query(
    with_(BARS, EVENTS)
    + """, x AS (SELECT symbol, min(trade_date) AS first_bar, max(trade_date) AS last_bar FROM priced WHERE adjustment = 'qfq' GROUP BY symbol),
    y AS (SELECT symbol, min(event_time)::DATE AS first_event FROM (SELECT unnest(symbols) AS symbol, event_time FROM ev) GROUP BY symbol)
    SELECT symbol, greatest(first_bar, coalesce(first_event, first_bar)) AS start, last_bar AS "end", first_bar - 60 AS padded_start, CASE WHEN greatest(first_bar, coalesce(first_event, first_bar)) > last_bar THEN 'empty' END AS problem FROM x LEFT JOIN y USING (symbol)"""
)
def b14_run_windows(spark: SparkSession, d: str) -> DataFrame:
    asked = B.bars(spark, d).select("symbol").distinct().select("symbol", F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end"))
    return W.run_windows(asked, M.priced(M.of_adjustment(B.bars(spark, d), "qfq")), B.events(spark, d), 60)


@query(
    with_(BARS, EVENTS)
    + """, c AS (SELECT min(event_time)::DATE AS corpus_start, max(event_time)::DATE AS corpus_end FROM ev), b AS (SELECT max(trade_date) AS bars_end FROM priced),
    q AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate::DATE END AS s, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate::DATE + (o_orderkey % 900)::INT END AS e FROM orders),
    w AS (SELECT o_orderkey, coalesce(s, corpus_start) AS start, coalesce(e, bars_end) AS "end", corpus_start, bars_end FROM q, c, b)
    SELECT o_orderkey, start, "end", CASE WHEN start < corpus_start THEN 'before_corpus' WHEN "end" > bars_end THEN 'after_bars' WHEN start > "end" THEN 'reversed' WHEN "end" - start > 750 THEN 'too_long' END AS problem FROM w"""
)
def b15_factor_windows(spark: SparkSession, d: str) -> DataFrame:
    o, day, k = B.table(spark, d, "orders"), F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    asked = o.select("o_orderkey", F.when(k % 3 > 0, day).alias("start"), F.when(k % 5 > 0, F.date_add(day, (k % 900).cast("int"))).alias("end"))
    return W.factor_windows(asked, M.priced(B.bars(spark, d)), B.events(spark, d), 750)
