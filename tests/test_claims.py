"""Claims, states, gates, windows, quality definitions and numbers on small cases."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import text
from tidegauge.operators import claims, quality, series, trades, windows

D = datetime.date


def reports(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "id int, j string").select("id", F.parse_json("j").alias("body"))


def test_claims_prove_themselves_or_are_told(spark):
    blocks = lambda *b: '{"a":{"b":{"c":2.50,"n":null,"t":"x"}},"evidence":[{"event_id":"e","day":"d"}],"blocks":[' + ",".join(b) + "]}"
    good = blocks('{"id":"1","kind":"fact","numbers":{"a.b.c":2.5,"a.b.t":"x","a.b.n":null,"a.b":{"t":"x","c":2.5,"n":null}}}', '{"id":"2","kind":"fact","evidence":["e|d"]}', '{"id":"3","kind":"inference"}')
    bad = blocks(
        '{"id":"1","kind":"fact","numbers":{"a.b.c":2.51,"a.z":1,"a.b.c.d":1,"a[0]":1,"x\\"y":1}}', '{"id":"2","kind":"fact","evidence":["e|d","f|d"]}', '{"id":"3","kind":"fact"}',
        '{"id":"4","kind":"inference","numbers":{"a.b.c":2.5}}', '{"id":"5","kind":"guess"}', '{"id":"6"}',
    )
    got = {tuple(r) for r in claims.claim_problems(reports(spark, good, bad, "{}", '{"blocks":[]}'), "body", "id").collect()}
    assert got == {
        (1, "1", "different_number", "a.b.c"), (1, "1", "missing_path", "a.z"), (1, "1", "missing_path", "a.b.c.d"), (1, "1", "missing_path", "a[0]"), (1, "1", "missing_path", 'x"y'),
        (1, "2", "unknown_evidence", "f|d"), (1, "3", "no_proof", None), (1, "4", "inference_with_numbers", None), (1, "5", "bad_kind", "guess"), (1, "6", "bad_kind", None),
    }


def test_canonical_json_orders_keys_at_every_depth(spark):
    rows = spark.createDataFrame([('{"b":{"z":1,"a":[{"q":1,"c":2}]},"a":"x"}',), ('{"a":"x","b":{"a":[{"c":2,"q":1.0}],"z":1}}',), ("{",), (None,)], "j string")
    digests = [r[0] for r in rows.select(claims.canonical_digest(F.col("j"))).collect()]
    assert digests[0] == digests[1] and digests[2:] == [None, None]
    assert rows.limit(1).select(claims.canonical(F.parse_json("j"))).first()[0] == '{"a":"x","b":{"a":[{"c":2,"q":1}],"z":1}}'


def test_leaves_and_changes(spark):
    before, after = reports(spark, '{"a":{"b":1,"e":{}},"l":[1,{"x":2}]}'), reports(spark, '{"a":{"b":1.0,"c":null},"l":[1,{"x":3}]}')
    assert {(r.path, r.v) for r in claims.leaves(before, "body", ["id"]).select("path", claims.canonical(F.col("value")).alias("v")).collect()} == {("a.b", "1"), ("a.e", "{}"), ("l", '[1,{"x":2}]')}
    assert {tuple(r)[1:] for r in claims.changes(before, after, "body", ["id"]).collect()} == {("a.e", "{}", None), ("a.c", None, "null"), ("l", '[1,{"x":2}]', '[1,{"x":3}]')}
    with pytest.raises(Exception, match="levels"):
        claims.leaves(reports(spark, '{"a":{"b":{"c":1}}}'), "body", ["id"], depth=2).collect()


def test_states_go_to_json_and_back(spark):
    rows = spark.sql("SELECT 1.2345::decimal(18,4) AS cash, array(named_struct('s', '600000', 'q', 100L), NULL) AS held, map('x', double('NaN'), 'y', 1e-300D) AS marks, timestamp_ntz'2024-01-02 03:04:05.000007' AS at, CAST(NULL AS string) AS note, date'1999-12-31' AS day")
    back = rows.select(F.struct("*").alias("was"), claims.state_of(claims.state_json(*rows.columns), rows.schema).alias("back")).first()
    assert str(back.was) == str(back.back) and back.back.cash == back.was.cash
    with pytest.raises(Exception, match="(?i)malformed"):
        spark.range(1).select(claims.state_of(F.lit('{"cash": '), rows.schema)).collect()


def test_gates_follow_the_published_order_and_amounts(spark):
    base = {"qty": 2000, "budget": 20_000.0, "price": 10.0, "equity": 100_000.0, "market_value": 0.0, "symbol_value": 0.0, "pending": 0.0, "drawdown": 0.0, "has_position": False, "stop_loss_pending": False}
    cases = [
        ({}, ("cap", "concentration", 1900)), ({"qty": 1900}, ("pass", None, 1900)), ({"has_position": True, "stop_loss_pending": True}, ("block", "position_open", 0)), ({"stop_loss_pending": True, "equity": 0.0}, ("block", "stop_loss_pending", 0)),
        ({"equity": 0.0}, ("block", "drawdown", 0)), ({"drawdown": 0.2}, ("block", "drawdown", 0)), ({"drawdown": None, "qty": 1900}, ("pass", None, 1900)), ({"symbol_value": 19_000.0}, ("block", "concentration", 0)),
        ({"market_value": 60_000.0, "pending": 15_000.0}, ("cap", "gross_exposure", 400)), ({"qty": 500, "budget": 5_100.0}, ("pass", None, 500)),
    ]
    rows = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], "qty long, budget double, price double, equity double, market_value double, symbol_value double, pending double, drawdown double, has_position boolean, stop_loss_pending boolean")
    assert [(r.action, r.reason, r.allowed) for r in trades.gate_buys(rows).collect()] == [w for _, w in cases]


def test_a_position_lets_every_other_signal_through(spark):
    told = "SBBSSBSS"
    rows = spark.createDataFrame([("x", D(2024, 1, i + 1), c) for i, c in enumerate(told)] + [("y", D(2024, 1, 1), "S")], "symbol string, trade_date date, c string")
    got = [(r.trade_date.day, r.action) for r in series.gated(rows, F.col("c") == "B").orderBy("trade_date").collect()]
    holding, want = False, []
    for i, c in enumerate(told):
        if (c == "B") != holding:
            holding = not holding
            want.append((i + 1, "buy" if holding else "sell"))
    assert got == want


def test_sessions_both_ways_and_out_of_range(spark):
    sessions = spark.createDataFrame([(D(2024, 1, d),) for d in (2, 3, 5, 8)], "trade_date date")
    rows = spark.createDataFrame([(D(2024, 1, d),) for d in (2, 4, 6, 8)], "day date")
    got = [(r.day.day, r.on_or_before.day, r.on_or_after.day, r.b and r.b.day, r.f and r.f.day) for r in windows.placed(rows, "day", sessions).select("*", windows.shifted("before_idx", -1).alias("b"), windows.shifted("after_idx", 1).alias("f")).orderBy("day").collect()]
    assert got == [(2, 2, 2, None, 3), (4, 3, 5, 2, 8), (6, 5, 8, 3, None), (8, 8, 8, 5, None)]
    late = spark.createDataFrame([(D(2024, 1, 9),), (None,)], "day date")
    with pytest.raises(Exception, match="outside the calendar: 2024-01-09"):
        windows.placed(late, "day", sessions).collect()
    assert [r.before_idx for r in windows.placed(late, "day", sessions, guard=False).collect()] == [None, None]


def test_windows_of_runs_and_factors(spark):
    bars = spark.createDataFrame([("a", D(2024, 1, 2)), ("a", D(2024, 3, 1)), ("b", D(2024, 2, 1))], "symbol string, trade_date date")
    events = spark.createDataFrame([(["a"], datetime.datetime(2024, 1, 10, 9)), (["b"], datetime.datetime(2024, 2, 20, 9))], "symbols array<string>, event_time timestamp_ntz")
    asked = spark.createDataFrame([("a", None, None), ("a", D(2024, 1, 5), D(2024, 2, 1)), ("b", None, None), ("z", None, None)], "symbol string, start date, end date")
    got = {(r.symbol, r.start, r.end, r.padded_start, r.problem) for r in windows.run_windows(asked, bars, events, 10).collect()}
    assert got == {("a", D(2024, 1, 10), D(2024, 3, 1), D(2023, 12, 23), None), ("a", D(2024, 1, 5), D(2024, 2, 1), D(2023, 12, 26), "before_corpus"), ("b", D(2024, 2, 20), D(2024, 2, 1), D(2024, 1, 22), "empty"), ("z", None, None, None, "no_bars")}
    assert windows.run_windows(asked.where("symbol = 'b'"), bars).first().problem is None
    wants = spark.createDataFrame([(1, None, None), (2, D(2024, 1, 9), None), (3, None, D(2024, 3, 2)), (4, D(2024, 2, 2), D(2024, 2, 1))], "q int, start date, end date")
    assert [r.problem for r in windows.factor_windows(wants, bars, events).orderBy("q").collect()] == [None, "before_corpus", "after_bars", "reversed"]
    assert windows.factor_windows(wants, bars, events, 30).orderBy("q").first().problem == "too_long"


def test_ids_are_version_5_uuids(spark):
    rows = spark.createDataFrame([("acc", D(2024, 5, 6), f"60000{i}", s) for i in range(8) for s in ("buy", "sell")], "account string, decided_on date, symbol string, side string")
    for r in trades.decision_ids(rows).collect():
        assert r.decision_id == str(uuid.uuid5(uuid.NAMESPACE_URL, f"acc|2024-05-06|{r.symbol}|{r.side}"))


def test_steps_judge_stored_changes(spark):
    closes = [10.0, 11.0, None, 12.1, 12.1, 12.1, 12.1, 20.0]
    stored = [None, 10.0, None, 10.01, 0.02, 2.0, 0.0, 65.0]
    rows = [("s", a, D(2024, 1, i + 1), c, p) for a in ("qfq", "raw") for i, (c, p) in enumerate(zip(closes, stored, strict=True))]
    got = {r.adjustment: (r.judged, r.inconsistent, r.beyond_1pp, r.beyond) for r in quality.steps(spark.createDataFrame(rows, "symbol string, adjustment string, trade_date date, close double, change_pct double")).collect()}
    assert got == {"qfq": (6, 3, 1, 1), "raw": (6, 3, 1, 0)}


def test_event_checks_count_what_they_should(spark):
    at = datetime.datetime(2024, 1, 2, 10)
    rows = [("e1", "k", "h", ["600000", "60"], "bullish", "x" * 13), ("e1", "k", "h", ["60"], None, None), ("e2", None, "h", [], "sideways", "up"), ("e3", None, "h", ["600000"], None, "ok")]
    events = spark.createDataFrame([(a, b, c, s, n, d, at, at) for a, b, c, s, n, d in rows], "event_id string, dedup_key string, content_hash string, symbols array<string>, direction_norm string, direction string, event_time timestamp_ntz, available_at timestamp_ntz")
    bars = spark.createDataFrame([("s", "qfq", D(2024, 1, 2), 1.0, 1.0, None, st) for st in ("traded", "odd", None)], "symbol string, adjustment string, trade_date date, close double, volume double, change_pct double, trading_status string")
    found = quality.suite(bars, events, bars.select("trade_date"), bars.select("trade_date"))
    count = lambda k: found[k][1]().first()["failing"]
    assert (count("E2"), count("E5"), count("B6"), count("B2")) == (2, 1, 2, 1)
    one = {r.id: (r.level, r.failing, r.note) for r in quality.one_pass(bars, events).collect()}
    assert one["E4"] == ("error", 2, "") and one["E3"] == ("ok", 0, "1 of 4 events have no symbols")
    assert quality.one_pass(bars, events.where("direction_norm IS NULL OR direction_norm = 'bullish'")).where("id = 'E4'").first().level == "warn"


def test_numbers_and_marks(spark):
    cases = {
        "1、增长 12.5 % 和 3亿元": ["12.5%", "3亿元"], "2. 1.5倍\n10) 7\n3.14 pi": ["1.5倍", "7", "3.14"], "- 5万\n-6万": ["5万", "6万"], "５０％ 2024.": ["50%", "2024"], "7\n亿元": ["7亿元"], "": [], "1.2.3": ["1.2", "3"], "  4)8个基点": ["8个基点"],
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.numbers_in(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == cases
    unknown = spark.createDataFrame([("有 5%、6% 与 7亿", ["5", "6%"])], "t string, a array<string>").select(text.unknown_numbers(F.col("t"), F.col("a"))).first()[0]
    assert unknown == ["7亿"]


def test_escaped_patterns_mean_themselves(spark):
    rows = spark.createDataFrame([("a%b", "a%b"), ("a%b", "axb"), ("a_b", "a_b"), ("a_b", "axb"), ("a\\b", "a\\b"), ("a\\b", "axb")], "asked string, name string")
    told = rows.withColumn("p", F.concat(F.lit("%"), text.like_escaped(F.col("asked")), F.lit("%")))
    assert [r.hit for r in told.select(F.expr("name ILIKE p ESCAPE '\\\\'").alias("hit")).collect()] == [True, False] * 3


def test_leaves_unfold_all_levels_in_one_pass(spark):
    found = claims.leaves(reports(spark, '{"a":{"b":{"c":1}},"d":[2]}'), "body", ["id"])
    assert {r.path for r in found.collect()} == {"a.b.c", "d"}
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
