"""Boundary cases of the market, factor and simulation operators, computed by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import rules, text
from tidegauge.operators import factor, market, quality, retrieval, series, state, trades
from tidegauge.sources import lake


def days(n, start=dt.date(2024, 1, 1)):
    return [start + dt.timedelta(i) for i in range(n)]


def test_events_reach_the_first_session_whose_cutoff_is_not_before_them(spark):
    at = dt.datetime
    stamps = [at(2024, 1, 2, 15), at(2024, 1, 2, 15, 0, 0, 1), at(2020, 1, 1), at(2024, 1, 5, 15, 0, 1), at(2024, 1, 6), None]
    events = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "event_id int, available_at timestamp_ntz")
    sessions = spark.createDataFrame([(dt.date(2024, 1, 2), 0), (dt.date(2024, 1, 5), 1)], "trade_date date, session_idx int")
    got = {r.event_id: r.session for r in market.session_buckets(events, sessions).collect()}
    assert got[0] == dt.date(2024, 1, 2) and got[1] == dt.date(2024, 1, 5) and got[2] == dt.date(2024, 1, 2)
    assert got[3] is None and got[4] is None and got[5] is None


def test_limit_bands_round_half_up_and_closes_beyond_are_skipped(spark):
    rows = spark.createDataFrame([("600001", 10.05, 11.06), ("600001", 10.0, 9.0), ("300001", 10.0, 15.0), ("999999", 10.0, 10.0), ("600002", None, 1.0)], "symbol string, prev_close double, close double")
    r = market.limit_counts(rows).first()
    assert (r["up"], r["down"], r["skipped"], r["judged"]) == (1, 1, 3, 2)


def test_quantile_rest_goes_to_the_top_slice_and_ties_share_ranks(spark):
    pool = spark.createDataFrame([(dt.date(2024, 1, 1), f"{i:06d}", float(i // 2), 0.01 * i) for i in range(13)], "trade_date date, symbol string, value double, fwd_ret double")
    sizes = {r["q"]: r["count"] for r in factor.quantile_members(pool).groupBy("q").count().collect()}
    assert sizes == {0: 2, 1: 2, 2: 2, 3: 2, 4: 5}
    ranks = [r.r for r in pool.withColumn("r", factor.average_rank("value")).orderBy("symbol").collect()]
    assert ranks[:4] == [1.5, 1.5, 3.5, 3.5]
    assert factor.rank_ic(pool.withColumn("value", F.lit(1.0))).count() == 0


def test_a_return_of_exactly_the_bound_stays(spark):
    values = spark.createDataFrame([(dt.date(2024, 1, 1), s, 1.0) for s in "abc"], "trade_date date, symbol string, value double")
    forward = spark.createDataFrame([(dt.date(2024, 1, 1), "a", 0.3), (dt.date(2024, 1, 1), "b", 0.30001)], "trade_date date, symbol string, fwd_ret double")
    assert [r.symbol for r in factor.pools(values, forward, 1).collect()] == ["a"]
    assert tuple(factor.pool_counters(values, forward, 2).first()) == (1, 1, 1, 0)


def test_sharpe_ratio_beyond_luck_of_fixed_inputs(spark):
    """Ratios 0.05, 0.06, 0.04, 0.07, 0.08 of five trials; the best has skewness -0.5, kurtosis 4 and 101 observations."""
    one = spark.range(1)
    row = one.select(series.luck(F.lit(0.0002), F.lit(5)).alias("sr0")).select("sr0", series.beyond_luck(F.lit(0.08), F.col("sr0"), F.lit(-0.5), F.lit(4.0), F.lit(101)).alias("dsr")).first()
    assert row.sr0 == pytest.approx(0.016865826106399077, abs=1e-12) and row.dsr == pytest.approx(0.7315995277598144, abs=1e-12)
    trials = spark.createDataFrame([(i, 101, r, 1.0, -0.5, 4.0) for i, r in enumerate([0.05, 0.06, 0.04, 0.07, 0.08])] + [(9, 101, 0.5, 0.0, None, None)], "cell long, n long, mean double, sd double, skew double, kurt double")
    best = series.rank_trials(trials).first()
    assert (best.cell, best.trials, best.sharpe) == (4, 5, 0.08) and best.dsr == pytest.approx(0.73159953, abs=1e-8)
    edge = one.select(series.luck(F.lit(1.0), F.lit(1)).alias("a"), series.luck(F.lit(0.0), F.lit(5)).alias("b"), series.beyond_luck(F.lit(0.1), F.lit(0.1), F.lit(0.0), F.lit(1.0), F.lit(50)).alias("c"), series.beyond_luck(F.lit(0.1), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1)).alias("d")).first()
    assert (edge.a, edge.b, edge.d) == (None, 0.0, None) and edge.c == pytest.approx(0.5)


def test_normal_functions_against_the_standard_library(spark):
    from statistics import NormalDist

    got = spark.range(1, 1000).select((F.col("id") / 1000).alias("p")).select("p", series.normal_quantile(F.col("p")).alias("x")).select("p", "x", series.normal_cdf(F.col("x")).alias("back")).collect()
    assert max(abs(r.x - NormalDist().inv_cdf(r.p)) for r in got) < 1e-10 and max(abs(r.back - r.p) for r in got) < 1e-12


def test_an_event_waits_for_its_own_symbols_next_bar(spark):
    d, at = days(4), dt.datetime
    bars = [("a", d[0]), ("a", d[3]), ("b", d[0]), ("b", d[1])]
    rows = spark.createDataFrame([(s, "qfq", x, 1.0, 1.0, 1.0, 1.0) for s, x in bars], "symbol string, adjustment string, trade_date date, open double, high double, low double, close double")
    events = [(1, at(2024, 1, 1, 15), ["a", "b"]), (2, at(2024, 1, 1, 15, 0, 0, 1), ["a", "b"]), (3, at(2024, 1, 3, 9), ["a", "b"]), (4, at(2020, 1, 1), ["a"]), (5, at(2024, 1, 9), ["a"])]
    got = {(r.event_id, r.symbol): r.trade_date for r in trades.fed_events(rows, spark.createDataFrame(events, "event_id long, available_at timestamp_ntz, symbols array<string>")).collect()}
    assert got == {(1, "a"): d[0], (1, "b"): d[0], (2, "a"): d[3], (2, "b"): d[1], (3, "a"): d[3], (4, "a"): d[0]}


def test_a_sell_closes_the_buy_right_before_it(spark):
    d = days(5)
    rows = [("a", "s", 1, d[0], "sell", 1.0, 9.0, 0.0), ("a", "s", 2, d[1], "buy", 100.0, 10.0, 5.0), ("a", "s", 3, d[2], "buy", 100.0, 20.0, 5.0), ("a", "s", 4, d[3], "sell", 100.0, 30.0, 5.0), ("a", "s", 5, d[4], "buy", 100.0, 7.0, 5.0)]
    fills = spark.createDataFrame(rows, "account string, symbol string, id long, trade_date date, side string, qty double, price double, fees double")
    got = sorted((r.entry_id, r.exit_id, r.pnl) for r in trades.trips(fills).collect() if r.exit_id)
    assert got == [(3, 4, 990.0)]
    assert [r.entry_id for r in trades.trips(fills).where("exit_id is null").collect()] == [5]
    more = spark.createDataFrame([("a", "s", 1, d[0], "buy", 100.0, 10.0, 0.0), ("a", "s", 2, d[1], "sell", 200.0, 11.0, 0.0)], fills.schema)
    assert [r.pnl for r in trades.trips(more).collect()] == [1200.0]
    held = trades.marked(trades.trips(fills), spark.createDataFrame([("s", 9.0)], "symbol string, close double")).where("exit_id is null").first()
    assert held.pnl == 195.0 and held.return_pct == pytest.approx(195 / 705, abs=1e-6)


def test_parameter_cells_and_sort_keys_are_checked(spark):
    cells = [tuple(r) for r in series.parameter_cells(spark, {"fast": [2, 3], "slow": [8, 9]}).orderBy("cell").collect()]
    assert cells == [(0, 2, 8), (1, 2, 9), (2, 3, 8), (3, 3, 9)]
    for bad in ({}, {"a": [True]}, {"a": [0]}, {"a": []}, {"a": [1.5]}, {"a": [1], "b": [1], "c": [1]}, {"a": list(range(1, 12)), "b": list(range(1, 12))}):
        with pytest.raises(ValueError):
            series.parameter_cells(spark, bad)
    with pytest.raises(ValueError):
        market.cross_section(spark.range(1), "2024-01-01", sort="drop table")


def test_scores_decode_once_or_twice_and_booleans_do_not_count(spark):
    raw = ['{"score": 3}', '"{\\"score\\": 4.5}"', '{"score": true}', "x", None, '{"score": "7"}']
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").withColumn("s", text.factor_score(F.col("r"))).orderBy("i").collect()
    assert [r.s for r in rows] == [3.0, 4.5, None, None, None, None]


def test_titles_names_and_fragments(spark):
    t = spark.createDataFrame([("拟回购并由高管增持",), ("业绩快报：营收下降",), (None,)], "t string").select(text.title_class(F.col("t")).alias("c")).collect()
    assert [r.c.category for r in t] == ["股份回购", "业绩预减", None]
    st = spark.createDataFrame([("* st　样本",), ("STAR",), (None,)], "n string").select(text.is_st(F.col("n")).alias("x")).collect()
    assert [r.x for r in st] == [True, False, False]
    names = spark.createDataFrame([("1", "alphabet"), ("2", "alpine")], "symbol string, name string")
    hits = text.matched_names(spark.createDataFrame([(1, "the alphab stock")], "text_id int, text string"), text.fragments(names)).collect()
    assert {r.fragment for r in hits} == {"alphab"} | {r.fragment for r in hits if r.fragment not in "alphab"}


def test_days_are_written_only_when_sound(spark, tmp_path):
    row = ("e1", dt.datetime(2024, 1, 1, 9), dt.datetime(2024, 1, 1, 10))
    schema = "event_id string, event_time timestamp, available_at timestamp"
    done = lake.write_day(spark.createDataFrame([row], schema), str(tmp_path / "ev"), "2024-01-01")
    assert done["rows"] == 1
    with pytest.raises(ValueError):
        lake.write_day(spark.createDataFrame([row, row], schema), str(tmp_path / "ev"), "2024-01-02")
    lake.write_manifest(spark, str(tmp_path / "m.json"), [done])
    assert lake.read_manifest(spark, str(tmp_path / "m.json")).first()["rows"] == 1
    with pytest.raises(lake.DataMissing):
        lake.scan(spark, str(tmp_path / "none"), schema)


def test_one_broken_check_does_not_hide_the_others(spark):
    good = lambda: spark.range(3).agg(F.count("*").alias("failing"))

    def bad():
        raise RuntimeError("no data")

    got = {r.id: (r.level, r.failing) for r in quality.run_suite({"A": ("warn", good), "B": ("error", bad)}).collect()}
    assert got == {"A": ("warn", 3), "B": ("error", -1)}


def test_rerank_falls_back_where_the_scorer_fails(spark):
    hits = spark.createDataFrame([(1, d, r, s) for d, r, s in ((10, 1, 0.1), (11, 2, 0.9), (12, 3, 0.5))] + [(2, 10, 1, None), (2, 11, 2, 0.9)], "query_id int, doc_id int, rank int, sc double")
    got = {(r.query_id, r["rank"]): r.doc_id for r in retrieval.reranked(hits, F.col("sc"), 2).collect()}
    assert got[1, 1] == 11 and got[1, 3] == 12 and got[2, 1] == 10


def test_state_changes(spark):
    d = spark.createDataFrame([(1, "pending"), (2, "done")], "id int, status string")
    c = spark.createDataFrame([(1, "approved"), (2, "approved")], "id int, to string")
    assert sorted(tuple(r) for r in state.moved(d, c).collect()) == [(1, "approved"), (2, "done")]


def test_shards_differ_by_presence_digest_or_rows(spark):
    files = lambda rows: spark.createDataFrame(rows, "file string, sha256 string, rows long")
    told = files([("a", "x", 1), ("b", "x", 1), ("c", "x", 1), ("d", None, 1), ("e", "x", 1)])
    found = files([("a", "x", 1), ("b", "y", 1), ("c", "x", 2), ("d", None, 1), ("f", "x", 1)])
    got = {r.file: r.state for r in quality.shard_differences(told, found).collect()}
    assert got == {"b": "mismatched", "c": "mismatched", "e": "missing", "f": "extra"}
    assert quality.shard_differences(told.limit(0), found.limit(0)).count() == 0


def test_one_word_boards_need_a_flat_bar_away_from_the_close_before(spark):
    d = days(5)
    prices = [(10.0, 10.0, 10.0, 10.0), (11.0, 11.0, 11.0, 11.0), (11.0, 11.0, 11.0, 11.0), (12.0, 12.1, 12.0, 12.0), (None, 13.0, 13.0, 13.0)]
    bars = spark.createDataFrame([("600001", "raw", d[i], *p) for i, p in enumerate(prices)], "symbol string, adjustment string, trade_date date, open double, high double, low double, close double")
    assert [(r.trade_date, r.prev_close) for r in quality.one_word_boards(bars).collect()] == [(d[1], 10.0)]


def test_slots_and_windows_count_per_user(spark):
    at = dt.datetime
    rows = spark.createDataFrame([("u", at(2024, 1, 1, 23), 3), ("u", at(2024, 1, 3), 1), ("u", at(2024, 1, 3), 2), ("v", at(2023, 12, 31, 23, 59), 4), (None, at(2024, 1, 2), 5), ("v", None, 6)], "user string, at timestamp_ntz, id int")
    assert {r.id: r.slot for r in state.slots(rows, "user", ["at", "id"]).where("user = 'u'").collect()} == {3: 0, 1: 1, 2: 2}
    assert {r.user: r.used for r in state.used_in_window(rows, "user", "at", "2024-01-03", 3).collect()} == {"u": 3, None: 1}


def test_curve_metrics_of_short_and_flat_curves(spark):
    rows = [("a", i, v) for i, v in enumerate([100.0, 120.0, 90.0, 110.0])] + [("b", 0, 5.0)] + [("c", i, 7.0) for i in range(3)]
    got = {r.id: r for r in series.curve_metrics(spark.createDataFrame(rows, "id string, i int, v double"), "id", "i", "v").collect()}
    assert (got["a"].n, got["a"].total, got["a"].max_drawdown, got["a"].sharpe) == (4, 0.1, 0.25, 3.4202)
    assert got["a"].annual == pytest.approx(1.1 ** (252 / 3) - 1, abs=1e-5)
    assert (got["b"].total, got["b"].annual, got["b"].sharpe) == (0.0, None, None)
    assert (got["c"].annual, got["c"].sharpe) == (0.0, None)


def test_numbers_names_and_embedding_text(spark):
    rows = [("1、净利润 12.5%",), ("2. 营收 67969.50 万元\n- 3) x",), ("- -5.2‰ １２．５％ 3个基点",), ("12.34%",)]
    got = [r.n for r in spark.createDataFrame(rows, "t string").select(text.numbers_in(F.col("t")).alias("n")).collect()]
    assert got == [["12.5%"], ["67969.50万元", "3"], ["5.2‰", "12.5%", "3个基点"], ["12.34%"]]
    names = spark.createDataFrame([("XD样 本",), ("Ｎ样本",), ("NIO",), (None,)], "n string")
    assert [r.o for r in text.normal_name(names, "n", "o").collect()] == ["样本", "样本", "NIO", ""]
    e = spark.createDataFrame([("题", " ", ["甲", " "], ["600001"], "kind", dt.datetime(2024, 1, 2, 3), None, 7.25)], "title string, summary string, industries array<string>, symbols array<string>, k string, t timestamp_ntz, d string, s double")
    (line,) = e.select(text.embedding_text(*[F.col(c) for c in e.columns]).alias("x")).first()
    assert line == "【标题】题\n【类型】kind 【时间】2024-01-02 【重要度】7.2 【行业】甲 【标的】600001"
    (left,) = e.select(text.unknown_numbers(F.lit("涨 5% 到 3 元，再涨 9%"), F.array(F.lit("5"), F.lit("3元")))).first()
    assert left == ["9%"]


def test_breadth_and_sections_of_given_days(spark):
    """A null sort key is last both ways; tags of events after the close don't count that day."""
    rows = spark.createDataFrame([("b", None), ("a", 1.0), ("c", -1.0)], "symbol string, change_pct double").withColumn("trade_date", F.lit("2024-01-02").cast("date"))
    for down, order in ((True, ["a", "c", "b"]), (False, ["c", "a", "b"])):
        assert [r.symbol for r in market.cross_section(rows, "2024-01-02", descending=down).collect()] == order
    events = spark.createDataFrame([(["x"], ["a"], dt.datetime(2024, 1, 2, 15)), (["y"], ["a"], dt.datetime(2024, 1, 2, 15, 0, 1))], "industries array<string>, symbols array<string>, available_at timestamp_ntz")
    day = rows.withColumn("amount", F.lit(1.0))
    assert [r.industry for r in market.sector_performance(day, events, "2024-01-02", dt.datetime(2024, 1, 2, 15), 1).collect()] == ["x"]


def test_a_calendar_with_other_days_fails_the_check(spark):
    day = lambda *xs: spark.createDataFrame([(x,) for x in xs], "trade_date date")
    got = market.date_differences(day(*days(3)), day(*days(2), days(9)[8])).collect()
    assert sorted((r.trade_date, r.side) for r in got) == [(days(3)[2], "left"), (days(9)[8], "right")]


def test_wilder_rsi_against_a_loop(spark):
    closes = [10.0, 11.0, 10.5, 12.0, 11.0, 11.5, 13.0, 12.5, 12.0]
    gain = loss = 0.0
    for i in range(1, len(closes)):
        up, down = max(0.0, closes[i] - closes[i - 1]), max(0.0, closes[i - 1] - closes[i])
        gain, loss = (gain + up / 3, loss + down / 3) if i <= 3 else ((gain * 2 + up) / 3, (loss * 2 + down) / 3)
    rows = spark.createDataFrame([("a", d, c) for d, c in zip(days(9), closes, strict=True)], "symbol string, trade_date date, close double")
    assert series.wilder_rsi(rows, 3).first().rsi == pytest.approx(100 - 100 / (1 + gain / loss), abs=1e-4)


def test_dictionary_of_nothing_and_a_failed_day_keep_what_was_there(spark, tmp_path):
    assert lake.read_dictionary(spark, str(tmp_path / "none")).count() == 0
    rows = spark.createDataFrame([("600001", "x", 2, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))], "symbol string, name string, count long, first_seen timestamp_ntz, last_seen timestamp_ntz")
    lake.write_dictionary(rows, str(tmp_path / "d"))
    assert lake.read_dictionary(spark, str(tmp_path / "d")).collect() == rows.collect()
    schema = "event_id string, event_time timestamp, available_at timestamp"
    row = ("e1", dt.datetime(2024, 1, 1, 9), dt.datetime(2024, 1, 1, 10))
    lake.write_day(spark.createDataFrame([row], schema), str(tmp_path / "ev"), "2024-01-01")
    lake.write_day(spark.createDataFrame([row, ("e2", *row[1:])], schema), str(tmp_path / "ev"), "2024-01-01")
    assert spark.read.schema(schema).parquet(str(tmp_path / "ev" / "event_day=2024-01-01")).count() == 2
    with pytest.raises(ValueError):
        lake.write_day(spark.createDataFrame([row, row], schema), str(tmp_path / "ev"), "2024-01-01")
    assert spark.read.schema(schema).parquet(str(tmp_path / "ev" / "event_day=2024-01-01")).count() == 2


def test_dense_search_filters_before_ranking(spark):
    """The nearest document isn't in the list of a query that may not see it; the k best of the rest are."""
    docs = spark.createDataFrame(
        [(i, [1.0, i / 10.0], f"2024-01-{i + 1:02d} 00:00:00", "ab"[i % 2], [f"s{i % 3}"], float(i)) for i in range(9)] + [(9, [1.0, 0.0], None, None, None, None)],
        "doc_id long, embedding array<double>, at string, event_type string, symbols array<string>, importance_score double",
    ).withColumn("available_at", F.to_timestamp_ntz("at")).drop("at")
    asks = spark.createDataFrame(
        [(0, [1.0, 0.0], None, None, None, None), (1, [1.0, 0.0], "2024-01-05 00:00:00", ["b"], None, None), (2, [1.0, 0.0], None, ["a", "b"], ["s0", "s2"], 4.0), (3, [1.0, 0.0], None, [], None, None)],
        "query_id long, embedding array<double>, at string, types array<string>, symbols array<string>, least double",
    ).withColumn("as_of", F.to_timestamp_ntz("at")).drop("at")
    for size in (512, 1):
        found: dict[int, list[int]] = {}
        for r in retrieval.dense(asks, docs, 3, size, retrieval.may_see).orderBy("query_id", "rank").collect():
            found.setdefault(r.query_id, []).append(r.doc_id)
        assert found == {0: [0, 9, 1], 1: [1, 3], 2: [5, 6, 8]}
