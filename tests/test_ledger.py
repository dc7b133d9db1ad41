"""Ledger lines, stalls, runs of failures and excused gaps, by hand."""

import datetime as dt

from tidegauge.operators import ledger, quality

DAY = dt.date


def lines(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "line_no long, text string")


def calendar(spark, *days):
    return spark.createDataFrame([(d, i) for i, d in enumerate(days)], "trade_date date, session_idx int")


def test_lines_that_are_no_entry_are_told_and_missing_keys_are_not(spark):
    found = ledger.entries(lines(spark, '{"scope": "daily", "day": "2024-01-02", "state": "ok"}', "", None, "  \t", '{"scope": "x"', "[1]", "7", "null", '{"day": "soon"}', '{"scope": {"a": 1}, "state": 3}'))
    got = {r.line_no: r for r in found.collect()}
    assert set(got) == {1, 5, 6, 7, 8, 9, 10} and {n for n, r in got.items() if r.bad} == {5, 6, 7, 8}
    assert (got[1].scope, got[1].day, got[1].state) == ("daily", DAY(2024, 1, 2), "ok") and (got[9].scope, got[9].day) == ("?", None)
    assert tuple(ledger.health(found).first()) == (3, 4, 5, 3, "error")
    assert tuple(ledger.health(ledger.entries(lines(spark, "{}"))).first()) == (1, 0, None, 1, "info")
    assert tuple(ledger.health(found.limit(0)).first()) == (0, 0, None, 0, "warn")


def test_the_last_entry_that_tells_the_archives_end_counts(spark):
    tell = lambda scope, day: '{"scope": "%s"%s}' % (scope, f', "archive_last": "{day}"' if day else "")
    found = ledger.entries(lines(spark, tell("a", "2024-01-09"), tell("a", "2024-01-02"), tell("a", None), tell("b", None), tell("c", "2024-01-03"), tell("a", "no day")))
    got = {r.scope: (r.archive_last, r.line_no, r.stalled_days, r.level) for r in ledger.archive_stalls(found, "2024-01-10").collect()}
    assert got == {"a": (DAY(2024, 1, 2), 2, 8, "warn"), "b": (None, None, None, "info"), "c": (DAY(2024, 1, 3), 5, 7, "info")}


def test_sessions_behind_count_trading_days_only(spark):
    days = calendar(spark, *[DAY(2024, 1, d) for d in (2, 3, 4, 5, 8, 9)])
    rows = [("friday", DAY(2024, 1, 5)), ("now", DAY(2024, 1, 8)), ("ahead", DAY(2024, 1, 9)), ("old", DAY(2024, 1, 2)), ("none", None), ("holiday", DAY(2024, 1, 6)), ("before", DAY(2023, 12, 1))]
    at = spark.createDataFrame(rows, "scope string, last_day date")
    got = {r.scope: (r.behind, r.level) for r in ledger.sessions_behind(at, days, "2024-01-08", 2).collect()}
    assert got == {"friday": (1, "info"), "now": (0, "info"), "ahead": (0, "info"), "old": (4, "warn"), "none": (None, "info"), "holiday": (0, "info"), "before": (4, "warn")}
    assert {r.behind for r in ledger.sessions_behind(at, days.limit(0), "2024-01-08", 2).collect()} == {None}


def test_the_calendars_end(spark):
    days = calendar(spark, DAY(2024, 1, 2), DAY(2024, 3, 1))
    assert tuple(ledger.runway(days, "2024-01-01").first()) == (DAY(2024, 1, 2), DAY(2024, 3, 1), 60, "info")
    assert ledger.runway(days, "2024-01-02").first().level == "warn" and ledger.runway(days.limit(0), "2024-01-02").first().level == "error"


def test_runs_of_failures_are_stretches_of_days_that_ended_alike(spark):
    entry = lambda day, state, scope="a": '{"scope": "%s", "day": "2024-01-%02d", "state": "%s"}' % (scope, day, state)
    told = [entry(2, "ok"), entry(3, "failed"), entry(3, "ok"), entry(4, "failed"), entry(6, "failed"), entry(8, "empty"), entry(9, "ok"), entry(10, "failed"), entry(3, "failed", "b"), "broken"]
    states = ledger.day_states(ledger.entries(lines(spark, *told)))
    days = calendar(spark, *[DAY(2024, 1, d) for d in (2, 3, 4, 5, 8, 9, 10)])
    got = {tuple(r) for r in ledger.failure_runs(states, days).collect()}
    at = lambda d: DAY(2024, 1, d)
    assert got == {("a", "failed", at(4), at(6), 2, 2, False), ("a", "empty", at(8), at(8), 1, 1, False), ("a", "failed", at(10), at(10), 1, 1, True), ("b", "failed", at(3), at(3), 1, 1, True)}
    events = spark.createDataFrame([(dt.datetime(2024, 1, d, 9),) for d in (3, 7, 9)], "event_time timestamp_ntz")
    gaps = {(r.day.day, r.kind) for r in quality.event_gaps(events, days, ledger.empty_days(states)).collect()}
    assert gaps == {(4, "trading"), (5, "trading"), (6, "natural")}
    assert (8, "trading") in {(r.day.day, r.kind) for r in quality.event_gaps(events, days).collect()}


def test_a_line_is_parsed_once_whatever_is_asked_of_it(spark):
    lines = spark.createDataFrame([(1, '{"day": "2024-01-02", "state": "empty"}'), (2, "[3]"), (3, "{}"), (4, "{"), (5, " ")], "line_no long, text string")
    states = ledger.empty_days(ledger.day_states(ledger.entries(lines)))
    assert [r.day.day for r in states.collect()] == [2]
    assert states._jdf.queryExecution().optimizedPlan().toString().lower().count("parse_json(") + states._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    assert [(r.line_no, r.bad, r.scope) for r in ledger.entries(lines).orderBy("line_no").collect()] == [(1, False, "?"), (2, True, None), (3, False, "?"), (4, True, None)]
