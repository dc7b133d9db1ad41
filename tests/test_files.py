"""Files against their manifests, and backfills that break off."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from tidegauge.sources import backfill, files, lake


def stored(spark, tmp_path):
    at = str(tmp_path / "bars")
    spark.range(100).withColumn("year", (F.col("id") % 4 + 2000).cast("int")).repartition("year").write.partitionBy("year").parquet(at)
    return at


def test_what_departs_from_a_manifest_is_found(spark, tmp_path):
    at = stored(spark, tmp_path)
    mark = files.seal(spark, at, str(tmp_path / "m.json"), "2000-01-01", "2003-12-31")
    told = files.manifest_files(spark, str(tmp_path / "m.json"))
    assert files.file_problems(told, files.file_facts(spark, at)).count() == 0
    assert mark == files.seal(spark, at, str(tmp_path / "m2.json")) and json.loads((tmp_path / "m.json").read_text())["first_day"] == "2000-01-01"
    assert {r.rows for r in told.collect()} == {25}
    one = {int(r.file[5:9]): tmp_path / "bars" / r.file for r in told.collect()}
    whole = one[2000].read_bytes()
    one[2000].write_bytes(whole[:8] + bytes([whole[8] ^ 1]) + whole[9:])
    for crc in (tmp_path / "bars").rglob("*.crc"):
        crc.unlink()
    one[2001].unlink()
    one[2002].write_bytes(one[2002].read_bytes()[:-20])
    os.rename(tmp_path / "bars" / "year=2003", tmp_path / "bars" / "old 2003")
    facts = files.file_facts(spark, at)
    got = {r.file[:9]: r.problem for r in files.file_problems(told, facts, r"^year=\d{4}/part-").collect()}
    assert got == {"year=2000": "corrupted", "year=2001": "missing", "year=2002": "unreadable", "year=2003": "missing", "old 2003/": "old_layout"}


def test_sidecars(spark, tmp_path):
    at = stored(spark, tmp_path)
    some = sorted((tmp_path / "bars").rglob("*.parquet"))
    for f in some[1:]:
        f.with_suffix(".json").write_text("{}")
    (missing,) = files.missing_sidecars(spark, at).collect()
    assert missing.file.endswith(some[0].name)


def flat(spark, days=(1, 2, 3), extra=()):
    rows = [(f"e{d}-{i}", datetime.datetime(2024, 1, d, 9), datetime.datetime(2024, 1, d, 10), datetime.date(2024, 1, d)) for d in days for i in range(5)]
    return spark.createDataFrame([*rows, *extra], "event_id string, event_time timestamp_ntz, available_at timestamp_ntz, event_day date")


def states(entries):
    return {r.date and r.date.day: (r.state, r.problem) for r in entries.collect()}


def test_days_are_judged_published_and_skipped(spark, tmp_path):
    at, ledger, t = str(tmp_path / "ev"), str(tmp_path / "ledger"), datetime.datetime
    bad = [("x", t(2024, 1, 4, 9), None, datetime.date(2024, 1, 4)), ("y", t(2024, 1, 5, 9), t(2024, 1, 5, 8), datetime.date(2024, 1, 5)), ("e3-0", t(2024, 1, 3, 9), t(2024, 1, 3, 9), datetime.date(2024, 1, 3)), ("n", None, None, None)]
    first, seen = backfill.backfill(flat(spark, extra=bad), at, ledger)
    want = {1: ("published", None), 2: ("published", None), 3: ("refused", "repeated_id"), 4: ("refused", "no_available_at"), 5: ("refused", "available_before_event"), None: ("refused", "no_day")}
    assert states(first) == want and seen["rows"] == 18 and seen["early"] == 1
    assert spark.read.parquet(at).count() == 10
    again, seen = backfill.backfill(flat(spark), at, ledger)
    assert states(again) == {1: ("skipped", None), 2: ("skipped", None), 3: ("published", None)} and seen["rows"] == 5
    changed = flat(spark).withColumn("available_at", F.expr("CASE WHEN event_day = DATE '2024-01-02' THEN NULL ELSE available_at END"))
    assert states(backfill.backfill(changed, at, ledger)[0])[2] == ("refused", "no_available_at")
    assert spark.read.parquet(at).count() == 15 and not [f for f in os.listdir(at) if f.startswith(".")]


def test_a_run_that_breaks_off_is_taken_up_again(spark, tmp_path, monkeypatch):
    at, ledger, put_in_place = str(tmp_path / "ev"), str(tmp_path / "ledger"), backfill._publish

    def breaks(spark_, fs, source, target, held):
        if target.endswith("03"):
            raise OSError("gone")
        put_in_place(spark_, fs, source, target, held)

    monkeypatch.setattr(backfill, "_publish", breaks)
    with pytest.raises(OSError):
        backfill.backfill(flat(spark), at, ledger)
    assert states(backfill.ledger_rows(spark, ledger)) == {1: ("published", None), 2: ("published", None)}
    monkeypatch.setattr(backfill, "_publish", put_in_place)
    assert states(backfill.backfill(flat(spark), at, ledger)[0]) == {1: ("skipped", None), 2: ("skipped", None), 3: ("published", None)}
    assert spark.read.parquet(at).count() == 15


def test_shards_are_never_gone(spark, tmp_path):
    bars = spark.createDataFrame([("s", "qfq", datetime.date(2024, 1, 2), 1.0)], "symbol string, adjustment string, trade_date date, close double")
    for n in (1, 2):
        lake.write_shards(bars.withColumn("close", F.lit(float(n))), str(tmp_path / "b"))
        assert spark.read.parquet(str(tmp_path / "b")).first().close == n
    assert os.listdir(tmp_path) == ["b"]
