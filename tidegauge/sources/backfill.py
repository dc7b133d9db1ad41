"""Many days of events written by one job: judged day by day, published by rename, resumed from a ledger."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .files import put
from .lake import _path

ENTRY = "date date, state string, rows long, problem string, fingerprint string, at timestamp, run string"


def day_facts(flat: DataFrame, day: str = "event_day") -> DataFrame:
    """Per day: rows, what makes it unfit (problem, null if nothing), and a fingerprint that the rows' order doesn't change."""
    found = flat.groupBy(F.col(day).alias("date")).agg(
        F.count("*").alias("rows"), F.count_if(F.col("available_at").isNull()).alias("unknown"), F.count_if(F.col("available_at") < F.col("event_time")).alias("early"),
        (F.count("event_id") - F.count_distinct("event_id")).alias("repeated"), F.sum(F.xxhash64(*sorted(flat.columns)).cast("decimal(38,0)")).cast("string").alias("fingerprint"),
    )
    problem = F.when(F.col("date").isNull(), "no_day").when(F.col("unknown") > 0, "no_available_at").when(F.col("early") > 0, "available_before_event").when(F.col("repeated") > 0, "repeated_id")
    return found.select("date", "rows", problem.alias("problem"), "fingerprint")


def ledger_rows(spark: SparkSession, ledger: str) -> DataFrame:
    """All entries of a ledger; a ledger that isn't there is empty."""
    at, fs = _path(spark, ledger)
    return spark.read.schema(ENTRY).json(ledger) if fs.exists(at) else spark.createDataFrame([], ENTRY)


def published_days(spark: SparkSession, ledger: str) -> DataFrame:
    """(date, fingerprint) of each day's last publication."""
    return ledger_rows(spark, ledger).where("state = 'published'").groupBy("date").agg(F.max_by("fingerprint", "at").alias("fingerprint"))


def backfill(flat: DataFrame, folder: str, ledger: str, day: str = "event_day") -> tuple[DataFrame, dict]:
    """Publishes the days of ``flat`` to ``folder/<day>=<date>``; returns an entry per day and the run's metrics.

    One job writes all days that the ledger hasn't with the same fingerprint, aside, and observes its totals; one aggregate
    over what was written judges each day. A fit day is put in place by rename, what was there goes only then; an unfit one
    is refused and what was there stays. Entries (published, refused, skipped) go to the ledger even if the run breaks off
    between two days: running it again publishes what is left. The driver holds a row per day, never rows of one.
    """
    spark = flat.sparkSession
    known = published_days(spark, ledger).select("date", F.col("fingerprint").alias("was"))
    wanted = day_facts(flat, day).join(known, "date", "left").withColumn("same", F.col("fingerprint").eqNullSafe(F.col("was")))
    plan = [r.asDict() for r in wanted.select("date", "rows", "fingerprint", "same").collect()]
    run, entries, seen = uuid.uuid4().hex, [], Observation(f"backfill {uuid.uuid4().hex}")
    aside = f"{folder}/.staging-{run}"
    todo = spark.createDataFrame([(r["date"],) for r in plan if not r["same"] and r["date"] is not None], f"{day} date")
    picked = flat.join(F.broadcast(todo), day, "left_semi").observe(seen, F.count(F.lit(1)).alias("rows"), F.max("available_at").alias("latest"), F.count_if(F.col("available_at") < F.col("event_time")).alias("early"))
    picked.hint("rebalance", day).write.partitionBy(day).parquet(aside)
    written = spark.read.schema(flat.schema).parquet(aside)
    here, fs = _path(spark, aside)
    try:
        for r in day_facts(written, day).orderBy("date").collect():
            if r["problem"] is None:
                _publish(spark, fs, f"{aside}/{day}={r['date']}", f"{folder}/{day}={r['date']}", f"{folder}/.replaced-{run}")
            entries.append(r.asDict() | {"state": "refused" if r["problem"] else "published"})
        entries += [{k: r[k] for k in ("date", "rows", "fingerprint")} | {"state": "skipped", "problem": None} for r in plan if r["same"]]
        entries += [{k: r[k] for k in ("date", "rows", "fingerprint")} | {"state": "refused", "problem": "no_day"} for r in plan if r["date"] is None]
    finally:
        fs.delete(here, True)
        now = spark.sql("SELECT date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX\")").first()[0]
        lines = [json.dumps(e | {"date": e["date"] and str(e["date"]), "run": run, "at": now}, sort_keys=True) for e in entries]
        if lines:
            put(spark, f"{ledger}/run-{run}.json", "\n".join(lines))
    return ledger_rows(spark, ledger).where(F.col("run") == run).drop("run", "at"), seen.get


def _publish(spark: SparkSession, fs, source: str, target: str, held: str) -> None:
    here, there, was = (_path(spark, p)[0] for p in (source, target, held))
    if fs.exists(there) and not fs.rename(there, was):
        raise OSError(f"{target} could not be moved aside")
    fs.mkdirs(there.getParent())
    if not fs.rename(here, there):
        fs.rename(was, there)
        raise OSError(f"{target} could not be put in place; what was there stays")
    fs.delete(was, True)
