"""The Parquet lake: scans with a fixed schema, the event archive's flattening, validated day partitions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS_SCHEMA = "symbol string, adjustment string, trade_date date, open double, high double, low double, close double, volume double, amount double, change_pct double, turnover_pct double, is_suspended boolean"

PAYLOAD_SCHEMA = (
    "title string, summary string, direction string, confidence double, factor_value double, factor_scores string, industries array<string>, "
    "stocks array<struct<code:string,name:string,reason:string>>, source string, source_url string, observed_at timestamp_ntz, quality_status string, "
    "source_time_quality string, dedup_key string, record_version int, revision_id string, revision_time timestamp_ntz, is_corrected boolean, correction_count int, person string"
)

# Directions as sources write them.
DIRECTIONS = {
    "bullish": ("利多", "bullish", "positive", "看多", "dovish"),
    "bearish": ("利空", "bearish", "negative", "看空", "hawkish"),
    "neutral": ("中性", "neutral"),
}


class DataMissing(RuntimeError):
    """A folder without data: missing data is an error, not an empty table."""


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def scan(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Parquet files below ``path`` under a declared schema; none: :class:`DataMissing`."""
    at, fs = _path(spark, path)
    if not fs.exists(at) or not (fs.getFileStatus(at).isFile() or any(".parquet" in f.getPath().getName() or f.isDirectory() for f in fs.listStatus(at))):
        raise DataMissing(f"no Parquet file in {path}")
    return spark.read.schema(schema).parquet(path)


def calendar(spark: SparkSession, path: str) -> DataFrame:
    """Sessions of a JSON file ``{"sessions": [dates]}``: trade_date."""
    return spark.read.schema("sessions array<string>").option("multiLine", True).json(path).select(F.explode("sessions").cast("date").alias("trade_date"))


def normal_code(code: Column, name: Column) -> Column:
    """The six-digit code of a code or else a name; empty where a suffix names another market, or there is none."""
    raw = F.coalesce(F.nullif(F.trim(code), F.lit("")), F.nullif(F.trim(name), F.lit("")), F.lit(""))
    foreign = raw.contains(".") & ~F.regexp_extract(raw, r"\.([A-Z]+)$", 1).isin("SH", "SZ")
    return F.when(foreign, F.lit("")).otherwise(F.regexp_extract(raw, r"([0-9]{6})", 1))


def normal_direction(raw: Column) -> Column:
    """bullish, bearish or neutral; anything else is no direction (null)."""
    out = F.lit(None).cast("string")
    for direction, words in DIRECTIONS.items():
        out = F.when(F.trim(raw).isin(*words), F.lit(direction)).otherwise(out)
    return out


def flatten_archive(archive: DataFrame, types: tuple[str, ...] | None = None, archive_name: str = "archive") -> DataFrame:
    """Archive rows with a JSON payload → one flat row per event; ``types`` is the whitelist of event types.

    A payload that can't be parsed gives nulls; symbols are distinct and sorted, empty codes fall away.
    """
    rows = archive.where(F.col("event_type").isin(*types)) if types else archive
    p = F.from_json("payload_json", PAYLOAD_SCHEMA)
    flat = rows.withColumn("p", p)
    codes = F.transform(F.coalesce("p.stocks", F.expr("cast(array() as array<struct<code:string,name:string,reason:string>>)")), lambda s: normal_code(s["code"], s["name"]))
    kept = [c for c in ("event_id", "event_type", "event_time", "available_at", "reported_available_at", "importance_score", "content_hash") if c in archive.columns]
    plain = ("observed_at", "title", "summary", "confidence", "factor_value", "factor_scores", "source_url", "quality_status", "source_time_quality", "dedup_key", "record_version", "revision_id", "revision_time", "is_corrected", "correction_count", "person")
    return flat.select(
        *kept,
        *[F.col(f"p.{c}").alias(c) for c in plain],
        F.col("p.direction").alias("direction"),
        normal_direction(F.col("p.direction")).alias("direction_norm"),
        F.col("p.industries").alias("industries"),
        F.get_json_object("payload_json", "$.stocks").alias("stocks"),
        F.array_sort(F.array_distinct(F.filter(codes, lambda c: c != ""))).alias("symbols"),
        F.lit(archive_name).alias("source"),
        F.col("p.source").alias("original_source"),
    )


def write_day(flat: DataFrame, folder: str, day: str) -> dict:
    """Writes one day's events to ``folder/event_day=<day>``: first aside, checked, then renamed into place.

    Raises if there is no row, a null available_at, one before its event_time, or a repeated event_id.
    """
    spark = flat.sparkSession
    aside = f"{folder}/.staging-{uuid.uuid4().hex}"
    flat.write.parquet(aside)
    seen = spark.read.schema(flat.schema).parquet(aside)
    found = seen.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("available_at").isNull()).alias("no_available_at"),
        F.count_if(F.col("available_at") < F.col("event_time")).alias("too_early"),
        (F.count("event_id") - F.count_distinct("event_id")).alias("repeated"),
        F.sum(F.xxhash64("event_id", "available_at").cast("decimal(38,0)")).cast("string").alias("fingerprint"),
    ).first()
    here, fs = _path(spark, aside)
    if not found["rows"] or found["no_available_at"] or found["too_early"] or found["repeated"]:
        fs.delete(here, True)
        raise ValueError(f"{day} is refused: {found.asDict()}")
    there, _ = _path(spark, f"{folder}/event_day={day}")
    was, _ = _path(spark, f"{folder}/.replaced-{uuid.uuid4().hex}")
    if fs.exists(there) and not fs.rename(there, was):
        raise OSError(f"{day} could not be moved aside")
    if not fs.rename(here, there):
        fs.rename(was, there)
        raise OSError(f"{day} could not be put in place; what was there stays")
    fs.delete(was, True)
    return {"date": day, "rows": found["rows"], "fingerprint": found["fingerprint"]}


def write_manifest(spark: SparkSession, path: str, days: list[dict]) -> None:
    """The manifest of the written days as JSON."""
    at, fs = _path(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(json.dumps({"days": sorted(days, key=lambda d: d["date"])}, sort_keys=True, indent=1).encode()))
    out.close()


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """date, rows, fingerprint of each day in a manifest."""
    return spark.read.option("multiLine", True).schema("days array<struct<date:string,rows:long,fingerprint:string>>").json(path).select(F.explode("days").alias("d")).select("d.*")


def days_to_write(manifest: DataFrame, archive_days: DataFrame) -> DataFrame:
    """Days whose fingerprint differs from the manifest's or that it lacks: date, action (write, rewrite, skip)."""
    both = archive_days.select("date", F.col("fingerprint").alias("now")).join(manifest.select("date", F.col("fingerprint").alias("was")), "date", "left")
    return both.select("date", F.when(F.col("was").isNull(), "write").when(F.col("was") != F.col("now"), "rewrite").otherwise("skip").alias("action"))


def overwrite_days(points: DataFrame, path: str, day_col: str = "event_day") -> None:
    """Replaces only the day partitions that ``points`` has; running it again changes nothing."""
    points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day_col).parquet(path)


def append_ledger(spark: SparkSession, path: str, scope: str, payload: dict) -> None:
    """One more run in a JSON-lines ledger."""
    spark.createDataFrame([(scope, json.dumps(payload, sort_keys=True))], "scope string, payload string").withColumn("at", F.current_timestamp()).write.mode("append").json(path)


def last_runs(spark: SparkSession, path: str) -> DataFrame:
    """The last run of each scope."""
    return spark.read.schema("scope string, payload string, at timestamp").json(path).groupBy("scope").agg(F.max_by("payload", "at").alias("payload"), F.max("at").alias("at"))


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """A name dictionary as one sorted file, so that equal rows give an equal table: it has a row per name, not per event."""
    dictionary.coalesce(1).sortWithinPartitions("symbol", "name").write.mode("overwrite").parquet(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary in ``path``; none: an empty one."""
    schema = "symbol string, name string, count long, first_seen timestamp_ntz, last_seen timestamp_ntz"
    at, fs = _path(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(at) else spark.createDataFrame([], schema)


def write_shards(bars: DataFrame, folder: str, made: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Bars by adjustment and year, sorted by day and symbol: written aside first, then put in place; what was there is moved aside until then.

    ``made`` makes the rows to write of those of a quarter, row by row, after they are dealt; it may add the adjustment.
    """
    spark = bars.sparkSession
    aside = f"{folder}.staging-{uuid.uuid4().hex}"
    dated = bars.withColumn("year", F.year("trade_date"))
    dealt = dated.repartition("year", F.quarter("trade_date")) if made else dated.repartition("adjustment", "year")
    (made(dealt) if made else dealt).sortWithinPartitions("adjustment", "year", "trade_date", "symbol").write.partitionBy("adjustment", "year").parquet(aside)
    here, fs = _path(spark, aside)
    there, _ = _path(spark, folder)
    was, _ = _path(spark, f"{folder}.replaced-{uuid.uuid4().hex}")
    if fs.exists(there) and not fs.rename(there, was):
        raise OSError(f"{folder} could not be moved aside")
    if not fs.rename(here, there):
        fs.rename(was, there)
        raise OSError(f"{folder} could not be put in place; what was there stays")
    fs.delete(was, True)


def shard_stats(bars: DataFrame) -> DataFrame:
    """Per adjustment and year: rows, symbols, first_day, last_day and a fingerprint of the rows that their order doesn't change."""
    mark = F.sum(F.xxhash64("symbol", "trade_date", "open", "high", "low", "close", "volume", "amount").cast("decimal(38,0)")).cast("string")
    return bars.groupBy("adjustment", F.year("trade_date").alias("year")).agg(F.count("*").alias("rows"), F.count_distinct("symbol").alias("symbols"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"), mark.alias("fingerprint"))


def window_fingerprint(shards: DataFrame, start, end) -> DataFrame:
    """One digest over the shards (adjustment, year, fingerprint, first_day, last_day) that a window meets, in order: shards, digest."""
    met = shards.where((F.col("last_day") >= F.lit(start).cast("date")) & (F.col("first_day") <= F.lit(end).cast("date")))
    each = F.array_sort(F.collect_list(F.concat_ws("|", "adjustment", F.col("year").cast("string"), "fingerprint")))  # a row per shard
    return met.agg(F.count("*").alias("shards"), F.sha2(F.array_join(each, "\n"), 256).alias("digest"))


def refresh_decision(local_last: Column, expected: Column, synced: Column, current: Column) -> Column:
    """skip where the local bars cover the expected day, up_to_date where the manifest is the one synced last, else refresh."""
    return F.when(local_last >= expected, "skip").when(synced.eqNullSafe(current) & current.isNotNull(), "up_to_date").otherwise("refresh")
