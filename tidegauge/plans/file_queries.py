"""Files and backfills over tables that Spark writes from the shared ones, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import backfill as K
from ..sources import bindings as B
from ..sources import files as P
from .market_queries import EVENTS, with_

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, label: str) -> str:
    return f"{B._store(spark)}/{label}-{uuid.uuid4().hex}"


@query(
    """WITH y AS (SELECT year(o_orderdate) AS year, count(*) AS rows FROM orders GROUP BY ALL),
    p AS (SELECT year, rows, CASE WHEN year % 4 = 1 THEN 'undeclared' WHEN year % 3 = 0 THEN 'corrupted' WHEN year % 5 = 2 THEN 'rows' END AS problem FROM y UNION ALL SELECT 1900, NULL, 'missing')
    SELECT year, rows, coalesce(problem, 'none') AS problem FROM p"""
)
def l1_file_problems(spark: SparkSession, d: str) -> DataFrame:
    """The orders as a file per year, against a manifest that some of them depart from."""
    folder = _folder(spark, "order-files")
    o = B.table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    o.repartition("year").write.option("maxRecordsPerFile", 0).partitionBy("year").parquet(folder)
    P.seal(spark, folder, f"{folder}.manifest.json")
    year = F.regexp_extract("file", r"year=(\d+)", 1).cast("int")
    facts = P.file_facts(spark, folder).withColumn("year", year)
    told = P.manifest_files(spark, f"{folder}.manifest.json").withColumn("year", year).where("year % 4 <> 1")
    told = told.withColumn("sha256", F.when(F.col("year") % 3 == 0, F.reverse("sha256")).otherwise(F.col("sha256"))).withColumn("rows", F.when(F.col("year") % 5 == 2, F.col("rows") + 1).otherwise(F.col("rows")))
    told = told.select("file", "sha256", "bytes", "rows").unionByName(spark.createDataFrame([("year=1900/part.parquet", "0", 1, 1)], "file string, sha256 string, bytes long, rows long"))
    found = P.file_problems(told, facts.drop("year"), r"^year=\d+/part-")
    one = facts.select("file", "rows").join(found, "file", "full_outer")
    return one.select(year.alias("year"), "rows", F.coalesce("problem", F.lit("none")).alias("problem"))


@query(
    with_(EVENTS)
    + """, m AS (SELECT date_trunc('month', event_time)::DATE AS date, count(*) AS rows, CASE WHEN month(date) = 6 THEN 'available_before_event' WHEN month(date) = 9 THEN 'no_available_at' END AS problem FROM ev GROUP BY ALL)
    SELECT date, rows, problem, CASE WHEN problem IS NULL THEN 'published' ELSE 'refused' END AS first_run, CASE WHEN problem IS NULL AND month(date) = 3 THEN 'published' WHEN problem IS NULL THEN 'skipped' ELSE 'refused' END AS second_run,
      CASE WHEN problem IS NULL THEN rows END AS stored FROM m"""
)
def m2_backfill(spark: SparkSession, d: str) -> DataFrame:
    """A backfill of all months of events, and a second one in which the months of March have changed."""
    month = F.month("event_time")
    stamp = F.when(month == 6, F.col("event_time") - F.expr("INTERVAL '1' HOUR")).when(month == 9, F.lit(None)).otherwise(F.col("available_at"))
    flat = B.events(spark, d).select("event_id", "event_type", "event_time", stamp.alias("available_at"), "importance_score", F.trunc(F.to_date("event_time"), "month").alias("event_day"))
    folder = _folder(spark, "backfill")
    first, _ = K.backfill(flat, folder, f"{folder}.ledger")
    changed = flat.withColumn("importance_score", F.when(month == 3, F.coalesce("importance_score", F.lit(0.0)) + 1).otherwise(F.col("importance_score")))
    second, _ = K.backfill(changed, folder, f"{folder}.ledger")
    stored = spark.read.schema(flat.schema).parquet(folder).groupBy(F.col("event_day").alias("date")).agg(F.count("*").alias("stored"))
    both = first.select("date", "rows", "problem", F.col("state").alias("first_run")).join(second.select("date", F.col("state").alias("second_run")), "date")
    return both.join(stored, "date", "left")
