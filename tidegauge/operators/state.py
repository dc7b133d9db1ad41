"""State tables as DataFrames: quotas, leases, upserts, versions, waits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capped_usage(requests: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """Requests in order per key: ``used`` counts up to the limit, the others are rejected."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return requests.withColumn("used", F.least(n, F.lit(limit))).withColumn("accepted", n <= limit)


def slots(tasks: DataFrame, user: str, order: list[str]) -> DataFrame:
    """Active tasks with their ``slot``, from 0 per user, in order."""
    return tasks.withColumn("slot", F.row_number().over(Window.partitionBy(user).orderBy(*order)) - 1)


def used_in_window(requests: DataFrame, user: str, stamp: str, last_day, days: int) -> DataFrame:
    """Requests per user on the ``days`` local days that end with ``last_day``: used."""
    day, last = F.col(stamp).cast("date"), F.lit(last_day).cast("date")
    return requests.where(day.between(F.date_sub(last, days - 1), last)).groupBy(user).agg(F.count("*").alias("used"))


def claim_order(tasks: DataFrame, k: int) -> DataFrame:
    """The next tasks to claim: priority first, then by availability, creation and id."""
    return tasks.where("status = 'queued'").orderBy(F.desc("priority"), "available_at", "created_at", "id").limit(k)


def after_lease(status: Column, lease_ends: Column, now: Column, attempts: Column, most: int) -> Column:
    """A running task whose lease has ended goes back to the queue, or fails after its last attempt."""
    over = (status == "running") & (lease_ends < now)
    return F.when(over & (attempts >= most), "failed").when(over, "queued").otherwise(status)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same keys; the rest stays."""
    return old.join(new, keys, "left_anti").unionByName(new)


def inserted_once(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys ``old`` lacks are added; none is replaced."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def moved(decisions: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Status changes (id, to) take effect on pending decisions only."""
    return decisions.join(changes, key, "left").withColumn("status", F.when((F.col("status") == "pending") & F.col("to").isNotNull(), F.col("to")).otherwise(F.col("status"))).drop("to")


def newest_version(versions: DataFrame, key: str, version: str) -> DataFrame:
    return versions.groupBy(key).agg(F.max(F.struct(version, *[c for c in versions.columns if c not in (key, version)])).alias("m")).select(key, "m.*")


def change_since(added: Column, latest: Column) -> Column:
    """(latest - added) / added; null where either is missing or the base isn't above zero."""
    return F.when(added > 0, F.round((latest - added) / F.nullif(added, F.lit(0.0)), 6))


def waits(tasks: DataFrame, start: str, end: str, by: str) -> DataFrame:
    """Seconds between two stamps per group: n, median and 95th percentile."""
    s = F.timestamp_diff("SECOND", F.col(start), F.col(end)).cast("double")
    return tasks.groupBy(by).agg(F.count("*").alias("n"), F.round(F.percentile(s, F.lit(0.5)), 4).alias("p50"), F.round(F.percentile(s, F.lit(0.95)), 4).alias("p95"))


def next_page(rows: DataFrame, after: tuple | None, keys: tuple[str, str], k: int) -> DataFrame:
    """Keyset pagination: the k rows after the last pair of keys, newest first."""
    a, b = keys
    left = rows if after is None else rows.where((F.col(a) < F.lit(after[0])) | ((F.col(a) == F.lit(after[0])) & (F.col(b) < F.lit(after[1]))))
    return left.orderBy(F.desc(a), F.desc(b)).limit(k)


def used_between(requests: DataFrame, user: str, stamp: str, first_day, last_day) -> DataFrame:
    """Requests per user on the days from ``first_day`` to ``last_day``: used."""
    day = F.col(stamp).cast("date")
    return requests.where(day.between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))).groupBy(user).agg(F.count("*").alias("used"))


def usage_page(users: DataFrame, used: DataFrame, key: str, name: str, asked: str, limit: int, offset: int) -> DataFrame:
    """A page of users whose name contains ``asked``, most used first, each with how many there are in all: used, total."""
    found = users.where(F.contains(F.lower(name), F.lit(asked.lower())))
    total = found.agg(F.count("*").alias("total"))  # one row
    return found.join(used, key, "left").withColumn("used", F.coalesce("used", F.lit(0))).orderBy(F.desc("used"), key).offset(offset).limit(limit).join(F.broadcast(total), F.lit(True))


def judged_means(items: DataFrame, part: Column, score: str) -> DataFrame:
    """Mean score per part over the items that were judged (score not null): judged, mean."""
    return items.where(F.col(score).isNotNull()).groupBy(part).agg(F.count("*").alias("judged"), F.round(F.avg(score), 6).alias("mean"))


def finished(tasks: DataFrame, ends: DataFrame) -> DataFrame:
    """Ends (id, token, to, progress) take effect on running tasks (id, status, token, done) that still have the token they were claimed with."""
    met = tasks.join(ends.select("id", F.col("token").alias("claimed"), "to", "progress"), "id", "left")
    right = (F.col("status") == "running") & F.col("token").eqNullSafe(F.col("claimed")) & F.col("to").isNotNull()
    return met.withColumn("done", F.when(right, F.col("progress")).otherwise(F.col("done"))).withColumn("status", F.when(right, F.col("to")).otherwise(F.col("status"))).drop("claimed", "to", "progress")
