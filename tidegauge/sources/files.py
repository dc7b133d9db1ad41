"""Data files themselves: digests and row counts by the executors, sealed manifests, and what differs from them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lake import _path

MANIFEST = "files array<struct<file:string,sha256:string,bytes:long,rows:long>>, first_day date, last_day date, fingerprint string"


def _under(folder: str, path) -> F.Column:
    """A file's name below ``folder``, without escapes of its address."""
    plain = F.url_decode(F.regexp_replace(path, r"\+", "%2B"))
    return F.substring_index(plain, folder.rstrip("/").rpartition("/")[2] + "/", -1)


def file_facts(spark: SparkSession, folder: str) -> DataFrame:
    """(file, sha256, bytes, rows) of every Parquet file under ``folder``, however deep; rows is null for one that can't be read.

    Executors read the bytes for the digest, a file at a time (a file is one value: at most 2 GB), and one scan counts
    rows by the file that they come from. An empty file has 0 rows.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(folder)
    facts = found.select(_under(folder, F.col("path")).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), F.substring("content", -4, 4).alias("tail"))
    scan = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option("ignoreCorruptFiles", True).parquet(folder)
    rows = scan.groupBy(_under(folder, F.col("_metadata.file_path")).alias("file")).agg(F.count("*").alias("n"))
    counted = facts.join(rows, "file", "left")
    return counted.select("file", "sha256", "bytes", F.when(F.col("tail") == F.lit(b"PAR1"), F.coalesce("n", F.lit(0))).alias("rows"))


def seal(spark: SparkSession, folder: str, path: str, first_day=None, last_day=None) -> str:
    """Writes the manifest of ``folder``'s files to ``path``: aside first, then put in place; returns its fingerprint.

    The fingerprint is that of all digests in order of the files' names: equal files give an equal one. The manifest is a
    JSON document with an entry per file, which the driver holds.
    """
    rows = [r.asDict() for r in file_facts(spark, folder).orderBy("file").collect()]  # a row per file
    mark = spark.createDataFrame([("\n".join(f"{r['file']} {r['sha256']}" for r in rows),)], "t string").select(F.sha2("t", 256)).first()[0]
    told = {"files": rows, "first_day": first_day and str(first_day), "last_day": last_day and str(last_day), "fingerprint": mark}
    put(spark, path, json.dumps(told, sort_keys=True, indent=1))
    return mark


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written aside and renamed: a reader finds the old one or the new one, never half of one."""
    aside, fs = _path(spark, f"{path}.{uuid.uuid4().hex}")
    at, _ = _path(spark, path)
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(at):
        fs.delete(at, False)
    if not fs.rename(aside, at):
        raise OSError(f"{path} could not be put in place")


def manifest_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, bytes, rows) that a manifest declares."""
    return spark.read.option("multiLine", True).schema(MANIFEST).json(path).select(F.explode("files").alias("f")).select("f.*")


def file_problems(declared: DataFrame, facts: DataFrame, layout: str | None = None) -> DataFrame:
    """(file, problem) where files depart from their manifest; a file without a problem has no row.

    missing (declared, not there), old_layout (there, of a name that ``layout``, a regular expression, doesn't match: a
    glob would count its rows twice), undeclared, unreadable, corrupted (other bytes), rows (another count). The first that holds.
    """
    a = declared.select("file", F.col("sha256").alias("told"), F.col("rows").alias("n"))
    met = a.join(facts.select("file", "sha256", "rows", F.lit(True).alias("there")), "file", "full_outer")
    old = ~F.col("file").rlike(layout) if layout else F.lit(False)
    problem = (
        F.when(F.col("there").isNull(), "missing")
        .when(old, "old_layout")
        .when(F.col("told").isNull(), "undeclared")
        .when(F.col("rows").isNull(), "unreadable")
        .when(F.col("told") != F.col("sha256"), "corrupted")
        .when(~F.col("n").eqNullSafe(F.col("rows")), "rows")
    )
    return met.select("file", problem.alias("problem")).where("problem IS NOT NULL")


def missing_sidecars(spark: SparkSession, folder: str, ending: str = ".json") -> DataFrame:
    """Data files under ``folder`` that have no file of the same name with ``ending`` beside them: (file)."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(_under(folder, F.col("path")).alias("file"))
    stem = F.regexp_replace("file", r"\.[^./]+$", "")
    data = listed.where(F.col("file").endswith(".parquet")).withColumn("stem", stem)
    return data.join(listed.where(F.col("file").endswith(ending)).select(stem.alias("stem")), "stem", "left_anti").select("file")
