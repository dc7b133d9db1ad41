"""Shared-folder tables and small helpers that several operators use."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDER = "tidegauge.scratch.dir"
_open: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session names none, as in tests, a folder of the driver's own is made once. On a cluster that would
    be a folder of one machine, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN_FOLDER, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tidegauge-")
        spark.conf.set(_OWN_FOLDER, named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own under the shared folder; deleted at the end of :func:`intermediates`, or with the interpreter."""
    path = f"{shared_folder(spark)}/tidegauge/{label}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    else:
        atexit.register(_delete, path)
    return path


@contextmanager
def intermediates() -> Iterator[None]:
    """Tables that are staged within are deleted at the end; what is to stay must be written elsewhere by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _delete(path)


#: What stages of a pipeline staged and nobody deleted yet, by the folder of the pipeline's input.
_left: dict[str, list[str]] = {}


@contextmanager
def stage_of(sf_dir: str, docs: DataFrame | None = None) -> Iterator[None]:
    """Around the making of a stage's result, or around nothing once the last one is written: what earlier stages over ``sf_dir`` staged is deleted first.

    A stage begins when the one before is written, so nobody needs that any more. Where ``docs`` still reads some of it
    (stages put together without being written) that much stays.
    """
    held = _left.setdefault(sf_dir, [])
    if held:
        read = "\n".join(docs.inputFiles()) if docs is not None else ""
        for path in [p for p in held if p.rsplit("/", 1)[1] not in read]:
            _delete(path)
            held.remove(path)
    _open.append(held)
    try:
        yield
    finally:
        _open.pop()


def _delete_left() -> None:
    for held in _left.values():
        for path in held:
            _delete(path)


atexit.register(_delete_left)


def _delete(path: str) -> None:
    session = SparkSession.getActiveSession()
    if session is None or session.sparkContext._jsc is None:
        return
    delete(session, path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder; none there: nothing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of a row group where rows are large.
LARGE_ROWS = 16 << 20


def staged(df: DataFrame, label: str, codec: str = "zstd", large_rows: bool = False) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read back.

    It cuts lineage: a lost executor costs later steps no recomputation, and ids made
    by ``monotonically_increasing_id`` stay what they were. Parquet measures a row group after its hundredth row only, and
    a group is buffered whole to be written and unfolded whole to be read; with ``large_rows`` it is measured from
    the first row on, and kept small.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    how = {"parquet.block.size": str(LARGE_ROWS), "parquet.page.size.row.check.min": "1"} if large_rows else {}
    df.write.options(compression=codec, **how).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be none of the columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def refuse_clash(df: DataFrame, name: str) -> None:
    """An output column never takes the place of one that is there."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {name!r} already: name another with as_col")


def numbered(docs: DataFrame, label: str = "numbered") -> tuple[DataFrame, str]:
    """``docs`` staged with a number for each row, and the name of that column: ids may be null or repeat, rows don't."""
    row = free_name(docs, "__row")
    return staged(docs.withColumn(row, F.monotonically_increasing_id()), label), row


#: Values that are met at most so often, or by less than this share of all rows, may meet in one task.
HOT_ROWS, HOT_SHARE = 1000, 100_000


def join_frequent(left: DataFrame, right: DataFrame, on: list[str], n_rows: str, total: int) -> DataFrame:
    """``left`` inner ``right`` on keys without nulls, where ``right`` (unique by key) counts the rows of ``left`` in ``n_rows``.

    Keys with HOT_ROWS rows and a HOT_SHAREth of all are broadcast: there can't be more than HOT_SHARE of those, whatever
    the size. The others are joined by a shuffle, where no key is large. Both sides must be staged: they are read twice.
    """
    least = max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(right.where(F.col(n_rows) >= least))
    cold = left.join(F.broadcast(right.where(F.col(n_rows) >= least).select(*on)), on, "left_anti")
    return left.join(hot, on).unionByName(cold.join(right.where(F.col(n_rows) < least), on))


def dealt_join(left: DataFrame, right: DataFrame, on: str, total: int) -> DataFrame:
    """``left`` inner ``right`` (unique by ``on``), where a key with very many rows of ``left`` is dealt over as many tasks as it needs.

    Unlike a broadcast, it suits wide rows of ``right``. ``left`` (``total`` rows) is read twice.
    """
    limit = max(HOT_ROWS, total // HOT_SHARE)
    parts, part = free_name(left, "__parts"), free_name(left, "__part")
    hot = F.broadcast(staged(left.groupBy(on).agg(F.ceil(F.count("*") / limit).cast("int").alias(parts)).where(F.col(parts) > 1), "frequent-keys"))
    n = F.coalesce(F.col(parts), F.lit(1))
    dealt = right.join(hot, on, "left").withColumn(part, F.explode(F.sequence(F.lit(0), n - 1))).drop(parts)
    rest = [c for c in left.columns if c != on]
    spread = F.pmod(F.xxhash64(on, *rest), n).cast("int")
    return left.join(hot, on, "left").withColumn(part, spread).drop(parts).join(dealt, [on, part]).drop(part)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
