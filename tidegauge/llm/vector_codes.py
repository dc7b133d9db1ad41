"""Compression of vectors into codes, with nearest entries found in an annulus of norms.

A vector is cut into parts, each part has a codebook, and a code names the nearest entry of each part. Whatever lies
within a distance d of a point has a norm within d of the point's norm. So the entries are sorted by norm, a first
distance comes from the entries around the point's own norm, and binary search finds the interval of norms that can hold
one as near; that annulus, its edges included, is compared exactly and nothing else. All of it is integer arithmetic, but
for the edges, which are widened by more than a float can be wrong.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import join_frequent, staged

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Larger components would let the sum of squares of a vector leave 64 bits.
LARGEST = 1 << 26
#: Entries on each side of a point's norm that are compared before the interval is searched again, and points at a time.
STEP, CHUNK = 4, 4096


@dataclass(frozen=True)
class Annuli:
    """The entries of one part, sorted by norm."""

    entries: np.ndarray
    order: np.ndarray
    norms: np.ndarray

    @staticmethod
    def of(entries: np.ndarray) -> Annuli:
        norms = np.sqrt((entries * entries).sum(1).astype(np.float64))
        order = np.argsort(norms, kind="stable")
        return Annuli(entries[order], order, norms[order])

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each point's nearest entry (of equally near ones the lower index), and how many entries were compared.

        Entries are compared from the point's own norm outwards, a few at a time; each time the interval is searched again.
        """
        norms, n = np.sqrt((points * points).sum(1).astype(np.float64)), len(self.order)
        best, index = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), n)
        low = np.searchsorted(self.norms, norms)
        high, open_, compared = low.copy(), np.arange(len(points)), 0
        while len(open_):
            reach = np.sqrt(best[open_].astype(np.float64))
            slack = (norms[open_] + reach + 1) * 1e-9
            first = np.searchsorted(self.norms, norms[open_] - reach - slack, "left")
            end = np.searchsorted(self.norms, norms[open_] + reach + slack, "right")
            at = np.c_[low[open_][:, None] - 1 - np.arange(STEP), high[open_][:, None] + np.arange(STEP)]
            row, column = np.nonzero((at >= first[:, None]) & (at < end[:, None]))
            place = at[row, column]
            gap = points[open_[row]] - self.entries[place]
            far = np.full(at.shape, np.iinfo(np.int64).max)
            far[row, column] = (gap * gap).sum(1)
            name = np.full(at.shape, n)
            name[row, column] = self.order[place]
            least = far.min(1)
            its = np.where(far == least[:, None], name, n).min(1)
            old, held = best[open_], index[open_]
            index[open_] = np.where(least < old, its, np.where(least == old, np.minimum(its, held), held))
            best[open_] = np.minimum(least, old)
            low[open_], high[open_] = low[open_] - STEP, high[open_] + STEP
            compared += len(row)
            open_ = open_[(low[open_] > first) | (high[open_] < end)]
        return index, best, compared


def _assigned(values: np.ndarray, books: list[Annuli]) -> tuple[np.ndarray, np.ndarray]:
    """(n, dims) integers → for each row and part the entry's index and squared distance."""
    width = values.shape[1] // len(books)
    index, far = np.zeros((len(values), len(books)), np.int64), np.zeros((len(values), len(books)), np.int64)
    for at in range(0, len(values), CHUNK):
        for part, book in enumerate(books):
            index[at : at + CHUNK, part], far[at : at + CHUNK, part], _ = book.nearest(values[at : at + CHUNK, part * width : (part + 1) * width])
    return index, far


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def integers(name: str, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null for a vector that is null or has a component that is null or not finite."""
    whole = F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.col(name).isNotNull() & whole, F.transform(name, lambda x: F.floor(x.cast("double") * scale)))


def _first_books(kept: DataFrame, entries: int) -> np.ndarray:
    """The vectors of the least ids; an id's repeated rows in order of their components, a null id last."""
    rows = kept.select("vec_id", "values").orderBy(F.col("vec_id").asc_nulls_last(), "values").limit(entries).collect()
    return np.array([r["values"] for r in rows], np.int64)


def _moved(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """``books`` (part, entry, component) after each entry took the floor of the mean of its parts; tasks hand on sums."""
    parts, entries, width = books.shape
    held = [Annuli.of(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            values = _matrix(batch.column(0), parts * width)
            index, _ = _assigned(values, held)
            for part in range(parts):
                np.add.at(sums[part], index[:, part], values[:, part * width : (part + 1) * width])
                counts[part] += np.bincount(index[:, part], minlength=entries)
        used = np.argwhere(counts)
        yield pa.record_batch([pa.array(used[:, 0]), pa.array(used[:, 1]), pa.array(counts[counts > 0]), pa.array(list(sums[counts > 0]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    found = kept.select("values").mapInArrow(run, "part long, entry long, n long, sums array<long>")
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    books = books.copy()
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():
        books[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return books


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) of ``kept`` (vec_id, values): at most ``entries`` entries a part, as the driver holds them."""
    first = _first_books(kept, entries)
    if not len(first):
        return np.zeros((parts, 0, 0), np.int64)
    if first.shape[1] % parts:
        raise ValueError(f"vectors of {first.shape[1]} components can't be cut into {parts} equal parts")
    books = np.ascontiguousarray(first.reshape(len(first), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _moved(kept, books)
    return books


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """``kept`` with code (two hex digits for each part) and error (squared distances to the named entries, summed) in place of values."""
    parts, entries, width = books.shape
    held = [Annuli.of(b) for b in books] if entries else []
    others = [f for f in kept.schema if f.name != "values"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, far = _assigned(_matrix(batch.column("values"), parts * width), held)
            codes = [row.tobytes().hex() for row in index.astype(np.uint8)]
            yield pa.record_batch([*(batch.column(f.name) for f in others), pa.array(codes, pa.string()), pa.array(far.sum(1))], [*(f.name for f in others), "code", "error"])

    shape = kept.select(*[f.name for f in others]).schema.add("code", "string").add("error", "long")
    return kept.mapInArrow(run, shape)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Codes of vectors by codebooks that are fitted to all of them.

    Returns vec_id, code, error, label_error (errors summed over rows of an equal label), codebooks_sha256.

    * A row whose vector is null, or has a component that is null or not finite, has no row here.
    * Rows that repeat an id are rows of their own; a null id sorts last among those that start the codebooks.
    * Fewer vectors than entries give shorter codebooks; no vectors give an empty result.
    * Null labels are one label. Of equally near entries the lower index is taken.
    * Vectors of other lengths than the first, lengths that parts don't divide and components of 2**26 / 256 or more in
      size raise an error. At most 256 entries, so that two digits name one.
    * Other columns are not looked at, whatever their names.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits for each part: at most 256 entries")
    whole = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), integers(vector_col).alias("values")).where("values IS NOT NULL")
    kept = staged(whole.withColumn("label_key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))).drop("label"), "vector-integers")
    lengths = kept.agg(F.min(F.size("values")).alias("least"), F.max(F.size("values")).alias("most"), F.max(F.array_max(F.transform("values", F.abs))).alias("largest")).first()
    if lengths["least"] != lengths["most"]:
        raise ValueError(f"vectors have from {lengths['least']} to {lengths['most']} components")
    if (lengths["largest"] or 0) >= LARGEST:
        raise ValueError("a component is too large to be compared in 64 bits")
    books = train(kept, parts, entries, rounds)
    coded = staged(encode(kept, books), "codes")
    by_label = staged(coded.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n_rows")), "label-errors")
    total = by_label.agg(F.sum("n_rows")).first()[0] or 0
    out = join_frequent(coded, by_label, ["label_key"], "n_rows", total)
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
