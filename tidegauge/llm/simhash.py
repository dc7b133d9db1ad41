"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most 2r bits exactly when some value lies within r bits of both. So every
fingerprint emits all values within half the radius, equal values meet, and those that meet are linked.

The variants are shuffled by their low bits: a fingerprint is sent once to each slice that any of its variants falls
in, and the task that holds the slice lists the variants there. So the network carries 1 + k + k(k-1)/2 numbers a
fingerprint instead of all 2,081 variants, and every variant still exists in exactly one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .tables import numbered, staged, text_or_empty

BITS = 64
#: Variants that a slice holds on average, and at most before a task lists it part by part.
SLICE_VARIANTS, PART_VARIANTS = 1 << 22, 1 << 23
CHUNK = 1 << 16


def fingerprint(body: bytes, words: int = 4) -> int:
    """SimHash of the XXH64 (seed 42) of all runs of ``words`` words; a bit is set if it is in over half of them."""
    tokens = body.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: max(1, len(tokens) - words + 1)], ends[min(words, len(tokens)) - 1 :]
    hash_of, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        hashes = np.array([hash_of(joined[x:y], 42) for x, y in spans], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp) for every row; fp holds the 64 bits as a signed long. No words, or null: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("body")).mapInArrow(run, "doc_id long, fp long")


def _masks(bits: range, most: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for n in range(most + 1) for c in combinations(bits, n)], np.uint64)


def _local_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least member of each of 0..n-1's component under edges u-v."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        was = root.copy()
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        np.minimum.at(root, was[u], low)
        np.minimum.at(root, was[v], low)
        root = root[root]
        if np.array_equal(root, was):
            return root


def _meetings(fps: np.ndarray, ids: np.ndarray, slice_: int, k: int, half: int, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions that share a variant whose low k of ``bits`` bits are ``slice_``: each with the first of its variant."""
    low = np.uint64((1 << k) - 1)
    flips = (fps ^ np.uint64(slice_)) & low
    used = np.bitwise_count(flips)
    sizes = [sum(math.comb(bits - k, n) for n in range(half - j + 1)) for j in range(half + 1)]
    count = [int((used == j).sum()) for j in range(half + 1)]
    if sum(count) < 2:
        return
    if sum(c * s for c, s in zip(count, sizes, strict=True)) > PART_VARIANTS and k < bits - 4:
        for more in range(16):
            part = slice_ | more << k
            near = np.bitwise_count((fps ^ np.uint64(part)) & np.uint64((1 << k + 4) - 1)) <= half
            yield from _meetings(fps[near], ids[near], part, k + 4, half, bits)
        return
    values, owners = [], []
    for j in range(half + 1):
        mine = np.flatnonzero(used == j)
        masks = _masks(range(k, bits), half - j)
        values.append(((fps[mine] ^ flips[mine])[:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(ids[mine], len(masks)))
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(value)
    value, owner = value[order], owner[order]
    starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    sizes_ = np.diff(np.r_[starts, len(value)])
    first = np.repeat(np.minimum.reduceat(owner, starts), sizes_)
    met = owner != first
    if met.any():
        pairs = np.unique(owner[met].astype(np.int64) << 32 | first[met])
        yield pairs >> 32, pairs & 0xFFFFFFFF


def slice_links(fps: np.ndarray, slice_: int, k: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links that the variants of one slice show: (fingerprint, its tree's root)."""
    u, v = [], []
    for a, b in _meetings(fps, np.arange(len(fps), dtype=np.int64), slice_, k, half):
        verified = np.bitwise_count(fps[a] ^ fps[b]) <= 2 * half
        u.append(a[verified])
        v.append(b[verified])
    if not u:
        return fps[:0], fps[:0]
    root = _local_roots(len(fps), np.concatenate(u), np.concatenate(v))
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked], fps[root[linked]]


def slice_bits(n: int, half: int) -> int:
    """Low bits that name a slice: 8, or as many as keep a slice at SLICE_VARIANTS on average."""
    ball = sum(math.comb(BITS, j) for j in range(half + 1))
    return min(32, max(8, math.ceil(math.log2(max(1, n * ball / SLICE_VARIANTS)))))


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of the distinct longs ``fp`` at most ``radius`` (even) bits apart."""
    if radius % 2:
        raise ValueError("radius must be even: two balls of half the radius meet in the middle")
    half = radius // 2
    k = slice_bits(fps.count(), half)
    low = (1 << k) - 1
    masks = F.array(*[F.lit(int(m)) for m in _masks(range(k), half)])

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        values = group.column("fp").to_numpy().view(np.uint64)
        a, b = slice_links(np.sort(values), key[0].as_py(), k, half)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    sent = fps.select("fp", F.explode(masks).alias("mask")).select((F.col("fp").bitwiseAND(low)).bitwiseXOR(F.col("mask")).alias("slice"), "fp")
    return sent.groupBy("slice").applyInArrow(run, "a long, b long").distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """Components of documents whose fingerprints are linked at ``radius`` or fewer differing bits.

    Returns a row per input row: doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable).

    * Null, empty and blank texts have fingerprint zero, which links like any other.
    * Equal fingerprints are one node, however many rows share it: links are between distinct values.
    * A null id stays null; it never is a component's name unless no row of the component has an id.
    * Rows that repeat get the same result; other columns, whatever their names, and empty tables do no harm.
    """
    rows = staged(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    roots = connected_components(near_links(distinct.select("fp"), radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that with the least id, a null id last.

    Rows count, not ids: rows that repeat an id are documents of their own.
    """
    rows, row = numbered(docs, "simhash-rows")
    known = near_components(rows, row, text_col, words, radius).select(F.col("doc_id").alias(row), "component_id").join(rows.select(row, F.col(id_col).cast("long").alias("id")), row)
    best = known.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", row)).alias("m")).select(F.col(f"m.{row}").alias(row))
    return rows.join(best, row, "left_semi").select(*docs.columns)
