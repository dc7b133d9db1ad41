"""Retrieval: exact dense and sparse legs, reciprocal rank fusion, reranking, ranking metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import lake

RRF_K = 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank from 1; ties by document."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Numbers of a block of queries, documents of a piece, and scores of a batch that a task holds at most, about.
BLOCK_NUMBERS, PIECE_DOCS, BATCH_SCORES = 1 << 20, 1 << 16, 1 << 22


def dense(queries: DataFrame, docs: DataFrame, k: int = 100, max_queries: int = 512, allowed: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Cosine search: (query_id, embedding, ...) against all (doc_id, embedding, ...).

    ``allowed`` makes a condition from the struct of a query's other columns and that of a document's; it holds before
    anything is ranked, so a query gets its k best among the documents that it may see.

    Where ids are integers and ``allowed`` is missing or :class:`Filters`, pieces of the documents meet blocks of queries,
    and a task scores the one against the other by matrix products and hands on k of each query. Rows without an id, and
    vectors that are null, of another length or hold what isn't finite, are scored pair by pair, as everything is with
    any other ``allowed``.
    """
    ids = {queries.schema["query_id"].dataType.typeName(), docs.schema["doc_id"].dataType.typeName()}
    filters = allowed if isinstance(allowed, Filters) and allowed.fit(queries, docs) else None
    if (allowed and not filters) or not ids <= {"integer", "long"}:
        return _dense_pairs(queries, docs, k, max_queries, allowed)
    given, had = filters.columns() if filters else ([], [])
    asked, held = queries.select(F.col("query_id").cast("long"), "embedding", *given), docs.select(F.col("doc_id").cast("long"), "embedding", *had)
    seen = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    width = max(1, seen["width"] or 0)
    plain = lambda c: F.coalesce(F.col(c).isNotNull() & (F.size("embedding") == width) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    odd_asked, odd_held = asked.where(~plain("query_id")), held.where(~plain("doc_id"))
    n, odd = held.agg(F.count("*"), F.count_if(~plain("doc_id"))).first()
    blocks = max(1, -(-seen["n"] * width // BLOCK_NUMBERS))
    pieces = max(1, -(-n // PIECE_DOCS), min(held.sparkSession.sparkContext.defaultParallelism, n // 1024))
    dealt = lambda df, c, more, own, mine, other, many: df.where(plain(c)).select(F.col(c).alias("id"), "embedding", *more, F.pmod(F.xxhash64(c), F.lit(mine)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))).alias(other)).groupBy("piece", "block")
    met = dealt(held, "doc_id", had, "piece", pieces, "block", blocks).cogroup(dealt(asked, "query_id", given, "block", blocks, "piece", pieces))
    out = met.applyInArrow(lambda d, q: _k_best(d, q, k, filters), "query_id long, doc_id long, score double")
    if odd:
        out = out.unionByName(_dense_pairs(asked, odd_held, k, max_queries, filters).drop("rank"))
    if not odd_asked.isEmpty():
        out = out.unionByName(_dense_pairs(odd_asked, held.where(plain("doc_id")), k, max_queries, filters).drop("rank"))
    return best(out, k)


@dataclass(frozen=True)
class Filters:
    """What a query may see, for :func:`dense`: (the query's column, the document's column, how they must meet).

    ``most``: the document's value is at most the query's; ``least``: at least; ``among``: the query's array holds it;
    ``share``: both arrays hold a value. A filter that is null lets everything pass; what the document lacks (null)
    passes no filter.
    """

    parts: tuple[tuple[str, str, str], ...]

    def __call__(self, query: Column, doc: Column) -> Column:
        meets = {
            "most": lambda q, d: d <= q,
            "least": lambda q, d: d >= q,
            "among": lambda q, d: F.array_contains(q, d),
            "share": lambda q, d: F.arrays_overlap(d, q),
        }
        return reduce(and_, (query[q].isNull() | F.coalesce(meets[how](query[q], doc[d]), F.lit(False)) for q, d, how in self.parts))

    def columns(self) -> tuple[list[str], list[str]]:
        """The queries' columns and those of the documents, each once."""
        return list(dict.fromkeys(q for q, _, _ in self.parts)), list(dict.fromkeys(d for _, d, _ in self.parts))

    def fit(self, queries: DataFrame, docs: DataFrame) -> bool:
        """Whether :meth:`prepared` knows the types: what is compared must be of one type, and order or equality the same in numpy."""
        ordered = (T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.DateType(), T.TimestampType(), T.TimestampNTZType())
        for ask, has, how in self.parts:
            q, d = queries.schema[ask].dataType, docs.schema[has].dataType
            if how in ("most", "least"):
                fits = q == d and d in ordered
            else:
                item = d if how == "among" else getattr(d, "elementType", None)
                fits = getattr(q, "elementType", None) == item and item in (T.StringType(), T.IntegerType(), T.LongType())
            if not fits:
                return False
        return True

    def prepared(self, docs: pa.Table, queries: pa.Table) -> Callable[[int, int], np.ndarray]:
        """A function that tells for the documents from a row to another which queries (columns) may see them."""
        tests = [(_in_order if how in ("most", "least") else _in_common)(docs[d].combine_chunks(), queries[q].combine_chunks(), how) for q, d, how in self.parts]
        return lambda at, to: reduce(np.logical_and, (test(at, to) for test in tests))


def _in_order(docs: pa.Array, queries: pa.Array, how: str) -> Callable[[int, int], np.ndarray]:
    (d, lacks), (q, free) = _numbers(docs), _numbers(queries)

    def test(at: int, to: int) -> np.ndarray:
        x = d[at:to, None]
        ok = x <= q if how == "most" else x >= q
        if d.dtype.kind == "f":
            ok |= np.isnan(q if how == "most" else x)  # NaN is above all numbers
        return ok & ~lacks[at:to, None] | free

    return test


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in the order of a column's values, and where it is null."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    if not pa.types.is_floating(column.type):
        column = column.cast(pa.int32() if pa.types.is_date(column.type) else pa.int64())
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False), null


def _in_common(docs: pa.Array, queries: pa.Array, how: str) -> Callable[[int, int], np.ndarray]:
    (rows, values), (asking, wanted), free = _items(docs), _items(queries), queries.is_null().to_numpy(zero_copy_only=False)
    codes = pa.concat_arrays([values, wanted]).dictionary_encode().indices.to_numpy()
    codes, wanted = codes[: len(rows)], codes[len(rows) :]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)

    def test(at: int, to: int) -> np.ndarray:
        ok = np.repeat(free[None, :], to - at, axis=0)
        low, high = np.searchsorted(rows, (at, to))
        for nth in range(place[low:high].max(initial=-1) + 1):  # a document's nth value, so that a table has a row per document at most
            here = low + np.flatnonzero(place[low:high] == nth)
            known, which = np.unique(codes[here], return_inverse=True)
            at_known = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            hit = known[at_known] == wanted
            holds = np.zeros((len(known), len(free)), bool)
            holds[at_known[hit], asking[hit]] = True
            ok[rows[here] - at] |= holds[which]
        return ok

    return test


def _items(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Rows, ascending, and values of a column or of its arrays, without nulls."""
    nested = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
    rows = pc.list_parent_indices(column).to_numpy() if nested else np.arange(len(column))
    values = pc.list_flatten(column) if nested else column
    there = values.is_valid()
    return rows[there.to_numpy(zero_copy_only=False)], values.filter(there)


def _units(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their unit vectors; sums run from the first number to the last, as those of :func:`dot` do."""
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    v = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)[order]
    size = np.sqrt(_dots(v, v))[:, None]
    return ids[order], np.divide(v, size, out=v, where=size > 0)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _millionths(x: np.ndarray) -> np.ndarray:
    """Numbers of up to 1 or so rounded to six digits as F.round does, half up by the shortest decimal form, as whole millionths."""
    scaled = np.abs(x) * 1e6
    out = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6).tolist():
        out[i] = float((Decimal(repr(float(abs(x[i])))) * 1_000_000).to_integral_value(ROUND_HALF_UP))
    return np.copysign(out, x).astype(np.int64)


def _k_best(docs: pa.Table, queries: pa.Table, k: int, filters: Filters | None = None) -> pa.Table:
    """The k best documents of a piece that each query of a block may see, by rounded score, then by id.

    Documents come in ascending order of id, so one must beat a query's k-th score by a millionth to enter. The matrix
    product only tells which pairs may; those are scored again number by number.
    """
    if not docs.num_rows or not queries.num_rows:
        return pa.table({"query_id": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    (ids, v), (asked, q) = _units(docs), _units(queries)
    by_id = lambda t: t.drop_columns(["embedding"]).take(np.argsort(t.column("id").to_numpy(), kind="stable"))
    may = filters.prepared(by_id(docs), by_id(queries)) if filters else None
    least = np.full(len(q), -np.inf)
    best_q, best_d, best_m = (np.zeros(0, np.int64) for _ in range(3))
    found, waiting = [], 0
    step = max(1, BATCH_SCORES // len(q))
    for at in range(0, len(v), step):
        close = v[at : at + step] @ q.T
        seen = may(at, at + len(close)) if may else None
        if may:
            close[~seen] = -np.inf
        if not at and len(close) > k:
            least = np.partition(close, -k, axis=0)[-k] - 2e-6
        near = close >= least
        d, n = np.nonzero(near & seen if may else near)
        for part in range(0, len(d), 1 << 17):
            dd, nn = d[part : part + (1 << 17)] + at, n[part : part + (1 << 17)]
            found.append((nn, dd, _millionths(_dots(q[nn], v[dd]))))
        waiting += len(d)
        if waiting and (waiting >= len(q) * k or not at or at + step >= len(v)):
            best_q, best_d, best_m = (np.concatenate(x) for x in zip((best_q, best_d, best_m), *found, strict=True))
            order = np.lexsort((best_d, -best_m, best_q))
            best_q, best_d, best_m = best_q[order], best_d[order], best_m[order]
            place = np.arange(len(best_q)) - np.searchsorted(best_q, best_q)
            last = place == k - 1
            least = np.full(len(q), -np.inf)
            least[best_q[last]] = (best_m[last] + 0.5) / 1e6 - 1e-9
            best_q, best_d, best_m = (x[place < k] for x in (best_q, best_d, best_m))
            found, waiting = [], 0
    return pa.table({"query_id": asked[best_q], "doc_id": ids[best_d], "score": best_m / 1e6})


def _dense_pairs(queries: DataFrame, docs: DataFrame, k: int, max_queries: int, allowed: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """:func:`dense` pair by pair.

    Queries go out in blocks of ``max_queries`` held as literals' worth of data, so that no block grows with the input;
    each task keeps its k best per query before anything is shuffled.
    """
    of = lambda df: F.struct(*(c for c in df.columns if c != "embedding")) if allowed else F.lit(None)
    rows = queries.select("query_id", unit(F.col("embedding")).alias("qv"), of(queries).alias("asks"))
    n = rows.count()
    numbered = rows.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // max_queries)))))
    units = docs.select("doc_id", unit(F.col("embedding")).alias("v"), of(docs).alias("has"))
    out = None
    for b in range(max(1, -(-n // max_queries))):
        held = numbered.where(F.col("block") == b).agg(F.collect_list(F.struct("query_id", "qv", "asks")).alias("qs"))
        met = units.join(F.broadcast(held), F.lit(True))  # one row of max_queries
        asking = F.filter("qs", lambda q: allowed(q["asks"], F.col("has"))) if allowed else F.col("qs")
        pairs = met.select("doc_id", "v", F.explode(asking).alias("q"))
        part = best(pairs.select(F.col("q.query_id").alias("query_id"), "doc_id", F.round(dot(F.col("q.qv"), F.col("v")), 6).alias("score")), k)
        out = part if out is None else out.unionByName(part)
    return out


#: The filters of a search for events: known by ``as_of``, of ``types``, about one of ``symbols``, of ``least`` importance.
may_see = Filters((("as_of", "available_at", "most"), ("types", "event_type", "among"), ("symbols", "symbols", "share"), ("least", "importance_score", "least")))


def sparse(queries: DataFrame, docs: DataFrame, k: int = 100) -> DataFrame:
    """Dot product of token weights: (query_id, weights) against (doc_id, weights), maps from token to weight."""
    q = queries.select("query_id", F.explode("weights").alias("token", "qw"))
    d = docs.select("doc_id", F.explode("weights").alias("token", "dw"))
    hits = d.join(q, "token").groupBy("query_id", "doc_id").agg(F.round(F.sum((F.col("qw") * F.col("dw")).cast("decimal(28,8)")).cast("double"), 6).alias("score"))
    return best(hits, k)


#: Documents that a block of the sparse index holds, about; and blocks that a query scores to learn what its k-th best must reach.
BLOCK_DOCS = 1024
SEED_BLOCKS = 4
_SALTS = 32


#: Rows that are sent to every task at most, whatever the input's size.
FEW_ROWS = 100_000
#: Documents whose words a task holds at once, about.
STEP_DOCS = 1024


def _few(df: DataFrame) -> bool:
    return df.limit(FEW_ROWS + 1).count() <= FEW_ROWS


def counted(docs: DataFrame, shortest: int) -> DataFrame:
    """(doc_id, text) → (doc_id, weights): how often each word occurs, counted within the row; rows without words are left out.

    Words are the runs of a to z, of ``shortest`` letters at least; the text comes in lower case.
    """
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: (_counts(b.slice(at, STEP_DOCS), shortest) for b in batches for at in range(0, b.num_rows, STEP_DOCS)), f"doc_id {doc_id}, weights map<string,double>")


def _counts(batch: pa.RecordBatch, shortest: int) -> pa.RecordBatch:
    texts = batch.column("text").fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    letters = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    letter = np.zeros(len(letters) + len(texts) + 1, bool)  # a gap before every text and after the last
    shift = np.repeat(np.arange(1, len(texts) + 1), np.diff(ends))
    letter[np.arange(len(letters)) + shift] = (letters >= 97) & (letters <= 122)
    edges = np.flatnonzero(np.diff(letter, prepend=False))
    starts, stops = edges[::2], edges[1::2]
    keep = stops - starts >= shortest
    starts, stops = starts[keep], stops[keep]
    row = np.searchsorted(ends + np.arange(len(ends)), starts) - 1
    sizes = stops - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    chars = letters[np.repeat(starts - row - 1 - offsets[:-1], sizes) + np.arange(offsets[-1])]
    words = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(chars))]).dictionary_encode()
    width = max(1, len(words.dictionary))
    pairs, times = np.unique(row * width + words.indices.to_numpy(), return_counts=True)
    first = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * width)
    maps = pa.MapArray.from_arrays(pa.array(first, pa.int32()), words.dictionary.take(pa.array(pairs % width)).cast(pa.string()), pa.array(times, pa.float64()))
    return pa.record_batch({"doc_id": batch.column("doc_id"), "weights": maps}).filter(pa.array(np.diff(first) > 0))


def headed(docs: DataFrame) -> DataFrame:
    """(doc_id, weights) with the heaviest token of each document that has weights."""
    entries = F.transform(F.map_entries("weights"), lambda e: F.struct(e["value"].alias("weight"), e["key"].alias("token")))
    return docs.where(F.size("weights") > 0).select("doc_id", "weights", F.array_max(entries)["token"].alias("head"))


def sparse_postings(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """:func:`headed` documents → (block, token, doc_id, weight, high, low): postings in blocks of documents that share their heaviest token.

    Documents alike in what weighs most give blocks whose bounds are tight. A token that heads very many documents has
    its documents dealt over as many blocks as they fill, so no block and no key grows with the corpus. Documents without
    weights have no postings. ``doc_id`` is unique.

    A document is shuffled once, as a row, to where its block is. The postings of a block follow each other by token, and
    the first of a token holds the highest and the lowest weight of the token in the block; the others have nulls there.
    """
    sizes = docs.groupBy("head").agg(F.ceil(F.count("*") / block_docs).alias("pieces")).where("pieces > 1")  # the others fill one block
    if _few(sizes):
        dealt = docs.join(F.broadcast(sizes), "head", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long")))
        dealt = docs.withColumn("salt", F.pmod(F.xxhash64("doc_id", "head"), F.lit(_SALTS))).join(sizes.withColumn("salt", salts), ["head", "salt"], "left")
    piece = F.pmod(F.xxhash64("doc_id"), F.coalesce("pieces", F.lit(1).cast("long")))
    placed = dealt.select(F.xxhash64("head", piece).alias("block"), "doc_id", "weights")
    return placed.repartition("block").sortWithinPartitions("block").mapInArrow(_whole_blocks, f"block long, token string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, weight double, high double, low double")


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of documents in order of their blocks, some whole blocks at a time."""
    left = None
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_DOCS):
            docs = pa.Table.from_batches([batch.slice(at, STEP_DOCS)])
            docs = pa.concat_tables([left, docs]).combine_chunks() if left else docs
            block = docs.column("block").to_numpy()
            cut = int(np.searchsorted(block, block[-1]))
            if cut:
                yield from _postings(docs.slice(0, cut)).to_batches()
            left = docs.slice(cut)
    if left:
        yield from _postings(left).to_batches()


def _postings(docs: pa.Table) -> pa.Table:
    weights = docs.column("weights").combine_chunks()
    ends = weights.offsets.to_numpy()
    tokens, weight = (x.slice(ends[0], ends[-1] - ends[0]) for x in (weights.keys, weights.items))
    tokens = tokens.dictionary_encode()
    place = np.empty(len(tokens.dictionary), np.int64)
    place[pc.array_sort_indices(tokens.dictionary).to_numpy()] = np.arange(len(place))
    owner = np.repeat(np.arange(docs.num_rows), np.diff(ends))
    blocks, of_doc = np.unique(docs.column("block").to_numpy(), return_inverse=True)
    at = of_doc[owner] * len(place) + place[tokens.indices.to_numpy()]
    order = np.argsort(at, kind="stable")
    first = np.diff(at[order], prepend=-1) > 0
    sizes = pc.fill_null(weight, 0.0).to_numpy(zero_copy_only=False)[order]  # what is null adds nothing, as 0

    def bound(of: np.ufunc) -> pa.Array:
        out = np.zeros(len(order))
        out[first] = of.reduceat(sizes, np.flatnonzero(first))
        return pa.array(out, mask=~first)

    in_order, owners = pa.array(order), owner[order]
    return pa.table({
        "block": blocks[of_doc[owners]], "token": tokens.dictionary.take(tokens.indices.take(in_order)), "doc_id": docs.column("doc_id").take(pa.array(owners)),
        "weight": weight.take(in_order), "high": bound(np.maximum), "low": bound(np.minimum),
    })


def write_sparse_index(docs: DataFrame, folder: str, block_docs: int = BLOCK_DOCS) -> None:
    """Postings, those of a block by token, and the bounds of each token in each block (high and low weight), as two Parquet tables of a new folder.

    Documents with their heads are stored while the index is made, for their heads are counted before they are dealt.
    """
    spark = docs.sparkSession
    headed(docs).write.parquet(f"{folder}/headed")
    sparse_postings(spark.read.parquet(f"{folder}/headed"), block_docs).write.parquet(f"{folder}/postings")
    spark.read.parquet(f"{folder}/postings").where("high IS NOT NULL").select("block", "token", "high", "low").write.parquet(f"{folder}/bounds")
    lake.delete(spark, f"{folder}/headed")


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode("weights").alias("token", "qw"))


def block_bounds(queries: DataFrame, bounds: DataFrame) -> DataFrame:
    """(query_id, block, most): what no document of a block can exceed; a token that a document lacks adds nothing."""
    most = F.greatest(F.col("qw") * F.col("high"), F.col("qw") * F.col("low"), F.lit(0.0))
    asked = _asked(queries)
    return bounds.join(F.broadcast(asked) if _few(asked) else asked, "token").groupBy("query_id", "block").agg(F.sum(most).alias("most"))


def _block_scores(queries: DataFrame, postings: DataFrame, blocks: DataFrame, few: bool = False) -> DataFrame:
    """Scores of the documents of the blocks that each query asks for (query_id, block); ``few`` blocks are broadcast.

    Postings of tokens that nobody asks for are left out first; the rest goes to where its block is, so that a document's
    sum is made there; where ``few`` blocks are broadcast, sums are shuffled instead. Queries are told apart by a hash within a
    block's list: of two with the same one, a block is scored for both, which changes nothing.
    """
    asked = _asked(queries)
    sent = F.broadcast if _few(asked) else lambda df: df
    wanted = blocks.groupBy("block").agg(F.collect_set(F.xxhash64("query_id")).alias("wanted"))
    held = postings.select("block", "token", "doc_id", "weight").join(sent(asked.select("token").distinct()), "token", "left_semi")
    met = held.join(F.broadcast(wanted) if few else wanted, "block").join(sent(asked), "token").where(F.array_contains("wanted", F.xxhash64("query_id")))
    score = F.sum((F.col("qw") * F.col("weight")).cast("decimal(28,8)")).cast("double")
    return met.groupBy("block", "query_id", "doc_id").agg(F.round(score, 6).alias("score")).drop("block")


def blocks_to_score(queries: DataFrame, postings: DataFrame, bounds: DataFrame, k: int) -> DataFrame:
    """(query_id, block): the blocks that may hold one of the query's k best.

    The blocks with the greatest bounds are scored first; what their k-th document reaches, all of the k best reach. A
    query that finds fewer than k there goes through all its blocks, so nothing is ever lost.
    """
    few = queries.limit(FEW_ROWS // SEED_BLOCKS + 1).count() <= FEW_ROWS // SEED_BLOCKS
    upper = block_bounds(queries, bounds)
    w = Window.partitionBy("query_id").orderBy(F.desc("most"), "block")
    seeds = upper.withColumn("n", F.row_number().over(w)).where(F.col("n") <= SEED_BLOCKS)
    floor = best(_block_scores(queries, postings, seeds, few), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    slack = F.lit(1e-5) * (1 + F.abs("floor"))  # scores are rounded, bounds are not
    return upper.join(F.broadcast(floor) if few else floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("most") + slack >= F.col("floor"))).select("query_id", "block")


def sparse_by_blocks(queries: DataFrame, postings: DataFrame, bounds: DataFrame, k: int = 100) -> DataFrame:
    """What :func:`sparse` returns, from a stored index: only postings of blocks that may enter a query's k best are scored."""
    return best(_block_scores(queries, postings, blocks_to_score(queries, postings, bounds, k)), k)


def fused(*legs: DataFrame, k: int = 50) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (60 + rank) over the legs."""
    both = legs[0].select("query_id", "doc_id", "rank")
    for leg in legs[1:]:
        both = both.unionByName(leg.select("query_id", "doc_id", "rank"))
    return best(both.groupBy("query_id", "doc_id").agg(F.round(F.sum((F.lit(1.0) / (RRF_K + F.col("rank"))).cast("decimal(20,12)")).cast("double"), 10).alias("score")), k)


def reranked(hits: DataFrame, scorer: Column, first: int = 50) -> DataFrame:
    """The first hits of each query in the order of a scorer, the others after them as they were; where the scorer is null the old order stays."""
    fallback = F.max(scorer.isNull() & (F.col("rank") <= first)).over(Window.partitionBy("query_id"))
    w = Window.partitionBy("query_id").orderBy(F.when(F.col("rank") <= first, 0).otherwise(1), F.when(~F.col("fell") & (F.col("rank") <= first), F.col("s")).desc_nulls_last(), "rank")
    return hits.withColumn("s", scorer).withColumn("fell", fallback).withColumn("rank", F.row_number().over(w)).drop("s").withColumnRenamed("fell", "fell_back")


def ranking_metrics(ranked: DataFrame, judged: DataFrame, k: int = 10, threshold: int = 1) -> DataFrame:
    """Per query: ndcg, mrr, recall at k, from (query_id, doc_id, rank) and grades (query_id, doc_id, grade).

    The ideal order is of all grades; a query without a relevant document has 0 everywhere.
    """
    return graded_metrics(ranked.join(judged, ["query_id", "doc_id"]), judged.groupBy("query_id", "grade").agg(F.count("*").alias("n")), k, threshold)


def graded_metrics(graded: DataFrame, counts: DataFrame, k: int = 10, threshold: int = 1) -> DataFrame:
    """:func:`ranking_metrics` from hits with their grades (query_id, rank, grade) and how many grades of each kind a query has (query_id, grade, n).

    Only counts are sorted, so that no task holds all grades of a query.
    """
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    places = F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("n"), F.lit(k).cast("long")))
    discount = F.when((F.col("before") < k) & (F.col("n") > 0), F.aggregate(places, F.lit(0.0), lambda s, p: s + 1 / F.log2(p + 1.0)))
    kinds = counts.groupBy("query_id", "grade").agg(F.sum("n").alias("n")).withColumn("before", before)
    ideal = kinds.groupBy("query_id").agg(F.sum(gain * discount).alias("idcg"), F.sum(F.when(F.col("grade") >= threshold, F.col("n")).otherwise(0)).alias("relevant"))
    met = graded.where(F.col("rank") <= k)
    got = met.groupBy("query_id").agg(F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.min(F.when(F.col("grade") >= threshold, F.col("rank"))).alias("first"), F.count_if(F.col("grade") >= threshold).alias("hits"))
    both = ideal.join(got, "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return both.select("query_id", zero(F.col("dcg") / F.nullif(F.col("idcg"), F.lit(0.0))).alias("ndcg"), zero(1.0 / F.col("first")).alias("mrr"), zero(F.col("hits") / F.nullif(F.col("relevant"), F.lit(0))).alias("recall"))


def late_evidence(evidence: DataFrame, as_of) -> DataFrame:
    """Evidence that wasn't known at ``as_of``."""
    return evidence.where(F.col("available_at") > F.lit(as_of).cast("timestamp_ntz"))


def length_batches(docs: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """Documents in order of length, ``size`` to a batch, so that a batch needs little padding: key, place, batch.

    Lengths are counted first; a document's place is that of its length's first one plus its rank among equals, so no task sorts all rows.
    """
    sized = docs.select(key, F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"))
    before = sized.groupBy("n").agg(F.count("*").alias("c")).select("n", F.coalesce(F.sum("c").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row per length
    ranked = sized.withColumn("rn", F.row_number().over(Window.partitionBy("n").orderBy(key)) - 1).join(before, "n")
    return ranked.select(key, (F.col("before") + F.col("rn")).alias("place"), F.floor((F.col("before") + F.col("rn")) / size).alias("batch"))
