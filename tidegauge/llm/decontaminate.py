"""Benchmark decontamination with a distributed positional inverted index.

Documents are indexed in blocks of about a million words. A block's row holds the sorted positions of every word in it:
the index is of the training text alone, is stored once and serves any benchmark. A test phrase waits under its rarest
word. A block looks up its own words among those and tries only the phrases that wait there: it starts from the
posting list of the rarest word, moved back by the word's offset, and intersects it with the moved lists of the next
rarest ones until it is empty or a match.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import numbered, staged, text_or_empty

WINDOW = 10
BLOCK_WORDS = 1 << 20
#: Bytes of test texts that a task holds at once; more are searched for in as many passes over the stored index.
PASS_BYTES = 16 << 20

#: Lower-cases A-Z and blanks the ASCII characters that are neither letters nor digits.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_INDEX = "row_id array<long>, doc_id array<long>, n_words array<int>, term array<binary>, n array<int>, positions binary"


def words_of(body: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return body.translate(_FOLD).split()


def build_index(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per block of the documents (row_id, doc_id, body): their numbers, ids and word counts, and the postings of all words.

    Positions count from the block's start; after each document one position stays free, so no phrase runs on into the next.
    A block ends with a document, so one document of any length is in one block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nos, ids, sizes, codes, total, terms = [], [], [], [], 0, {}
        gap = np.array([-1], np.int32)

        def block() -> pa.RecordBatch:
            code = np.concatenate(codes)
            at = np.flatnonzero(code >= 0)
            order = at[np.argsort(code[at], kind="stable")]
            n = np.bincount(code[at], minlength=len(terms))
            row = [[nos], [ids], [sizes], [list(terms)], [n], [order.astype(np.uint32).tobytes()]]
            types = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]
            return pa.record_batch([pa.array(x, t) for x, t in zip(row, types, strict=True)], ["row_id", "doc_id", "n_words", "term", "n", "positions"])

        for batch in batches:
            for no, doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = words_of(body.as_py())
                nos.append(no)
                ids.append(doc_id)
                sizes.append(len(words))
                for w in set(words):
                    terms.setdefault(w, len(terms))
                codes.append(np.fromiter(map(terms.__getitem__, words), np.int32, len(words)))
                codes.append(gap)
                total += len(words) + 1
                if total >= block_words:
                    yield block()
                    nos, ids, sizes, codes, total, terms = [], [], [], [], 0, {}
        if ids:
            yield block()

    return docs.select("row_id", "doc_id", "body").mapInArrow(run, _INDEX)


def _contains(sorted_list: np.ndarray, values: np.ndarray, slop: int) -> np.ndarray:
    """Which values have a member of the list within ``slop``."""
    at = np.searchsorted(sorted_list, values - slop)
    return (at < len(sorted_list)) & (sorted_list[np.minimum(at, len(sorted_list) - 1)] <= values + slop)


def phrase_starts(postings: dict[int, np.ndarray], phrase: np.ndarray, rarest: np.ndarray, slop: int = 0) -> np.ndarray:
    """Start positions of a phrase, found from its rarest terms on; with slop, each term may be that far from its place."""
    start = None
    for offset in rarest.tolist():
        held = postings.get(int(phrase[offset]))
        if held is None:
            return np.empty(0, np.int64)
        start = held - offset if start is None else start[_contains(held, start + offset, slop)]
        if not len(start):
            return start
    return start


@dataclass(frozen=True)
class Tests:
    """Test items as numbers of words, and their windows in order of the rarest word of each."""

    items: list[str]
    terms: dict[bytes, int]
    words: np.ndarray  # of all items, one after another
    total: np.ndarray  # occurrences of each term in the training text
    rare: np.ndarray  # rarest term of each window, in order
    item: np.ndarray
    start: np.ndarray  # in ``words``
    size: np.ndarray

    def waiting(self, term: int) -> range:
        return range(int(np.searchsorted(self.rare, term)), int(np.searchsorted(self.rare, term, side="right")))


def _prepared(items: list[tuple[str, bytes]], total_of, window: int) -> Tests:
    terms: dict[bytes, int] = {}
    runs = [[terms.setdefault(w, len(terms)) for w in words_of(body)] for _, body in items]
    known = total_of(terms)
    total = np.array([known.get(w, 0) for w in terms], np.int64)
    words = np.array([t for r in runs for t in r], np.int64)
    found, base = [], 0
    for i, r in enumerate(runs):
        size = min(window, len(r))
        if size:
            w = np.lib.stride_tricks.sliding_window_view(words[base : base + len(r)], size)
            rare = w[np.arange(len(w)), total[w].argmin(1)]
            there = total[w].min(1) > 0
            found.append(np.stack([rare, np.full(len(w), i), base + np.arange(len(w)), np.full(len(w), size)])[:, there])
        base += len(r)
    table = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    return Tests([i for i, _ in items], terms, words, total, *table[:, np.argsort(table[0], kind="stable")])


def _matches(index: DataFrame, tests: Tests, slop: int) -> DataFrame:
    """A row per document: row_id, doc_id, n_words, the hit spans and the ids of the items that match."""
    spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    shape = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", spans), ("items", pa.list_(pa.string()))])
    shared = index.sparkSession.sparkContext.broadcast(tests)

    def stretches(hit: np.ndarray) -> list[dict]:
        edge = np.flatnonzero(np.diff(np.r_[0, hit, 0]))
        return [{"start": a, "stop": b} for a, b in edge.reshape(-1, 2).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        asked = pa.array(list(t.terms), pa.binary())
        for batch in batches:
            for b in range(batch.num_rows):
                block = {c: batch.column(i)[b] for i, c in enumerate(batch.schema.names)}
                sizes = block["n_words"].values.to_numpy(zero_copy_only=False).astype(np.int64)
                first = np.cumsum(sizes + 1) - sizes - 1
                positions = np.frombuffer(block["positions"].as_buffer(), np.uint32)
                end = np.cumsum(block["n"].values.to_numpy(zero_copy_only=False))
                postings = {}
                number = pc.fill_null(pc.index_in(block["term"].values, value_set=asked), -1).to_numpy(zero_copy_only=False)
                for k in np.flatnonzero(number >= 0).tolist():
                    postings[int(number[k])] = positions[end[k - 1] if k else 0 : end[k]].astype(np.int64)
                level, pairs = np.zeros(int((sizes + 1).sum()) + 1, np.int32), set()
                for term in postings:
                    for x in t.waiting(term):
                        phrase = t.words[t.start[x] : t.start[x] + t.size[x]]
                        starts = phrase_starts(postings, phrase, np.argsort(t.total[phrase], kind="stable"), slop)
                        if not len(starts):
                            continue
                        doc = np.searchsorted(first, starts, side="right") - 1
                        inside = (starts >= 0) & (starts + len(phrase) <= first[doc] + sizes[doc])
                        starts, doc = starts[inside], doc[inside]
                        np.add.at(level, starts, 1)
                        np.add.at(level, starts + len(phrase), -1)
                        pairs.update((d, t.items[t.item[x]]) for d in np.unique(doc).tolist())
                hits, found = (np.cumsum(level) > 0).astype(np.int8), {}
                for d, i in sorted(pairs):
                    found.setdefault(d, []).append(i)
                rows = [
                    {"row_id": no, "doc_id": x, "n_words": n, "spans": stretches(hits[a : a + n]) if d in found else [], "items": found.get(d, [])}
                    for d, (no, x, n, a) in enumerate(zip(block["row_id"].as_py(), block["doc_id"].as_py(), sizes.tolist(), first.tolist(), strict=True))
                ]
                yield pa.RecordBatch.from_pylist(rows, shape)

    return index.mapInArrow(run, "row_id long, doc_id long, n_words long, spans array<struct<start:int,stop:int>>, items array<string>")


def search(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int = 0, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(row_id, doc_id, n_words, spans, items) of every document of a stored index; ``row_id`` tells rows apart.

    ``spans`` are the stretches of words that lie in an occurrence of a window of a test item, ``items`` those items.
    """
    tests = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), text_or_empty(item_text_col).cast("binary").alias("body"))
    passes = 1 + (tests.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // pass_bytes
    counted = index.select(F.explode(F.arrays_zip("term", "n")).alias("x")).select("x.term", "x.n")
    spark = index.sparkSession

    def total_of(terms: dict[bytes, int]) -> dict[bytes, int]:
        asked = spark.createDataFrame([(w,) for w in terms], "term binary")  # words of at most pass_bytes of tests
        return {bytes(r["term"]): r["n"] for r in counted.join(F.broadcast(asked), "term").groupBy("term").agg(F.sum("n").alias("n")).collect()}

    parts = []
    for k in range(passes):
        here = tests if passes == 1 else tests.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k)
        parts.append(_matches(index, _prepared([(r.item, bytes(r.body)) for r in here.collect()], total_of, window), slop))
    return parts[0] if passes == 1 else _united(parts)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    slop: int = 0,
    block_words: int = BLOCK_WORDS,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """Words of documents that lie in an occurrence of ``window`` consecutive words of a benchmark item.

    Returns a row per input row: doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted item ids, joined by commas),
    contaminated, spans (first and last-but-one word numbers of each hit stretch).

    * Null and empty texts have no words; an item of fewer words than the window is one window, of none it has none.
    * Items that share an id are one item; a null item id is the empty string. Words repeat as they stand.
    * Null and repeated document ids are passed on: rows are told apart by numbers of their own.
    * ``slop`` > 0 gives proximity matches: each term of the window at most so many words from its place.
    * Tests of over ``pass_bytes`` are searched in several passes over the index.
    * An empty benchmark leaves every document clean; other columns on either side aren't looked at.
    * A document is searched whole; the task that has it holds its words and those of the block's other documents.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("body"))
    found = search(staged(build_index(rows, block_words), "postings", large_rows=True), benchmark, item_col, item_text_col, window, slop, pass_bytes)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "spans",
    )


def _united(parts: list[DataFrame]) -> DataFrame:
    """One row per document of the rows that the passes have for it; spans that meet are one."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    grown = both.groupBy("row_id").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.flatten(F.collect_list("items")).alias("items"))
    merged = F.expr("""aggregate(s, cast(array() as array<struct<start:int,stop:int>>), (a, x) ->
        if(size(a) > 0 and element_at(a, -1).stop >= x.start,
           concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'stop', greatest(element_at(a, -1).stop, x.stop)))),
           concat(a, array(x))))""")
    return grown.select("row_id", "doc_id", "n_words", merged.alias("spans"), "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS, **how) -> DataFrame:
    """The rows of ``docs`` that have no word of a benchmark's passage, with all their columns; rows count, not ids."""
    rows, row = numbered(docs, "indexed-rows")
    index = staged(build_index(rows.select(F.col(row).alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("body")), block_words), "postings", large_rows=True)
    # Staged, its size is known: where it is small the documents aren't shuffled.
    bad = staged(search(index, benchmark, **how).where(F.size("spans") > 0).select(F.col("row_id").alias(row)), "contaminated-rows")
    return rows.join(bad, row, "left_anti").select(*docs.columns)
