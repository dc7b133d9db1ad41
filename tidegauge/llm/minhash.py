"""MinHash near-dedup by bottom-k sketches of one hash function.

A text is the set of hashes of its word runs, and its sketch the ``k`` least of them. Of two sets with a similarity of
0.8 or more, at least ``SHARED`` of the ``k`` least values of their union lie in both with a chance of all but one in a
billion, and for sets of at most ``k`` runs always. So any two such texts meet in the inverted list of a retained value,
even if each text enters only the lists of its rarest values: of ``k`` it may leave out all but ``SHARED - 1``.

A list is never turned into all its pairs. All rows of a list are compared with one of them, its pivot. Then the rows that
met the same pivot, in whichever lists, are one group: where links left it in several pieces, one task (or one for each
pair of blocks of a large group) compares wide sketches of rows of different pieces, and hands on a forest of the links
that it sees, not the pairs. Each link is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .tables import dealt_join, join_frequent, staged, text_or_empty

WORDS, LEAST = 4, 0.8
#: Values that a set's sketch retains for inverted lists, and how many of a union's least ones two similar sets share.
K, SHARED = 64, 30
#: Values of a union by which a pair is estimated, and the share that all but one in a billion similar pairs pass.
NARROW, NARROW_SHARE = 256, 0.63
#: The same for rows of a group; sets of so many runs at most are compared as a whole.
WIDE, WIDE_SHARE = 4096, 0.76
#: Rows of a group that one task compares with as many others.
BLOCK = 1024
#: Values that so many rows of a group share are counted as a matrix product, others one by one.
DENSE = 32
_SEED, _STEP = 7, np.uint64(0x9E3779B97F4A7C15)
_ROWS = "node long, hashes array<long>"


def shingles(body: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of all runs of ``words`` words, in order of size; a shorter text is one run, one without words none."""
    tokens = body.lower().split()
    if not tokens:
        return np.zeros(0, np.int64)
    each = np.fromiter((xxhash.xxh64_intdigest(t, _SEED) for t in tokens), np.uint64, len(tokens))
    width = min(words, len(tokens))
    n = len(tokens) - width + 1
    runs = np.full(n, width, np.uint64)
    for i in range(width):
        runs = (runs ^ each[i : i + n]) * _STEP
        runs ^= runs >> np.uint64(29)
    return np.unique(runs.view(np.int64))


def _sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, text_key, n, set_id, sketch) of every row: size and digest of its set, and the set's K least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py(), words) for x in batch.column(2)]
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            made = [batch.column(0), batch.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([x[:K] for x in sets], pa.list_(pa.int64()))]
            yield pa.record_batch(made, ["id", "text_key", "n", "set_id", "sketch"])

    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(text_or_empty(text_col))).alias("text_key"), text_or_empty(text_col).cast("binary").alias("body"))
    return keyed.mapInArrow(run, "id long, text_key binary, n long, set_id binary, sketch array<long>")


def _distinct_sets(known: DataFrame) -> DataFrame:
    """(node, set_id, id, text_key, n, sketch, n_rows): a row for each set that has runs, with a text that has it."""
    one = known.where("n > 0").groupBy("set_id").agg(F.min(F.struct("id", "text_key")).alias("one"), F.min(F.struct("n", "sketch")).alias("set"), F.count("*").alias("n_rows"))
    return one.select(F.monotonically_increasing_id().alias("node"), "set_id", "one.id", "one.text_key", "set.n", "set.sketch", "n_rows")


def _lists(sets: DataFrame, least: float) -> DataFrame:
    """(value, node, lone): each set under the rarest values of its sketch that another has too; ``lone`` is the share of values that none has."""
    postings = sets.select("node", F.explode("sketch").alias("value"))
    shared = staged(postings.groupBy("value").agg(F.count("*").alias("n_rows")).where("n_rows > 1"), "shared-values")
    total = shared.agg(F.sum("n_rows")).first()[0] or 0
    met = join_frequent(postings, shared, ["value"], "n_rows", total)
    ranked = met.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n_rows", "value"))).alias("values"))
    kept, lone = F.size("sketch"), F.size("sketch") - F.size("values")
    needed = F.least(F.lit(SHARED), F.ceil(F.lit(least) * F.col("n") - 1e-9)).cast("int")
    room = kept - needed + 1 - lone
    fits = sets.select("node", "n", "sketch").join(ranked, "node").where(room > 0)
    return fits.select("node", (lone / kept).alias("lone"), F.explode(F.slice("values", F.lit(1), room)).alias("v")).select("v.value", "node", "lone")


def _star(listed: DataFrame, lists: DataFrame) -> DataFrame:
    """(pivot, node): each row of a list with the list's pivot."""
    total = lists.agg(F.sum("n_rows")).first()[0] or 0
    return join_frequent(listed.select("value", "node"), lists, ["value"], "n_rows", total).where("node <> pivot").select("pivot", "node").distinct()


def _full_sets(docs: DataFrame, id_col: str, text_col: str, words: int, sets: DataFrame) -> DataFrame:
    """(node, hashes) of ``sets``, from the texts again: only those are cut into words a second time."""
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(text_or_empty(text_col))).alias("text_key"), text_or_empty(text_col).cast("binary").alias("body"))
    named = sets.select("node", F.col("id").alias("its_id"), F.col("text_key").alias("key"))
    met = named.join(text, (F.col("key") == F.col("text_key")) & F.col("id").eqNullSafe(F.col("its_id"))).select("node", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(x.as_py(), words) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.list_(pa.int64()))], ["node", "hashes"])

    return met.mapInArrow(run, _ROWS).dropDuplicates(["node"])


def _below(end: str) -> Column:
    """The value up to which the NARROW least hashes of ``end`` show all of its set."""
    return F.when(F.size(end) > NARROW, F.element_at(F.col(end), NARROW)).otherwise(F.lit((1 << 63) - 1))


def _confirmed(pairs: DataFrame, full: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) of nodes that are similar enough: first by the union of their sketches, then by their full sets."""
    total = pairs.count()
    met = dealt_join(pairs, full.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a", total)
    met = dealt_join(met, full.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b", total)
    far = F.least(_below("x"), _below("y"))
    cut = lambda end: F.filter(F.slice(end, 1, NARROW), lambda v: v <= far)
    near = F.size(F.array_intersect(cut("x"), cut("y"))) > NARROW_SHARE * F.size(F.array_union(cut("x"), cut("y")))
    both = F.size(F.array_intersect("x", "y"))
    percent = round(100 * least)
    return met.where(near).withColumn("both", both).where(100 * F.col("both") >= percent * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b")


def _forest(u: np.ndarray, v: np.ndarray, root: np.ndarray) -> list[int]:
    """Positions of those edges u-v that join two trees; ``root`` is changed."""

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for i, (a, b) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append(i)
    return kept


def _common(sketches: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values the sketches of ``left`` and of ``right`` share, as a matrix."""
    value = np.concatenate(sketches)
    owner = np.repeat(np.arange(len(sketches)), [len(x) for x in sketches])
    _, column, times = np.unique(value, return_inverse=True, return_counts=True)
    shape = len(sketches), len(sketches)
    out = np.zeros(shape, np.float32)
    often = times >= DENSE
    name = np.cumsum(often) - 1
    dense = often[column]
    held_by, of = owner[dense], name[column[dense]]
    for at in range(0, int(often.sum()), WIDE):
        held = np.zeros((len(sketches), min(WIDE, int(often.sum()) - at)), np.float32)
        here = (of >= at) & (of < at + WIDE)
        held[held_by[here], of[here] - at] = 1
        out += held @ held.T
    rare = ~dense & (times[column] > 1)
    column, owner = column[rare], owner[rare]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for step in range(1, DENSE):
        same = np.flatnonzero(column[step:] == column[:-step])
        if not len(same):
            break
        place, n = np.unique(owner[same] * len(sketches) + owner[same + step], return_counts=True)
        out.ravel()[place] += n
        out[place % len(sketches), place // len(sketches)] += n
    return out[np.ix_(left, right)]


def meetings(piece: np.ndarray, size: np.ndarray, sketches: list[np.ndarray], side: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of rows of different pieces that can be similar.

    Where both sketches are whole sets, the similarity is known: of those links a forest is enough. Other pairs are given
    if their sketches' union shares WIDE_SHARE of its values and the forest doesn't join them already. ``side`` is 0 for rows
    that are compared with one another, else 1 and 2 for the two halves that are compared.
    """
    left, right = (np.arange(len(piece)),) * 2 if not side.any() else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    common = _common(sketches, left, right)
    whole = size <= WIDE
    far = np.array([np.iinfo(np.int64).max if w else x[-1] for w, x in zip(whole, sketches, strict=True)], np.int64)
    length = np.array([len(x) for x in sketches])
    in_right = np.stack([np.searchsorted(sketches[j], far[left], "right") for j in right], 1)
    in_left = np.stack([np.searchsorted(sketches[i], far[right], "right") for i in left], 0)
    first = far[left][:, None] <= far[right][None, :]
    union = np.where(first, length[left][:, None] + in_right, in_left + length[right][None, :]) - common
    both = whole[left][:, None] & whole[right][None, :]
    sizes = size[left][:, None], size[right][None, :]
    able = (piece[left][:, None] != piece[right][None, :]) & (np.minimum(*sizes) >= least * np.maximum(*sizes) - 1e-6)
    if not side.any():
        able &= left[:, None] < right[None, :]
    u, v = np.nonzero(able & both & (common >= least * union - 1e-3))
    u, v = left[u], right[v]
    root = np.unique(piece, return_index=True, return_inverse=True)
    root = root[1][root[2]].copy()
    kept = _forest(u, v, root)
    x, y = np.nonzero(able & ~both & (common > WIDE_SHARE * union))
    x, y = left[x], right[y]
    for _ in range(64):
        root = root[root]
    open_ = root[x] != root[y]
    return np.r_[u[kept], x[open_]], np.r_[v[kept], y[open_]]


def _across(star: DataFrame, full: DataFrame, pieces: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs that can be similar, of rows that met the same pivot and lie in different ``pieces`` (node, root).

    Rows that share a list met its pivot, so every pair of a list is in a group; a row is in few groups, for texts that
    have much in common have the same pivot in most of their lists.
    """
    members = star.unionByName(star.select("pivot", F.col("pivot").alias("node")).distinct())
    placed = staged(members.join(pieces, "node", "left").select("pivot", "node", F.coalesce("root", "node").alias("piece")), "placed")
    open_ = placed.groupBy("pivot").agg(F.min("piece").alias("x"), F.max("piece").alias("y"), F.count("*").alias("n_rows")).where("x <> y").select("pivot", "n_rows", F.ceil(F.col("n_rows") / BLOCK).cast("int").alias("blocks"))
    open_ = staged(open_, "open-groups")
    total = open_.agg(F.sum("n_rows")).first()[0] or 0
    met = join_frequent(placed, open_, ["pivot"], "n_rows", total).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    with_other = met.select("pivot", "node", "piece", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    half = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    sent = with_other.select("pivot", "node", "piece", half.alias("side"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    sent = sent.join(full.select("node", F.size("hashes").alias("size"), F.slice("hashes", 1, WIDE).alias("sketch")), "node")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node, piece, size, side = (group.column(c).to_numpy() for c in ("node", "piece", "size", "side"))
        ends = node[:0], node[:0]
        if len(node) > 1 and (piece != piece[0]).any() and (not side.any() or len(np.unique(side)) == 2):
            column = group.column("sketch").combine_chunks()
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            u, v = meetings(piece, size, [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], side, least)
            ends = node[u], node[v]
        return pa.table({"a": np.minimum(*ends), "b": np.maximum(*ends)})

    return sent.groupBy("pivot", "i", "j").applyInArrow(run, "a long, b long").distinct()


def linked_sets(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, least: float = LEAST, hints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, text_key, n, set_id) of every row, and (set_id, root) of every set that has runs: equal roots hang together by links.

    Links are between sets whose similarity is ``least`` or more. ``hints`` (a, b) are pairs of ids that are to be compared too.
    """
    if least < LEAST:
        raise ValueError(f"sketches are made for a similarity of {LEAST} or more")
    known = staged(_sketches(docs, id_col, text_col, words), "sketches")
    sets = staged(_distinct_sets(known), "distinct-sets")
    listed = staged(_lists(sets, least), "listed")
    lists = staged(listed.groupBy("value").agg(F.min(F.struct("lone", "node"))["node"].alias("pivot"), F.count("*").alias("n_rows")).where("n_rows > 1"), "lists")
    star = staged(_star(listed, lists), "star")
    tried = star.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
    involved = listed.select("node")
    if hints is not None:
        of = known.join(sets.select("set_id", "node"), "set_id").select("id", "node")
        ends = hints.join(of.select(F.col("id").alias("a"), F.col("node").alias("x")), "a").join(of.select(F.col("id").alias("b"), F.col("node").alias("y")), "b")
        hinted = staged(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "hints")
        tried = tried.unionByName(hinted).distinct()
        involved = involved.unionByName(hinted.select(F.explode(F.array("a", "b")).alias("node")))
    full = staged(_full_sets(docs, id_col, text_col, words, sets.join(involved.distinct(), "node", "left_semi")), "full-sets")
    links = staged(_confirmed(tried, full, least), "links")
    pieces = staged(connected_components(links), "pieces")
    pieces = pieces.unionByName(pieces.select(F.col("root").alias("node"), "root").distinct())
    more = staged(_across(star, full, pieces, least).join(tried, ["a", "b"], "left_anti"), "more-pairs")
    new = staged(_confirmed(more, full, least), "more-links")
    roots = connected_components(reduce(DataFrame.unionByName, (links, new)))
    named = sets.select("node", "set_id").join(roots, "node", "left").select("set_id", F.coalesce("root", "node").alias("root"))
    return known.select("id", "text_key", "n", "set_id"), named


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """Components of documents whose sets of word runs have a Jaccard similarity of ``least`` or more.

    Returns a row per input row: doc_id, n_shingles (size of its set), component_id (the least id reachable, its own
    included), kept (whether the two ids are equal).

    * A null text, an empty one and one without words have no runs and are linked with nothing.
    * Texts with equal sets are one node, however many rows share them.
    * A null id stays null; it never names a component unless no row of it has an id. ``kept`` is false for it.
    * Rows that repeat get the same result; other columns, whatever their names, and empty tables do no harm. ``docs`` is
      read twice: the second time only for texts that share rare runs with others.
    """
    known, named = linked_sets(docs, id_col, text_col, words, least)
    named = staged(named, "set-roots")
    sizes = staged(known.where("n > 0").groupBy("set_id").agg(F.min("id").alias("least_id"), F.count("*").alias("n_rows")), "set-sizes")
    best = staged(sizes.join(named, "set_id").groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n_sets")), "best")
    total = best.agg(F.sum("n_sets")).first()[0] or 0
    by_set = join_frequent(named, best, ["root"], "n_sets", total).select("set_id", "component_id").join(sizes.select("set_id", "n_rows"), "set_id")
    found = join_frequent(known.where("n > 0"), staged(by_set, "set-components"), ["set_id"], "n_rows", known.count()).select("id", "n", "component_id")
    out = found.unionByName(known.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
