"""The prefix trie of conversations, by smallest-member ownership.

A node is a sequence of turns that some conversation starts with. Its owner is the least conversation that does. Along a
conversation's path owners only grow, so what a conversation owns is a suffix of its path, and each node is owned once.
Then whatever is summed over the nodes of a subtree is a sum over the conversations that pass through its top: of the
tokens from there to the end of each, less those of the nodes that it owns; leaves and children are counted by owners too.
No subtree is walked: sums along each conversation, then one group-by on prefixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import join_frequent, staged

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: Hex digits of a turn's digest that make a number; two such numbers, summed along the path, name a prefix.
DIGITS = 15


def _turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, at, digest, tokens): the turns of each conversation, counted from 1; no text goes further than this."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    told = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), told.alias("digest"), F.length(text).cast("long").alias("tokens"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.withColumn("at", F.row_number().over(order)).select("conv_id", "at", "digest", "tokens")


def rebuilt(turns: DataFrame, span: int, most: int) -> DataFrame:
    """(conv_id, at, digest, tokens): conversations whose first turns are those of the first conversation of their span.

    The number of turns taken is the unsigned CRC-32 of the decimal id modulo ``most``. Row 0 of each is the root.
    """
    ids = turns.groupBy("conv_id").agg(F.max("at").alias("own"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    ids = ids.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % span).alias("base"))
    opening = turns.where(F.col("at") < most).select(F.col("conv_id").alias("base"), "at", "digest", "tokens")
    opened = staged(ids.join(opening, "base").where("at <= h").select("conv_id", "at", "digest", "tokens"), "openings")
    taken = opened.groupBy("conv_id").agg(F.max("at").alias("taken"))
    heads = ids.join(taken, "conv_id", "left").select("conv_id", "h", F.coalesce("taken", F.lit(0)).alias("taken"))
    own = turns.join(heads, "conv_id").where("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).cast("int").alias("at"), "digest", "tokens")
    root = ids.select("conv_id", F.lit(0).alias("at"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("tokens"))
    return opened.unionByName(own).unionByName(root)


def _number(at: int) -> Column:
    """A number from the digest of a turn and its place, so that the same turn elsewhere in the path is another number."""
    mixed = F.sha2(F.concat(F.col("at").cast("string"), F.lit(" "), F.col("digest")), 256)
    return F.coalesce(F.conv(F.substring(mixed, at * DIGITS + 1, DIGITS), 16, 10).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))


def _ends_digests(ends: DataFrame) -> DataFrame:
    """(p, q, depth, ends_sha256) of ``ends`` (p, q, depth, conv_id), sorted within partitions: a node's ids are hashed as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, told = None, hashlib.sha256()
        for batch in batches:
            done = []
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            for key, conv in zip(keys, batch.column(3).to_pylist(), strict=True):
                if key != node:
                    if node is not None:
                        done.append((*node, told.hexdigest()))
                    node, told = key, hashlib.sha256()
                    told.update(str(conv).encode())
                else:
                    told.update(f",{conv}".encode())
            yield _batch(done)
        if node is not None:
            yield _batch([(*node, told.hexdigest())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.decimal128(38, 0), pa.decimal128(38, 0), pa.int32(), pa.string())
        return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["p", "q", "depth", "ends_sha256"])

    sorted_ = ends.repartition("p", "q", "depth").sortWithinPartitions("p", "q", "depth", "conv_id")
    return sorted_.select("p", "q", "depth", "conv_id").mapInArrow(run, "p decimal(38,0), q decimal(38,0), depth int, ends_sha256 string")


def trie(paths: DataFrame) -> DataFrame:
    """The nodes of ``paths`` (conv_id, at, digest, tokens; at 0 is the root): see :func:`conversation_trie`."""
    along = Window.partitionBy("conv_id").orderBy("at")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("conv_id")
    named = paths.select("conv_id", F.col("at").alias("depth"), "tokens", F.sum(_number(0)).over(so_far).alias("p"), F.sum(_number(1)).over(so_far).alias("q"), F.max("at").over(whole).alias("n_turns"))
    named = staged(named.withColumn("p", F.col("p").cast("decimal(38,0)")).withColumn("q", F.col("q").cast("decimal(38,0)")), "paths")
    node = ["p", "q", "depth"]
    owners = staged(named.groupBy(*node).agg(F.min("conv_id").alias("owner"), F.max("n_turns").alias("deepest"), F.count("*").alias("n_rows")), "owners")
    total = owners.agg(F.sum("n_rows")).first()[0] or 0
    met = join_frequent(named, owners, node, "n_rows", total)
    on_path = Window.partitionBy("conv_id").orderBy("depth")
    onward = on_path.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    owned = F.col("conv_id") == F.col("owner")
    is_leaf = owned & (F.col("deepest") == F.col("depth"))
    sums = met.select(
        *node, "conv_id", "owner", "n_turns",
        F.lag("owner").over(on_path).alias("parent"),
        F.coalesce(F.lead(owned.cast("int")).over(on_path), F.lit(0)).alias("child"),
        F.sum(F.when(owned, 0).otherwise(F.col("tokens"))).over(onward).alias("saved"),
        F.max(is_leaf.cast("int")).over(onward).alias("leaf"),
    )
    out = sums.groupBy(*node).agg(
        F.min("owner").alias("conv_id"), F.min("parent").alias("parent_conv_id"), F.count("*").alias("n_convs"),
        F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    ends = _ends_digests(named.where("depth = n_turns").select(*node, "conv_id"))
    out = out.join(ends, node, "left")
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", span: int = 100, most: int = 6) -> DataFrame:
    """The prefix trie of rebuilt conversations (:func:`rebuilt`), a row per node.

    Returns conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the subtree,
    members but one times code points of the node's last text), ends_sha256 (of the ids of members that end there).

    * A null role or text is the empty one. Turns are in order of their number, nulls first; repeated numbers in order of
      a digest of role and text, so that equal turns are interchangeable.
    * Rows with a null id belong to no conversation and are left out. No rows give no nodes, not even a root.
    * A conversation that ends up without turns is a member of the root alone.
    * Texts are read once, for their digests and lengths: what is shuffled for a turn doesn't grow with its text. A
      prefix is named by two sums of 60-bit numbers from SHA-256.
    * The turns of one conversation are summed by one task, and the ids that end at one node are hashed by one task as they
      come, for a digest is sequential; nodes that very many conversations share are broadcast with their owners.
    """
    return trie(rebuilt(staged(_turns(conversations, id_col, turn_col, role_col, text_col), "turns"), span, most))
