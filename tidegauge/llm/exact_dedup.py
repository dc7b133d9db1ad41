"""Exact dedup by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes. All distinct blocks are sorted and
get integer names; then adjacent names are paired and every distinct pair gets a name,
again and again, until each document has a single name. Two documents of one level have
the same last name exactly when their bytes are equal: no digest decides.

A name is a rank: of a block in the order of its 64-bit hash, then of its content, of a pair in the order of its two
names. So the same documents get the same names in every run, however many files and partitions there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import join_frequent, numbered, staged, text_or_empty

BLOCK_BYTES = 4096


def _blocks(rows: DataFrame, block_bytes: int, key_bits: int) -> DataFrame:
    """(row_id, text) → one row per block: row_id, n, idx, block, key."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / block_bytes)).cast("int")
    cut = rows.select("row_id", F.col("text").cast("binary").alias("body"), n.alias("n")).select("row_id", "n", "body", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("idx"))
    block = F.substring("body", F.col("idx") * block_bytes + 1, F.lit(block_bytes))
    return cut.select("row_id", "n", "idx", block.alias("block")).withColumn("key", F.shiftrightunsigned(F.xxhash64("block"), 64 - key_bits))


def _ranked(keys: DataFrame, by: list[str], label: str) -> DataFrame:
    """``keys`` (unique by ``by``, no nulls) with ``name``: the rank in the order of ``by``, from 0.

    Rows are partitioned by range, so a rank is the number of rows in earlier partitions and the place in its own.
    """
    sorted_keys = staged(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), label)
    part = F.shiftright("at", 33).alias("part")
    counts = sorted_keys.groupBy(part).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = sorted_keys.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(starts), "part")
    return placed.withColumn("name", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "start", "at")


def _first_names(blocks: DataFrame) -> DataFrame:
    """row_id, n, idx, name.

    The blocks' content is shuffled once, each distinct one at most once per map task. The names
    travel back by a 64-bit key; blocks that share a key with another are joined by content.
    """
    distinct = blocks.groupBy("key", "block").agg(F.count("*").alias("n_rows"))
    names = _ranked(distinct.groupBy("key").agg(F.count("*").alias("n_blocks"), F.sum("n_rows").alias("n_rows")), ["key"], "block-names")
    rows = ["row_id", "n", "idx"]
    total = names.agg(F.sum("n_rows")).first()[0] or 0
    found = join_frequent(blocks.select(*rows, "key"), names.where("n_blocks = 1").select("key", "name", "n_rows"), ["key"], "n_rows", total).select(*rows, "name")
    shared = names.where("n_blocks > 1").select("key")
    if shared.isEmpty():
        return found
    clashing = staged(blocks.join(shared, "key").select(*rows, "block"), "clashing-blocks")
    by_content = _ranked(clashing.groupBy("block").agg(F.count("*").alias("n_rows")), ["block"], "clashing-names").withColumn("name", -1 - F.col("name"))
    return found.unionByName(join_frequent(clashing, by_content, ["block"], "n_rows", total).select(*rows, "name"))


def _identities(rows: DataFrame, block_bytes: int, key_bits: int) -> DataFrame:
    """Staged (row_id, text) → (row_id, level, name): equal level and name mean equal bytes."""
    first = staged(_first_names(staged(_blocks(rows, block_bytes, key_bits), "blocks")), "first-names")
    longest = first.agg(F.max("n")).first()[0] or 1
    level = first.where("n > 1")
    ends = first.where("n = 1").select("row_id", F.lit(0).alias("level"), "name")
    for k in range(1, (longest - 1).bit_length() + 1):
        half = F.expr("idx div 2").cast("int").alias("idx")
        pairs = level.groupBy("row_id", half).agg(
            F.max("n").alias("n"),
            F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"),
            F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))).alias("b"),
        )
        pairs = staged(pairs.withColumn("lone", F.col("b").isNull()).withColumn("b", F.coalesce("b", F.lit(0))), f"pairs-{k}")
        names = _ranked(pairs.groupBy("a", "b", "lone").agg(F.count("*").alias("n_rows")), ["a", "b", "lone"], f"pair-names-{k}")
        total = names.agg(F.sum("n_rows")).first()[0] or 0
        met = join_frequent(pairs, names, ["a", "b", "lone"], "n_rows", total)
        level = staged(met.select("row_id", F.expr("(n + 1) div 2").cast("int").alias("n"), "idx", "name"), f"level-{k}")
        ends = ends.unionByName(level.where("n = 1").select("row_id", F.lit(k).alias("level"), "name"))
        level = level.where("n > 1")
    return staged(ends, "identities")


def _grouped(rows: DataFrame, block_bytes: int, key_bits: int) -> DataFrame:
    """Staged (row_id, doc_id, text) → (row_id, doc_id, keep_row, keep_id, group_size) of every row."""
    known = staged(_identities(rows.select("row_id", "text"), block_bytes, key_bits).join(rows.select("row_id", "doc_id"), "row_id"), "named-rows")
    groups = staged(known.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row_id")).alias("keep"), F.count("*").alias("group_size")), "text-groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    met = join_frequent(known, groups, ["level", "name"], "group_size", total)
    return met.select("row_id", "doc_id", F.col("keep.row_id").alias("keep_row"), F.col("keep.doc_id").alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, key_bits: int = 64) -> DataFrame:
    """Groups of byte-equal texts; of each the row with the largest id stays.

    Returns a row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    * A null text is the empty text; all empty texts are one group.
    * A null id sorts below every other. Rows that repeat the largest id of their group: one stays.
    * Texts of any length are cut into blocks; an empty table gives an empty result.
    * Other columns of ``docs`` are not looked at, whatever their names.
    * Blocks, pairs and texts that very many rows share are broadcast instead of meeting in one task.

    ``key_bits`` is the width of the routing key (fewer bits only force the join by content).
    """
    rows = staged(docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), "dedup-rows")
    digests = rows.select("row_id", F.sha2("text", 256).alias("text_sha256"))
    return _grouped(rows, block_bytes, key_bits).join(digests, "row_id").select("doc_id", "keep_id", "group_size", (F.col("keep_row") == F.col("row_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns: one of each text.

    Rows count, not ids: of rows that repeat an id and its text one stays, those with other texts are other documents.
    """
    rows, row = numbered(docs, "dedup-rows")
    known = rows.select(F.col(row).alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    stay = _grouped(known, BLOCK_BYTES, 64).where("keep_row = row_id").select(F.col("row_id").alias(row))
    return rows.join(stay, row, "left_semi").select(*docs.columns)
