"""Near copies of documents: SimHash neighbours and rows with common sketch values, each confirmed by full word runs.

Two ways lead to candidates. Ball hashing of :mod:`.simhash` links fingerprints at most 4 bits apart. That sees few texts
of Jaccard similarity 0.8, so the inverted lists of :mod:`.minhash` find the others. A text is cut once for its sketch
and, if it is in any candidate, once for its full set; a pair counts only if the full sets are similar enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash, simhash
from .tables import join_frequent, numbered, staged

WORDS, LEAST = 5, 0.8


def neighbours(rows: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): ids of ``rows`` (row_id, text) that hang together by fingerprints at most ``radius`` bits apart; no group's pairs, a tree."""
    fps = staged(simhash.fingerprints(rows, "row_id", "text").withColumnRenamed("doc_id", "row_id"), "fingerprints")
    first = staged(fps.groupBy("fp").agg(F.min("row_id").alias("first_id"), F.count("*").alias("n_rows")), "distinct-fingerprints")
    total = first.agg(F.sum("n_rows")).first()[0] or 0
    same = join_frequent(fps, first.where("n_rows > 1"), ["fp"], "n_rows", total).select(F.col("row_id").alias("a"), F.col("first_id").alias("b"))
    of = lambda end: first.select(F.col("fp").alias(end), F.col("first_id").alias(f"{end}_id"))
    near = simhash.near_links(first.select("fp"), radius).join(of("a"), "a").join(of("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return same.unionByName(near).where("a <> b")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` with the least id of their group of near copies, with all their columns.

    Groups are connected by pairs of texts whose sets of ``words``-word runs have a Jaccard similarity of ``least`` or more.

    * Rows count, not ids: those with a null id are compared too and stay only if no row of the group has an id; rows that
      repeat an id with another text are different documents. Of a group's rows with equal ids one stays.
    * A null text is the empty one. Texts without words are near copies of nothing: all stay. Texts under five words are
      one run, so that only equal ones are alike.
    * Texts of any length are compared whole; columns with whatever names and empty tables do no harm.
    """
    known, row = numbered(docs)
    rows = known.select(F.col(row).alias("row_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sets, roots = minhash.linked_sets(rows, "row_id", "text", words, least, neighbours(rows, radius))
    of_set = staged(sets.groupBy("set_id").agg(F.count("*").alias("n_rows")).join(roots, "set_id"), "rows-of-sets")
    total = of_set.agg(F.sum("n_rows")).first()[0] or 0
    grouped = join_frequent(sets.where("n > 0"), of_set, ["set_id"], "n_rows", total).select(F.col("id").alias("node"), "root")
    named = staged(known.select(F.col(row).alias("node"), F.col(id_col).cast("long").alias("id")).join(grouped, "node"), "members")
    best = staged(named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("best"), F.count("*").alias("n")), "best")
    gone = staged(join_frequent(named, best, ["root"], "n", total).where("node <> best.node").select(F.col("node").alias(row)), "near-copies")
    return known.join(gone, row, "left_anti").select(*docs.columns)
