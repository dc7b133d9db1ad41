"""Sparse search from an index with bounds finds what scoring everything finds, and skips blocks."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidegauge.operators import retrieval

ROW = "doc_id long, weights map<string,double>"
ASK = "query_id string, weights map<string,double>"


def corpus(spark, signed):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    weight = lambda: round(rng.uniform(-1 if signed else 0.05, 3), 3)
    rows = [(i, {w: weight() for w in rng.sample(words, rng.randint(1, 12))} | ({"the": 9.0} if i % 3 == 0 else {})) for i in range(900)]  # a third share their head
    rows += [(900 + i, {"w1": 1.0, "w2": 1.0}) for i in range(40)] + [(2000, {}), (2001, None)]  # ties, empty, null
    asks = [(f"q{i}", {w: weight() for w in rng.sample(words, 4)}) for i in range(8)] + [("common", {"the": 1.0}), ("none", {"absent": 1.0}), ("empty", {})]
    return spark.createDataFrame(rows, ROW), spark.createDataFrame(asks, ASK)


def indexed(spark, docs, folder):
    retrieval.write_sparse_index(docs, folder, 16)
    return spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/bounds")


def test_blocks_give_what_all_postings_give(spark, tmp_path):
    for signed in (False, True):
        docs, asks = corpus(spark, signed)
        index = indexed(spark, docs, str(tmp_path / str(signed)))
        for k in (3, 2000):  # 2,000: more than there are
            want = {tuple(r) for r in retrieval.sparse(asks, docs, k).select("query_id", "doc_id", "score", "rank").collect()}
            assert {tuple(r) for r in retrieval.sparse_by_blocks(asks, *index, k).select("query_id", "doc_id", "score", "rank").collect()} == want


def test_blocks_that_cannot_enter_are_skipped_and_hold_few_documents(spark, tmp_path):
    docs, asks = corpus(spark, False)
    postings, bounds = indexed(spark, docs, str(tmp_path / "index"))
    asks = asks.where("query_id LIKE 'q%'")
    met, kept = retrieval.block_bounds(asks, bounds).count(), retrieval.blocks_to_score(asks, postings, bounds, 3).count()
    assert 0 < kept < met * 0.8
    sizes = [r[1] for r in postings.groupBy("block").agg({"doc_id": "approx_count_distinct"}).collect()]
    assert max(sizes) <= 48 and len(sizes) > 19  # about 16, the common head dealt over many


def test_an_empty_corpus_finds_nothing(spark, tmp_path):
    docs, asks = corpus(spark, False)
    assert retrieval.sparse_by_blocks(asks, *indexed(spark, docs.limit(0), str(tmp_path / "none")), 3).count() == 0


def test_words_are_counted_in_the_row(spark):
    texts = ["alpha beta alpha", None, "", "abc ab a", "naïve élan1000words-words words", "x" * 70000 + " x", "one,twoo;THREE\nfour\x00five" * 300, "日本語test日本語test", "end"] * 300
    rows = [(i if i else None, t) for i, t in enumerate(texts)]
    want = {(i, w, float(n)) for i, t in rows for w, n in Counter(w for w in re.split("[^a-z]+", t or "") if len(w) > 3).items()}
    got = retrieval.counted(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 4)
    assert {(r.doc_id, w, n) for r in got.collect() for w, n in r.weights.items()} == want
    assert got.where("size(weights) = 0").isEmpty()


def test_the_index_works_its_documents_out_once(spark, tmp_path):
    """Before, the documents were worked out anew for their heads, their sizes and the ranges of the postings."""
    docs, _ = corpus(spark, False)
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    retrieval.write_sparse_index(docs.mapInArrow(passed, ROW), str(tmp_path / "once"), 16)
    assert seen.value == docs.count()
    assert sorted(x.name for x in (tmp_path / "once").iterdir()) == ["bounds", "postings"]
    stored = spark.read.parquet(str(tmp_path / "once" / "postings"))
    bounds = spark.read.parquet(str(tmp_path / "once" / "bounds"))
    want = {(r.block, r.token): (r.high, r.low) for r in stored.groupBy("block", "token").agg(F.max("weight").alias("high"), F.min("weight").alias("low")).collect()}
    assert {(r.block, r.token): (r.high, r.low) for r in bounds.collect()} == want and bounds.count() == len(want)
    assert stored.count() == docs.selectExpr("explode(weights)").count()


def test_documents_with_one_id_are_one(spark, tmp_path):
    from tidegauge.plans import model_queries

    for name, rows, schema in (("documents", [(1, "alpha beta"), (1, "alpha gamma"), (2, "alpha"), (None, "beta"), (None, "beta")], "doc_id long, text string"), ("benchmark", [(7, "Alpha beta beta")], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for f in (model_queries.j2_sparse_search, model_queries.j2_block_search):
        assert sorted((r["rank"], str(r.doc_id), r.score) for r in f(spark, str(tmp_path)).collect()) == [(1, "1", 3.0), (2, "None", 2.0), (3, "2", 1.0)]
