"""Dense search by matrix products finds what scoring pair by pair finds, ties and odd vectors included, and does the work in few products."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidegauge.operators import retrieval


def found(df):
    return sorted(((r.query_id, r["rank"], r.doc_id, repr(r.score)) for r in df.collect()), key=repr)


def test_products_give_what_pairs_give(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(90)]  # thirty copies of each of three
    rows += [(400, [0.0] * 6), (401, None), (402, [1.0, 2.0]), (403, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (404, [float("inf")] + [1.0] * 5), (None, rows[0][1])]
    e = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    asks = e.where("doc_id % 10 = 0 OR doc_id > 400").withColumnRenamed("doc_id", "query_id")
    monkeypatch.setattr(retrieval, "PIECE_DOCS", 100)
    monkeypatch.setattr(retrieval, "BLOCK_NUMBERS", 90)
    monkeypatch.setattr(retrieval, "BATCH_SCORES", 200)
    for k in (7, 500):
        assert found(retrieval.dense(asks, e.where("doc_id IS NOT NULL"), k)) == found(retrieval._dense_pairs(asks, e.where("doc_id IS NOT NULL"), k, 512))
    assert retrieval.dense(asks, e.limit(0), 3).count() == 0 and retrieval.dense(asks.limit(0), e, 3).count() == 0


def test_rounding_is_that_of_spark(spark):
    rng = random.Random(6)
    xs = [s * (rng.randrange(10**6) + 0.5) / 1e6 for _ in range(4000) for s in (1, -1)] + [rng.uniform(-1, 1) for _ in range(4000)] + [0.0, -0.0, 1.0]
    want = [r.r for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(F.round("x", 6).alias("r")).collect()]
    assert (retrieval._millionths(np.array(xs)) / 1e6).tolist() == want


def test_few_pairs_are_scored_number_by_number(monkeypatch):
    """Of 2,000 documents, 1,000 of them copies, few are scored number by number; before, all pairs were."""
    rng, pairs, dots = np.random.default_rng(7), [], retrieval._dots
    v = rng.normal(size=(2000, 8))
    v[1000:] = v[0]
    monkeypatch.setattr(retrieval, "BATCH_SCORES", 4000)
    monkeypatch.setattr(retrieval, "_dots", lambda a, b: pairs.append(len(a)) or dots(a, b))
    table = lambda x: pa.table({"id": pa.array(range(len(x))), "embedding": pa.array(x.tolist())})
    assert retrieval._k_best(table(v), table(v[:40]), 5).num_rows == 200
    assert sum(pairs) - 2040 < 2000 * 40 / 4


def test_counted_grades_give_what_all_grades_give(spark):
    """The ideal order comes from counts of grades; before, all grades of a query were sorted."""
    ranked = spark.createDataFrame([(1, d, d) for d in range(1, 6)] + [(2, 9, 1)], "query_id long, doc_id long, rank int")
    judged = spark.createDataFrame([(1, 2, 2), *((1, d, 1) for d in range(4, 40)), (2, 50, 0), (3, 7, 1)], "query_id long, doc_id long, grade int")
    plan = (out := retrieval.ranking_metrics(ranked, judged, 3))._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
    got = {r.query_id: (r.ndcg, r.mrr, r.recall) for r in out.collect()}
    log = np.log2
    assert got == {1: (round(3 / log(3) / (3 + 1 / log(3) + 0.5), 6), 0.5, round(1 / 37, 6)), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}


def filtered(spark):
    rng = random.Random(8)
    some = lambda x, share=0.2: None if rng.random() < share else x
    at = lambda: some(f"2024-01-{rng.randint(1, 28):02d} 00:00:00")
    names = lambda most: some([some(f"s{rng.randint(0, 9)}", 0.1) for _ in range(rng.randint(0, most))])
    number = lambda: some(rng.choice([float("nan"), float("inf"), -0.0, 0.0, rng.uniform(-1, 1)]))
    vector = lambda: [float(np.float32(rng.gauss(0, 1))) for _ in range(6)]
    docs = [(i, vector(), at(), some(rng.choice("abc")), names(4), number()) for i in range(300)]
    docs += [(300 + i, docs[i % 3][1], *docs[i][2:]) for i in range(60)]  # copies
    docs += [(400 + i, v, None, "a", ["s1"], 0.5) for i, v in enumerate([[0.0] * 6, None, [1.0, 2.0], [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("inf")] + [1.0] * 5])]
    asks = [(i, vector(), at(), some([some(x, 0.1) for x in rng.sample("abcd", rng.randint(0, 3))]), names(3), number()) for i in range(60)]
    asks += [(60, None, None, None, None, None), (61, vector(), None, None, None, None), (62, vector(), None, ["absent"], None, None)]
    e = spark.createDataFrame(docs, "doc_id long, embedding array<float>, at string, event_type string, symbols array<string>, importance_score double")
    q = spark.createDataFrame(asks, "query_id long, embedding array<float>, at string, types array<string>, symbols array<string>, least double")
    return q.withColumn("as_of", F.to_timestamp_ntz("at")).drop("at"), e.withColumn("available_at", F.to_timestamp_ntz("at")).drop("at")


def test_filtered_products_give_what_filtered_pairs_give(spark, monkeypatch):
    asks, docs = filtered(spark)
    monkeypatch.setattr(retrieval, "PIECE_DOCS", 100)
    monkeypatch.setattr(retrieval, "BLOCK_NUMBERS", 150)
    monkeypatch.setattr(retrieval, "BATCH_SCORES", 400)
    for k in (4, 500):
        want = found(retrieval._dense_pairs(asks, docs, k, 512, retrieval.may_see))
        assert found(retrieval.dense(asks, docs, k, allowed=retrieval.may_see)) == want
    assert found(retrieval.dense(asks, docs, k, 20, lambda q, d: retrieval.may_see(q, d))) == want  # any other condition


def test_filtered_search_scores_no_pairs_in_rows(spark, monkeypatch):
    """Before, every pair of a query and a document was a row, and the documents were scanned once per block of queries."""
    asks, docs = filtered(spark)
    monkeypatch.setattr(retrieval, "_dense_pairs", None)
    plain = retrieval.dense(asks.where("query_id <> 60"), docs.where("doc_id < 400"), 4, 1, retrieval.may_see)
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "aggregate(" not in plan
    assert plain.where("query_id = 61").count() == 4 and plain.where("query_id = 62").isEmpty()
