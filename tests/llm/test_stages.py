"""Stages of the pipeline, and the pipeline itself, on rows with null, repeated and clashing everything."""

import random

import corpus_pipeline
import pyarrow.parquet as pq
import pytest

from tidegauge.llm import decontaminate, exact_dedup, language, simhash, tables, toxicity
from tests.llm.test_operators import forward_brute, toxic_corpus

PASSAGE = " ".join(f"term{i}" for i in range(12))
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, __row string, __toxic_score string"


def rows_of(texts, ids=None):
    return [((ids or range(len(texts)))[i], t, "en", f"s{i % 3}", 1, "x", "y") for i, t in enumerate(texts)]


def kept(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in df.collect())


def test_exact_dedup_keeps_texts_that_share_an_id(spark):
    frame = spark.createDataFrame(rows_of(["a", "b", "a", "a", None, ""], [1, 1, 1, None, None, 4]), SHAPE)
    out = exact_dedup.drop_copies(frame)
    assert out.columns == frame.columns
    assert kept(out) == [((False, 1), "a"), ((False, 1), "b"), ((False, 4), "")]


def test_frequent_blocks_and_groups_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(tables, "HOT_ROWS", 3)
    texts = ["same" * 3] * 9 + ["same" * 2 + f"{i:04d}" for i in range(9)] + ["", None, "x"]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows_of(texts), SHAPE), block_bytes=4).collect()}
    plain = [t or "" for t in texts]
    assert got == {i: (max(j for j, u in enumerate(plain) if u == t), plain.count(t)) for i, t in enumerate(plain)}


def test_decontamination_stage_goes_by_row(spark):
    bench = spark.createDataFrame([("i", PASSAGE)], "item_id string, text string")
    texts = ["clean text", f"x {PASSAGE.upper()}", f"{PASSAGE} y", "clean too", None]
    frame = spark.createDataFrame(rows_of(texts, [1, 1, None, None, 5]), SHAPE)
    out = decontaminate.drop_contaminated(frame, bench)
    assert out.columns == frame.columns and kept(out) == [((False, 1), "clean text"), ((False, 5), ""), ((True, 0), "clean too")]
    assert decontaminate.drop_contaminated(frame, bench.limit(0)).count() == 5


def test_blocks_of_an_index_lie_in_small_row_groups(spark, monkeypatch):
    monkeypatch.setattr(tables, "LARGE_ROWS", 4096, raising=False)
    written = []

    def kept_in_mind(df, label, *how, **more):
        out = tables.staged(df, label, *how, **more)
        if label == "postings":
            written.append(out.inputFiles())
        return out

    monkeypatch.setattr(decontaminate, "staged", kept_in_mind)
    frame = spark.createDataFrame(rows_of([" ".join(f"w{k}x{i}" for k in range(100)) for i in range(40)] + [f"x {PASSAGE}"]), SHAPE).coalesce(1)
    bench = spark.createDataFrame([("i", PASSAGE)], "item_id string, text string")
    assert decontaminate.drop_contaminated(frame, bench, block_words=100).count() == 40
    assert decontaminate.decontaminate(frame, bench, block_words=100).where("contaminated").count() == 1
    for files in written:
        groups = [g for f in files for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for g in [m.row_group(k).num_rows for k in range(m.num_row_groups)]]
        assert sum(groups) == 41 and max(groups) <= 4
    assert len(written) == 2


def test_one_index_serves_several_benchmarks_against_brute_force(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("abcd") + rng.choice("xy")
    texts = [" ".join(word() for _ in range(rng.randrange(0, 90))) for _ in range(60)]
    body = spark.createDataFrame([(i, i, t.encode()) for i, t in enumerate(texts)], "row_id long, doc_id long, body binary")
    index = tables.staged(decontaminate.build_index(body, block_words=200), "index")
    for size in (3, 4):
        items = {f"i{k}": " ".join(word() for _ in range(rng.randrange(0, 9))) for k in range(30)}
        found = {r.doc_id: r for r in decontaminate.search(index, spark.createDataFrame(list(items.items()), "item_id string, text string"), window=size, pass_bytes=60).collect()}
        for i, t in enumerate(texts):
            w, hit, who = t.split(), set(), set()
            for name, item in items.items():
                for run in ({tuple(item.split()[k : k + size]) for k in range(max(1, len(item.split()) - size + 1))} if item else ()):
                    for at in range(len(w) - len(run) + 1):
                        if tuple(w[at : at + len(run)]) == run:
                            hit |= set(range(at, at + len(run)))
                            who.add(name)
            assert {x for s in found[i].spans for x in range(s.start, s.stop)} == hit and set(found[i]["items"]) == who and found[i].n_words == len(w)


def test_toxicity_stage_keeps_its_columns(spark):
    texts, toxic = toxic_corpus()
    labels = spark.createDataFrame([(i, int(toxic(i)), 1) for i in range(600)], "doc_id long, toxic int, quality int")
    frame = spark.createDataFrame(rows_of([*texts, texts[0], texts[1], None], [*range(600), None, None, None]), SHAPE)
    out = toxicity.drop_toxic(frame, labels)
    left = out.collect()
    assert out.columns == frame.columns
    assert sum(toxic(r.doc_id) for r in left if r.doc_id is not None) <= 8
    assert sum(not toxic(r.doc_id) for r in left if r.doc_id is not None) >= 440
    assert sorted(r.text or "" for r in left if r.doc_id is None) == ["", texts[1]]


def test_simhash_stage_goes_by_row(spark):
    frame = spark.createDataFrame(rows_of(["one two three four", "quite another text", "one two three four", "one two three four"], [5, 5, 3, None]), SHAPE)
    assert kept(simhash.keep_one_of_each(frame)) == [((False, 3), "one two three four"), ((False, 5), "quite another text")]


def test_language_against_brute_force(spark):
    texts = [("the house and the garden", "en"), ("das haus und der garten", "de"), ("la maison et le jardin", "fr")] * 20
    rows = [(i, t, lang) for i, (t, lang) in enumerate(texts)] + [(100, "the haus et garden", None), (101, "12", None), (102, "ß", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(frame)
    tables_ = [{p: model.chance[i, k] for i, p in enumerate(model.pieces) if p} for k in range(len(model.langs))]
    for r in language.identify(frame, model).collect():
        words = language.words_of(r.text)
        if not words:
            assert tuple(r.language) == ("und", 0.0)
            continue
        total = []
        for k in range(len(model.langs)):
            p = __import__("math").exp(model.prior[k])
            for w in words:
                p *= forward_brute("▁" + w, tables_[k], model.chance[-1, k])
            total.append(p)
        best = max(range(len(total)), key=lambda k: (total[k], -k))
        assert r.language.lang == model.langs[best] and r.language.score == pytest.approx(total[best] / sum(total), rel=1e-6)
    with pytest.raises(ValueError):
        language.identify(frame.withColumn("Language", frame.lang), model)


def test_the_whole_pipeline(spark, tmp_path):
    texts, toxic = toxic_corpus()
    more = [texts[1], f"{PASSAGE} {texts[5]}", " ".join(texts[2].split()[:70] + ["other"] + texts[2].split()[71:]), None, None, "tiny"]
    ids = [*range(600), 1, None, 9, None, 700, 700]
    spark.createDataFrame(rows_of([*texts, *more], ids), SHAPE).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(toxic(i)), 1) for i in range(600)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("i", PASSAGE)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert set(out[0].asDict()) == {"shard", "position", "doc_id", "source", "epoch", "block", "words", "text"}
    assert not [r for r in out if PASSAGE in r.text]
    assert sum("vilegrub" in r.text for r in out) <= 8 * 3
    places = [(r.shard, r.position) for r in out]
    assert len(places) == len(set(places))
    assert len({r.text for r in out}) >= 300 and all(len(r.text.split()) == r.words for r in out)


def test_a_stage_deletes_what_the_written_one_before_staged(spark, tmp_path):
    """Stages called one by one, as the pipeline's runner may: before, all that each had staged stayed until the session's end."""
    import glob

    folder = tables.shared_folder(spark) + "/tidegauge"
    frame = spark.createDataFrame(rows_of([f"word{i % 7} and some more of text {i % 7}" for i in range(30)]), SHAPE)
    there = lambda: set(glob.glob(f"{folder}/*"))
    before = there()
    corpus_pipeline.without_copies(spark, frame, str(tmp_path)).write.parquet(str(tmp_path / "a"))
    staged = there() - before
    assert staged
    chained = corpus_pipeline.without_copies(spark, spark.read.parquet(str(tmp_path / "a")), str(tmp_path))
    assert not staged & there()
    last = corpus_pipeline.without_copies(spark, chained, str(tmp_path))  # of a result that isn't written yet
    assert last.count() == 7 and chained.count() == 7
    with tables.stage_of(str(tmp_path)):
        assert there() == before


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        tables.shared_folder(Cluster())
    before = len(tables._open)
    with tables.intermediates():
        path = tables.new_folder(spark, "x")
        spark.range(3).write.parquet(path)
    assert len(tables._open) == before and not __import__("os").path.exists(path)
