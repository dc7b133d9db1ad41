"""Near copies against brute force over all pairs."""

import itertools
import random

from tidegauge.llm import near_copies as N
from tidegauge.llm import simhash


def brute_pairs(texts, least=N.LEAST):
    runs = []
    for t in texts:
        w = (t or "").lower().split()
        runs.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(runs[i] & runs[j]) >= least * len(runs[i] | runs[j])}


def fixture(n=60, seed=3):
    """Texts and copies with single words changed, down to a similarity of 0.8; and strangers."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    texts = []
    for _ in range(n):
        base = [word() for _ in range(draw.randint(90, 400))]
        copy = list(base)
        for _ in range(draw.randint(1, max(1, len(base) // 46))):
            copy[draw.randrange(len(base))] = word()
        texts += [" ".join(base), " ".join(copy), " ".join(word() for _ in range(200))]
    return texts


def groups(n, pairs):
    """The least position that each of ``n`` reaches."""
    root = list(range(n))
    for a, b in pairs:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_the_stage_leaves_one_of_each_group_of_pairs_and_families(spark):
    import corpus_pipeline

    texts = fixture() + family() + family(30, 150, 5, 6)
    random.Random(1).shuffle(texts)
    truth = brute_pairs(texts)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()}
    assert len(truth) > 90 and kept == set(groups(len(texts), truth))


def test_neighbours_are_a_tree_over_fingerprints(spark):
    texts = family(30, 400, 2, 7) * 2 + ["", " ", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, text string")
    edges = [(r["a"], r["b"]) for r in N.neighbours(rows).collect()]
    fps = [simhash.fingerprint((t or "").encode()) for t in texts]
    near = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    assert groups(len(texts), edges) == groups(len(texts), near) and len(edges) < 2 * len(texts)


def test_rows_with_null_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(200)]
    copy = " ".join(words[:100] + ["other"] + words[101:])
    rows = [(None, copy), (7, " ".join(words)), (9, "one two three"), (9, "ONE two\tthree"), (9, "quite another text of its own"), (None, None), (3, "x y z x y z")]
    out = N.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "").lower().replace("\t", " ")) for r in out) == sorted([(7, " ".join(words)), (9, "one two three"), (9, "quite another text of its own"), (0, ""), (3, "x y z x y z")])
    assert N.keep_one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def family(n=40, words=300, changed=6, seed=5):
    """A text and copies of it that are each similar to it, while few of them are to one another."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    base = [word() for _ in range(words)]
    texts = []
    for _ in range(n):
        copy = list(base)
        for at in draw.sample(range(0, words, 7), changed):
            copy[at] = word()
        texts.append(" ".join(copy))
    return texts[: n // 2] + [" ".join(base)] + texts[n // 2 :]
