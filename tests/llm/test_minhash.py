"""Bottom-k sketches against brute force over all pairs, in every branch: long lists, wide sets, families, odd rows."""

import itertools
import random

import numpy as np
import pytest

from tidegauge.llm import minhash as M
from tidegauge.llm import tables

SHAPE = "doc_id long, text string, node long, hashes string, __parts string"


def brute(texts, words=M.WORDS, percent=80):
    """(size, root) of every text; the root is the least position reachable by links."""
    sets = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    return [(len(s), r) for s, r in zip(sets, root, strict=True)]


def frame(spark, texts, ids=None):
    return spark.createDataFrame([((ids or range(len(texts)))[i], t, 1, "x", "y") for i, t in enumerate(texts)], SHAPE)


def family(draw, n, words, edits):
    """Copies of one text with up to ``edits`` words changed: near its original, far from many of one another."""
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    base = [word() for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        copy = list(base)
        for at in draw.sample(range(words), draw.randint(0, edits)):
            copy[at] = word()
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_components_are_brute_force(spark, monkeypatch, small):
    if small:  # sketches that hold no set whole, lists in many blocks, keys that count as frequent
        for name, value in (("WIDE", 128), ("BLOCK", 8), ("WIDE_SHARE", 0.5), ("DENSE", 4)):
            monkeypatch.setattr(M, name, value)
        monkeypatch.setattr(tables, "HOT_ROWS", 4)
    draw = random.Random(11)
    texts = family(draw, 60, 120, 12) + family(draw, 30, 700, 60) + family(draw, 20, 12, 2) + ["one two", "ONE two", "one", None, "", " \n", "É x y z w", "é x y z w", "a b c d a b c d a b c d", "a b c d a b c d"]
    draw.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_components(frame(spark, texts)).collect()}
    assert got == {i: (n, r, r == i) for i, (n, r) in enumerate(brute(texts))}
    assert len({r for _, r, _ in got.values()}) < len(texts) - 20


def test_another_length_of_runs_and_share(spark):
    draw = random.Random(12)
    texts = family(draw, 30, 60, 9)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_components(frame(spark, texts), words=2, least=0.9).collect()}
    assert got == dict(enumerate(brute(texts, 2, 90)))


def test_odd_rows(spark):
    texts, ids = ["a b c d e", "a b c d e", "a b c d e", None, "x y z v w", "x y z v w"], [5, 5, None, 7, None, None]
    got = sorted(map(str, (tuple(r) for r in M.near_components(frame(spark, texts, ids)).collect())))
    assert got == sorted(map(str, [(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (7, 0, 7, True), (None, 2, None, False), (None, 2, None, False)]))
    assert M.near_components(frame(spark, [])).count() == 0
    long = " ".join(f"w{i}" for i in range(60_000))
    (a, b) = M.near_components(frame(spark, [long, long + " end"])).orderBy("doc_id").collect()
    assert (a.n_shingles, b.n_shingles, b.component_id) == (59_997, 59_998, 0)


def test_a_forest_of_known_links_and_all_that_may_be():
    draw = random.Random(13)
    sets = [M.shingles(t.encode()) for t in family(draw, 12, 90, 8)]
    size = np.array([len(s) for s in sets])
    u, v = M.meetings(np.arange(len(sets)), size, sets, np.zeros(len(sets)), 0.8)
    near = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))
    assert len(u) < len(sets) and all(near(i, j) for i, j in zip(u, v, strict=True))
    root = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if near(i, j):
            root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert len(u) == len(sets) - len(set(root))
    side = np.array([1, 2] * 6 + [1])
    u, v = M.meetings(np.arange(len(sets)), size, sets, side, 0.8)
    assert all(side[i] == 1 and side[j] == 2 for i, j in zip(u, v, strict=True))
    assert not len(M.meetings(np.zeros(len(sets), int), size, sets, np.zeros(len(sets)), 0.8)[0])
