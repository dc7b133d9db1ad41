"""Vector codes against plain integer loops."""

import hashlib
import math
import random

import numpy as np
import pytest

from tidegauge.llm import vector_codes as V

SHAPE = "vec_id long, embedding array<float>, label int, code string, values string"


def brute(rows, parts, entries, rounds):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut = lambda v: [v[k * len(v) // parts : (k + 1) * len(v) // parts] for k in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v)[k] for _, v, _ in first] for k in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: [min((far(p, e), i) for i, e in enumerate(book)) for p, book in zip(cut(v), books, strict=True)]
    for _ in range(rounds):
        told = [near(v) for _, v, _ in kept]
        for k in range(parts):
            for e in range(len(books[k])):
                mine = [cut(v)[k] for (_, v, _), t in zip(kept, told, strict=True) if t[k][1] == e]
                books[k][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else books[k][e]
    out = [(i, "".join(f"{e:02x}" for _, e in near(v)), sum(d for d, _ in near(v)), label) for i, v, label in kept]
    text = ",".join(str(x) for book in books for e in book for x in e)
    return sorted(((i is None, i or 0), c, d, sum(x[2] for x in out if x[3] == label), hashlib.sha256(text.encode()).hexdigest()) for i, c, d, label in out)


def codes(spark, rows, **k):
    made = V.compress(spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SHAPE), **k)
    return sorted(((r.vec_id is None, r.vec_id or 0), r.code, r.error, r.label_error, r.codebooks_sha256) for r in made.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_are_brute_force(spark, seed):
    draw = random.Random(seed)
    rows = [(i, [draw.choice([0.0, 0.25, -0.25, draw.gauss(0, 1)]) for _ in range(8)], draw.choice([None, 0, 1, 2])) for i in range(150)]
    rows += [(150, None, 1), (151, [None] * 8, 1), (152, [math.nan] * 8, 1), (153, [math.inf] + [0.0] * 7, None), (154, [-0.001] * 8, 7)]
    rows += [(3, rows[3][1], 9), (3, rows[4][1], None), (None, [0.5] * 8, 0), (None, [0.5] * 8, 0)]
    assert codes(spark, rows, parts=4, entries=20) == brute(rows, 4, 20, 2)


def test_fewer_vectors_than_entries_and_none(spark):
    rows = [(i, [float(i), 1.0], 0) for i in range(5)]
    assert codes(spark, rows, parts=2) == brute(rows, 2, 64, 2)
    assert codes(spark, [(1, None, 1)], parts=2) == [] == codes(spark, [])


def test_what_cannot_be_coded_is_refused(spark):
    for rows, parts in (([(0, [1.0, 2.0], 0), (1, [1.0], 0)], 1), ([(0, [1.0, 2.0, 3.0], 0)], 2), ([(0, [1e9], 0)], 1)):
        with pytest.raises(ValueError):
            codes(spark, rows, parts=parts)


def test_the_annulus_holds_every_nearest_entry_and_prunes():
    rng = np.random.default_rng(5)
    for spread in (3, 200, 1 << 20, None):
        far_out = 10 ** rng.uniform(0, 5, (3064, 1)) if spread is None else np.full((3064, 1), spread)
        drawn = np.floor(rng.uniform(-1, 1, (3064, 4)) * far_out).astype(np.int64)
        entries, points = drawn[:64], drawn[64:]
        entries[7], entries[9] = entries[3], -entries[3]
        points[:64] = entries
        far = ((points[:, None, :] - entries[None]) ** 2).sum(-1)
        index, least, compared = V.Annuli.of(entries).nearest(points)
        assert (index == far.argmin(1)).all() and (least == far.min(1)).all()
        assert compared < far.size * (0.5 if spread is None else 1)
