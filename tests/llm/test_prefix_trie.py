"""The trie against a walk over all prefixes."""

import hashlib
import random
import zlib

from tidegauge.llm import prefix_trie as P

SHAPE = "conv_id long, turn long, role string, text string, depth string, owner string"


def brute(rows, span=100, most=6):
    told = {}
    for c, t, role, text in rows:
        if c is not None:
            told.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    told = {c: [x[2:] for x in sorted(v)] for c, v in told.items()}
    paths = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % most
        paths[c] = tuple(told.get(c - c % span, [])[:h] + own[h:])
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in nodes)]
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(p))
        out.append((
            min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below),
            len(leaves), sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def nodes(spark, rows, **k):
    made = P.conversation_trie(spark.createDataFrame([(*r, "x", "y") for r in rows], SHAPE), **k)
    assert made.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in made.collect()), key=str)


def test_the_trie_is_brute_force(spark, monkeypatch):
    from tidegauge.llm import tables

    draw = random.Random(3)
    rows = []
    for c in draw.sample(range(0, 400), 150):
        rows += [(c, t, draw.choice(["user", "assistant", None]), draw.choice(["a", "bé", "ccc", None, "", "😀x"])) for t in range(draw.randrange(1, 8))]
    rows = [r for r in rows if not 200 <= r[0] < 201]  # a span without its first conversation: some end up without turns
    rows += [(301, None, "user", "first"), (303, 0, "user", "x" * 50_000), (None, 0, "user", "of nobody"), (-7, 0, "user", "a"), (-7, 1, "assistant", "b")]
    want = brute(rows)
    assert nodes(spark, rows) == want
    monkeypatch.setattr(tables, "HOT_ROWS", 5)
    assert nodes(spark, rows) == want


def test_repeated_turns_and_none(spark):
    rows = [(5, 1, "user", "a"), (5, 1, "user", "a"), (5, None, None, None), (6, 0, "user", "a")]
    assert nodes(spark, rows, span=10, most=1) == brute(rows, 10, 1)
    assert nodes(spark, []) == []


def test_a_role_never_reads_as_a_text(spark):
    rows = [(1, 0, "a", "bc"), (2, 0, "ab", "c"), (3, 0, "1", ":x"), (4, 0, "", "1:x")]
    assert len(nodes(spark, rows, span=1, most=1)) == 5
