"""The training-data operators against brute force, round trips and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegauge.llm import chat, decontaminate, exact_dedup, language, mixing, pii, simhash, toxicity, url_rules, warc

DOCS = "doc_id long, text string, lang string, source string, row_id string, key string"


def docs(spark, texts, source=lambda i: f"s{i % 3}"):
    """Documents with columns whose names clash with ones that operators use inside."""
    return spark.createDataFrame([(i, t, "en", source(i), "x", "y") for i, t in enumerate(texts)], DOCS)


KEY = b"a key of the tests"
ODD = ["", None, "a", "a", "b" * 20_000, "b" * 20_000, "b" * 20_001, "\n", "\\", "é" * 5000, "é" * 5000]


@pytest.mark.parametrize(("block", "bits"), [(4096, 64), (3, 64), (3, 2)])
def test_exact_dedup_is_brute_force(spark, block, bits):
    texts = ODD if block > 100 else [t[:40] if t else t for t in ODD] + ["abcabc", "abcab", "abcabcabc"]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs(spark, texts), block_bytes=block, key_bits=bits).collect()}
    plain = [t or "" for t in texts]
    want = {i: (max(j for j, u in enumerate(plain) if u == t), plain.count(t), i == max(j for j, u in enumerate(plain) if u == t), hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(plain)}
    assert got == want
    assert exact_dedup.drop_copies(docs(spark, texts)).count() == len(set(plain))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a>>b\\", "<s>"]), st.lists(st.sampled_from([*chat.CONTROL, "\\", "x", " ", "\n", "<", "é"]), max_size=8).map("".join)), max_size=6))
def test_chat_round_trip(turns):
    assert chat.parse("".join(chat.render_turn(r, t) for r, t in turns)) == turns


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (2, 0, None, "x\\"), (None, 0, "system", "s"), (1, 2, "assistant", "c")]
    got = {r.conv_id: r for r in chat.read_conversations(chat.render_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb</s>\nassistant\nc\n").hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (6, hashlib.sha256(b"b</s>c").hexdigest())
    assert got[2].n_turns == 1 and got[None].n_turns == 1


def test_stored_pieces_read_back_however_they_lie(spark, tmp_path):
    rows = [(c, t, "assistant" if t % 2 else "user", f"text {t} </s> \\ of {c}" * 30) for c in range(5) for t in range(25)]
    pieces = chat.render_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    whole = sorted(tuple(r) for r in chat.read_conversations(pieces).collect())
    pieces.repartition(7, "seq").write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    assert sorted(tuple(r) for r in chat.read_conversations(stored).collect()) == whole and len(whole) == 5
    for broken in (stored.where("conv_id <> 3 OR seq <> 7"), stored.where("conv_id <> 3 OR NOT last"), stored.unionByName(stored.where("seq = 2"))):
        with pytest.raises(Exception, match="piece"):
            chat.read_conversations(broken).collect()
    spans = stored.where("conv_id = 1 AND seq = 1").first()
    (span,) = spans.loss_spans
    assert chat.unescape(spans.piece[span.start : span.stop]) == rows[26][3]


def test_mixing_against_sql_and_bounds(spark):
    """Sizes, source sizes and targets against SQL that is written apart from the operator; what is taken against its bounds."""
    import duckdb

    rng = random.Random(8)
    frame = docs(spark, [*("w\t" * rng.randrange(0, 900) for _ in range(80)), None, "", " \n"], lambda i: None if i % 7 == 0 else "big" if i % 2 else f"s{i % 3}")
    got = {r.doc_id: r for r in mixing.taken(frame).collect()}
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    con.execute("CREATE TABLE s AS SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS size FROM documents GROUP BY source")
    sources = con.execute("SELECT source, size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s ORDER BY source NULLS LAST").fetchall()
    capped, total = set(), sum(x[1] for x in sources)
    while True:
        left, weight = total - sum(3 * x[1] for x in sources if x[0] in capped), sum(x[2] for x in sources if x[0] not in capped)
        more = {x[0] for x in sources if x[0] not in capped and left * x[2] / weight > 3 * x[1]}
        if not more:
            break
        capped |= more
    want = {x[0]: (x[1], 3.0 * x[1] if x[0] in capped else left * x[2] / weight) for x in sources}
    size = dict(con.execute("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) FROM documents").fetchall())
    by = Counter()
    for i, r in got.items():
        assert r["size"] == size[i] and (r.source_size, pytest.approx(r.target)) == want[r.source]
        assert 0 <= r.taken <= 3 * r["size"]
        by[r.source] += r.taken
    assert all(abs(by[x] - t) <= 1 for x, (_, t) in want.items())


def test_mixed_corpus_is_text_whatever_the_files(spark):
    rng = random.Random(9)
    texts = ["  lead\n" + " \t".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    frame = docs(spark, [*texts, None, ""])
    key = lambda d: sorted((r.shard, r.position, r.doc_id, r.epoch, r.block, r.words, r.text) for r in d.collect())
    one = key(mixing.mixed_corpus(frame, block_words=64, shard_blocks=20))
    assert one == key(mixing.mixed_corpus(frame.repartition(13), block_words=64, shard_blocks=20))
    for doc in range(60):
        first = sorted((b, t) for _, _, d, e, b, _, t in one if d == doc and e == 0)
        if len("".join(t for _, t in first).split()) == len(texts[doc].split()):
            assert "".join(t for _, t in first) in texts[doc]
    taken = {r.doc_id: r.taken for r in mixing.taken(frame, block_words=64, shard_blocks=20).collect()}
    assert Counter({d: n for d, n in taken.items() if n}) == sum((Counter({d: len(t.split())}) for _, _, d, _, _, _, t in one), Counter())


def test_mixing_meets_its_targets(spark):
    rng = random.Random(1)
    texts = ["w " * rng.randrange(0, 3000) for _ in range(120)] + [None, ""]
    frame = docs(spark, texts, lambda i: "hot" if i % 3 else (None if i % 2 else f"s{i % 5}"))
    drawn, known = mixing.mix(frame, block_words=64, shard_blocks=50, cell_blocks=32)
    rows = known.join(drawn.groupBy("row_id").agg(F.sum("words").alias("t")), "row_id", "left").collect()
    by = Counter()
    for r in rows:
        assert (r.t or 0) <= 3 * r["size"]
        by[r.source] += r.t or 0
    for source, target in {r.source: r.target for r in rows}.items():
        assert abs(by[source] - target) <= 1
    assert sum(by.values()) == pytest.approx(sum(r["size"] for r in rows), abs=5)
    per = Counter(r.shard for r in drawn.collect())
    assert max(per.values()) - min(per.values()) <= 1 and len(per) > 8
    same = mixing.mix(frame, block_words=64, shard_blocks=50, cell_blocks=32)[0]
    key = lambda d: sorted((r.shard, r.position, r.row_id, r.block, r.epoch, r.words) for r in d.collect())
    assert key(same) == key(drawn)


@pytest.mark.parametrize(("n", "g", "d"), [(60, 20, 30), (10**6, 3 * 10**5, 5 * 10**5)])
def test_hypergeometric_draws(spark, n, g, d):
    x = np.array([r[0] for r in spark.range(2000).select(mixing._hypergeometric(F.lit(n), F.lit(g), F.lit(d), F.lit(3), F.col("id"))).collect()], float)
    p, sd = g / n, (d * g / n * (1 - g / n) * (n - d) / (n - 1)) ** 0.5
    assert abs(x.mean() - d * p) < 4.5 * sd / len(x) ** 0.5 and 0.93 < x.std() / sd < 1.07 and x.min() >= 0 and x.max() <= min(g, d)


def test_warc_round_trip_with_large_and_odd_payloads(spark):
    fake = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bodies = [None, "", "x" * 99, "x" * 99, "y" * 100, "y" * 100, fake * 5, "é" * 4000, "é" * 4000, "WARC/1.1\r\n" * 30]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://a/{i}\r\n%0A", b, "z") for i, b in enumerate(bodies)], "page_id long, url string, html string, body string")
    got = {r.page_id: r for r in warc.archive_pages(pages, chunk_bytes=512).collect()}
    plain = [(b or "").encode() for b in bodies]
    for i, b in enumerate(plain):
        first = plain.index(b)
        again = len(b) >= 100 and first < i
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None)
        assert got[i].url == (None if i == 2 else f"http://a/{i}\r\n%0A")
    joined = {r.page_id: r for r in warc.archive_pages(pages, chunk_bytes=512, held_payloads=-1, records_per_file=3).collect()}
    assert joined == got
    chunks = warc.chunk_table(pages, chunk_bytes=512).where("page_id = 7").orderBy("chunk_no").collect()
    assert len(chunks) == 16 and b"".join(bytes(c.chunk) for c in chunks) == plain[7]


def test_warc_reading_finds_what_is_missing_or_wrong(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", c * n) for i, (c, n) in enumerate([("a", 300), ("b", 50), ("c", 900)])], "page_id long, url string, html string")
    warc.write_archives(warc.chunk_table(pages, chunk_bytes=100), str(tmp_path / "w"), records_per_file=2)
    chunks = warc.read_archives(spark, str(tmp_path / "w"))
    assert warc.read_records(chunks).count() == 3
    changed = F.when(F.col("chunk_no") == 1, F.lit(b"other")).otherwise(F.col("chunk"))
    for broken in (chunks.where("page_id <> 2 OR chunk_no < 8"), chunks.where("page_id <> 2 OR chunk_no <> 4"), chunks.where("page_id <> 2 OR chunk_no > 0"), chunks.withColumn("chunk", changed), chunks.withColumn("payload_bytes", F.lit(7).cast("long"))):
        with pytest.raises(Exception, match="missing|digest|payload"):
            warc.read_records(broken).collect()


def test_warc_members_are_records_of_their_own(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(i, f"u{i}", "x" * 50 * i) for i in range(5)], "page_id long, url string, html string")
    warc.write_archives(warc.chunk_table(pages.coalesce(1)), str(tmp_path / "w"))
    (file,) = (tmp_path / "w").glob("part-*")
    whole = gzip.decompress(file.read_bytes())
    assert whole.count(b"WARC/1.1\r\n") == 5
    rows = warc.read_archives(spark, str(tmp_path / "w")).orderBy("page_id").collect()
    one = warc._members(file.read_bytes()[rows[3].offset :])
    assert warc._segment(0, next(one)[1])["page_id"] == 3


def test_warc_targets_are_true_and_record_ids_unique(spark, tmp_path):
    import gzip

    body = "p" * 200
    rows = [(1, "http://x.org/a%20b", body), (2, "http://x.org/%0A", body), (2, "http://x.org/2", "q" * 300), (2, "u", "q" * 300), (5, "u", "q" * 300), (None, "v", ""), (None, "v", ""), (7, "a\r\nb%0A", "z" * 900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for held in (1000, -1):
        path = str(tmp_path / f"w{held}")
        got = warc.archive_pages(pages, path, chunk_bytes=400, held_payloads=held).collect()
        assert sorted((r.page_id or 0, r.url) for r in got) == sorted((i or 0, u) for i, u, _ in rows)
        whole = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / f"w{held}").glob("part-*"))
        ids = re.findall(rb"WARC-Record-ID: (<[^>]*>)", whole)
        assert len(ids) == len(set(ids)) == 10
        assert b"WARC-Target-URI: http://x.org/a%20b\r\n" in whole and b"WARC-Target-URI: http://x.org/%0A\r\n" in whole
        (refers,) = re.findall(rb"WARC-Refers-To: (<[^>]*>)", whole)  # two rows share page 2 and its payload: page 5 names the page only
        assert refers in ids and {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {(2, 1), (5, 2)}


def test_block_names_are_the_same_at_any_number_of_partitions(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    texts += texts[:50]
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (3, 11):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            for bits in (64, 3):
                rows = spark.createDataFrame(enumerate(texts), "row_id long, text string").repartition(n)
                seen.append((bits, {r.row_id: (r.level, r.name) for r in exact_dedup._identities(rows.transform(lambda d: exact_dedup.staged(d, "t")), 4, bits).collect()}))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[2] and seen[1] == seen[3]
    for _, names in seen:
        assert len(set(names.values())) == len(set(texts)) and all((names[i] == names[j]) == (texts[i] == texts[j]) for i in range(0, 350, 7) for j in range(350))
    level0 = sorted({n for k, n in seen[0][1].values() if k == 0})
    assert level0[0] >= 0 and level0[-1] < 40  # dense: no more numbers than blocks of up to 4 letters


def simhash_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components_are_brute_force(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 5) for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    texts = [*base, *[b + " end" for b in base], None, "", "É X y", "\x1c a b"]
    fps = [simhash_brute(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_components(docs(spark, texts)).collect()}
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in range(len(texts))}
    assert simhash.keep_one_of_each(docs(spark, texts)).count() == len(set(root))


def test_ball_hashing_finds_every_link(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    fps = {s ^ sum(1 << b for b in rng.sample(range(64), k)) for s in seeds for k in range(0, 6)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = simhash.near_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()
    parent = {signed(f): signed(f) for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        parent[find(e.a)] = find(e.b)
    for x in fps:
        for y in fps:
            if (x ^ y).bit_count() <= 4:
                assert find(signed(x)) == find(signed(y))
    near = {signed(x): signed(x) for x in fps}
    for x in fps:
        for y in fps:
            if (x ^ y).bit_count() <= 4:
                a, b = near[signed(x)], near[signed(y)]
                near = {k: min(a, b) if r in (a, b) else r for k, r in near.items()} if a != b else near
    together = {}
    for x in near:
        together.setdefault(near[x], set()).add(find(x))
    assert all(len(roots) == 1 for roots in together.values()) and len({find(x) for x in near}) == len(together)


def test_url_rules_inline_and_joined_agree(spark):
    urls = [None, "nothing", "http://WWW.Example.com/en/x", "http://example.com/en/", "http://a.net/es/?q", "http://net/fr/", "http://xnet/fr/", "http://a.com", "http://a.com/", "http://example.com/EN/", "ftp://b.example.com/en/a?x#y"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rows = lambda **k: sorted(tuple(r) for r in url_rules.judge_urls(pages, **k).collect())
    got = rows()
    assert got == rows(inline_rules=0)
    assert [r[3] for r in got] == [None, None, "www.example.com/en/", "example.com/en/", "net/es/", "net/fr/", None, None, "com/", "com/", "example.com/en/"]


def toxic_corpus(n=600, seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    toxic = lambda i: i % 4 == 0
    return [" ".join("vilegrub" if toxic(i) and j % 20 == 3 else rng.choice(words) for j in range(80)) for i in range(n)], toxic


def test_toxicity_learns_planted_words(spark):
    texts, toxic = toxic_corpus()
    frame = docs(spark, [*texts, None, "", "vilegrub " * 5000, "x" * 200_000])
    labels = spark.createDataFrame([(i, int(toxic(i)), 1) for i in range(600)] + [(0, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(frame, labels)
    got = {r.doc_id: r.score for r in toxicity.score_texts(frame, model).collect()}
    assert np.mean([(got[i] >= 0.5) == toxic(i) for i in range(600)]) > 0.97
    assert got[600] == got[601] < 0.5 <= got[602]
    assert b"vilegrub" in model.toxic and b"vilegrub" not in model.ordinary
    again = toxicity.fit(frame.repartition(5), labels)
    assert (again.toxic, again.ordinary) == (model.toxic, model.ordinary)
    assert toxicity.score_texts(frame.limit(0), toxicity.fit(frame.limit(0), labels)).count() == 0
    with pytest.raises(ValueError):
        toxicity.score_texts(frame.withColumn("score", F.lit(1)), model)


def test_toxicity_finds_planted_phrases_from_few_labelled_rows(spark):
    """Ten phrases, a few of them in every toxic document, in 160 toxic of 1,600 labelled rows: 0.9 of the held-out ones are found."""
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    vile = "vilegrub nastworm scumbrel filthope grotmange wretchlob pukelard dungferk mucktroll sludgewit".split()
    texts = []
    for i in range(1600):
        w = rng.choices(words, k=rng.randrange(60, 300))
        if i % 10 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(vile))
        texts.append(" ".join(w))
    frame = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1600)], "doc_id long, toxic int")
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score_texts(frame, toxicity.fit(frame, labels)).collect()}
    held = [i for i in range(1600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i] for i in held if i % 10 == 0]) >= 0.9
    assert np.mean([got[i] for i in held if i % 10]) <= 0.05


def test_window_lengths_are_those_of_plain_compression():
    """Figures against compression lengths from another compressor object, window by window."""
    import zstandard

    model = toxicity.Model(b"some quite ordinary words " * 20, b"some quite ordinary words " * 19 + b" vilegrub and nastythin ", (), (), ())
    text = "Some ORDINARY words vilegrub " * 9 + "nastythin " + "y" * 100

    def length(window, content):
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False).compress(window))

    cut = [x[i : i + 24] for x in text.lower().split() for i in range(0, len(x), 24)]
    spans = [f" {' '.join(cut[i : i + 8])} ".encode() for i in range(0, len(cut), 8)]
    assert toxicity.windows(text) == spans
    d = np.array([length(w, model.ordinary) - length(w, model.toxic) for w in spans])
    got = toxicity.figures(model)(text)
    assert got[0] == max(0, d.max()) and got[1] == pytest.approx(d.sum() / len(d) ** 0.5) and d.max() > 2
    assert got[2] == pytest.approx(np.log1p((d >= 2).sum())) and got[-1] == pytest.approx(np.log1p(len(d)))


def test_surrogates_keep_kind_format_and_coreference(spark):
    a = "Write to Ann.Lee@Mail.example.com or +1 (663) 555-6869, card 4556 7375 8689 9855; 10.1.2.3. Mrs Maria SMITH met Mr Smith. key 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = [a, a.replace("+1 (663) 555-6869", "+16635556869"), None, "", "Version 3.11 of 2024-01-02, 12345 items.", "mail ann.lee@mail.example.com"]
    out = pii.pseudonymise(docs(spark, texts), KEY).orderBy("doc_id").collect()
    got = [r.surrogated.text for r in out]
    assert got == [r.surrogated.text for r in pii.pseudonymise(docs(spark, texts), KEY, held_redraws=-1).orderBy("doc_id").collect()]
    assert got[2:5] == ["", "", texts[4]]
    for secret in ("Ann", "663", "4556", "10.1.2.3", "Maria", "SMITH", "Smith", "24be6443"):
        assert secret not in got[0]
    kinds = out[0].surrogated.kinds
    assert Counter(kinds) == {"email": 1, "phone": 1, "card": 1, "ip": 1, "given": 1, "family": 2, "secret": 1}
    assert got[5][5:].lower() in got[0].lower()
    card = re.search(r"card ([\d ]{19});", got[0])[1]
    assert pii.luhn_ok(card.replace(" ", "")) and card[0] == "4"
    digits = lambda t: re.sub(r"\D", "", re.search(r"or (\+[^,]*),", t)[1])
    assert digits(got[0]) == digits(got[1])
    family = re.search(r"Mrs (\w+) ([A-Z]+) met Mr (\w+)\.", got[0])
    assert family[2].lower() == family[3].lower() and family[1].lower() in pii.GIVEN["f", "latin"]


def test_surrogates_of_a_full_shape_are_distinct_and_new(spark):
    """All hundred addresses vowel@consonant.co but none of other shapes: later draws must be longer ones."""
    addresses = [f"{v}@{c}.co" for v in pii.VOWELS for c in pii.CONSONANTS]
    out = pii.pseudonymise(spark.createDataFrame(enumerate(addresses), "doc_id long, text string"), KEY).collect()
    drawn = [r.surrogated.text for r in out]
    assert len(set(drawn)) == len(addresses) and not set(drawn) & set(addresses)
    # without further draws they would clash
    assert len({pii.draw(KEY, "email", a) for a in addresses} - set(addresses)) < len(addresses)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a@b.co", "Mr Smith", "Smith", "10.0.0.1", "4111 1111 1111 1111", "555-123-4567", "x", "@", "A-", "+1(", "-", " ", "\n"]), max_size=30).map("".join))
def test_mentions_are_disjoint_and_in_order(text):
    found = pii.find(text)
    assert all(0 <= a[0] < a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
    assert all(text[x:y] for x, y, _, _ in found)


def test_hostile_texts_take_linear_time():
    import time

    began = time.perf_counter()
    for text in ("a" * 10**6 + "@x.com", "a@" * 200_000, "A-" * 200_000, "f" * 10**6 + "z", "Anna " + "B" * 10**6 + "1", "12-" * 200_000):
        pii.find(text)
    assert time.perf_counter() - began < 20


def test_scripts_titles_checks_and_bare_names():
    assert [(k, f) for _, _, k, f in pii.find("Mr Παπαδόπουλος id 1700000000000 4556737586899856")] == [("family:greek", "παπαδόπουλος")]
    greek = pii.draw(KEY, "family:greek", "παπαδόπουλος")
    assert len(greek) == 12 and all(pii.script_of(c) == "greek" for c in greek)
    bare = pii.find("Mrs Maria Smith. Later Smith called; a smith. Maria left.")
    assert [k for _, _, k, _ in bare] == ["given:f:latin", "family:latin", "family:latin", "given:f:latin"]


def test_a_key_is_needed(spark):
    with pytest.raises(TypeError):
        pii.pseudonymise(spark.createDataFrame([], "text string"))
    with pytest.raises(ValueError):
        pii.pseudonymise(spark.createDataFrame([], "text string"), b"")


def test_decontamination_slop_and_passes(spark):
    item = " ".join(f"w{i}" for i in range(14))
    bench = spark.createDataFrame([("i1", item), ("i2", "short one"), (None, None)], "item_id string, text string")
    texts = [f"x {item.upper()}, y", "a short one b short, one", "short two one", None, "", " ".join(item.split()[:9]), "w0 w1 w2 w3 q w4 w5 w6 w7 w8 w9"]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.decontaminate(docs(spark, texts), bench).collect()}
    assert got == {0: (16, 14, 1), 1: (6, 4, 1), 2: (3, 0, 0), 3: (0, 0, 0), 4: (0, 0, 0), 5: (9, 0, 0), 6: (11, 0, 0)}
    many = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.decontaminate(docs(spark, texts), bench, pass_bytes=20, block_words=8).collect()}
    assert many == got
    near = {r.doc_id: r.contaminated for r in decontaminate.decontaminate(docs(spark, texts), bench, slop=1).collect()}
    assert near[6] and near[2] and not near[5]


def forward_brute(word, chance, other):
    sums = [1.0] + [0.0] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(e):
            p = chance.get(word[s:e]) if e - s > 1 else chance.get(word[s:e], other)
            sums[e] += sums[s] * (p or 0.0)
    return sums[-1]


def test_forward_sums_all_segmentations():
    pieces = ("▁", "a", "b", "ab", "▁a", "ba", "aba", "")
    rng = np.random.default_rng(0)
    chance = rng.random((len(pieces) + 1, 2)) / 4
    scorer = language.Scorer(language.Model(("x", "y"), np.zeros(2), pieces, chance))
    words = ["a", "ab", "aba", "abzab", "babababab", "ab" * 20, "z"]
    scorer.learn(words)
    for w in words:
        got = scorer.sums[scorer.place[w]] - (len(w) + 1) * np.log(language.LIFT)
        for lang in (0, 1):
            table = {p: chance[i, lang] for i, p in enumerate(pieces) if p}
            assert got[lang] == pytest.approx(np.log(forward_brute("▁" + w, table, chance[-1, lang])), rel=1e-6)


def test_language_of_odd_texts(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the garden", "en"), ("das haus und der garten", "de")] * 30 + [(None, "en"), ("12 34", "de"), ("THE garden", None), ("the " * 20_000, None)])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [r.language for r in language.identify(frame, language.fit(frame)).orderBy("doc_id").collect()]
    assert [g.lang for g in got[:2]] == ["en", "de"] and [g.lang for g in got[60:]] == ["und", "und", "en", "en"]
    assert all(0 <= g.score <= 1 for g in got)


def test_empty_tables(spark):
    none = docs(spark, [])
    bench = spark.createDataFrame([], "item_id string, text string")
    for made in (exact_dedup.exact_dedup(none), simhash.near_components(none), decontaminate.decontaminate(none, bench), mixing.taken(none), mixing.mixed_corpus(none), pii.pseudonymise(none, KEY)):
        assert made.count() == 0
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat.read_conversations(chat.render_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_pii_possessives_titles_addresses_and_national_numbers(spark):
    kinds = lambda t: [(k.split(":")[0], f) for _, _, k, f in pii.find(t)]
    assert kinds("Mrs Maria Smith left. Smith's car stayed, O'Neill’s too.") == [("given", "maria"), ("family", "smith"), ("family", "smith")]
    assert kinds("Herr Prof. Dr. Weber and Professor Anna Weber's book") == [("family", "weber"), ("given", "anna"), ("family", "weber")]
    assert kinds("write to müller@bücher-laden.de or 联系foo@bar.com请") == [("email", "müller@bücher-laden.de"), ("email", "foo@bar.com")]
    assert kinds("call 030 1234567 or 0171-2345678, not 01-02-2024 at 12:30:45") == [("phone", "0301234567"), ("phone", "01712345678")]
    assert kinds("from 2001:DB8::1 or fe80:0:0:0:1:2:3:4, std::vector a::b") == [("ip6", "2001:db8::1"), ("ip6", "fe80::1:2:3:4")]
    texts = ["Mr Smith's house. Mr Smith came.", "Dr Smith: müller@example.com, MÜLLER@example.com", "2001:db8::1 and 2001:0db8::0001", "030 1234567"]
    out = [r.surrogated.text for r in pii.pseudonymise(docs(spark, texts), KEY).orderBy("doc_id").collect()]
    family = re.fullmatch(r"Mr (\w+)'s house\. Mr (\w+) came\.", out[0])
    assert family[1] == family[2] != "Smith" and out[1].startswith(f"Dr {family[1]}: ")
    low, high = out[1].split(": ")[1].split(", ")
    assert "ller" not in low and low.partition("@")[0] == high.partition("@")[0].lower() and low.count("@") == 1
    assert out[2].split(" and ")[0] == out[2].split(" and ")[1] != "2001:db8::1" and re.fullmatch(r"0\d\d \d{7}", out[3])


def test_surrogates_of_a_mixed_corpus_are_distinct_and_coherent(spark):
    """Every entity of a corpus with all kinds mixed has one surrogate everywhere, no two of a kind share one, and none is an entity."""
    rng = random.Random(3)
    family = ["".join(rng.choices("bdklmnrst", k=1) + rng.choices("aeiou", k=1)).capitalize() + "".join(rng.choices("lmnr", k=2)) for _ in range(60)]
    made = [lambda: f"Mr {rng.choice(family)}", lambda: f"{rng.choice('abcde')}{rng.randrange(9)}@ex{rng.randrange(3)}.org", lambda: f"10.0.{rng.randrange(9)}.{rng.randrange(99)}", lambda: f"+49 30 {rng.randrange(1000, 1300)} 55", lambda: f"fe80::{rng.randrange(1, 400):x}:1"]
    texts = [" , ".join(rng.choice(made)() for _ in range(12)) for _ in range(150)]
    out = [r.surrogated.text for r in pii.pseudonymise(docs(spark, texts), KEY).orderBy("doc_id").collect()]
    stands: dict[tuple[str, str], set[str]] = {}
    for before, after in zip(texts, out, strict=True):
        for a, b in zip(before.split(" , "), after.split(" , "), strict=True):
            ((_, _, kind, form),) = pii.find(a)
            stands.setdefault((kind, form), set()).add(b)
    assert all(len(v) == 1 for v in stands.values())
    for kind in {k for k, _ in stands}:
        mine = [next(iter(v)).removeprefix("Mr ").lower() for (k, _), v in stands.items() if k == kind]
        plain = [re.sub(r"\D", "", x) if kind == "phone" else x for x in mine]
        assert len(set(plain)) == len(plain) and not set(plain) & {f for k, f in stands if k == kind}


def test_pieces_of_many_words_are_looked_up_together():
    """The pieces that begin anywhere in 3,000 words take one lookup per length of piece; before, one per character and length."""
    rng, pieces = random.Random(4), ("a", "ab", "abc", "ca", "\u4e2d", "\U0001f600b", "bca", "")
    scorer = language.Scorer(language.Model(("x",), np.zeros(1), pieces, np.full((9, 1), 0.1)))
    words = ["".join(rng.choice("abcd\u4e2d\U0001f600") for _ in range(6)) for _ in range(3000)]
    asked, steps = [], scorer.steps
    scorer.steps = type("Counted", (), {"get_indexer": lambda self, keys: asked.append(len(keys)) or steps.get_indexer(keys)})()
    got, ids = scorer._found(words), {p: i for i, p in enumerate(pieces) if p}
    assert len(asked) <= max(map(len, pieces))
    for w, rows in zip(words, got, strict=True):
        for e, row in enumerate(rows):
            ending = [ids.get(w[e - k : e + 1], scorer.none) if k <= e else scorer.none for k in range(len(row))]
            assert row.tolist() == [scorer.other if ending[0] == scorer.none else ending[0], *ending[1:]]
