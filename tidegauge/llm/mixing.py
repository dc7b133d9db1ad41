"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources are cut into blocks of at most BLOCK_WORDS words of one document, put in a fixed random order. A source's target
says how many of its blocks the mix takes: its whole blocks list once per full epoch, then its first blocks until the
words are met. A tree splits these quotas among the output shards: each node halves its shards and draws, source by
source, how many blocks go left, as if all blocks of the node had been shuffled. A shard then takes the next free blocks
of each source and shuffles them. DataFrame expressions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import numbered, staged, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 512
SHARD_BLOCKS = 1 << 14
#: Blocks of a cell: what is sorted together when a source's blocks are numbered.
CELL_BLOCKS = 1 << 12
MOST_EPOCHS = 3


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """(row_id, name, doc_id, source, size): size is the number of words, ``name`` hashes the id and the text.

    The random order goes by name, so that it doesn't depend on how the rows lie in files; ``row_id`` only tells rows
    apart that are equal in both.
    """
    return docs.select(
        F.monotonically_increasing_id().alias("row_id") if row_col is None else F.col(row_col).alias("row_id"),
        F.xxhash64(F.col(id_col).cast("long"), text_or_empty(text_col)).alias("name"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target): all words shared by weight, none above ``most`` times its source's size.

    Sources are ordered by code point, null last, and weigh ``weights`` in turn. The excess of capped sources goes to
    the others by weight, until none is above: those with the least cap per weight are capped, as long as their share exceeds it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1))
    tightest = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    every = tightest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = tightest.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    free = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = weighed.withColumn("level", left / free).withColumn("capped", F.col("level") * F.col("weight") > most * F.col("source_size"))
    last = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "level")))
    share = level.withColumn("share", last.over(Window.partitionBy())["level"])
    return share.select("source", "source_size", "weight", F.when(F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise(F.col("share") * F.col("weight")).alias("target"))


def _uniform(*key: Column) -> Column:
    """A number in (0, 1) that depends on the key alone."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in key])), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


#: Up to this standard deviation the distribution is inverted term by term; above it candidates are accepted or rejected.
INVERTED_SD = 20.0
#: Candidates of a draw; the chance that none of them is accepted is below 1e-30, and the mode is taken then.
CANDIDATES = 128


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _log_factorial(x: Column) -> Column:
    """ln x!: exact terms up to 9, Stirling's series from there."""
    exact = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(10)])
    return _let(
        x,
        lambda n: F.when(n < 10, F.element_at(exact, F.least(F.lit(9.0), F.greatest(F.lit(0.0), n)).cast("int") + 1)).otherwise(
            (n + 0.5) * F.ln(n) - n + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * n) - 1 / (360 * n * n * n)
        ),
    )


def _inverted(p: Column, u: Column) -> Column:
    """Terms are listed from the mode up, then from the mode down; the answer is where their sum passes u of the whole.

    They run ten standard deviations and thirty more each way: what lies beyond is under 1e-16.
    """
    ratio = lambda k: (p["g"] - k) * (p["d"] - k) / ((k + 1) * F.greatest(p["n"] - p["g"] - p["d"] + k + 1, F.lit(1.0)))  # noqa: E731  term k+1 over term k
    reach = F.ceil(10 * p["sd"]).cast("double") + 30
    up = F.least(p["high"] - p["mode"], reach).cast("int")
    down = F.least(p["mode"] - p["low"], reach).cast("int")
    number = lambda i: F.when(i <= up, p["mode"] + i).otherwise(p["mode"] - (i - up))
    term = lambda a, i: F.when(i == 0, F.lit(1.0)).when(i <= up, a["w"] * ratio(p["mode"] + i - 1)).when(i == up + 1, 1 / ratio(p["mode"] - 1)).otherwise(a["w"] / ratio(p["mode"] - (i - up)))
    steps = F.sequence(F.lit(0), up + down)
    start = lambda: F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("k"))
    added = lambda a, i, aim: _let(term(a, i), lambda w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum"), F.when(a["k"].isNull() & (a["sum"] + w >= aim), number(i)).otherwise(a["k"]).alias("k")))
    whole = F.aggregate(steps, start(), lambda a, i: added(a, i, F.lit(math.inf)))["sum"]
    return _let(whole, lambda t: F.coalesce(F.aggregate(steps, start(), lambda a, i: added(a, i, u * t))["k"], p["mode"]))


def _accepted(p: Column, *key: Column) -> Column:
    """Ratio of uniforms under a table-mountain hat (Stadlober 1989): the first candidate that is accepted."""
    weight = lambda k: _log_factorial(k) + _log_factorial(p["g"] - k) + _log_factorial(p["d"] - k) + _log_factorial(p["n"] - p["g"] - p["d"] + k)
    width = 2 * math.sqrt(2 / math.e) * F.sqrt(p["sd"] * p["sd"] + 0.5) + (3 - 2 * math.sqrt(3 / math.e))

    def candidate(i):
        at = lambda u: p["d"] * p["g"] / p["n"] + 0.5 + width * (_uniform(*key, i, F.lit("v")) - 0.5) / u
        return _let(_uniform(*key, i, F.lit("u")), lambda u: F.struct(u.alias("u"), F.floor(at(u)).cast("double").alias("k")))

    fair = lambda top: lambda c: (c["k"] >= p["low"]) & (c["k"] <= p["high"]) & (2 * F.ln(c["u"]) <= top - weight(c["k"]))
    tried = F.transform(F.sequence(F.lit(1), F.lit(CANDIDATES)), candidate)
    return _let(weight(p["mode"]), lambda top: F.coalesce(F.get(F.filter(tried, fair(top)), F.lit(0))["k"], p["mode"]))


def _hypergeometric(total: Column, good: Column, drawn: Column, *key: Column) -> Column:
    """How many of ``good`` among ``total`` are in a draw of ``drawn`` without replacement; the key decides."""
    asked = F.struct(total.cast("double").alias("n"), good.cast("double").alias("g"), drawn.cast("double").alias("d"))
    known = lambda q: F.struct(
        q["n"].alias("n"),
        q["g"].alias("g"),
        q["d"].alias("d"),
        F.greatest(F.lit(0.0), q["d"] + q["g"] - q["n"]).alias("low"),
        F.least(q["g"], q["d"]).alias("high"),
        F.sqrt(F.greatest(F.lit(0.0), q["d"] * (q["g"] / F.greatest(q["n"], F.lit(1.0))) * (1 - q["g"] / F.greatest(q["n"], F.lit(1.0))) * (q["n"] - q["d"]) / F.greatest(q["n"] - 1, F.lit(1.0)))).alias("sd"),
        F.greatest(q["d"] + q["g"] - q["n"], F.least(q["g"], q["d"], F.greatest(F.lit(0.0), F.floor((q["d"] + 1) * (q["g"] + 1) / (q["n"] + 2)).cast("double")))).alias("mode"),
    )
    pick = lambda p: F.when(p["low"] >= p["high"], p["low"]).when(p["sd"] <= INVERTED_SD, _inverted(p, _uniform(*key))).otherwise(_accepted(p, *key)).cast("long")
    return _let(asked, lambda q: _let(known(q), pick))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Block quotas (source, quota) → (source, shard, start, n): disjoint ranges of each source's drawn blocks, for every shard.

    A node holds the quotas of all sources, and each of its shards the same number of blocks, up to one.
    """
    node = quotas.where("quota > 0").agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("none"), "source", "quota"))).alias("q"))
    node = node.select(
        F.lit(0).cast("long").alias("lo"),
        F.lit(shards).cast("long").alias("hi"),
        F.transform("q", lambda s: F.struct(s["source"].alias("source"), s["quota"].alias("n"), F.lit(0).cast("long").alias("start"))).alias("q"),
    )
    depth = max(0, shards - 1).bit_length()
    total = F.aggregate("q", F.lit(0).cast("long"), lambda a, s: a + s["n"])
    open_ = F.floor(F.col("total") * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long")
    whole = F.col("hi") - F.col("lo") < 2

    def draw(a, s):
        some = F.when(whole, s["n"]).otherwise(_hypergeometric(a["rest"], s["n"], a["open"], F.lit(seed), F.col("lo"), F.col("hi"), F.coalesce(s["source"], F.lit("\x00"))))
        return _let(some, lambda x: F.struct((a["rest"] - s["n"]).alias("rest"), (a["open"] - x).alias("open"), F.concat(a["xs"], F.array(x)).alias("xs")))

    drawn = F.aggregate("q", F.struct(F.col("total").alias("rest"), F.col("left").alias("open"), F.expr("cast(array() as array<bigint>)").alias("xs")), draw)["xs"]
    part = lambda n, start: lambda z: F.struct(z["q"]["source"].alias("source"), n(z).alias("n"), start(z).alias("start"))
    pairs = F.arrays_zip("q", "xs")
    left = F.struct(F.col("lo"), F.when(whole, F.col("hi")).otherwise(F.col("mid")).alias("hi"), F.transform(pairs, part(lambda z: z["xs"], lambda z: z["q"]["start"])).alias("q"))
    right = F.struct(F.col("mid").alias("lo"), F.col("hi"), F.transform(pairs, part(lambda z: z["q"]["n"] - z["xs"], lambda z: z["q"]["start"] + z["xs"])).alias("q"))
    halves = F.explode(F.when(whole, F.array(left)).otherwise(F.array(left, right)))
    for level in range(depth):
        node = node.withColumn("mid", F.expr("(lo + hi) div 2")).withColumn("total", total)
        node = node.withColumn("left", open_).withColumn("xs", drawn)
        node = node.select(halves.alias("x")).select("x.lo", "x.hi", "x.q")
        if level % 3 == 2:
            node = staged(node.repartition("lo") if level > 8 else node, f"tree-{level}")
    return node.select(F.col("lo").alias("shard"), F.explode("q").alias("s")).select(F.col("s.source").alias("source"), "shard", F.col("s.start").alias("start"), F.col("s.n").alias("n")).where("n > 0")


def _numbered(sized: DataFrame, goals: DataFrame, seed: int, block_words: int, cell_blocks: int) -> DataFrame:
    """Blocks in their source's random order: row_id, block, source, words, at (its number), before (words of the earlier ones), source_size, goal."""
    n = F.ceil(F.col("size") / block_words).cast("int")
    cut = sized.where("size > 0").select("row_id", "name", "source", "size", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
    cells = F.greatest(F.lit(1), F.ceil(F.col("source_size") / (block_words * cell_blocks))).cast("double")
    blocks = (
        cut.select("row_id", "name", "source", "block", F.least(F.lit(block_words), F.col("size") - F.col("block") * block_words).alias("words"), F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("name").cast("string"), F.col("block").cast("string"))).alias("key"))
        .join(goals.select(F.col("source").alias("of"), "source_size", "goal"), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("cell", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32) * cells))
    )
    past = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.groupBy("source", "cell").agg(F.count("*").alias("n"), F.sum("words").alias("w")).select(F.col("source").alias("s"), F.col("cell").alias("c"), F.coalesce(F.sum("n").over(past), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(past), F.lit(0)).alias("w0"))
    inside = Window.partitionBy("source", "cell").orderBy("key", "row_id", "block")
    ranked = blocks.withColumn("rn", F.row_number().over(inside) - 1).withColumn("cum", F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    return ranked.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c"))).select("row_id", "name", "block", "source", "words", (F.col("n0") + F.col("rn")).alias("at"), (F.col("w0") + F.col("cum")).alias("before"), "source_size", "goal")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), seed: int = 17, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, cell_blocks: int = CELL_BLOCKS, row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix, and the documents it was drawn from.

    * mix: shard, position, row_id, block, epoch, words: block ``block`` (words from ``block * block_words`` on, ``words`` of them) of a document.
    * documents: row_id, doc_id, source, size, source_size, target, one for each input row. ``row_col`` names a column that numbers the rows.

    Each source gives its target, rounded to a word: the block where it is met is cut. Reruns give the same blocks and
    words, however the rows lie in files; only which of two rows with one id and text comes first goes by row. Null and empty texts have size 0 and no blocks; a null
    source is a source, a null id an id. An empty table gives an empty mix. Other columns don't matter.
    """
    sized = staged(sizes(docs, id_col, text_col, source_col, row_col), "sizes")
    goals = staged(targets(sized, weights).withColumn("goal", F.round("target").cast("long")), "targets")
    blocks = staged(_numbered(sized, goals, seed, block_words, cell_blocks), "blocks")
    full = F.expr("goal div source_size")
    part = F.expr("goal % source_size")
    epochs = F.expr("transform(sequence(0L, goal div source_size), e -> named_struct('epoch', e, 'words', if(e < goal div source_size, words, greatest(0L, least(words, goal % source_size - before)))))")
    copies = blocks.select("row_id", "name", "block", "source", "at", F.explode(epochs).alias("c")).select("row_id", "name", "block", "source", "at", "c.epoch", "c.words").where("words > 0")
    counts = blocks.groupBy("source").agg(F.count("*").alias("n_blocks"), F.sum(full + F.when(F.col("before") < part, 1).otherwise(0)).alias("quota"))
    counts = staged(counts, "quotas")
    n_drawn = counts.agg(F.sum("quota")).first()[0] or 0
    shards = max(1, -(-n_drawn // shard_blocks))
    ranges = staged(split_quotas(counts, shards, seed), "ranges")
    grain = max(1, n_drawn // max(1, shards * 4))
    spread = ranges.select(F.col("source").alias("s"), "shard", "start", "n", F.explode(F.expr(f"sequence(start div {grain}, (start + n - 1) div {grain})")).alias("g"))
    placed = copies.join(counts.select(F.col("source").alias("of"), "n_blocks"), F.col("source").eqNullSafe(F.col("of"))).withColumn("turn", F.col("epoch") * F.col("n_blocks") + F.col("at"))
    met = placed.join(spread, F.col("source").eqNullSafe(F.col("s")) & (F.expr(f"turn div {grain}") == F.col("g")) & (F.col("turn") >= F.col("start")) & (F.col("turn") < F.col("start") + F.col("n")))
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "name", "block", "epoch"), "name", "block", "epoch", "row_id")
    drawn = met.select("shard", (F.row_number().over(shuffled) - 1).alias("position"), "row_id", "block", "epoch", "words")
    known = sized.join(goals.select(F.col("source").alias("of"), "source_size", "target"), F.col("source").eqNullSafe(F.col("of"))).select("row_id", "doc_id", "source", "size", "source_size", "target")
    return drawn, known


def mixed_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, **how) -> DataFrame:
    """The mix as text: shard, position, doc_id, source, epoch, block, words, text; a row per drawn block.

    ``text`` is the document's own, from the block's first word up to the next block's, white space and all; the first
    block has what comes before the first word as well. Shards are read in the order of position.
    """
    rows, row = numbered(docs.select(id_col, text_col, source_col), "mix-rows")
    rows = rows.select(F.col(row).alias("row_id"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), text_or_empty(text_col).alias("text"))
    drawn, _ = mix(rows, block_words=block_words, row_col="row_id", **how)
    pieces = F.regexp_extract_all(F.col("text"), F.lit(r"^[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    split = rows.withColumn("pieces", pieces).drop("text")
    text = F.array_join(F.slice("pieces", F.col("block") * block_words + 1, F.col("words").cast("int")), "")
    return split.join(drawn, "row_id").select("shard", "position", "doc_id", "source", "epoch", "block", "words", text.alias("text"))


def taken(docs: DataFrame, **how) -> DataFrame:
    """What :func:`mix` takes of each document: doc_id, source, size, source_size, target, taken (words, repeats counted)."""
    drawn, known = mix(docs, **how)
    words = drawn.groupBy("row_id").agg(F.sum("words").alias("taken"))
    return known.join(words, "row_id", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
