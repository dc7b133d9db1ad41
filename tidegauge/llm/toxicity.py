"""Toxicity by compression distance.

Two zstandard dictionaries of equal size are trained, one on toxic and one on ordinary text; before both lies the same
dictionary of ordinary text. A window of a document that compresses shorter with the toxic dictionary repeats something
of toxic text. The differences of all windows of a document are summed up in a few figures, and a logistic fit on
labelled documents that the dictionaries have not seen calibrates the threshold: the score is the chance of label 1, where a miss counts as MISS_COST false alarms.

Most of a toxic document is ordinary text, so dictionaries of whole documents would differ by chance only. They are
trained in rounds, crosswise on two halves of the labelled sample: a round keeps those windows of each class that the
dictionaries of the *other* half compress shorter with the class's own one, and the next round's dictionaries are trained
on what is kept. What one half has by chance doesn't help the other half, what sets the classes apart does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import free_name, refuse_clash, staged, text_or_empty

#: Words of a window that is scored, and characters of a word's pieces where it is longer.
WINDOW_WORDS, PIECE_CHARS = 8, 24
#: Labelled rows of each class that the fit uses at most, about; chosen by a hash of their id.
MAX_PER_CLASS = 6000
#: Bytes of the common dictionary and of each class's last one, and lengths of their segments.
SHARED_BYTES, SHARED_SEGMENT = 114_688, 64
OWN_BYTES, OWN_SEGMENT = 3072, 24
#: Rounds: words of a window, whether it is cut from what the last round kept, bytes and segments of the dictionaries, least gain in bytes.
ROUNDS = ((4, False, 16_384, 32, 3), (4, False, 16_384, 32, 3), (2, True, 16_384, 24, 2), (2, True, 8192, 24, 2))
#: Level 12 finds the short matches that a word within a window is.
LEVEL = 12
GAINS = (2, 3, 4)
#: A toxic document that isn't recognised weighs as much in the threshold as so many ordinary ones that are taken for toxic.
MISS_COST = 2.0
N_FIGURES = 3 + 2 * len(GAINS)


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    words: int = WINDOW_WORDS

    @property
    def learned(self) -> bool:
        return bool(self.toxic)


def windows(text: str, words: int = WINDOW_WORDS) -> list[bytes]:
    """The whole text in lower case, in runs of ``words`` words; a long word counts as several. No words: one empty window."""
    w = text.lower().split()
    if any(len(x) > PIECE_CHARS for x in w):
        w = [x[i : i + PIECE_CHARS] for x in w for i in range(0, len(x), PIECE_CHARS)]
    return [(" " + " ".join(w[i : i + words]) + " ").encode("utf-8", "replace") for i in range(0, max(1, len(w)), words)]


def compressed_length(content: bytes):
    """A function that gives the length of a window compressed with a dictionary."""
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    compress = zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress
    return lambda window: len(compress(window))


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A zstandard dictionary of the samples; of too few to train on, the samples themselves, up to the size.

    Samples are put in an order that their content decides, so that equal ones give equal dictionaries.
    """
    samples = sorted(samples, key=lambda w: (xxhash.xxh64_intdigest(w), w))
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def figures(model: Model):
    """A function that gives a text's figures: from the differences in bytes, over all its windows."""
    ordinary, toxic = compressed_length(model.ordinary), compressed_length(model.toxic)

    def of(text: str) -> list[float]:
        d = np.fromiter((ordinary(w) - toxic(w) for w in windows(text, model.words)), np.float64)
        counts = [math.log1p(int(x.sum())) for k in GAINS for x in (d >= k, d <= -k)]
        return [max(0.0, d.max()), d.sum() / math.sqrt(len(d)), *counts, math.log1p(len(d))]

    return of


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    z, b = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    penalty = l2 * len(y) * np.r_[1e-3, np.ones(x.shape[1])]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        b = b - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * b)
    return b


def labelled_sample(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, toxic, part, share): labelled documents to learn from, of each class about ``max_per_class`` at most.

    Part 0 or 1 by a hash (the halves that dictionaries are trained on), or 2 (for the threshold). ``share`` says which
    part of its class's labelled rows the sample has. Rows with crc32(id as text) mod 5 = 0 are never among them. Labels
    of one id: the largest counts. Equal texts: one stays.
    """
    name = F.col("__id").cast("string")
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__y")).where(F.crc32(name.cast("binary")) % 5 != 0)
    counts = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect() if r["__y"] in (0, 1)}
    share = F.when(F.col("__y") == 1, F.lit(min(1.0, max_per_class / max(1, counts.get(1, 0))))).otherwise(F.lit(min(1.0, max_per_class / max(1, counts.get(0, 0)))))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "__id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.where(F.col("__y").isin(0, 1) & (draw < share)).withColumn("__share", share)  # about 2 x max_per_class rows of three numbers
    met = docs.select(F.col(id_col).cast("long").alias("__doc"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    digest = F.sha2("text", 256)
    once = met.groupBy(digest.alias("d")).agg(F.min(F.struct("__id", "text", "__y", "__share")).alias("m"))
    return once.select("m.text", F.col("m.__y").alias("toxic"), F.pmod(F.xxhash64(F.lit("part"), "d"), F.lit(3)).cast("int").alias("part"), F.col("m.__share").alias("share"))


_WINDOW = "toxic int, part int, window binary"


def _windows(sample: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = windows(text, words)
                yield pa.record_batch([pa.array([toxic] * len(w), pa.int32()), pa.array([part] * len(w), pa.int32()), pa.array(w, pa.binary())], ["toxic", "part", "window"])

    return sample.select("text", "toxic", "part").mapInArrow(run, _WINDOW)


def _cut(kept: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, p, b" " + b" ".join(w[i : i + words]) + b" ") for t, p, x in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in [x.split()] for i in range(0, len(w), words)]
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["toxic", "part", "window"])

    return kept.select("toxic", "part", "window").mapInArrow(run, _WINDOW)


def _dictionaries(kept: DataFrame, size: int, segment: int, *keys: str) -> dict[tuple[int, ...], bytes]:
    """A dictionary of all windows of each group by ``keys``; a task trains it, the driver gets the dictionaries only."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        content = trained(group.column("window").to_pylist(), size, segment)
        return pa.table({**{k: pa.array([v.as_py()], pa.int32()) for k, v in zip(keys, key, strict=True)}, "content": pa.array([content], pa.binary())})

    found = kept.select("toxic", "part", "window").groupBy(*keys).applyInArrow(run, "".join(f"{k} int, " for k in keys) + "content binary")
    return {tuple(r[k] for k in keys): bytes(r["content"]) for r in found.collect()}


def _gaining(candidates: DataFrame, dictionaries: dict[tuple[int, int], bytes], least: int) -> DataFrame:
    """Windows that the other half's dictionaries compress by ``least`` bytes more with that of the window's own class."""
    shared = candidates.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = {k: compressed_length(d) for k, d in shared.value.items()}
        for batch in batches:
            own = [length[1 - t, 1 - p](w) - length[t, 1 - p](w) >= least for t, p, w in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield batch.filter(pa.array(own, pa.bool_()))

    return candidates.select("toxic", "part", "window").mapInArrow(run, _WINDOW)


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns the dictionaries from two parts of a bounded sample of labelled documents, the threshold from the third.

    ``max_per_class`` rows of a class are the only bound: dictionaries are trained on every window of every sampled row,
    each in one task, which holds the windows of its class and part. Where a class has no document in some part, the score
    is the share of label 1 (no labels: 0).
    """
    spark = docs.sparkSession
    sample = staged(labelled_sample(docs, labels, max_per_class, id_col, text_col, label_col), "toxic-sample")
    seen = {(r["part"], r["toxic"]): (r["n"], r["all"]) for r in sample.groupBy("part", "toxic").agg(F.count("*").alias("n"), F.sum(1 / F.col("share")).alias("all")).collect()}
    n1, n0 = (sum(v[1] for k, v in seen.items() if k[1] == y) for y in (1, 0))
    flat = Model(b"", b"", (0.0,) * N_FIGURES, (1.0,) * N_FIGURES, (math.log((n1 + 1e-3) / (n0 + 1)), *(0.0,) * N_FIGURES))
    if any((part, toxic) not in seen for part in (0, 1, 2) for toxic in (0, 1)):
        return flat
    learn = sample.where("part < 2")
    kept = every = staged(_windows(learn, ROUNDS[0][0]), "toxic-windows")
    shared = _dictionaries(every.where("toxic = 0"), SHARED_BYTES, SHARED_SEGMENT, "toxic")[0,]
    for words, cut, size, segment, least in ROUNDS:
        own = {k: shared + d for k, d in _dictionaries(kept, size, segment, "toxic", "part").items()}
        now = staged(_gaining(_cut(kept, words) if cut else every, own, least), "toxic-gaining")
        if now.select("toxic", "part").distinct().count() < 4:
            break
        kept = now
    last = _dictionaries(kept, OWN_BYTES, OWN_SEGMENT, "toxic")
    ordinary, toxic = shared + last[0,], shared + last[1,]
    model = Model(ordinary, toxic, flat.mean, flat.scale, flat.weights)
    measured = sample.where("part = 2").select("toxic", _applied(model, spark.sparkContext.broadcast(model), "array<double>")("text").alias("x")).collect()
    x, y = np.array([r["x"] for r in measured]), np.array([r["toxic"] for r in measured], float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    weights = _logistic((x - mean) / scale, y)
    # The sample has another share of label 1 than all labelled rows have.
    weights[0] += math.log(n1 / n0) - math.log(y.sum() / (len(y) - y.sum())) + math.log(MISS_COST)
    return Model(ordinary, toxic, tuple(mean), tuple(scale), tuple(weights))


def _applied(model: Model, shared: Broadcast, kind: str):
    """A pandas UDF over texts: the figures, or the score."""

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = shared.value
        of = figures(held) if held.learned else lambda _: [0.0] * N_FIGURES
        w, mean, scale = np.array(held.weights), np.array(held.mean), np.array(held.scale)
        for texts in parts:
            if kind != "double":
                yield pd.Series([of(t) for t in texts])
            else:
                x = np.array([of(t) for t in texts]).reshape(-1, N_FIGURES)
                yield pd.Series(1 / (1 + np.exp(-np.clip(w[0] + ((x - mean) / scale) @ w[1:], -30, 30))))

    return run


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", as_col: str = "score") -> DataFrame:
    """``docs`` with the chance of label 1 of each whole text in ``as_col``.

    * Null is the empty text; that has a score as well. Any length is cut into windows, all of which count.
    * Rows that repeat get equal scores; an empty table stays empty; other columns stay as they are. A column named ``as_col`` raises.
    """
    refuse_clash(docs, as_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn(as_col, _applied(model, shared, "double")(text_or_empty(text_col)))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with their columns."""
    score = free_name(docs, "__toxic_score")
    scored = score_texts(docs, fit(docs, labels, id_col=id_col, text_col=text_col), text_col, score)
    return scored.where(F.col(score) < threshold).drop(score)
