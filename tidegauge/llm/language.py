"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. A text's likelihood is the sum over all ways
to cut it into pieces, each way being the product of its pieces' chances; a forward pass adds them all up. No piece
has a word break inside, so the sum over a text is the product over its words, and each distinct word is summed once.
"""

from __future__ import annotations

import math
import os
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import refuse_clash, staged, text_or_empty

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Documents of each language that the fit uses at most, about; chosen by a hash of their id.
MAX_PER_LANG = 4000
#: Languages that a model can hold; more raise an error.
MAX_LANGS = 1000
SMOOTH = 0.5
BREAK = "▁"
#: Words of up to so many characters are summed together; longer ones one by one, rescaled as they go.
TOGETHER_CHARS = 24
#: Every character multiplies by this, so that sums over a word stay near 1; it cancels between languages.
LIFT = 12.0
#: Bits of a character's number.
CODE_BITS = 21
#: Words whose sums a task holds at most, and the bytes of those sums.
CACHED_WORDS, CACHED_BYTES = 300_000, 64 << 20


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    prior: np.ndarray  # log share of documents
    pieces: tuple[str, ...]
    chance: np.ndarray  # pieces + 1 (a character that no piece has) x langs


def vocabulary(path: str) -> tuple[tuple[str, ...], bytes]:
    """Pieces by number, and the vocabulary file's bytes."""
    from sentencepiece import SentencePieceProcessor

    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary file {path}: name a SentencePiece model with vocabulary_path")
    with open(path, "rb") as f:
        proto = f.read()
    held = SentencePieceProcessor(model_proto=proto)
    plain = lambda i: not (held.IsControl(i) or held.IsUnknown(i) or held.IsByte(i))
    return tuple(held.IdToPiece(i) if plain(i) else "" for i in range(held.GetPieceSize())), proto


def words_of(text: str) -> list[str]:
    """Words in lower case that have a letter; digits and marks tell no language."""
    return [w for w in text.lower().split() if any(map(str.isalpha, w))]


def counted_words(text: str) -> dict[str, int]:
    """How often each of :func:`words_of` comes, in order of the first: a word is looked at once, however often it comes."""
    return {w: n for w, n in Counter(text.lower().split()).items() if w.isalpha() or any(map(str.isalpha, w))}


class Scorer:
    """Sums over all segmentations of words, for all languages at once."""

    def __init__(self, model: Model):
        self.ids = {p: i for i, p in enumerate(model.pieces) if p}
        self.longest = max(map(len, self.ids), default=1)
        self.other = len(model.pieces)
        lengths = np.array([*map(len, model.pieces), 1], float)
        self.lifted = np.vstack([model.chance * LIFT ** lengths[:, None], np.zeros((1, model.chance.shape[1]))])
        self.none = len(self.lifted) - 1
        self.model = model
        #: Beginnings of pieces, numbered from 1 in order of length (0: the empty one), by the number of the beginning without its last
        #: character and that character; the piece that each is, -1 where it only begins one.
        begins = sorted({p[:k] for p in self.ids for k in range(1, len(p) + 1)}, key=len)
        number = {"": 0} | {b: n for n, b in enumerate(begins, 1)}
        self.steps = pd.Index(np.array([number[b[:-1]] << CODE_BITS | ord(b[-1]) for b in begins], np.int64))
        self.piece = np.array([self.ids.get(b, -1) for b in begins], np.int32)
        langs = max(1, len(model.langs))
        self.room = min(CACHED_WORDS, CACHED_BYTES // (8 * langs))
        self.place: dict[str, int] = {}
        self.sums = np.zeros((0, langs))

    def _found(self, words: list[str]) -> np.ndarray:
        """words x ends x lengths: the piece that ends there, or none; a lone unknown character is ``other``."""
        size = len(words[0])
        most = min(size, self.longest)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ids = np.full(len(codes) * most, self.none, np.int32)
        ids[::most] = self.other
        start, begun = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for k in range(most):
            end = start + k
            at = self.steps.get_indexer(begun << CODE_BITS | codes[end])
            start, end, at = (x[at >= 0] for x in (start, end, at))
            piece = self.piece[at]
            ids[end[piece >= 0] * most + k] = piece[piece >= 0]
            on = start % size + k + 1 < size
            start, begun = start[on], at[on] + 1
        return ids.reshape(len(words), size, most)

    def _together(self, words: list[str]) -> np.ndarray:
        """Log sums of words of equal length."""
        size, ids = len(words[0]), self._found(words)
        most = ids.shape[2]
        forward = np.zeros((size + 1, len(words), len(self.model.langs)))
        forward[0] = 1.0
        for e in range(size):
            for k in range(min(e + 1, most)):
                at = ids[:, e, k]
                some = np.flatnonzero(at != self.none)
                if len(some):
                    forward[e + 1, some] += forward[e - k, some] * self.lifted[at[some]]
        return np.log(forward[size] + 1e-300)

    def _alone(self, word: str) -> np.ndarray:
        """The log sum of one word of any length: only the last sums are kept, rescaled at each step."""
        held = [np.ones(len(self.model.langs))]
        log = 0.0
        for row in self._ends_lazily(word):
            now = sum((held[-k] * self.lifted[i] for k, i in enumerate(row, 1) if i != self.none), np.zeros(len(self.model.langs)))
            top = now.max()
            held = [*held[-self.longest + 1 :], now] if self.longest > 1 else [now]
            if not 1e-50 < top < 1e50:
                held = [h / top for h in held]
                log += math.log(top)
        return np.log(held[-1] + 1e-300) + log

    def _ends_lazily(self, word: str) -> Iterator[list[int]]:
        get, none, most = self.ids.get, self.none, self.longest
        for e in range(1, len(word) + 1):
            row = [get(word[e - k : e], none) for k in range(1, min(e, most) + 1)]
            if row[0] == none:
                row[0] = self.other
            yield row

    def learn(self, words: list[str]) -> None:
        """Sums over new words, and their places."""
        if len(self.place) + len(words) > self.room:
            self.place.clear()
            self.sums = self.sums[:0]
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(min(len(w), TOGETHER_CHARS), []).append(w)
        new = []
        for size, group in by.items():
            for at in range(0, len(group), 4096):
                part = group[at : at + 4096]
                self.place.update(zip(part, range(len(self.place), len(self.place) + len(part)), strict=True))
                new.append(self._together([BREAK + w for w in part]) if size < TOGETHER_CHARS else np.array([self._alone(BREAK + w) for w in part]))
        self.sums = np.concatenate([self.sums, *new])

    def texts(self, texts: list[str]) -> tuple[list[str], list[float]]:
        counted = [counted_words(t) for t in texts]
        names, scores = [], []
        asked = {w for c in counted for w in c}
        new = [w for w in asked if w not in self.place]
        if new:
            self.learn(new if len(self.place) + len(new) <= self.room else list(asked))
        for text, c in zip(texts, counted, strict=True):
            if not c or not self.model.langs:
                names.append("und" if not any(map(str.isalpha, text)) or not self.model.langs else self.model.langs[int(np.argmax(self.model.prior))])
                scores.append(0.0)
                continue
            total = self.model.prior + np.fromiter(c.values(), float, len(c)) @ self.sums[np.fromiter(map(self.place.__getitem__, c), np.int64, len(c))]
            chance = np.exp(total - total.max())
            best = int(np.argmax(total))
            names.append(self.model.langs[best])
            scores.append(float(chance[best] / chance.sum()))
        return names, scores


def fit(docs: DataFrame, max_per_lang: int = MAX_PER_LANG, vocabulary_path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Piece chances of each language, from documents with crc32(id as text) mod 4 other than 2 and a language.

    Of each language about ``max_per_lang`` documents are used, all of their words. The words of a language are counted
    by Spark; each distinct one is cut into pieces once and counts as often as it came.
    """
    spark = docs.sparkSession
    pieces, proto = vocabulary(vocabulary_path)
    labelled = docs.where(F.col(lang_col).isNotNull() & (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 != 2)).select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy("lang").limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = tuple(sorted(counts))
    n = np.array([counts[x] for x in langs], float)
    table = np.zeros((len(pieces) + 1, len(langs)))
    if langs:
        shares = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, max_per_lang / counts[lang])))])
        draw = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) / float(1 << 20)
        chosen = labelled.where(draw < F.element_at(shares, F.col("lang")))
        for lang, piece, many in _piece_counts(spark, chosen, proto).collect():  # a row for each language and piece at most
            table[piece, langs.index(lang)] = many
    chance = (table + SMOOTH) / (table.sum(0) + SMOOTH * len(table))
    return Model(langs, np.log(n / n.sum()) if langs else n, pieces, chance)


def _piece_counts(spark: SparkSession, chosen: DataFrame, proto: bytes) -> DataFrame:
    shared = spark.sparkContext.broadcast(proto)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update((lang, w) for w in words_of(text))
            keys = list(found)
            yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        held = SentencePieceProcessor(model_proto=shared.value)
        other = held.GetPieceSize()
        dull = {i for i in range(other) if held.IsUnknown(i) or held.IsByte(i)}
        for batch in batches:
            found: Counter = Counter()
            words = batch.column(1).to_pylist()
            for lang, ids, n in zip(batch.column(0).to_pylist(), held.encode(words, num_threads=1), batch.column(2).to_pylist(), strict=True):
                for i in ids:
                    found[lang, other if i in dull else i] += n
            keys = list(found)
            yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(found.values()), pa.int64())], ["lang", "piece", "n"])

    words = chosen.select("lang", "text").mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return staged(words.mapInArrow(cut, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")), "piece-counts")


def identify(docs: DataFrame, model: Model, text_col: str = "text", as_col: str = "language") -> DataFrame:
    """``docs`` with a struct (lang, score) of each whole text in ``as_col``: the likeliest learned language and its posterior.

    * ``und`` with score 0 where the text is null or has no letter, and for all rows where no language was learned.
    * Words count as often as they come; any length is read whole. Ties go to the first language by code point.
    * Rows that repeat get equal answers; an empty table stays empty; other columns stay as they are. A column named ``as_col`` raises.
    """
    refuse_clash(docs, as_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in parts:
            names, scores = [], []
            for at in range(0, len(texts), 256):
                a, b = scorer.texts(texts.iloc[at : at + 256].tolist())
                names += a
                scores += b
            yield pd.DataFrame({"lang": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype=float)})

    return docs.withColumn(as_col, run(text_or_empty(text_col)))
