"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text.

A window is a word without the marks at its ends, between blanks (long words in pieces), after a short lead that all dictionaries know; every byte is followed by its
complement, here and in the dictionaries, so that a match of three letters pays. zstandard's trainer makes three dictionaries: one of ordinary training texts, and one of each
half of the toxic ones that are set aside for it. It counts the texts that have a string, so that a text gives it each of its words once, doubled (short words are then
long enough to be counted). The distance of a window is its compressed length with the ordinary dictionary less that with the toxic and the ordinary one together; the
smaller of the two halves' counts, because what one half has by chance the other has not. Every window is compressed; lengths of windows seen before are
remembered. Thresholds on distances are calibrated on ordinary training texts that made no dictionary. A text's windows beyond each threshold, their share and the largest distance make its score
by a logistic regression that is fitted on the texts that made no dictionary. Labels are learned from training rows only; nothing but the text enters a score.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import pick, slices, texts_as_bytes

#: Labelled rows of each class that are learned from at most (those of least hash): the bound of the sample that reaches the driver.
SAMPLE = 4000
#: Bytes of the dictionaries; the trainer's segments and the strings it counts.
ORDINARY_BYTES, TOXIC_BYTES = 110_000, 16_384
SEGMENT, COUNTED = 24, 8
#: Toxic dictionaries, of disjoint parts of the toxic texts; every how manieth text makes no dictionary but the thresholds and the regression.
PARTS, ASIDE = 2, 2
#: Longest window, and what precedes it.
PIECE = 40
LEAD = b"01234567"
#: zstandard's match finder: binary trees, matches of three letters at least.
FINDER = {"strategy": zstandard.STRATEGY_BTLAZY2, "min_match": 6, "search_log": 5, "hash_log": 17, "chain_log": 18, "window_log": 18, "target_length": 12}
#: Share of the ordinary training texts that may have a window beyond each threshold.
HIT_RATES = (0.05, 0.01, 0.002)
WORDS_KEPT = 600_000
CUT = 0.3
_OTHER = bytes(255 - b for b in range(256))
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_EDGE = b".,;:!?\"'()[]{}<>*&%$#|-_~`"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def pieces(word: bytes) -> list[bytes]:
    return [word[i : i + PIECE] for i in range(0, len(word), PIECE)]


def wide(text: bytes) -> bytes:
    """Every byte and its complement."""
    out = bytearray(2 * len(text))
    out[0::2], out[1::2] = text, text.translate(_OTHER)
    return bytes(out)


def held_out(doc_id: Column, of: int, at: int) -> Column:
    """Whether the CRC-32 of the doc_id's text leaves that remainder; null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of == at


def windows(word: bytes) -> list[bytes]:
    """The windows of a word."""
    word = word.strip(_EDGE) or word
    return [b" " + p + b" " for p in pieces(word)]


@dataclass
class Model:
    """The dictionaries, the thresholds and the regression; it is as large as its dictionaries, whatever the data."""

    ordinary: bytes
    toxic: tuple[bytes, ...]
    bars: tuple[int, ...] = ()
    weights: tuple[float, ...] = ()
    known: dict = field(default_factory=dict, repr=False)
    seen: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"ordinary": self.ordinary, "toxic": self.toxic, "bars": self.bars, "weights": self.weights}

    def __setstate__(self, state):
        self.__dict__.update(state, known={}, seen={})

    def _compressors(self):
        if "_compress" not in self.__dict__:

            def made(content: bytes):
                dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                how = zstandard.ZstdCompressionParameters(**FINDER, write_content_size=False, write_dict_id=False, write_checksum=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
                dictionary.precompute_compress(compression_params=how)
                return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=how).compress

            self._compress = made(wide(self.ordinary + LEAD)), [made(wide(t + self.ordinary + LEAD)) for t in self.toxic]
        return self._compress

    def distance(self, window: bytes) -> int:
        """Bytes that every toxic dictionary saves beside the ordinary one; 0 at least."""
        ordinary, toxic = self._compressors()
        window = wide(LEAD + window)
        least = alone = len(ordinary(window))
        for compress in toxic:
            least = min(least, alone - len(compress(window)))
            if least <= 0:
                return 0  # the least of the parts counts
        return least if toxic else 0

    def gain(self, word: bytes) -> int:
        """The largest distance of a word's windows."""
        got = 0
        for w in windows(word):
            one = self.seen.get(w)
            if one is None:
                one = self.distance(w)
                if len(self.seen) >= WORDS_KEPT:
                    self.seen.clear()
                self.seen[w] = one
            got = max(got, one)
        if len(self.known) >= WORDS_KEPT:
            self.known.clear()
        self.known[word] = got
        return got

    def features(self, text: bytes) -> list[float]:
        words = words_of(text)
        gains = [g if g is not None else self.gain(w) for w, g in zip(words, map(self.known.get, words), strict=True)]
        gains = [g for g in gains if g]
        out = [float(max([0, *gains]))]
        for bar in self.bars:
            hits = sum(g >= bar for g in gains)
            out += [log1p(hits), min(1.0, 10.0 * hits / max(1, len(words)))]
        return out

    def score(self, text: bytes) -> float:
        x = self.weights[0] + sum(w * f for w, f in zip(self.weights[1:], self.features(text), strict=True))
        return 1 / (1 + exp(-max(-30.0, min(30.0, x))))


def trained_dictionary(texts: list[bytes], size: int) -> bytes:
    """The trainer's dictionary of texts, each as its different words, doubled; of the sizes size, size / 2, ... the largest that the texts are enough for.

    Texts too few for any are the dictionary themselves.
    """
    samples = [b" " + b" ".join(w + b" " + w for w in dict.fromkeys(words_of(t))) + b" " for t in texts]
    while size >= 256:
        try:
            return zstandard.train_dictionary(size, samples, k=SEGMENT, d=COUNTED).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return b"".join(samples)


def train(rows: list[tuple[bytes, int]], prior: float) -> Model:
    """rows: (text, label). prior: the share of label 1 among all training rows. One class only, or none: every score is the prior."""
    rows = sorted(dict.fromkeys(rows), key=lambda r: (xxhash.xxh64_intdigest(r[0]), r))
    toxic, ordinary = [t for t, y in rows if y == 1], [t for t, y in rows if y != 1]
    base = log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    if not toxic or not ordinary:
        return Model(b"", (), (1,), (base, 0.0, 0.0, 0.0))
    made = {id(c): [t for i, t in enumerate(c) if i % ASIDE] or c for c in (toxic, ordinary)}
    halves = [made[id(toxic)][i::PARTS] for i in range(PARTS)]
    model = Model(trained_dictionary(made[id(ordinary)], ORDINARY_BYTES), tuple(trained_dictionary(h, TOXIC_BYTES) for h in halves if h))
    largest = np.array([max([0, *map(model.gain, words_of(t))]) for t in ordinary[::ASIDE]])
    model.bars = tuple(sorted({int(np.quantile(largest, 1 - r, method="higher")) + 1 for r in HIT_RATES}))
    # The regression: Newton steps with a small ridge, classes weighted back to the prior.
    other = [(t, y) for half, y in ((toxic[::ASIDE], 1), (ordinary[::ASIDE], 0)) for t in half]
    y = np.array([v for _, v in other], dtype=float)
    x = np.array([[1.0, *model.features(t)] for t, _ in other])
    weight = np.where(y == 1, prior / max(1, y.sum()), (1 - prior) / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(x.shape[1])
    w[0] = base
    ridge = np.full(len(w), 0.5)
    ridge[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge), grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.weights = tuple(map(float, w))
    return model


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> tuple[list[tuple[bytes, int]], float]:
    """Texts and labels of the training rows of least hash, ``rows`` of each class at most, and the share of label 1 among all training rows."""
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    marks = marks.where(~held_out(F.col("doc_id"), 4, 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {int(r["toxic"]): r["n"] for r in marks.groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    h = F.xxhash64("doc_id")
    picked = marks.where("toxic = 1").orderBy(h, "doc_id").limit(rows).unionByName(marks.where("toxic != 1").orderBy(h, "doc_id").limit(rows))
    taken = pick(docs, "doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), "toxic")
    found = sorted((r["doc_id"], bytes(r["text"]), int(r["toxic"] == 1)) for r in taken.toLocalIterator())
    return [(t, y) for _, t, y in found], prior


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null and empty texts have the score of a text without hits; null doc_ids and repeated rows are kept; labels without a document count in the share of toxic ones only; rows of ``labels``
    with a null are not learned from (of several labels of one doc_id the largest counts); no labels at all: every score is 0. An empty table gives an empty
    result; other columns are not read. Texts are scored where they lie: nothing is shuffled but labels.
    """
    model = train(*sample(docs, labels, rows))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # three dictionaries: some 150 kB

    def run(batches):
        scorer = shared.value
        for batch in slices(batches):
            scores = [scorer.score(t) for t in texts_as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = pick(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
