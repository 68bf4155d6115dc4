"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The model is fitted on the driver from a bounded sample of labelled rows (`Settings.sample_rows`), one pass per
epoch with per-coordinate learning rates and L1, which leaves few weights other than zero. Only those are sent to
the executors, where every whole text is scored.

Defined results: a null or empty text has no n-gram and gets the score of the bias alone; rows repeat as they
come; a null doc_id counts as held out and never trains; labels other than 0 and 1 are ignored, a document with
both labels counts as toxic; without labels of both classes the score is the share of toxic labels (0 without any).
Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import Memo, bounded_sample, texts

_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    #: Bound of the labelled rows that the model is fitted on.
    sample_rows: int = 8_000
    epochs: int = 8
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.1
    skips: tuple[int, ...] = (1, 2)  # distances of the second word of a pair: 1 makes bigrams, 2 skip-grams
    beginnings: tuple[int, ...] = (6, 8)  # bytes of word beginnings, for the word unigrams of inflected forms


class Features:
    """Distinct hashed n-gram numbers of a text: its words and their beginnings, neighbouring words and words with one between."""

    def __init__(self, settings: Settings):
        self.s, self.mask = settings, np.uint64((1 << settings.bits) - 1)
        self.words = Memo(zlib.crc32, 200_000)
        self.starts = [Memo(lambda w, n=n: zlib.crc32(w[:n]), 200_000) for n in settings.beginnings]

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_SPLIT).split()
        w = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        found = [w * np.uint64(0x9E3779B97F4A7C15)]
        for k, d in enumerate(self.s.skips, 1):
            found.append((w[:-d] * np.uint64(0xC2B2AE3D27D4EB4F) + w[d:] * np.uint64(0x165667B19E3779F9)) * np.uint64(2 * k + 1))
        for k, memo in enumerate(self.starts, 1):
            found.append(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)) * np.uint64(0x9FB21C651E98DF25 + 2 * k))
        h = np.concatenate(found)
        return np.unique(((h ^ (h >> np.uint64(29))) >> np.uint64(11)) & self.mask).astype(np.int32)


@dataclass
class Model:
    index: np.ndarray  # feature numbers with a weight, ascending
    weight: np.ndarray
    bias: float

    def dense(self, bits: int) -> np.ndarray:
        w = np.zeros(1 << bits, np.float32)
        w[self.index] = self.weight
        return w


def fit(rows: list[tuple[np.ndarray, int]], s: Settings) -> Model:
    """FTRL-proximal over the rows in the order given; the last coordinate is the bias, which has no L1."""
    labels = [y for _, y in rows]
    if not rows or min(labels) == max(labels):
        share = sum(labels) / len(labels) if rows else 0.0
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    size = 1 << s.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        zi, l1 = z[i], np.where(i == size, 0.0, s.l1)
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2))

    rng = np.random.default_rng(7)
    for _ in range(s.epochs):
        for r in rng.permutation(len(rows)):
            i, y = np.append(rows[r][0], size), rows[r][1]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            ni = n[i]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / s.alpha
            z[i] += g - sigma * w
            n[i] = ni + g * g
    w = weights(np.arange(size + 1))
    index = np.flatnonzero(w[:size]).astype(np.int32)
    return Model(index, w[index].astype(np.float32), float(w[size]))


def training_rows(docs: DataFrame, labels: DataFrame, s: Settings) -> list[tuple[np.ndarray, int]]:
    y = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    y = y.where("y in (0, 1) and crc32(cast(doc_id as string)) % 5 <> 0").groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = F.broadcast(bounded_sample(y, "doc_id", s.sample_rows))
    # of several texts of one id the smallest, whatever the order of rows
    texted = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))

    def run(batches):
        features = Features(s)
        for b in texts(batches):
            f = [features(t.as_py()).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(f, pa.binary()), b.column("y")], ["doc_id", "f", "y"])

    got = texted.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, f binary, y int").toArrow().sort_by("doc_id")
    return [(np.frombuffer(f.as_buffer(), np.int32), y.as_py()) for f, y in zip(got.column("f"), got.column("y"), strict=True)]


def score(docs: DataFrame, model: Model, s: Settings) -> DataFrame:
    """doc_id and score of every row."""
    weights, bias = docs.sparkSession.sparkContext.broadcast((model.index, model.weight)), model.bias

    def run(batches):
        features, w = Features(s), Model(*weights.value, bias).dense(s.bits)
        for b in texts(batches):
            x = np.array([bias + float(w[features(t.as_py())].sum(dtype=np.float64)) for t in b.column("text")], np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(x, -35, 35))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs, by a model of the rows that aren't held out."""
    scored = score(docs, fit(training_rows(docs, labels, settings), settings), settings)
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
