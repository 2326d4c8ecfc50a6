"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased runs of letters and digits; features are the distinct words, pairs of neighbours and pairs with
one word between, hashed into `2 ** bits` slots, with value 1. Training follows the per-coordinate FTRL-proximal rule:
rates that fall with a coordinate's own gradients and an L1 term that keeps most weights at exactly zero, so that the
model is a short list of slots and weights, of proven size at most `2 ** bits` entries, and is broadcast.

The fit reads a bounded sample of labelled rows (`max_rows`, chosen by a hash of doc_id); scoring reads every text whole.

Defined results: a null or empty text has only the bias feature and gets its probability; null doc_ids are kept,
scored and never trained on; labels that are null are not used; conflicting labels of an id count as 1, and an id that
stands on several texts is trained on one of them, so that the sample is bounded in rows; repeated rows are scored alike;
texts of any length are read whole; without any usable label, or from an empty table, every text scores 0. Other columns stay
as they are, but for one with the name of the score, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmeridian.llm.bpe import Memo
from kmeridian.llm.text import held_out
from kmeridian.session import ship

BITS = 20
MAX_ROWS = 12_000
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Every ASCII byte but digits and lower-case letters becomes a space.
_TO_SPACE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def _hash(word: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in word:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


_hashed = Memo(_hash, most=300_000)


def features(text: str | None, bits: int) -> np.ndarray:
    """Distinct slots of a text; slot 0 is the bias."""
    found = text.lower().encode().translate(_TO_SPACE).split() if text else []
    h = np.fromiter(map(_hashed.__getitem__, found), np.uint64, len(found))
    with np.errstate(over="ignore"):
        m = h * MIX
        grams = [m, (m[:-1] ^ (m[1:] >> np.uint64(7))) * MIX, (m[:-2] ^ (m[2:] >> np.uint64(13))) * MIX]
    slots = np.concatenate(grams) >> np.uint64(64 - bits)
    return np.concatenate(([0], np.maximum(slots, 1))).astype(np.int64)


class Ftrl:
    def __init__(self, size: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.1):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        root = np.sqrt(self.n[at])
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - root) / self.alpha * w
        self.n[at] += g * g


def fit(docs: DataFrame, labels: DataFrame, folds: int, fold: int, label: str = "toxic", max_rows: int = MAX_ROWS, bits: int = BITS, epochs: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights learned from labelled rows outside the fold; at most about max_rows of them are read."""
    ship(docs.sparkSession)
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    share = max_rows / max(1, labels.count())
    ids = ids.withColumn("_order", F.xxhash64("doc_id"))
    if share < 1:
        ids = ids.where(F.abs(F.col("_order") % 1_000_003) < int(share * 1_000_003))
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most about max_rows ids

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [np.unique(features(t, bits)).astype("<u4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_order"), b.column("_y"), pa.array(at, pa.binary())], ["k", "y", "at"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((k, at, y) for b in batches for k, y, at in zip(*(b.column(c).to_pylist() for c in ("k", "y", "at")), strict=True))
        model = Ftrl(1 << bits)
        for _ in range(epochs):
            for _, at, y in rows:
                model.learn(np.frombuffer(at, "<u4"), y)
        w = model.weights()
        kept = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([kept.astype("<u4").tobytes()]), pa.array([w[kept].astype("<f8").tobytes()])], ["slot", "weight"])

    each = sample.mapInArrow(slots, "k long, y int, at binary").groupBy("k").agg(F.min("y").alias("y"), F.min("at").alias("at"))  # a row an id
    row = each.repartition(1).mapInArrow(train, "slot binary, weight binary").first()
    return (np.frombuffer(row["slot"], "<u4"), np.frombuffer(row["weight"], "<f8")) if row else (np.zeros(0, "<u4"), np.zeros(0))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS, text: str = "text", into: str = "score") -> DataFrame:
    """docs with the probability of label 1 for each whole text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        slots, weights = shared.value
        table = np.zeros(1 << bits)
        table[slots] = weights
        used = table != 0
        for texts in batches:
            sums = []
            for t in texts:
                at = features(t, bits)
                sums.append(table[np.unique(at[used[at]])].sum() if len(slots) else -np.inf)
            with np.errstate(over="ignore"):
                yield pd.Series(1.0 / (1.0 + np.exp(-np.array(sums))))

    return docs.withColumn(into, probability(F.col(text)))
