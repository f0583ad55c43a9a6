"""Logistic regression over hashed n-grams, trained by FTRL-proximal and scored as sparse dot products.

Features are made where the texts lie; training sees a bounded sample of labelled rows as lists of feature numbers. The
per-coordinate learning rates and the L1 term leave a few thousand weights out of millions of slots, so the model is broadcast
and every text is scored in one pass without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Labelled rows that a model is fitted on at most; beyond that an even, repeatable share of them.
SAMPLE_ROWS = 20_000
#: Two to this power slots.
BITS = 22

Features = Callable[[bytes | None], np.ndarray]


class WordHashes:
    """64-bit numbers of words, remembered up to a bound."""

    def __init__(self, limit: int = 300_000):
        self.known, self.limit = {}, limit

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = (zlib.crc32(w) << 32 | zlib.adler32(w)) & 0xFFFFFFFFFFFFFFFF
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words)) * np.uint64(0x9E3779B97F4A7C15)


def slots(hashes: np.ndarray, kind: int, bits: int = BITS) -> np.ndarray:
    """Slots of n-gram hashes; ``kind`` keeps equal words of different features apart."""
    mixed = (hashes ^ np.uint64(kind * 0xD6E8FEB86659FD93 % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(64 - bits)).astype(np.int32)


def chain(hashes: np.ndarray, *steps: int) -> np.ndarray:
    """Hashes of the words at the given distances taken together, in order."""
    last = max(steps, default=0)
    n = max(len(hashes) - last, 0)
    out = hashes[:n]
    for s in steps:
        out = out * np.uint64(0x2545F4914F6CDD1D) + hashes[s:s + n]
    return out


@dataclass
class Model:
    slots: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int = BITS


def fit(rows: list[tuple[int, np.ndarray]], bits: int = BITS, epochs: int = 3, alpha: float = 0.1, beta: float = 1.0,
        l1: float = 1.0, l2: float = 0.1) -> Model:
    """FTRL-proximal over (label, distinct slots) rows in the given order. The bias is slot ``2 ** bits`` and bears no L1 term."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    strength = np.full(size + 1, l1)
    strength[size] = 0.0

    def weights(at):
        far = np.abs(z[at]) - strength[at]
        return np.where(far > 0, -np.sign(z[at]) * far / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for label, own in rows:
            at = np.append(own, size)
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            before = n[at]
            z[at] += g - (np.sqrt(before + g * g) - np.sqrt(before)) / alpha * w
            n[at] = before + g * g
    used = np.flatnonzero(np.abs(z[:size]) > l1)
    return Model(used.astype(np.int32), weights(used).astype(np.float32), float(weights(np.array([size]))[0]), bits)


def train(docs: DataFrame, labels: DataFrame, features: Features, label: str, id_col: str = "doc_id", text_col: str = "text",
          sample_rows: int = SAMPLE_ROWS, **settings) -> Model:
    """Fits on the rows of ``docs`` whose id ``labels (id_col, label)`` marks 0 or 1. Null ids and labels are left out, and
    ids that carry both labels. Without labelled rows the model has no weights and scores everything 0.5."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(id_col).agg(
        F.min(label).alias("_label"), F.max(label).alias("_top")).filter("_label = _top")
    total = known.count()
    if total > sample_rows:
        known = known.filter(F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * sample_rows / total))
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    # at most sample_rows ids and labels (give or take the evenness of a hash), so small enough for every executor
    marked = docs.select(id_col, F.col(text_col).cast("binary").alias("_text")).join(F.broadcast(known.select(id_col, "_label")), id_col)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [features(t.as_py()) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_label").cast(pa.int32()), pa.array(own, pa.list_(pa.int32())),
                                              pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())], names=["label", "slots", "turn"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += [(t, y, s.values.to_numpy()) for t, y, s in zip(batch.column("turn").to_pylist(), batch.column("label").to_pylist(), batch.column("slots"))]
        rows.sort(key=lambda r: (r[0], r[1]))
        model = fit([r[1:] for r in rows], **settings)
        yield pa.RecordBatch.from_arrays([pa.array([model.slots.tobytes()]), pa.array([model.weights.tobytes()]), pa.array([model.bias])], names=["slots", "weights", "bias"])

    sample = marked.mapInArrow(extract, "label int, slots array<int>, turn long").repartition(1)
    got = sample.mapInArrow(learn, "slots binary, weights binary, bias double").collect()
    bits = settings.get("bits", BITS)
    if not got:
        return Model(np.empty(0, np.int32), np.empty(0, np.float32), 0.0, bits)
    return Model(np.frombuffer(got[0]["slots"], np.int32), np.frombuffer(got[0]["weights"], np.float32), got[0]["bias"], bits)


def score(docs: DataFrame, model: Model, features: Features, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 as ``name``; an existing column of that name is replaced. Null and empty
    texts have no features and get the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    inner = docs.select(F.struct(*kept).alias("row"), F.col(text_col).cast("binary").alias("text"))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        weights = np.zeros(1 << known.bits, np.float32)
        weights[known.slots] = known.weights
        for batch in batches:
            sums = [float(weights[features(t.as_py())].sum(dtype=np.float64)) for t in batch.column(1)]
            p = 1.0 / (1.0 + np.exp(-np.clip(np.array(sums, float) + known.bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["row", "score"])

    return inner.mapInArrow(stage, f"row {inner.schema['row'].dataType.simpleString()}, score double").select("row.*", F.col("score").alias(name))
