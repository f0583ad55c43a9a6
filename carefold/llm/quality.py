"""Quality of texts: hashed word n-gram logistic regression trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from carefold.llm import linear

#: A document scored at least so high is of good quality.
THRESHOLD = 0.5

_HASHES = linear.WordHashes()
_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^\s0-9a-z\x80-\xff]+")


def features(text: bytes | None) -> np.ndarray:
    """Distinct slots of words, marks and pairs of neighbours, each alone and with the share of the text that it makes up (in
    powers of four). A word that repeats the one before it is read as the mark ``=``, numbers as their number of digits."""
    words = [b"0" * len(w) if w.isdigit() else w for w in _TOKEN.findall((text or b"").lower())]
    words = [b"=" if a == b else b for a, b in zip([b"", *words], words)]
    h = _HASHES.of(words)
    out = []
    for kind, grams in ((1, h), (2, linear.chain(h, 1))):
        one, times = np.unique(grams, return_counts=True)
        share = np.minimum(np.floor(-np.log2(times / max(len(grams), 1)) / 2), 4).astype(np.uint64)
        out += [linear.slots(one, kind), linear.slots(one + share * np.uint64(0x632BE59BD9B4E019), kind + 10)]
    out.append(linear.slots(np.array([np.log2(len(words) + 1).astype(np.uint64)]), 20) if len(words) else np.empty(0, np.int32))
    return np.unique(np.concatenate(out))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", **options) -> linear.Model:
    return linear.train(docs, labels, features, label, **{"alpha": 1.0, "l1": 2.0, "l2": 0.01} | options)


def score(docs: DataFrame, model: linear.Model, text_col: str = "text", name: str = "score") -> DataFrame:
    return linear.score(docs, model, features, text_col, name)
