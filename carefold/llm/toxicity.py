"""Toxicity of texts: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from carefold.llm import linear
from carefold.llm.decontaminate import words_of

#: A document scored at least so high is toxic.
THRESHOLD = 0.5

_HASHES = linear.WordHashes()


def features(text: bytes | None) -> np.ndarray:
    """Distinct slots of words, pairs of neighbours and pairs with one word skipped."""
    h = _HASHES.of(words_of(text))
    return np.unique(np.concatenate([linear.slots(h, 1), linear.slots(linear.chain(h, 1), 2), linear.slots(linear.chain(h, 2), 3)]))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", **options) -> linear.Model:
    return linear.train(docs, labels, features, label, **{"alpha": 1.0, "l1": 4.0, "l2": 0.01} | options)


def score(docs: DataFrame, model: linear.Model, text_col: str = "text", name: str = "score") -> DataFrame:
    return linear.score(docs, model, features, text_col, name)


def keep_civil(docs: DataFrame, model: linear.Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scored below the threshold, all columns as they are. Null and empty texts stay. A model without
    weights, as from a table without labels, tells no rows apart and rejects none."""
    if not len(model.slots):
        return docs
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    blank = F.coalesce(F.length(F.col(text_col)), F.lit(0)) == 0
    return score(docs, model, text_col, name).filter((F.col(name) < threshold) | blank).drop(name)
