"""Hard negatives against brute force: ties, repeats, odd vectors, scores beyond 64 bits, several blocks of anchors."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from carefold.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label string, _row int, _score double, rank int"


def brute(rows, anchor, positives=5, kept=3, low=50, high=95):
    held = [(i, r[0], r[2], [math.floor(256 * x) for x in r[1]]) for i, r in enumerate(rows)
            if None not in r[:3] and all(x is not None and math.isfinite(x * 256) for x in r[1])]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    long = lambda x: x if -2**63 <= x < 2**63 else None
    out = []
    for a in held:
        if not anchor(a[1]):
            continue
        near = sorted((-dot(a[3], b[3]), b[1], b[0]) for b in held if b[0] != a[0] and b[2] == a[2])[:positives]
        far = sorted((-dot(a[3], b[3]), b[1], b[0]) for b in held if b[2] != a[2])
        for s, p, _ in near:
            chosen = [(n, -t) for t, n, _ in far if low * -s <= 100 * -t <= high * -s][:kept]
            out += [(a[1], p, k + 1, n, long(-s), long(t)) for k, (n, t) in enumerate(chosen)]
    return sorted(out, key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2.0, 3) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in negatives.mine(df, F.col("vec_id") % 3 == 0, **options).collect()), key=str)


def table(seed, n, width, scale=1.0):
    r = random.Random(seed)
    return [(i, [r.choice([-.5, 0, .25, .5, 1]) * scale if i % 2 else r.uniform(-scale, scale) for _ in range(width)], r.choice("aab")) for i in range(n)]


def test_ties_and_odd_rows(spark):
    odd = [(None, [1.0] * 5, "a"), (300, None, "a"), (303, [None] * 5, "a"), (306, [float("nan")] * 5, "b"), (309, [1e308] * 5, "a"), (312, [1.0] * 5, None),
           (315, [1.0, 1.0], "b"), (318, [], "a"), (321, [float("inf")] * 5, "a")]
    rows = table(1, 80, 5) + odd
    assert found(spark, rows) == brute(rows, lambda i: i % 3 == 0)


def test_repeated_rows_and_blocks_of_anchors(spark):
    rows = table(2, 40, 4)
    rows = rows + rows[:7] + [rows[3]] * 5
    want = brute(rows, lambda i: i % 3 == 0)
    assert found(spark, rows) == want == found(spark, rows, block_bytes=200)


def test_long_vectors_and_other_limits(spark):
    rows = table(3, 60, 200)
    assert found(spark, rows, positives=2, negatives=7, low=10, high=120) == brute(rows, lambda i: i % 3 == 0, 2, 7, 10, 120)


@pytest.mark.parametrize("scale", [1e7, 1e30, 1e305])
def test_large_components_are_exact(spark, scale):
    rows = table(4, 40, 3, scale) + table(5, 10, 3)
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    got = found(spark, rows, low=1, high=99)
    assert got and got == brute(rows, lambda i: i % 3 == 0, low=1, high=99)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(empty, F.lit(True)).collect() == []
    assert found(spark, [(1, [1.0], "a"), (2, [1.0], "b")]) == []


def test_residue_numbers():
    r = np.random.default_rng(6)
    a, b = r.integers(-2**20, 2**20, (7, 130)).astype(float), r.integers(-2**20, 2**20, (9, 130)).astype(float)
    exact = a.astype(object) @ b.astype(object).T
    primes, chunk = negatives.moduli(130 * 2**40)
    parts = [negatives.product(x, y, p, chunk) for x, y, p in zip(negatives.residues(a, primes), negatives.residues(b, primes), primes)]
    assert (negatives.reconstruct(parts, primes, False) == exact).all() and (negatives.reconstruct(parts, primes, True) == exact).all()
