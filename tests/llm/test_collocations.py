"""Collocations against brute force: whole results, several rounds, odd texts and languages."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from carefold.llm import collocations

SCHEMA = "doc_id long, text string, lang string, n long, w1 string, cell int"
ODD = [(1, None, "en"), (2, "", "en"), (3, " \t \n.", None), (4, "a\x00b  c d\te", None), (5, "x", "xx")]


def brute(rows, limit=2000, least=10, share=50):
    counts, total = {}, Counter()
    for _, text, lang in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = tuple(x for x in re.split(r"[\x20\x09]", piece) if x)
            own = counts.setdefault(lang or "und", Counter())
            total[lang or "und"] += len(w)
            for k in (1, 2, 3):
                own.update(w[i:i + k] for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        many = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = {q for p, a in many.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= share * f[q]}
        found = []
        for p, a in many.items():
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if p not in dropped:
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:limit])]
    return sorted(out)


def table(seed, n=150):
    r = random.Random(seed)
    fixed = ["alpha beta gamma", "one Two", "le Été dort", "a b c d e f", "p q p q p"]
    rows = []
    for i in range(n):
        words = [r.choice(fixed) if r.random() < .3 else "".join(r.choice("abc") for _ in range(r.choice([1, 1, 2, 3]))) for _ in range(r.randint(0, 60))]
        rows.append((i, "".join(w + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "!"]) for w in words), r.choice(["en", "en", "de", None, "und"])))
    return rows + rows[:9] + ODD


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in collocations.mine(df, **options).collect())


def test_all_phrases(spark):
    rows = table(1)
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("limit,first,growth", [(3, 1, 2), (25, 1, 2), (60, 2, 8)])
def test_rounds_settle_the_best(spark, limit, first, growth):
    rows = table(2)
    assert found(spark, rows, limit=limit, first=first, growth=growth) == brute(rows, limit)


def test_other_least_and_share(spark):
    rows = table(3, 80)
    assert found(spark, rows, least=3, share=90, limit=40) == brute(rows, 40, 3, 90)


def test_long_text_and_small_tasks(spark, monkeypatch):
    """Slices, flushes and cleared vocabularies lose nothing; the settings reach the tasks inside the counting function."""
    rows = [(1, " ".join(t for _, t, _ in table(4, 60) if t) * 3, "en"), *table(5, 30)]
    batch = pa.RecordBatch.from_pydict({"lang": [r[2] or "und" for r in rows if r[1]], "text": [r[1].encode() for r in rows if r[1]]})

    def summed():
        out = Counter()
        for b in collocations._counted(3, None, None)(iter([batch])):
            for lang, *w, n in zip(*(c.to_pylist() for c in b.columns)):
                out[(lang, *w)] += n
        return out
    whole = summed()
    for name, value in (("VOCABULARY", 20), ("HELD", 50), ("SLICE", 7)):
        monkeypatch.setattr(collocations, name, value)
    assert summed() == whole


def test_empty(spark):
    assert found(spark, ODD[:3]) == [] and found(spark, ODD) == []
    out = collocations.mine(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.collect() == []


def test_products_beyond_64_bits(spark):
    big = 10**11
    df = spark.createDataFrame([(big, 2 * big, 3 * big + 1)], "a long, l long, r long")
    assert df.select(collocations._score("a", "l", "r")).first()[0] == 1000000 * big * big // (2 * big * (3 * big + 1))


def test_words_are_looked_up_as_by_the_bitmap_without_numpy(monkeypatch):
    """One word's look-up gives what ``has`` gives, and calls no numpy."""
    words = [f"w{i}".encode() for i in range(2_000)]
    hashes = np.array([collocations.xxhash.xxh64_intdigest(w, collocations.Words("en", None).seed) for w in words], np.uint64)
    bitmap = np.zeros(collocations.BITS // 64, np.uint64)
    slot = hashes[::3] & np.uint64(collocations.BITS - 1)
    np.bitwise_or.at(bitmap, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
    want = collocations.has(bitmap, hashes).tolist()
    monkeypatch.delattr(collocations, "has")
    own = collocations.Words("en", bitmap)
    assert [own[w] > 0 for w in words] == want and own.names[1:] == [w for w, there in zip(words, want) if there]
