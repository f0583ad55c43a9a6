"""Quality rules against brute force: odd texts, references, distances, no Python in the plan."""

from __future__ import annotations

import math
import random
import re
import statistics
import time
from collections import Counter

import pytest

from carefold.llm import rules

SCHEMA = "doc_id long, text string, lang string, words string, _r0 int, classes int, kept int, doc string"
STEPS = [("lower", str.islower), ("space", lambda c: c in " \t\n\v\f\r"), ("upper", str.isupper), ("letters", str.isalpha), ("digits", str.isnumeric), ("marks", lambda c: c in ".,;:!?'\"()[]-–—…")]


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {i + o for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def classes(text):
    out = Counter()
    for c in text:
        out[next((n for n, has in STEPS if has(c)), "signs")] += 1
    return [out[n] for n in [*(n for n, _ in STEPS), "signs"]]


def distance(p, q):
    part = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0.0
    return math.sqrt(max(0.0, sum(part(x, y) + part(y, x) for x, y in zip(p, q)) / 2))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def brute(rows, common=8, least_docs=20):
    texts = [(lang or "und", text or "") for _, text, lang in rows]
    refs = {}
    for lang in {x for x, _ in texts}:
        own = [t for g, t in texts if g == lang and len(words(t)) >= 50]
        if len(own) < least_docs:
            continue
        medians = [statistics.median(int(1000 * classes(t)[k] / len(t)) for t in own) for k in range(7)]
        weight = Counter()
        for t in own:
            for w in words(t):
                weight[w] += 2**30 // len(words(t))
        top = sorted(weight, key=lambda w: (-weight[w], w.encode()))[:common]
        total = sum(weight.values())
        refs[lang] = [m / sum(medians) for m in medians], top, [(total - sum(weight[w] for w in top)) / total, *(weight[w] / total for w in top)]
    out = []
    for (doc, _, _), (lang, t) in zip(rows, texts):
        n, *rest = base(t)
        failed, cd, wd = n < 50 or 100 * rest[-1] > 50 * n, None, None
        if lang in refs:
            shares, top, own = refs[lang]
            if len(t) >= 200:
                cd = distance([x / len(t) for x in classes(t)], shares)
            if len(words(t)) >= 100:
                c = Counter(top.index(w) + 1 if w in top else 0 for w in words(t))
                wd = distance([c[k] / len(words(t)) for k in range(len(top) + 1)], own)
        kept = not failed and (cd or 0) <= rules.MAX_CLASS_DISTANCE and (wd or 0) <= rules.MAX_WORD_DISTANCE
        out.append((doc, n, *rest, failed, cd and round(cd, 6), wd and round(wd, 6), kept))
    return sorted(out, key=str)


def table(seed):
    r = random.Random(seed)
    rows = []
    for i in range(90):
        words = [r.choice("the of and to un été Straße 12 x-y z".split()) if r.random() < .6 else "".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 220))]
        rows.append((i, "".join(w + r.choice([" ", " ", " ", ". ", "\n", "\t", " # ", ", "]) for w in words), r.choice(["en", "en", "fr", None])))
    rows += [(100, "\n".join(["the same line again"] * 40), "en"), (101, "WHO SHOUTS LIKE THIS! " * 5 + " ".join(f"WORD{k}" for k in range(90)), "en"),
             (102, " ".join(f"ab$#%{k}&&&***" for k in range(120)), "en"), (103, "of " * 300, "fr"), (104, "a b c a b c a b", "en"), (105, "a b a b a", "en")]
    return rows + rows[:5] + [(None, "no id", None), (200, None, "en"), (201, "", None), (202, " \n \t", "xx"), (203, "alone in its language " * 30, "xx"), (204, "北京 emoji 😀 ok " * 20, "en")]


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in rows], SCHEMA).repartition(3)
    out = rules.judge(df, **options)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")
    rounded = lambda v: round(v, 6) if isinstance(v, float) else v
    return out, sorted((tuple(rounded(r[c]) for c in names) for r in out.collect()), key=str)


def test_everything(spark):
    rows = table(1)
    out, got = found(spark, rows, common=8)
    want = brute(rows)
    assert got == want
    kept = {r[0] for r in got if r[-1]}
    assert not kept & {100, 101, 102, 103} and len(kept) > 30
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_carried_columns_and_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rules.judge(df, carry=("doc", "words")).columns[:2] == ["doc", "words"]
    assert rules.judge(df).collect() == []


@pytest.mark.parametrize("text", ["same words here " * 60_000, " ".join(str(i % 70_001) for i in range(200_000)), "x\n" * 100_000, "a" * 2_000_000])
def test_long_texts_take_linear_time(spark, text):
    t0 = time.time()
    r = rules.judge(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string"), least_docs=1).first()
    assert time.time() - t0 < 30 and r["n_words"] == len(text.split())


def test_repeated_windows_few_and_many(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(pool) for _ in range(n)) for pool, n in [("abcd", 400), ("abcdefgh", 30), ([f"w{i}" for i in range(12)], 3_000), ([f"w{i}" for i in range(300)], 500), ("a", 9)]]
    got = {x["doc_id"]: x["n_repeat_words"] for x in rules.judge(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")).collect()}
    assert got == {i: base(t)[-1] for i, t in enumerate(texts)}


def test_a_word_is_hashed_once(spark, monkeypatch):
    """The measures take windows and places from one hash of every word."""
    plans, real = [], rules.cut_lineage
    monkeypatch.setattr(rules, "cut_lineage", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df))[1])
    rules.judge(spark.createDataFrame([(1, "some words here " * 30, "en")], "doc_id long, text string, lang string"))
    measures = next(p for p in plans if "word_distance" in p and "xxhash64" in p)
    assert measures.count("xxhash64(") == 2  # of a word, and of three such hashes
