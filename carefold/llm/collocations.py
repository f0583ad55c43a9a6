"""Phrase collocations by best-first branch-and-bound growth over n-gram counts.

A phrase occurs at most as often as any part of it, which prunes twice. Words and pairs below the least count never grow. And a
phrase with the prefix ``x y`` scores at most ``f(x y) / f(x)``, whatever follows: every language expands its prefixes in the order
of this bound, counting the triples around them, until as many survivors as asked for score at least as much as any prefix that
is left could reach, ties included. What is not expanded then cannot matter. Every round is one pass over the texts, which
counts in tasks and adds up by phrase; what may grow goes to the tasks as bitmaps of fixed size, whose false hits cost
work but change no count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from carefold.session import cut_lineage

#: Least count of a candidate.
LEAST = 10
#: Bits of a bitmap of words or pairs that may grow.
BITS = 1 << 25
#: Words that a task numbers, and occurrences that it holds, before it hands on what it has counted; words that it looks up at once.
VOCABULARY, HELD, SLICE = 1 << 18, 1 << 21, 1 << 17
#: Prefixes that every language expands in the first round, as a multiple of the phrases asked for, and how many times more in the
#: next. A round is a pass over the texts, which costs far more than the triples around some more prefixes.
FIRST, GROWTH = 16, 8

_CUT = b"\xff"  # no byte of UTF-8
_CLEAN = bytearray(bytes(range(256)).lower())
_CLEAN[0x09] = 0x20
for _b in b".,;:!?\x0a\x0b\x0c\x0d":
    _CLEAN[_b] = 0xFF
_CLEAN = bytes(_CLEAN)


def tokens(text: bytes) -> list[bytes]:
    """Words in order, A-Z lowered, with the cut mark between pieces."""
    return text.translate(_CLEAN).replace(_CUT, b" \xff ").split()


class Words(dict):
    """Numbers of one language's words from 1; 0 for the cut mark and words that cannot grow."""

    def __init__(self, lang: str, bitmap: np.ndarray | None):
        super().__init__({_CUT: 0})
        # bytes of the bitmap: words come one by one, for which numpy's calls cost more than the rest of the pass
        self.bytes, self.names, self.hashes = None if bitmap is None else bitmap.astype("<u8", copy=False).data.cast("B"), [b""], [0]
        self.seed = xxhash.xxh64_intdigest(lang.encode(), 42)

    def __missing__(self, word: bytes) -> int:
        number = xxhash.xxh64_intdigest(word, self.seed)  # as Spark's xxhash64(lang, word)
        if self.bytes is not None and not self.bytes[(number & BITS - 1) >> 3] >> (number & 7) & 1:
            self[word] = 0
            return 0
        self[word] = len(self.names)
        self.names.append(word), self.hashes.append(number)
        return len(self.names) - 1


def has(bitmap: np.ndarray, hashes) -> np.ndarray:
    slot = hashes & np.uint64(BITS - 1)
    return bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1) != 0


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << np.uint64(21) | a >> np.uint64(43)) ^ b


def _slot(*words: str) -> Column:
    """The hash that ``Words`` and ``_pair`` make of a word or a pair."""
    h = [F.xxhash64("lang", w) for w in words]
    return h[0] if len(h) == 1 else F.shiftleft(h[0], 21).bitwiseOR(F.shiftrightunsigned(h[0], 43)).bitwiseXOR(h[1])


def bitmap(df: DataFrame, *words: str) -> np.ndarray:
    """The words or pairs of ``df (lang, ...)`` as BITS bits; an aggregate of at most BITS / 64 rows reaches the driver."""
    slots = df.select(_slot(*words).bitwiseAND(F.lit(BITS - 1)).alias("slot"))
    cells = slots.selectExpr("cast(shiftright(slot, 6) as int) AS cell", "shiftleft(1L, cast(slot & 63 as int)) AS bit")
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[found.column("cell").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _counted(n: int, may_grow, wanted: Callable[[list[np.ndarray]], np.ndarray] | None):
    """Counts runs of ``n`` words in the batches of a task: (lang, w1 .. wn, n). ``may_grow``, a broadcast bitmap, leaves out words;
    ``wanted`` picks runs by the hashes of their words. With runs of one word comes the number of all, as the word ''."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Words] = {}
        pending: dict[str, list[bytes]] = {}
        keys: dict[str, list[np.ndarray]] = {}

        def of(key: np.ndarray, i: int) -> np.ndarray:
            return key >> 20 * (n - 1 - i) & (1 << 20) - 1

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, parts in keys.items():
                every = np.concatenate(parts)
                key, times = np.unique(every, return_counts=True)
                names = pa.array(words[lang].names, pa.binary()).cast(pa.string())
                columns = [names.take(pa.array(of(key, i))) for i in range(n)]
                if n == 1:
                    columns, times = [pa.concat_arrays([columns[0], pa.array([""])])], np.r_[times, len(every)]
                for a in range(0, len(times), 1 << 17):
                    part = [c.slice(a, 1 << 17) for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(part[0])), *part, pa.array(times[a:a + (1 << 17)], pa.int64())],
                                                     names=["lang", *(f"w{i + 1}" for i in range(n)), "n"])
            keys.clear()

        def count(lang: str) -> Iterator[pa.RecordBatch]:
            run = pending.pop(lang)
            for a in range(0, len(run), SLICE):
                own = words.get(lang)
                if own is None:
                    own = words[lang] = Words(lang, may_grow.value if may_grow else None)
                part = run[a:a + SLICE + n - 1]  # runs that begin in this slice
                ids = np.fromiter(map(own.__getitem__, part), np.int64, len(part))
                starts = max(0, len(ids) - n + 1)
                key, good = np.zeros(starts, np.int64), np.ones(starts, bool)
                for i in range(n):
                    key, good = key << 20 | ids[i:i + starts], good & (ids[i:i + starts] > 0)
                key = key[good]
                if wanted:
                    hashes = np.array(own.hashes, np.uint64)
                    key = key[wanted([hashes[of(key, i)] for i in range(n)])]
                if len(key):
                    keys.setdefault(lang, []).append(key)
                full = sum(map(len, words.values())) > VOCABULARY
                if full or sum(len(k) for parts in keys.values() for k in parts) > HELD:
                    yield from emit()
                if full:
                    words.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                run = pending.setdefault(lang, [])
                run += tokens(text.as_py())
                run.append(_CUT)
                if len(run) > SLICE:
                    yield from count(lang)
        for lang in list(pending):
            yield from count(lang)
        yield from emit()
    return work


def _counts(docs: DataFrame, n: int, may_grow=None, wanted=None, least: int = LEAST) -> DataFrame:
    """(lang, w1 .. wn, n) of runs that occur often enough. Tasks hand on sums already, so rows are added up after the shuffle."""
    names = ["lang", *(f"w{i + 1}" for i in range(n))]
    rows = docs.mapInArrow(_counted(n, may_grow, wanted), ", ".join(f"{c} string" for c in names) + ", n long")
    return rows.repartition(*names).groupBy(*names).agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("w1") == ""))


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a^2 / (left right)) in whole numbers of 38 digits."""
    d = lambda c: f"cast({c} as decimal(20,0))"
    return F.expr(f"({d(a)} * {d(a)} * cast(1000000 as decimal(7,0))) div ({d(left)} * {d(right)})")


def _cut(df: DataFrame, column: str, target: int) -> DataFrame:
    """(lang, cut): the highest multiple of 1,000 that ``target`` rows of the language reach in ``column`` (0 .. 1,000,000), from
    a histogram of 1,001 bins; no row for languages with fewer rows."""
    bins = df.groupBy("lang", F.expr(f"{column} div 1000").alias("bin")).agg(F.count("*").alias("n"))
    down = bins.withColumn("sum", F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("bin"))))
    return down.filter(F.col("sum") >= target).groupBy("lang").agg((F.max("bin") * 1000).alias("cut"))


def mine(docs: DataFrame, limit: int = 2000, least: int = LEAST, share: int = 50, lang_col: str = "lang", text_col: str = "text",
         first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``limit`` best phrases of two or three words that occur ``least`` times.

    Texts are split at ``.,;:!?`` and line ends into pieces and these at blanks and tabs into words, A-Z lowered; phrases lie within a
    piece. ``a``, ``l`` and ``r`` count the phrase and the two parts of its lowest-scoring cut (the first of equals), ``n`` all words
    of the language, score is floor(1000000 a a / (l r)). A phrase inside a longer one that has ``share`` per cent of its count is
    left out. Order: score, then count, both falling, then phrase by its bytes.

    A null language is ``und``; null, empty and blank texts have no words; repeated rows count each; very long texts are counted in
    slices. Languages without phrases and empty tables yield no rows. Other columns are not looked at. Words and pairs go through
    bitmaps of fixed size by 64-bit hash, counts and joins by the words themselves, so nothing depends on hashes."""
    sc = docs.sparkSession.sparkContext
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    words = cut_lineage(_counts(texts, 1, least=least))
    single = words.filter("w1 <> ''")
    grows = sc.broadcast(bitmap(single, "w1"))
    both = _counts(texts, 2, grows, least=least).withColumnRenamed("n", "a")
    both = both.join(single.withColumnRenamed("n", "l"), ["lang", "w1"]).join(single.select("lang", F.col("w1").alias("w2"), F.col("n").alias("r")), ["lang", "w2"])
    pairs = cut_lineage(both.select("lang", "w1", "w2", "a", "l", "r", _score("a", "l", "r").alias("score"), F.expr("cast(a as decimal(20,0)) * 1000000 div l").alias("bound")))
    known = sc.broadcast(bitmap(pairs, "w1", "w2"))

    def triples(expand: np.ndarray, settle: np.ndarray) -> DataFrame:
        """Triples that begin with a pair of ``expand`` or end with one of ``settle``."""
        right, left = sc.broadcast(expand), sc.broadcast(settle)

        def wanted(h: list[np.ndarray]) -> np.ndarray:
            before, after = _pair(h[0], h[1]), _pair(h[1], h[2])
            return has(known.value, before) & has(known.value, after) & (has(right.value, before) | has(left.value, after))
        return _counts(texts, 3, grows, wanted, least)

    def judged(found: DataFrame, state: DataFrame) -> DataFrame:
        """The phrases that are settled and survive: all counted triples, and pairs that score at least the language's bound."""
        head = pairs.select("lang", "w1", "w2", F.col("a").alias("a12"), F.col("l").alias("f1"))
        tail = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("a23"), F.col("r").alias("f3"))
        three = found.withColumnRenamed("n", "a").join(head, ["lang", "w1", "w2"]).join(tail, ["lang", "w2", "w3"])
        three = three.withColumn("s1", _score("a", "f1", "a23")).withColumn("s2", _score("a", "a12", "f3")).withColumn("one", F.expr("s1 <= s2"))
        pick = lambda x, y: F.when(F.col("one"), F.col(x)).otherwise(F.col(y))
        three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", pick("f1", "a12").alias("l"), pick("a23", "f3").alias("r"), pick("s1", "s2").alias("score"))
        inside = found.select("lang", "w1", "w2", "n").union(found.select("lang", "w2", "w3", "n")).groupBy("lang", "w1", "w2").agg(F.max("n").alias("most"))
        two = pairs.join(state, "lang").filter("score >= theta").join(inside, ["lang", "w1", "w2"], "left").filter(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * share))
        return three.unionByName(two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", "score"))

    target = first * limit
    state = cut_lineage(pairs.select("lang").distinct().join(_cut(pairs, "bound", target), "lang", "left").select("lang", F.coalesce("cut", F.lit(0)).alias("theta"), F.lit(1_000_001).cast("long").alias("before")))
    found, open_ = None, state
    while True:
        now = pairs.join(open_, "lang")
        new = triples(bitmap(now.filter("bound >= theta and bound < before"), "w1", "w2"), bitmap(now.filter("score >= theta and score < before"), "w1", "w2"))
        found = cut_lineage(new if found is None else found.unionByName(new).dropDuplicates(["lang", "w1", "w2", "w3"]))
        best = cut_lineage(judged(found, state.select("lang", "theta")))
        target *= growth
        reached = state.join(_cut(best, "score", limit), "lang", "left").join(_cut(pairs, "bound", target).withColumnRenamed("cut", "wider"), "lang", "left")
        after = F.least("theta", F.coalesce("cut", "wider", F.lit(0)))  # the survivors' own bound, where there are enough of them
        state = cut_lineage(reached.select("lang", after.alias("theta"), F.col("theta").alias("before")))
        open_ = state.filter("theta < before")
        if open_.isEmpty():
            break
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit)
    total = words.filter("w1 = ''").select("lang", "n")
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
