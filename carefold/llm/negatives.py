"""Hard-negative mining by exact inner products in a residue number system.

Components are whole numbers. Modulo a small prime a matrix product stays below 2^24 and is exact in float32, so the anchors meet
all rows in one float32 product a prime; the residues of a score give the signed score itself by Chinese remaindering, whatever
its size. Anchors are broadcast in blocks of bounded bytes, every task goes over its own rows once a block and keeps the few
best of each anchor, and only these are shuffled: first for the positives, then for the negatives within the positives' windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from carefold.session import cut_lineage, scratch_path

#: Bytes of anchor vectors that one pass broadcasts; more anchors take more passes.
BLOCK_BYTES = 8_000_000
#: Anchors and rows whose scores are held at once.
ANCHOR_ROWS, CANDIDATE_ROWS = 256, 4096
#: Components that one float32 product adds up before it is reduced; fewer leave room for more primes.
CHUNKS = (64, 16, 4)
#: Scores below this bound are int64, with room for the product of the primes and for percentages; others are Python integers,
#: and byte strings between tasks.
WIDE = 2**50


def moduli(bound: int) -> tuple[list[int], int]:
    """(primes, largest first, and a number of components) such that centred residues add up below 2^24 over so many products and
    the product of the primes exceeds twice ``bound``: they tell all scores from -bound to bound apart."""
    for chunk in CHUNKS:
        out, total = [], 1
        for p in range(2 * math.isqrt((2**24 - 1) // chunk) + 1, 2, -1):
            if total > 2 * bound + 1:
                return out, chunk
            if all(p % d for d in range(2, math.isqrt(p) + 1)):
                out.append(p)
                total *= p
    raise ValueError("the scores are too large for small primes")  # not reached by products of finite doubles


def residues(vectors: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Centred residues of whole-numbered float64 rows, a float32 matrix a prime."""
    out = []
    for p in primes:
        r = np.fmod(vectors, p)
        r -= p * np.rint(r / p)
        out.append(r.astype(np.float32))
    return out


def product(a: np.ndarray, b: np.ndarray, p: int, chunk: int) -> np.ndarray:
    """a @ b.T modulo p, as numbers 0 .. p - 1."""
    total = np.zeros((len(a), len(b)), np.float32)
    for k in range(0, a.shape[1], chunk):
        total = np.fmod(total + np.fmod(a[:, k:k + chunk] @ b[:, k:k + chunk].T, np.float32(p)), np.float32(p))
    return total.astype(np.int64) % p


def reconstruct(parts: list[np.ndarray], primes: list[int], wide: bool) -> np.ndarray:
    """The signed numbers with the given residues: mixed-radix digits, one a prime, added up from the first."""
    digits: list[np.ndarray] = []
    for part, p in zip(parts, primes):
        known, weight = np.zeros_like(part), 1
        for digit, q in zip(digits, primes):
            known = (known + digit * weight) % p
            weight = weight * q % p
        digits.append((part - known) * pow(weight, -1, p) % p)
    value, weight = np.zeros(parts[0].shape, object if wide else np.int64), 1
    for digit, q in zip(digits, primes):
        value = value + (digit.astype(object) if wide else digit) * weight
        weight *= q
    return np.where(value > weight // 2, value - weight, value)


class Best:
    """The ``k`` best (score, then smaller id, then earlier row) of each of ``n`` slots; only slots with new hits are touched."""

    def __init__(self, n: int, k: int, least: int):
        self.k, self.least = k, least
        self.score = np.full((n, k), least, object if abs(least) >= WIDE else np.int64)
        self.id, self.row, self.held = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros(n, np.int64)

    def offer(self, slots: np.ndarray, scores: np.ndarray, good: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Of every row of ``scores``, which belongs to one slot, the entries that ``good`` admits."""
        good = good & (scores >= self.score[slots, -1][:, None])
        if good.shape[1] > self.k and good.sum() > 8 * self.k * len(slots):
            held = np.where(good, scores, self.least)
            held.sort(axis=1) if held.dtype == object else held.partition(held.shape[1] - self.k, axis=1)
            good &= scores >= held[:, -self.k][:, None]
        i, j = np.nonzero(good)
        if not len(i):
            return
        hit = np.unique(i)
        at, old = np.nonzero(np.arange(self.k) < self.held[slots[hit], None])
        before = (slots[hit][at], old)
        i, score = np.concatenate([hit[at], i]), np.concatenate([self.score[before], scores[i, j]])
        id_, row = np.concatenate([self.id[before], ids[j]]), np.concatenate([self.row[before], rows[j]])
        order = np.lexsort((row, id_, -np.unique(score, return_inverse=True)[1], i))
        place = np.arange(len(i)) - np.searchsorted(i[order], i[order], "left")
        order, place = order[place < self.k], place[place < self.k]
        after = (slots[i[order]], place)
        self.score[after], self.id[after], self.row[after] = score[order], id_[order], row[order]
        np.maximum.at(self.held, after[0], place + 1)

    def all(self) -> tuple[np.ndarray, ...]:
        """(slot, score, id, row) of everything held."""
        slot, place = np.nonzero(np.arange(self.k) < self.held[:, None])
        return slot, self.score[slot, place], self.id[slot, place], self.row[slot, place]


def _vectors(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a list column as float64 rows; shorter rows end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((len(sizes), width))
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(flat * scale)
    return out


def _key(score: int, size: int) -> bytes:
    """A whole number as bytes that sort like the numbers."""
    return (int(score) + (1 << 8 * size - 1)).to_bytes(size, "big")


def _number(key: bytes) -> int:
    return int.from_bytes(key, "big") - (1 << 8 * len(key) - 1)


def _long(score: int) -> int | None:
    return int(score) if -2**63 <= score < 2**63 else None


def mine(df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id",
         vector_col: str = "embedding", label_col: str = "label", scale: int = 256, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that ``is_anchor`` picks and each of
    its ``positives`` best other rows of the same label, the ``negatives`` best rows of other labels whose score lies between ``low``
    and ``high`` per cent of the positive's. Scores are inner products of floor(scale * x); ties go to the smaller id.

    Rows with a null id, label or vector, or with a null or non-finite component (scaled or not), take no part. Rows are told apart
    by position: rows that repeat an id count each, an anchor row that occurs twice is answered twice, equal ids go by position.
    Vectors of different length are filled up with zeros. Components may be of any size; a score beyond 64 bits is ordered
    exactly and comes out as null. Other columns are not looked at. No anchors, no partners or no negatives in the window: no rows."""
    spark = df.sparkSession
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < float("inf")))
    rows = cut_lineage(df.filter(v.isNotNull() & fine & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_label"), v.alias("_v"),
        F.coalesce(is_anchor, F.lit(False)).alias("_anchor")))
    size = lambda x: F.abs(x.cast("double") * scale) + 1
    seen = rows.agg(F.sum(F.col("_anchor").cast("long")).alias("n"), F.max(F.size("_v")).alias("width"),
                    F.max(F.aggregate("_v", F.lit(0.0), lambda a, x: F.greatest(a, size(x)))).alias("most"),
                    F.max(F.aggregate("_v", F.lit(0.0), lambda a, x: a + size(x) * size(x))).alias("square")).first()
    width, most, square = max(1, seen["width"] or 0), seen["most"] or 0.0, seen["square"] or 0.0
    bound = width * int(most) ** 2 + 1
    bound = min(bound, int(square * 1.001) + 1) if math.isfinite(square) else bound
    (primes, chunk), wide = moduli(bound), bound >= WIDE
    bytes_ = (bound.bit_length() + 8) // 8 + 1
    kind = "binary" if wide else "long"
    pack = (lambda s: pa.array([_key(x, bytes_) for x in s], pa.binary())) if wide else (lambda s: pa.array(s, pa.int64()))
    unpack = (lambda c: np.array([_number(x.as_py()) for x in c], object)) if wide else (lambda c: c.to_numpy())
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    none = spark.createDataFrame([], schema)
    blocks = max(1, math.ceil((seen["n"] or 0) * width * 8 / block_bytes))
    block = F.pmod(F.xxhash64("_row"), F.lit(blocks))

    def search(held, k: int, windows: bool):
        """Best ``k`` rows of every anchor among its own label, or of every anchor and window among the other labels."""
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, anchors, label, edges = held.value
            mine_ = residues(anchors, primes)
            names, label = np.unique(label, return_inverse=True)
            slots = edges[0].shape[1] if windows else 1
            best = Best(len(own) * slots, k, -bound - 1)
            for batch in batches:
                for part in (batch.slice(i, CANDIDATE_ROWS) for i in range(0, batch.num_rows, CANDIDATE_ROWS)):
                    ids, row, their = part.column("_id").to_numpy(), part.column("_row").to_numpy(), part.column("_label").to_numpy(zero_copy_only=False)
                    place = np.minimum(np.searchsorted(names, their), len(names) - 1)
                    their = np.where(names[place] == their, place, -1)
                    theirs = residues(_vectors(part.column("_v"), width, scale), primes)
                    for a in range(0, len(own), ANCHOR_ROWS):
                        cut = slice(a, a + ANCHOR_ROWS)
                        scores = reconstruct([product(x[cut], y, p, chunk) for x, y, p in zip(mine_, theirs, primes)], primes, wide)
                        same = label[cut, None] == their[None, :]
                        at = np.arange(a, a + len(scores))
                        if not windows:
                            best.offer(at, scores, same & (own[cut, None] != row[None, :]), ids, row)
                        else:
                            for s in range(slots):
                                inside = ~same & (scores >= edges[0][cut, s, None]) & (scores <= edges[1][cut, s, None])
                                best.offer(at * slots + s, scores, inside, ids, row)
            slot, score, ids, row = best.all()
            yield pa.RecordBatch.from_arrays([pa.array(own[slot // slots]), pa.array(slot % slots), pa.array(row), pa.array(ids), pack(score)],
                                             names=["_anchor_row", "_slot", "_other", "_other_id", "_score"])
        found = rows.select("_row", "_id", "_label", "_v").mapInArrow(work, f"_anchor_row long, _slot long, _other long, _other_id long, _score {kind}")
        order = Window.partitionBy("_anchor_row", "_slot").orderBy(F.desc("_score"), "_other_id", "_other")
        return found.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)

    def answers(b: int) -> DataFrame:
        asked = rows.filter(F.col("_anchor") & (block == b)).select("_row", "_id", "_label", "_v").toArrow().combine_chunks()
        if not asked.num_rows:
            return none
        own, anchors, label = asked.column("_row").to_numpy(), _vectors(asked.column("_v"), width, scale), asked.column("_label").to_numpy()
        place = {r: i for i, r in enumerate(own.tolist())}
        first = search(spark.sparkContext.broadcast((own, anchors, label, None)), positives, False)
        chosen = first.select("_anchor_row", "_rank", "_other_id", "_score").toArrow().combine_chunks()  # at most ``positives`` an anchor of the block
        row, slot = np.array([place[r] for r in chosen.column("_anchor_row").to_pylist()], int), chosen.column("_rank").to_numpy().astype(int) - 1
        score = unpack(chosen.column("_score"))
        shape, number = (len(own), max(1, positives)), object if wide else np.int64
        lower, upper = np.full(shape, bound + 1, number), np.full(shape, -bound - 1, number)
        lower[row, slot], upper[row, slot] = -(-score * low // 100), score * high // 100
        theirs, points = np.zeros(shape, np.int64), np.zeros(shape, number)
        theirs[row, slot], points[row, slot] = chosen.column("_other_id").to_numpy(), score
        found = search(spark.sparkContext.broadcast((own, anchors, label, (lower, upper))), negatives, True)
        named = spark.sparkContext.broadcast((place, asked.column("_id").to_numpy(), theirs, points))

        def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, ids, other, score_of = named.value
            for batch in batches:
                i, s = np.array([at[r] for r in batch.column("_anchor_row").to_pylist()], int), batch.column("_slot").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i], pa.int64()), pa.array(other[i, s], pa.int64()), batch.column("_rank"), batch.column("_other_id"),
                     pa.array([_long(x) for x in score_of[i, s]], pa.int64()), pa.array([_long(x) for x in unpack(batch.column("_score"))], pa.int64())],
                    names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])
        return found.select("_anchor_row", "_slot", "_rank", "_other_id", "_score").mapInArrow(name, schema)

    if blocks == 1:
        return answers(0)
    paths = [scratch_path(spark, "negatives") for _ in range(blocks)]
    for b, path in enumerate(paths):
        answers(b).write.parquet(path)
    return spark.read.schema(schema).parquet(*paths)
