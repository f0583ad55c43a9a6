"""Stupid-backoff scores of documents under an n-gram model counted over the whole corpus.

Texts are read once into slices: the numbers of their words, and each word's hash. From a slice come its distinct n-grams of
all orders with their counts, as sorted 64-bit hashes cut by hash range into blocks; a block is one row, so a frequent n-gram
is one entry a slice and never a hot key. The tasks of a hash range add the counts up and send them back in the order in
which they came. Slices are then joined with their counts, which gives every word its longest n-gram that the model keeps,
and the logarithms are summed per document. What is shuffled is a few bytes a distinct n-gram of a slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from carefold.llm.decontaminate import words_of
from carefold.session import cut_lineage

ORDER, BACKOFF, MIN_COUNT = 3, 0.4, 2
#: Bytes of text in a slice, except that a document is never cut.
SLICE_BYTES = 24_000_000
#: A hash range of one order gets about so many n-grams at most.
RANGE_GRAMS = 2_000_000


def pack(values: np.ndarray) -> bytes:
    """Byte planes, compressed: small numbers and sorted hashes' differences have mostly empty upper planes."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()) if len(values) else b""


def unpack(packed: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if not packed:
        return np.empty(0, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(kind)


def grams(words: np.ndarray, lengths: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """Order by order the hash of the n-gram that ends at each word, 0 where the document has not begun so far back."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    last = words
    for n in range(1, order + 1):
        if n > 1:
            last = np.where(place >= n - 1, np.r_[np.uint64(0), last[:-1]] * np.uint64(0x2545F4914F6CDD1D) + words, np.uint64(0))
        mixed = last ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        yield np.where(place >= n - 1, np.maximum(mixed, np.uint64(1)), np.uint64(0))


def cuts(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Where the hash ranges begin in sorted hashes; the last entry is the end."""
    return np.searchsorted((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1))


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The distinct hashes, sorted. (``np.unique`` goes through a hash table, which is many times slower on long columns.)"""
    out = np.sort(hashes)
    return out[np.r_[True, out[1:] != out[:-1]][:len(out)]]


def places(found: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where each of ``hashes`` stands in ``found``, which is sorted and has them all. Their upper bits, counted from the smallest as a hash range holds a small part
    of all values, tell the place nearly, as hashes are even; the rest is steps of one, which spares most of a binary search."""
    if not len(found):
        return np.zeros(len(hashes), np.int64)
    span = int(found[-1] - found[0])
    shift = np.uint64(max(0, span.bit_length() - (len(found).bit_length() - 1)))
    first = np.searchsorted(found - found[0] >> shift, np.arange((span >> int(shift)) + 2, dtype=np.uint64))
    at = first[(hashes - found[0] >> shift).astype(np.int64)]
    behind = np.flatnonzero(found[at] < hashes)
    while len(behind):
        at[behind] += 1
        behind = behind[found[at[behind]] < hashes[behind]]
    return at


def log_scores(number: list[np.ndarray], total: int, backoff: float, min_count: int) -> np.ndarray:
    """Logarithm of every word's score, from the counts of the n-grams that end there (0: the text has not begun so far back)."""
    out, open_, steps = np.zeros(len(number[0])), np.ones(len(number[0]), bool), np.zeros(len(number[0]))
    for n in range(len(number), 1, -1):
        able = open_ & (number[n - 1] > 0)
        hit = able & (number[n - 1] >= min_count)
        at = np.flatnonzero(hit)
        out[at] = np.log(number[n - 1][at]) - np.log(number[n - 2][at - 1]) + steps[at] * np.log(backoff)
        open_ &= ~hit
        steps += able & ~hit
    at = np.flatnonzero(open_)
    out[at] = np.log(number[0][at]) - np.log(total) + steps[at] * np.log(backoff)
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT,
          slice_bytes: int = SLICE_BYTES, range_grams: int = RANGE_GRAMS) -> DataFrame:
    """(id_col, n_words, log_score) of every row: the sum over its words of log S, where S of a word is
    count(n-gram) / count(its first n - 1 words) for the longest n-gram, up to ``order``, that ends there and occurs
    ``min_count`` times in ``docs``, times ``backoff`` for every longer one passed over; a word alone always counts, over the number of all words.

    With ``min_count`` 2 an n-gram that only one place has is no evidence for that place. Null, empty and wordless texts have
    no words and the score 0. Repeated rows count and come out as often as they occur; ids may be null."""
    kind, arrow_id = docs.schema[id_col].dataType.simpleString(), "_ids"
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row():
            names = list(vocabulary)
            hashes = np.array([xxhash.xxh64_intdigest(w, 1) for w in names], np.uint64)
            return pa.RecordBatch.from_arrays([pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type)), *(pa.array([x], pa.binary()) for x in (
                pack(np.array(lengths, np.uint32)), pack(np.concatenate(tokens)), hashes.tobytes())), pa.array([sum(lengths)], pa.int64())],
                names=[arrow_id, "lengths", "tokens", "words", "n"])

        ids, lengths, tokens, vocabulary, held = [], [], [], {}, 0
        for batch in batches:
            for i in range(batch.num_rows):
                own = words_of(batch.column(1)[i].as_py())
                for w in set(own).difference(vocabulary):
                    vocabulary[w] = len(vocabulary)
                tokens.append(np.fromiter(map(vocabulary.__getitem__, own), np.uint32, len(own)))
                ids.append(batch.column(0).slice(i, 1)), lengths.append(len(own))
                held += 6 * len(own) + 64
                if held >= slice_bytes:
                    yield row()
                    ids, lengths, tokens, vocabulary, held = [], [], [], {}, 0
        if ids:
            yield row()

    slices = cut_lineage(slim.mapInArrow(read, f"{arrow_id} array<{kind}>, lengths binary, tokens binary, words binary, n long")
                         .withColumn("_slice", F.monotonically_increasing_id()))
    total = slices.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(1, -(-total // range_grams))  # of each order

    def ends(row) -> tuple[np.ndarray, Iterator[np.ndarray]]:
        lengths = unpack(row["lengths"], np.uint32).astype(np.int64)
        words = np.frombuffer(row["words"], np.uint64)[unpack(row["tokens"], np.uint32)]
        return lengths, grams(words, lengths, order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, own = ends({c: batch.column(c)[i].as_py() for c in ("lengths", "tokens", "words")})
                for level, hashes in enumerate(own):
                    found, n = np.unique(hashes, return_counts=True)
                    found, n = (found[1:], n[1:]) if len(found) and found[0] == 0 else (found, n)
                    at = cuts(found, ranges)
                    k = np.flatnonzero(np.diff(at))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(k), batch.column("_slice")[i].as_py(), np.int64)), pa.array((level * ranges + k).astype(np.int32)),
                        pa.array([pack(np.diff(found[at[j]:at[j + 1]], prepend=np.uint64(0))) for j in k], pa.binary()),
                        pa.array([pack(n[at[j]:at[j + 1]].astype(np.uint32)) for j in k], pa.binary())], names=["_slice", "range", "grams", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for s, r, g, n in zip(*(batch.column(c).to_pylist() for c in ("_slice", "range", "grams", "n"))):
                held.setdefault(r, []).append((s, g, n))
        for r in sorted(held):
            rows = held.pop(r)
            parts = [np.cumsum(unpack(g, np.uint64), dtype=np.uint64) for _, g, _ in rows]
            every = np.concatenate(parts)
            at = places(distinct(every), every)
            sums = np.bincount(at, np.concatenate([unpack(n, np.uint32) for *_, n in rows])).astype(np.uint64)[at]
            borders = np.cumsum([0, *map(len, parts)])
            yield pa.RecordBatch.from_arrays([pa.array([s for s, *_ in rows], pa.int64()), pa.array(np.full(len(rows), r, np.int32)),
                                              pa.array([pack(sums[a:b]) for a, b in zip(borders, borders[1:])], pa.binary())], names=["_slice", "range", "n"])

    width = max(int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions")), ranges)
    counted = slices.select("_slice", "lengths", "tokens", "words").mapInArrow(count, "_slice long, range int, grams binary, n binary")
    answers = counted.repartition(width, "range").mapInArrow(add, "_slice long, range int, n binary")

    def sum_up(texts: pa.Table, counts: pa.Table) -> pa.Table:
        out = []
        for row in texts.to_pylist():
            lengths = unpack(row["lengths"], np.uint32).astype(np.int64)
            words = np.frombuffer(row["words"], np.uint64)[unpack(row["tokens"], np.uint32)]
            sums: list[float] = []
            # whole documents of about half a million words at a time: only one order's hashes are held for the slice
            upto = np.cumsum(lengths)
            turn = upto // 500_000
            cut = np.r_[0, np.flatnonzero(turn[1:] != turn[:-1]) + 1, len(lengths)]
            spans = [(words[(upto[i - 1] if i else 0):upto[j - 1]], lengths[i:j]) for i, j in zip(cut, cut[1:]) if j > i]
            parts = sorted(zip(counts.column("range").to_pylist(), counts.column("n").to_pylist()))
            number = [[] for _ in spans]
            for level in range(order):
                hashes = [next(islice(grams(*span, order), level, None)) for span in spans]
                found = distinct(np.concatenate([distinct(h) for h in hashes]))
                blank = np.zeros(int(len(found) > 0 and found[0] == 0), np.uint64)
                known = np.concatenate([blank, *(unpack(n, np.uint64) for r, n in parts if r // ranges == level)])
                for k in range(len(spans)):
                    number[k].append(known[places(found, hashes[k])])
                    hashes[k] = None
            for (_, own), n in zip(spans, number):
                logs, ends_ = log_scores(n, total, backoff, min_count), np.cumsum(own)
                sums += [logs[e - w:e].sum() for e, w in zip(ends_, own)]
            out.append(pa.table({id_col: texts.column(arrow_id).combine_chunks().flatten(), "n_words": pa.array(lengths, pa.int64()), "log_score": pa.array(np.array(sums, float), pa.float64())}))
        return pa.concat_tables(out)

    keyed = slices.select(F.col("_slice").alias("_slice"), arrow_id, "lengths", "tokens", "words")
    return keyed.groupBy("_slice").cogroup(answers.groupBy("_slice")).applyInArrow(sum_up, f"`{id_col}` {kind}, n_words long, log_score double")
