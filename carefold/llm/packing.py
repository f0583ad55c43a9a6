"""Packing of documents into training sequences by cutting-stock column generation.

One pass over the texts yields the pieces: a document is cut at every full sequence, and what is left is one piece. The
histogram of piece lengths, in classes of ``unit`` tokens, is all that reaches the driver; its size does not depend on the
data. There a linear program over patterns (how many pieces of each class a sequence holds) is solved by column generation:
a knapsack over the dual values of the classes finds the pattern that saves most, until no pattern saves more than the given
share. Pattern counts are rounded down, the few pieces left over are packed best-fit. Documents are ranked inside their class
and take the pattern places in that order, all as joins and windows over slim rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from carefold.llm.tokens import encoder
from carefold.session import cut_lineage

CAPACITY = 4096
#: Tokens of a length class; a piece takes its length rounded up to a multiple.
UNIT = 2
#: The search for patterns ends when none can lower the number of sequences by more than this share.
GAP = 0.0005
#: Columns that are generated at most; the counts found so far hold everything at any step.
STEPS = 400
#: Pieces that one task ranks at a time.
RANKED = 50_000


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer_file: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens[, ids]) for every piece. A null text is an empty one: its only id is ``end_id``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Path(tokenizer_file).read_text())
    ids_type = pa.list_(pa.int32())

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = encoder(shared), int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows, starts, lengths, crcs, totals, ids = [], [], [], [], [], []
            held, begins = own.encode_all(batch.column(1))
            begins = begins.tolist()
            for i, (begin, end) in enumerate(zip(begins, begins[1:])):
                total = (end - begin) // 4 + 1
                for start in range(0, total, capacity):
                    part = bytes(held[begin + 4 * start:min(end, begin + 4 * (start + capacity))])
                    part += last if start + capacity >= total else b""
                    rows.append(i), starts.append(start), lengths.append(len(part) // 4), totals.append(total)
                    crcs.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(ids, ids_type)), names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(
        stage, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else ""))


def best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the most valuable pattern and its copies of each size (sizes rise)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c], k = best[c - 1], upto[c]
        if k:
            got = best[c - sizes[:k]] + values[:k]
            i = int(got.argmax())
            if got[i] > best[c] + 1e-12:
                best[c], pick[c] = got[i], i
    copies, c = np.zeros(len(sizes), int), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            copies[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[capacity]), copies


def greedy_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Square matrix of patterns and their counts, a feasible start: each pattern takes the largest sizes that still fit, is used
    until one of its sizes is spent, and that size is in no later pattern, so the matrix is triangular up to order."""
    left, live, own = demand.tolist(), list(range(len(sizes))), sizes.tolist()
    columns, counts = np.zeros((len(sizes), len(sizes))), np.zeros(len(sizes))
    while live:
        copies, space = {}, capacity
        while (k := bisect.bisect_right(own, space)):
            n = max(1, min(space // own[k - 1], int(left[live[k - 1]]) - copies.get(live[k - 1], 0)))
            copies[live[k - 1]] = copies.get(live[k - 1], 0) + n
            space -= n * own[k - 1]
        spent = min(copies, key=lambda i: left[i] / copies[i])
        uses = left[spent] / copies[spent]
        for i, n in copies.items():
            left[i] = max(0.0, left[i] - uses * n)
            columns[i, spent] = n
        counts[spent] = uses
        at = bisect.bisect_left(live, spent)
        del live[at], own[at]
    return columns, counts


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, counts): columns of the linear program ``least sum(x), patterns @ x >= demand`` and their fractional counts.

    Revised simplex with generated columns. Farley's bound (objective / best pattern value) and the total length prove how
    far the optimum can be; the search ends within ``gap`` of it or within one sequence."""
    m = len(sizes)
    patterns, x = greedy_basis(sizes, demand, capacity)
    cost, inverse, steps, proven = np.ones(m), None, 0, float(sizes @ demand) / capacity
    while (total := float(cost @ x)) > max(proven * (1 + gap), proven + 1) and steps < STEPS:
        inverse = np.linalg.inv(patterns) if steps % 100 == 0 else inverse
        duals = cost @ inverse
        i = int(duals.argmin())
        if duals[i] < -1e-9:
            column, price = -np.eye(m)[i], 0.0
        else:
            value, copies = best_pattern(sizes, duals, capacity)
            proven = max(proven, total / max(value, 1.0))
            if value <= 1 + 1e-9 or total <= proven * (1 + gap):
                break
            column, price = copies.astype(float), 1.0
        change = inverse @ column
        rising = change > 1e-9
        if not rising.any():
            break
        ratio = np.where(rising, x / np.where(rising, change, 1), np.inf)
        least = ratio.min()
        out = int(np.where(ratio <= least + 1e-12, change, -1).argmax())  # of equal ratios the largest pivot
        patterns[:, out], cost[out] = column, price
        steps += 1
        row = inverse[out] / change[out]
        inverse -= np.outer(change, row)
        inverse[out] = row
        x = np.maximum(inverse @ demand, 0)
    keep = cost > 0
    return patterns[:, keep].astype(int), x[keep]


def plan(histogram: dict[int, int], capacity: int, gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """[(copies of each size, how many sequences)] that hold the whole histogram."""
    left = {s: n for s, n in histogram.items() if n}
    if not left:
        return []
    sizes = np.array(sorted(left))
    patterns, counts = cutting_stock(sizes, np.array([float(left[s]) for s in sizes]), capacity, gap)
    out = []
    for k in np.argsort(-counts, kind="stable"):
        copies = {int(sizes[i]): int(patterns[i, k]) for i in np.flatnonzero(patterns[:, k])}
        n = min([int(counts[k] + 1e-6), *(left[s] // a for s, a in copies.items())])
        if n > 0:
            out.append((copies, n))
            for s, a in copies.items():
                left[s] -= a * n
    room: list[tuple[int, int]] = []  # (space, sequence), rising
    bins: list[dict[int, int]] = []
    for s in sorted(left, reverse=True):
        for _ in range(left[s]):
            at = bisect.bisect_left(room, (s, -1))
            space, b = room.pop(at) if at < len(room) else (capacity, len(bins))
            if b == len(bins):
                bins.append({})
            bins[b][s] = bins[b].get(s, 0) + 1
            bisect.insort(room, (space - s, b))
    return out + [(b, 1) for b in bins]


def places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per class: first rank, first sequence and copies of every pattern that has the class."""
    rows: dict[int, list] = {}
    first = 0
    for copies, n in patterns:
        for s, a in copies.items():
            own = rows.setdefault(s, [[0], [], []])
            own[0].append(own[0][-1] + a * n), own[1].append(first), own[2].append(a)
        first += n
    return {s: (np.array(r[:-1]), np.array(f), np.array(a)) for s, (r, f, a) in rows.items()}


def _ranked(df: DataFrame, id_col: str, total: int) -> DataFrame:
    """Adds ``_rank``, from 0 inside every class. A class is ranked in parts of bounded size, so no task holds a whole one."""
    parts = max(1, -(-total // RANKED))
    parted = df.withColumn("_part", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(parts)))
    sizes = parted.groupBy("_class", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_class", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_class", "_part").orderBy(F.desc("length"), id_col, "start", "ids_crc32")
    numbered = parted.withColumn("_own", F.row_number().over(inside) - 1)
    return numbered.join(sizes, ["_class", "_part"]).withColumn("_rank", F.col("_before") + F.col("_own"))


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = CAPACITY,
         unit: int = UNIT, with_ids: bool = False) -> DataFrame:
    """Pieces with the sequence and the offset where they lie: id_col, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and the token ids of the piece if ``with_ids``.

    Every id of every document, the closing ``end_id`` included, lies in exactly one piece. A null or empty text is its
    closing id alone. Repeated rows are packed as often as they occur, rows with a null id like others. No rows, no
    pieces. ``capacity`` must be a multiple of ``unit``."""
    if capacity % unit:
        raise ValueError("capacity must be a multiple of unit")
    cut = cut_lineage(pieces(docs, id_col, text_col, tokenizer_file, end_id, capacity, with_ids)
                      .withColumn("_class", F.ceil(F.col("length") / unit).cast("int")))
    histogram = {r["_class"]: r["n"] for r in cut.groupBy("_class").agg(F.count("*").alias("n")).collect()}
    table = places(plan(histogram, capacity // unit))
    shared = cut.sparkSession.sparkContext.broadcast(table)  # at most (capacity / unit) ** 2 patterns by classes

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, ranks = batch.column("_class").to_numpy(), batch.column("_rank").to_numpy()
            sequence = np.empty(len(kinds), np.int64)
            for kind in np.unique(kinds):
                own = kinds == kind
                start, first, copies = shared.value[int(kind)]
                at = np.searchsorted(start, ranks[own], "right") - 1
                sequence[own] = first[at] + (ranks[own] - start[at]) // copies[at]
            keep = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(sequence)], names=[*keep, "sequence_id"])

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else []), "_class"]
    ranked = _ranked(cut, id_col, sum(histogram.values())).select(*names, "_rank")
    schema = ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id long"
    placed = ranked.mapInArrow(place, schema)
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), id_col, "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("_class")
