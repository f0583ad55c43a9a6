"""Near duplicates by SimHash fingerprints and a Gray-order hierarchical index.

Fingerprints are made in one pass over the texts. Every distinct fingerprint is then turned into one rotated copy per
block of bits: two fingerprints that differ in at most ``distance`` bits agree in at least one of ``distance + 1`` blocks.
A rotated copy has its block in front and goes to the shard that holds its Gray rank; shards are cut at even row counts, so
a block value that many fingerprints share is spread over as many shards as it needs. The upper nodes of the index are the
bit patterns that all codes of a shard share: a code visits a later shard only if the pattern differs from it in at most
``distance`` bits. Inside a shard the codes lie in Gray order, nodes are runs with a common bit prefix, and the search goes
down pairs of nodes, adding up the differing bits and dropping whole groups once they exceed the distance.

Distinct codes within two bits are at most 2,080 per code, so the work stays linear in the number of distinct fingerprints
however dense a group of copies is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from carefold.operators.graph import components
from carefold.session import cut_lineage

SEED = 42
#: Rotated codes of a shard; what a task holds in memory is a few times as many.
SHARD_ROWS = 200_000
#: Candidate pairs of nodes that are expanded at a time.
CHUNK = 2_000_000
#: Bits that one level of the index adds to the common prefix.
STEP = 4


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words, repeats included; a shorter text is one run, one without words none."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    runs = map(b" ".join, zip(*(tokens[i:] for i in range(words)))) if len(tokens) > words else (b" ".join(tokens),)
    return np.array([xxhash.xxh64_intdigest(r, SEED) for r in runs], np.uint64)


def majority(hashes: np.ndarray) -> np.uint64:
    """Bit i is 1 if it is 1 in over half the hashes."""
    if not len(hashes):
        return np.uint64(0)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id_col, fp): the 64-bit fingerprint of every row as a signed long. Null and wordless texts have fingerprint 0."""
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([majority(shingle_hashes(t.as_py(), words)) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    slim = docs.select(id_col, F.col(text_col).cast("binary").alias("_text"))
    return slim.mapInArrow(stage, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


def blocks_of(distance: int) -> list[tuple[int, int]]:
    """(offset, width) of the ``distance + 1`` blocks that the 64 bits are cut into."""
    cuts = [64 * i // (distance + 1) for i in range(distance + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def rotate(codes: np.ndarray, by: int) -> np.ndarray:
    return codes if by % 64 == 0 else (codes << np.uint64(by % 64)) | (codes >> np.uint64(64 - by % 64))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of a code in the reflected Gray sequence."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def gray_code(ranks: np.ndarray) -> np.ndarray:
    return ranks ^ (ranks >> np.uint64(1))


class Labels:
    """Smallest member of each set; unions come in batches."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            la, lb = self.of[a], self.of[b]
            apart = la != lb
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(self.of, np.maximum(la, lb), np.minimum(la, lb))
            while (self.of != (up := self.of[self.of])).any():
                self.of = up


class GrayIndex:
    """Distinct rotated codes of one block in Gray order, as a tree: level k joins neighbours with the same first ``bits[k]`` bits."""

    def __init__(self, codes: np.ndarray, prefix: int):
        self.codes = np.unique(codes)
        self.codes = self.codes[np.argsort(gray_rank(self.codes), kind="stable")]
        self.bits = [*range(prefix, 64, STEP), 64]
        self.starts = []
        for bits in self.bits:
            head = self.codes >> np.uint64(64 - bits)
            self.starts.append(np.flatnonzero(np.r_[True, head[1:] != head[:-1]]) if len(head) else np.empty(0, int))
        #: child[k][i]: the first node of level k + 1 below node i of level k.
        self.child = [np.r_[np.searchsorted(low, top), len(low)] for top, low in zip(self.starts, self.starts[1:])]

    def link(self, distance: int, labels: Labels, at: np.ndarray) -> int:
        """Joins in ``labels`` all codes that share the prefix and differ in at most ``distance`` bits; ``at`` gives
        each code's place there. Returns how many pairs of nodes were looked at."""
        roots = np.arange(len(self.starts[0]))
        roots = roots[np.diff(np.r_[self.starts[0], len(self.codes)]) > 1]
        return self._down(0, roots, roots, np.zeros(len(roots), np.int64), distance, labels, at)

    def _down(self, level, left, right, diff, distance, labels, at) -> int:
        if level == len(self.bits) - 1:
            labels.join(at[left], at[right])
            return 0
        first, looked = self.child[level], 0
        widths = (first[left + 1] - first[left]) * (first[right + 1] - first[right])
        ends = np.cumsum(widths)
        begin = 0
        while begin < len(left):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CHUNK, "right")))
            part = slice(begin, stop)
            n, wide = widths[part], (first[right + 1] - first[right])[part]
            which = np.repeat(np.arange(stop - begin), n)
            k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            a, b = first[left[part]][which] + k // wide[which], first[right[part]][which] + k % wide[which]
            looked += len(a)
            keep = (left[part] != right[part])[which] | (a <= b)
            a, b, d = a[keep], b[keep], diff[part][which][keep]
            low = self.starts[level + 1]
            mask = np.uint64((1 << (64 - self.bits[level])) - (1 << (64 - self.bits[level + 1])))
            d = d + np.bitwise_count((self.codes[low[a]] ^ self.codes[low[b]]) & mask)
            size = np.diff(np.r_[low, len(self.codes)])
            keep = (d <= distance) & ((a != b) | (size[a] > 1))
            if keep.any():
                looked += self._down(level + 1, a[keep], b[keep], d[keep], distance, labels, at)
            begin = stop
        return looked


def visits(codes: np.ndarray, width: int, distance: int, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) for rotated codes: the shard that holds a code's Gray rank, and every later shard that can hold a code
    with the same first ``width`` bits within the distance. ``low``: smallest rank of each shard, from 0, rising."""
    ranks = gray_rank(codes)
    home = np.searchsorted(low, ranks, "right") - 1
    rows, shards = [np.arange(len(codes))], [home]
    high = np.r_[low[1:] - np.uint64(1), np.uint64(2**64 - 1)]
    spread = low ^ high
    for s in (1, 2, 4, 8, 16, 32):
        spread |= spread >> np.uint64(s)
    shared = ~spread  # the leading bits that all ranks, and so all codes, of a shard have in common
    last = np.searchsorted(low, ranks | np.uint64((1 << (64 - width)) - 1), "right") - 1
    for step in range(1, int((last - home).max(initial=0)) + 1):
        row = np.flatnonzero(home + step <= last)
        shard = home[row] + step
        near = np.bitwise_count((codes[row] ^ gray_code(low[shard])) & shared[shard]) <= distance
        rows.append(row[near])
        shards.append(shard[near])
    return np.concatenate(rows), np.concatenate(shards)


def linked(codes: DataFrame, distance: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): edges that connect exactly the distinct longs of ``codes (fp)`` that differ in at most ``distance`` bits.
    Reduced inside each shard to stars; the connected components are those of all links."""
    spark, blocks = codes.sparkSession, blocks_of(distance)
    signed = F.col("fp")
    ranks = []
    for k, (offset, _) in enumerate(blocks):
        turned = F.shiftleft(signed, offset).bitwiseOR(F.shiftrightunsigned(signed, 64 - offset)) if offset else signed
        for s in (1, 2, 4, 8, 16, 32):
            turned = turned.bitwiseXOR(F.shiftrightunsigned(turned, s))
        ranks.append(turned.bitwiseXOR(F.lit(-2**63)))  # in the order of unsigned numbers
    total = codes.count()
    shards = max(1, -(-total // shard_rows))
    cuts = [[] for _ in blocks]
    if shards > 1:  # so many quantiles a block: the only thing the driver sees, one number for every shard_rows codes
        share = [i / shards for i in range(1, shards)]
        row = codes.select(*[r.alias(f"r{k}") for k, r in enumerate(ranks)]).agg(*[
            F.percentile_approx(f"r{k}", share, 20 * shards).alias(f"r{k}") for k in range(len(blocks))]).first()
        cuts = [sorted({v + 2**63 for v in row[k]} - {0}) for k in range(len(blocks))]
    lows = [np.array([0, *c], np.uint64) for c in cuts]
    stride = max(len(x) for x in lows)

    def deal(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (offset, width) in enumerate(blocks):
                rows, shard = visits(rotate(own, offset), width, distance, lows[k])
                yield pa.RecordBatch.from_arrays(
                    [pa.array((k * stride + shard).astype(np.int32)), pa.array(own[rows].view(np.int64))], names=["shard", "fp"])

    def search(batches):
        parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        if not parts:
            return
        block = np.concatenate([p[0] for p in parts]) // stride
        own = np.concatenate([p[1] for p in parts]).view(np.uint64)
        names = np.unique(own)
        labels = Labels(len(names))
        for k, (offset, width) in enumerate(blocks):
            index = GrayIndex(rotate(own[block == k], offset), width)
            index.link(distance, labels, np.searchsorted(names, rotate(index.codes, 64 - offset)))
        child = np.flatnonzero(labels.of != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[child].view(np.int64)), pa.array(names[labels.of[child]].view(np.int64))], names=["a", "b"])

    dealt = codes.select("fp").mapInArrow(deal, "shard int, fp long").repartition(max(stride * len(blocks), _width(spark)), "shard")
    return dealt.mapInArrow(search, "a long, b long")


def _width(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """(id_col, fp, component_id) for every row: fingerprint as a signed long and the smallest id that links of at most
    ``distance`` differing bits reach.

    Null texts, empty texts and texts of white space have fingerprint 0 and link like any other. Repeated rows come out as
    often as they came in. Null ids never become a component id; a class of nothing but null ids has a null one. No rows in,
    no rows out. Other columns are not looked at."""
    marked = cut_lineage(fingerprints(docs, id_col, text_col, words))
    codes = cut_lineage(marked.groupBy("fp").agg(F.min(id_col).alias("_low")))
    found = components(linked(codes, distance))
    classes = codes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("_root", F.coalesce("component", "fp"))
    best = classes.groupBy("_root").agg(F.min("_low").alias("component_id"))
    named = cut_lineage(classes.join(best, "_root").select("fp", "component_id"))
    return marked.join(named, "fp").select(id_col, "fp", "component_id")
