"""One document of each near-duplicate group: SimHash codes in a Gray-order index first, then a lossless search for the rest.

The distinct word shingles of a text are dealt by hash into ``PARTS`` parts, and a part gets a 64-bit SimHash. An edit touches
few parts, so close copies agree in most codes, and operator 1's Gray-order index ties each to the oldest of its group. No
distance that this index can search covers a similarity of 0.8, where codes differ in about ten bits, so the index only saves
work: sets that reach the similarity share one of their rarest shingles (prefix filter), and all sets of such a shingle that no
verified link connects yet are compared. Exact Jaccard on the whole shingle sets decides every link. Equal shingle sets are
reduced to one row first. A shingle of more sets than ``GROUP_ROWS`` is searched in tiles.

Pairs of sets that may reach the similarity never leave the task that finds them, as a group of near copies has a number of them that
grows with its square. The task hands on stars that connect the same sets; what these connect over all shingles is a clump, which
holds both ends of every link. Sketches of each clump's sets then meet in one task, or in tiles, which cuts it to smaller clumps in
the same way, and at last their whole sets do, which gives no more links than connect them.

Whole sets are larger than the texts, so they are made for few sets only. Two small sketches of a set, the number of its hashes by
their upper bits and a bitmap of their lower bits, bound from above what two sets can have in common; pairs whose bound is
below the similarity are dropped before, which loses none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from carefold.llm.simhash import SHARD_ROWS, Labels, linked, majority, shingle_hashes
from carefold.operators.graph import components
from carefold.session import cut_lineage

WORDS, SIMILARITY = 5, 0.8
#: Parts of a shingle set, and how many of them go through the Gray index.
PARTS, INDEXED = 32, 8
#: Differing bits up to which the index connects two codes of a part.
DISTANCE = 2
#: Sets that share a shingle up to which one task compares them all.
GROUP_ROWS = 8192
#: Hashes and sets of a clump up to which one task compares them all.
PIECE_HASHES, PIECE_ROWS = 1 << 20, 2048
#: Slots in which occurrences of shingles are counted.
SLOTS = 1 << 20
#: Bins in which a set's hashes are counted by their upper bits, a byte each; FULL in a bin says that many or more.
BINS, FULL = 64, 255
#: Pairs whose counts are compared at once.
PAIRS = 1 << 17
_EMPTY = np.uint64(0)


def signature(text: bytes | None, words: int = WORDS) -> tuple[bytes, bytes, bytes, int]:
    """(digest of the shingle set, code of all parts, the set itself as sorted 64-bit hashes, its size)."""
    whole = np.unique(shingle_hashes(text, words))
    mixed = whole * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    part = (mixed >> np.uint64(27) & np.uint64(PARTS - 1)).astype(int)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(PARTS + 1))
    code = np.zeros(PARTS, np.uint64)
    for k in np.flatnonzero(np.diff(ends)):
        code[k] = majority(whole[order[ends[k]:ends[k + 1]]]) or np.uint64(1)
    return xxhash.xxh3_128_digest(whole.tobytes()), code.tobytes(), whole.tobytes(), len(whole)


def set_id(digest: bytes) -> int:
    """The digest of a shingle set cut to a signed long, which names the set."""
    return int.from_bytes(digest[:8], "little", signed=True)


def spread(whole: np.ndarray) -> bytes:
    """How many hashes of a set fall into each of ``BINS`` bins, cut at ``FULL``."""
    return np.minimum(np.bincount((whole >> np.uint64(58)).astype(np.int64), minlength=BINS), FULL).astype(np.uint8).tobytes()


def most_by_spread(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The most that sets with the counts in the rows of ``x`` and ``y`` can have in common; a bin that is full in both sets no bound."""
    least = np.minimum(x, y)
    return np.where((least == FULL).any(1), np.iinfo(np.int64).max, least.sum(1, dtype=np.int64))


def bits(whole: np.ndarray) -> bytes:
    """A bitmap of a set's hashes by their lower bits, of 64 times a power of two and at least two bits a hash."""
    m = 64 << ((2 * len(whole) - 1) // 64).bit_length() if len(whole) else 64
    there = np.zeros(m, bool)
    there[(whole & np.uint64(m - 1)).astype(np.int64)] = True
    return np.packbits(there, bitorder="little").tobytes()


def most_by_bits(x: np.ndarray, y: np.ndarray, n: int, m: int) -> int:
    """The most that sets of ``n`` and ``m`` hashes with these bitmaps (64-bit words) can have in common: every bit that only one of them
    has is a hash that the other lacks. The longer bitmap is folded to the length of the other."""
    while len(x) > len(y):
        x = x[:len(x) // 2] | x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] | y[len(y) // 2:]
    return min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))


def _needed(n, m, similarity: float):
    """What sets of these sizes have in common at least if they reach the similarity."""
    return similarity / (1 + similarity) * (n + m) - 1e-6


def _codes(column, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, parts)


def candidate_links(sets: DataFrame, group_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): for every row of ``sets (_set, _size, _code)`` and part, the smallest row whose code of a part the Gray-order
    index of operator 1 connects with its own. ``group_rows``: codes of a shard of the index."""
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = _codes(batch.column("_code"), PARTS)[:, :INDEXED]
            row, part = np.nonzero(code != _EMPTY)
            yield pa.RecordBatch.from_arrays([batch.column("_set").take(pa.array(row)), pa.array(code[row, part].view(np.int64))], names=["_set", "fp"])

    own = cut_lineage(sets.select("_set", "_code").mapInArrow(codes, "_set long, fp long"))
    found = components(linked(own.select("fp").distinct(), DISTANCE, group_rows)).withColumnRenamed("node", "fp")
    named = cut_lineage(own.join(found, "fp", "left").select("_set", F.coalesce("component", "fp").alias("class")))
    first = named.groupBy("class").agg(F.min("_set").alias("b"))
    return named.join(first, "class").filter("_set <> b").select(F.col("_set").alias("a"), "b").distinct()


def commonness(slim: DataFrame, words: int = WORDS) -> np.ndarray:
    """How often shingles occur, by slot of their hash, counted in every eighth text. It only decides which shingles come first
    in a set, the rare ones, and so how much is compared; any order gives the same links."""
    step = SLOTS // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int32)
        for batch in batches:
            for text in batch.column("_text"):
                np.add.at(total, (np.unique(shingle_hashes(text.as_py(), words)) & np.uint64(SLOTS - 1)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array([total[i * step:(i + 1) * step].tobytes() for i in range(64)], pa.binary())], names=["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column("piece").to_pylist(), batch.column("counts")):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(counts.as_buffer(), np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["piece", "counts"])

    some = slim.filter("pmod(_mark, 8) = 0").select("_text").mapInArrow(count, "piece long, counts binary")
    out = np.zeros(SLOTS, np.int64)
    for r in some.repartition("piece").mapInArrow(add, "piece long, counts binary").toLocalIterator():  # SLOTS numbers, whatever the data
        out[r["piece"] * step:(r["piece"] + 1) * step] = np.frombuffer(r["counts"], np.int64)
    return out


def shared_shingles(slim: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(key, row, size, place, first, n): the sets that have the shingle ``key`` among their rarest ``size - ceil(similarity * size) + 1``,
    its place in the set, the smallest such set and their number, for shingles of two sets at least. Two sets that reach
    the similarity always share one of these."""
    counts = slim.sparkSession.sparkContext.broadcast(commonness(slim, words))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keys, rows, sizes = [np.empty(0, np.uint64)], [], []
            for text in batch.column("_text"):
                whole = np.unique(shingle_hashes(text.as_py(), words))
                row = set_id(xxhash.xxh3_128_digest(whole.tobytes()))
                if not len(whole) or row in seen:
                    continue
                seen.add(row)
                order = np.lexsort((whole, counts.value[(whole & np.uint64(SLOTS - 1)).astype(np.int64)]))
                keys.append(whole[order[:len(whole) - math.ceil(similarity * len(whole) - 1e-9) + 1]])
                rows.append(row)
                sizes.append(len(whole))
            n = [len(k) for k in keys[1:]]
            place = np.concatenate([np.empty(0, np.int32), *(np.arange(k, dtype=np.int32) for k in n)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(rows, np.int64), n)),
                                              pa.array(np.repeat(np.array(sizes, np.int32), n)), pa.array(place.astype(np.int32))], names=["key", "row", "size", "place"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row, size, place = _columns(batches, 4)
        order = np.lexsort((row, key))
        order = order[np.r_[True, (np.diff(key[order]) != 0) | (np.diff(row[order]) != 0)][:len(order)]]
        key, row, size, place = (x[order] for x in (key, row, size, place))
        starts = np.flatnonzero(np.r_[True, np.diff(key) != 0][:len(key)])
        n = np.diff(np.r_[starts, len(key)])
        first, n = np.repeat(row[starts], n), np.repeat(n, n)
        for at in np.array_split(np.flatnonzero(n > 1), max(1, len(n) >> 17)):
            yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (key, row, size, place, first, n)], names=["key", "row", "size", "place", "first", "n"])

    posts = slim.select("_text").mapInArrow(post, "key long, row long, size int, place int")
    return cut_lineage(posts.repartition("key").mapInArrow(gather, "key long, row long, size int, place int, first long, n long"))


def _columns(batches: Iterator[pa.RecordBatch], n: int) -> list[np.ndarray]:
    held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    return [np.concatenate(x) for x in zip(*held)] if held else [np.empty(0, np.int64)] * n


def _spreads(columns: list[pa.Array]) -> np.ndarray:
    return np.concatenate([np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, BINS) for c in columns])


def links_between(shared: DataFrame, found: DataFrame, similarity: float = SIMILARITY, group_rows: int = GROUP_ROWS, sets: DataFrame | None = None, stars: bool = False) -> DataFrame:
    """(a, b): every two sets of different components ``found (node, component)`` that share a shingle of ``shared`` and may reach
    the similarity by their sizes, by what is left of them after that shingle and, where ``sets (_set, _spread)`` are given, by their
    hashes' counts. ``stars``: in place of all these pairs, stars that connect the same sets, at most one row for each set and task.

    A shingle of more than ``group_rows`` sets is cut by hash into pieces, and every two pieces meet in a task of their own."""
    counted = sets is not None

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        key, low, high, piece, row, size, place, label = _columns((b.select(range(8)) for b in held), 8)
        if not len(key):
            return
        counts = _spreads([b.column("_spread") for b in held]) if counted else None
        del held
        order = np.lexsort((size, high, low, key))
        key, low, high, piece, row, size, place, label = (x[order] for x in (key, low, high, piece, row, size, place, label))
        group = np.cumsum(np.r_[False, (np.diff(key) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)])
        # the largest component of every group: pairs have at most one end in it, so only the other rows search
        by_label = np.lexsort((label, group))
        runs = np.flatnonzero(np.r_[True, (np.diff(group[by_label]) != 0) | (np.diff(label[by_label]) != 0)])
        length, of = np.diff(np.r_[runs, len(by_label)]), group[by_label[runs]]
        best = np.lexsort((length, of))
        best = best[np.r_[np.diff(of[best]) != 0, True]]
        main = label == label[by_label[runs[best]]][group]
        who = np.flatnonzero(~main)
        at = group.astype(np.int64) << 32 | size.astype(np.int64)
        base = group[who].astype(np.int64) << 32
        begin = np.searchsorted(at, base + np.ceil(similarity * size[who] - 1e-6).astype(np.int64), "left")
        n = np.searchsorted(at, base + np.floor(size[who] / similarity + 1e-6).astype(np.int64), "right") - begin
        ends, done = np.cumsum(n), 0
        names, name = np.unique(row, return_inverse=True)
        tied = Labels(len(names))
        while done < len(who):
            stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + 1_000_000, "right")))
            part = slice(done, stop)
            done = stop
            a = np.repeat(who[part], n[part])
            b = np.repeat(begin[part] - np.cumsum(n[part]) + n[part], n[part]) + np.arange(len(a))
            keep = (label[a] != label[b]) & (main[b] | (a < b)) & ((low[a] == high[a]) | (piece[a] != piece[b]))
            if stars:
                keep &= tied.of[name[a]] != tied.of[name[b]]
            a, b = a[keep], b[keep]
            need = _needed(size[a].astype(np.int64), size[b], similarity)
            keep = np.minimum(size[a] - place[a], size[b] - place[b]) >= need
            a, b, need = a[keep], b[keep], need[keep]
            if counts is not None:
                cuts = range(0, len(a), PAIRS)
                most = [most_by_spread(counts[order[a[i:i + PAIRS]]], counts[order[b[i:i + PAIRS]]]) for i in cuts]
                keep = np.concatenate([np.empty(0, np.int64), *most]) >= need
                a, b = a[keep], b[keep]
            if stars:
                tied.join(name[a], name[b])
                continue
            a, b = row[a], row[b]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])
        if stars:
            child = np.flatnonzero(tied.of != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names[child]), pa.array(names[tied.of[child]])], names=["a", "b"])

    named = shared.join(found.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("component", "row"))
    piece = named.withColumn("pieces", F.ceil(F.col("n") / group_rows).cast("int")).withColumn("piece", F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int"))
    if counted:
        piece = piece.join(sets.select(F.col("_set").alias("row"), "_spread"), "row")
    every = piece.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    dealt = every.select("key", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"), "piece", "row", "size", "place", "label", *["_spread"] * counted)
    return dealt.repartition("key", "low", "high").mapInArrow(search, "a long, b long").distinct()


def first_links(shared: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): each set with the smallest set of every shingle it shares."""
    return shared.filter("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b")).distinct()


def promising(links: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The links whose ends may reach the similarity by the bitmaps of ``sets (_set, _size, _bits)``; no link that reaches it is lost."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist())
            words = ((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column("ba"), batch.column("bb")))
            good = [most_by_bits(x, y, n, m) >= _needed(n, m, similarity) for (x, y), (n, m) in zip(words, sizes)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    end = lambda x: sets.select(F.col("_set").alias(x), F.col("_size").alias(f"n{x}"), F.col("_bits").alias(f"b{x}"))
    return links.join(end("a"), "a").join(end("b"), "b").mapInArrow(keep, "a long, b long")


def shingle_sets(links: DataFrame, sets: DataFrame, slim: DataFrame, words: int = WORDS) -> DataFrame:
    """(_set, _hashes): the whole sorted shingle set of every end of the links, made again from the text of its row."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [np.unique(shingle_hashes(t.as_py(), words)).tobytes() for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_set"), pa.array(whole, pa.binary())], names=["_set", "_hashes"])

    ends = links.select(F.explode(F.array("a", "b")).alias("_set")).distinct().join(sets.select("_set", "_best"), "_set").alias("_e")
    rows = ends.join(slim.alias("_t"), F.col("_e._best._id").eqNullSafe(F.col("_t._id")) & (F.col("_e._best._mark") == F.col("_t._mark")))
    return cut_lineage(rows.select("_set", "_text").mapInArrow(make, "_set long, _hashes binary")).dropDuplicates(["_set"])


def similar(links: DataFrame, whole: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The links whose ends' shingle sets ``whole (_set, _hashes)`` reach the similarity by exact Jaccard."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("ha"), batch.column("hb"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = same >= similarity * (len(x) + len(y) - same)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    end = lambda x: whole.select(F.col("_set").alias(x), F.col("_hashes").alias(f"h{x}"))
    return links.join(end("a"), "a").join(end("b"), "b").mapInArrow(keep, "a long, b long")


def links_among(whole: list[np.ndarray], size: np.ndarray, label: np.ndarray, piece: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Places of pairs of the sorted sets ``whole`` of these sizes that reach the similarity by exact Jaccard, as many as it takes to connect the labels as
    all such pairs do. Only pairs of different pieces are looked at if there are several.

    A set's hashes lead to the sets that have them too, so a set without a partner costs no more than its own hashes."""
    every, owner = np.concatenate(whole), np.repeat(np.arange(len(whole)), size)
    order = np.argsort(every, kind="stable")
    sets = owner[order]
    new = np.r_[True, np.diff(every[order]) != 0]
    begin = np.flatnonzero(new)
    length = np.diff(np.r_[begin, len(every)])
    which = np.empty(len(every), np.int64)
    which[order] = np.cumsum(new) - 1
    ends = np.r_[0, np.cumsum(size)]
    _, first, of = np.unique(label, return_index=True, return_inverse=True)
    tied = Labels(len(whole))
    tied.of = first[of]
    apart = len(np.unique(piece)) > 1
    links = []
    for i in np.flatnonzero(tied.of != first[np.bincount(of).argmax()]):  # pairs have at most one end in the largest component
        own = which[ends[i]:ends[i + 1]]
        own = own[length[own] > 1]
        n = length[own]
        there = sets[np.repeat(begin[own] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        same = np.bincount(there, minlength=len(whole))
        good = (same >= similarity * (size[i] + size - same)) & (tied.of != tied.of[i])
        if apart:
            good &= piece != piece[i]
        partner = np.flatnonzero(good)
        partner = partner[np.unique(tied.of[partner], return_index=True)[1]]
        links += [(int(i), int(j)) for j in partner]
        tied.join(np.full(len(partner), i), partner)
    return links


def pairs_among(bitmaps: list[np.ndarray], size: np.ndarray, label: np.ndarray, piece: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Places of pairs of sets that may reach the similarity by their bitmaps, as ``links_among`` gives those that do; known labels
    are no connection here, as clumps need both ends of every link.

    Sizes that may reach it differ by less than a factor of two, so a bitmap is compared with those of its length and, folded, of twice its length."""
    words = np.array([len(x) for x in bitmaps])
    tied = Labels(len(bitmaps))
    apart = len(np.unique(piece)) > 1
    pairs = []
    for length in np.unique(words):
        own, twice = np.flatnonzero(words == length), np.flatnonzero(words == 2 * length)
        there = np.r_[own, twice]
        table = np.stack([bitmaps[i] for i in own] + [bitmaps[i][:length] | bitmaps[i][length:] for i in twice])
        for at, i in enumerate(own):
            keep = (label[there] != label[i]) & (tied.of[there] != tied.of[i]) & (np.minimum(size[there], size[i]) >= _needed(size[there], size[i], similarity))
            keep[:at + 1] = False
            if apart:
                keep &= piece[there] != piece[i]
            who = np.flatnonzero(keep)
            step = max(1, (PAIRS << 4) // int(length))
            for k in range(0, len(who), step):
                j, rows = there[who[k:k + step]], table[who[k:k + step]]
                most = np.minimum(size[i] - np.bitwise_count(table[at] & ~rows).sum(1, dtype=np.int64), size[j] - np.bitwise_count(rows & ~table[at]).sum(1, dtype=np.int64))
                partner = j[most >= _needed(size[i], size[j], similarity)]
                partner = partner[np.unique(tied.of[partner], return_index=True)[1]]
                partner = partner[tied.of[partner] != tied.of[i]]
                pairs += [(int(i), int(x)) for x in partner]
                tied.join(np.full(len(partner), i), partner)
    return pairs


def links_in_clumps(clumps: DataFrame, sets: DataFrame, whole: DataFrame, found: DataFrame, similarity: float = SIMILARITY, piece_hashes: int = PIECE_HASHES, among=links_among) -> DataFrame:
    """(a, b): links that reach the similarity by exact Jaccard on ``whole (_set, _hashes)`` and connect the components ``found (node,
    component)`` as all links inside the clumps ``clumps (node, component)`` do; at most one for each set and task. ``among``
    decides: with ``pairs_among`` and bitmaps as the second column of ``whole``, pairs that may reach it.

    A clump of more than ``piece_hashes`` hashes by ``sets (_set, _size)`` is cut into pieces, and every two pieces meet in a task of their own."""
    payload = whole.columns[1]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def solved() -> pa.RecordBatch:
            row, size, piece, label, data = zip(*held)
            links = among([np.frombuffer(x, np.uint64) for x in data], np.array(size, np.int64), np.array(label, np.int64), np.array(piece), similarity)
            a, b = ([row[link[k]] for link in links] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(map(max, a, b), pa.int64()), pa.array(map(min, a, b), pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *tile, row, size, piece, label, data in zip(*columns):
                if tile != at and held:
                    yield solved()
                    held.clear()
                at = tile
                held.append((row, size, piece, label, data))
        if held:
            yield solved()

    labels = found.select(F.col("node").alias("_set"), F.col("component").alias("label"))
    named = clumps.select(F.col("node").alias("_set"), F.col("component").alias("clump")).join(sets.select("_set", "_size"), "_set").join(labels, "_set", "left")
    named = cut_lineage(named.withColumn("label", F.coalesce("label", "_set")))
    pieces = named.groupBy("clump").agg(F.ceil(F.greatest(F.sum("_size") / piece_hashes, F.count("*") / PIECE_ROWS)).cast("int").alias("pieces"))
    own = named.join(pieces, "clump").withColumn("piece", F.pmod(F.xxhash64("_set"), F.col("pieces")).cast("int")).join(whole, "_set")
    every = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    dealt = every.select("clump", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"), "_set", "_size", "piece", "label", payload)
    width = int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: the rows are few, the work is not
    tiles = dealt.repartition(width, "clump", "low", "high").sortWithinPartitions("clump", "low", "high")
    return tiles.mapInArrow(search, "a long, b long").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group that links of at least ``similarity`` (Jaccard over
    distinct shingles of ``words`` words) connect, the one with the smallest id, null ids before others, stays as it is.

    Texts of fewer words are one shingle. Null, empty and blank texts have no shingles and are equal to each other. Of rows that repeat an
    id and a text, one stays. Every link is decided by exact Jaccard on the 64-bit hashes of the whole sets."""
    mark = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    slim = docs.select(F.col(id_col).alias("_id"), mark.alias("_mark"), F.col(text_col).cast("binary").alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, code, whole, size = zip(*(signature(t.as_py(), words) for t in batch.column("_text"))) if batch.num_rows else ([], [], [], [])
            whole = [np.frombuffer(w, np.uint64) for w in whole]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_mark"), pa.array([set_id(d) for d in digest], pa.int64()), pa.array(code, pa.binary()),
                                              pa.array(size, pa.int32()), pa.array(map(spread, whole), pa.binary()), pa.array(map(bits, whole), pa.binary())],
                                             names=["_id", "_mark", "_set", "_code", "_size", "_spread", "_bits"])

    signed = cut_lineage(slim.mapInArrow(sign, f"_id {kind}, _mark long, _set long, _code binary, _size int, _spread binary, _bits binary"))
    of_set = [F.first(c).alias(c) for c in ("_code", "_size", "_spread", "_bits")]
    sets = cut_lineage(signed.groupBy("_set").agg(F.min(F.struct("_id", "_mark")).alias("_best"), *of_set))
    shared = shared_shingles(slim, words, similarity)
    near = candidate_links(sets.filter("_size > 0")).unionByName(first_links(shared)).distinct()
    near = cut_lineage(promising(near, sets, similarity))
    sure = cut_lineage(similar(near, shingle_sets(near, sets, slim, words), similarity))
    early = cut_lineage(components(sure))
    rest = cut_lineage(links_between(shared, early, similarity, sets=sets, stars=True))
    rest = cut_lineage(links_in_clumps(components(rest), sets, sets.select("_set", "_bits"), early, similarity, 16 * PIECE_HASHES, pairs_among))  # a hash is two to four bits there
    more = links_in_clumps(components(rest), sets, shingle_sets(rest, sets, slim, words), early, similarity)
    found = components(sure.unionByName(more))
    classes = sets.select("_set", "_best").join(found.withColumnRenamed("node", "_set"), "_set", "left")
    kept = classes.groupBy(F.coalesce("component", "_set").alias("_class")).agg(F.min("_best").alias("_best")).select("_best.*")
    # the caller's row travels as one struct, so that its columns may have any names
    keys = [F.col("_d._kid").eqNullSafe(F.col("_k._id")), F.col("_d._kmark") == F.col("_k._mark")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_kid"), mark.alias("_kmark")).alias("_d").join(kept.alias("_k"), keys, "left_semi")
    again = cut_lineage(signed.groupBy("_id", "_mark").agg(F.count("*").alias("n")).filter("n > 1").select("_id", "_mark"))
    twice = rows.alias("_d").join(again.alias("_k"), keys, "left_semi").dropDuplicates(["_kid", "_kmark"])
    once = rows.alias("_d").join(again.alias("_k"), keys, "left_anti")
    return once.unionByName(twice).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
