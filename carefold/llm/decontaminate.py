"""Benchmark decontamination with suffix arrays over the training texts.

Every slice of documents is a shard with its own suffix array over word numbers: the places at which a test suffix could
begin, sorted by the words that follow. Places whose first words no test item has are left out before sorting, as no match
can begin there. Every suffix of every test item is then looked up by binary search, which yields all its occurrences;
occurrences that continue each other word by word are joined into longest verbatim matches with their places on both sides.
No text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

WINDOW = 10
#: Bytes of test texts that one pass broadcasts; longer tests take more passes.
PASS_BYTES = 16_000_000
#: Bytes of text in a shard, except that a document is never cut.
SHARD_BYTES = 4_000_000

_WORD = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_CLEAN = bytes(b if b in _WORD else ord(chr(b).lower()) if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z are lowered) and characters beyond ASCII."""
    return (text or b"").translate(_CLEAN).split()


@dataclass
class Tests:
    """Windows of a set of test items: sorted keys, and per key the (item, start) pairs that have it."""
    vocabulary: dict[bytes, int]
    keys: np.ndarray
    sizes: np.ndarray
    first: np.ndarray
    items: np.ndarray
    starts: np.ndarray
    heads: np.ndarray
    shortest: int
    window: int


def _keys(numbers: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort like the rows; 0 stands for no word."""
    return np.ascontiguousarray(numbers.astype(">u4")).view(f"S{4 * numbers.shape[1]}").ravel()


def index_tests(items: list[tuple], window: int = WINDOW) -> Tests | None:
    """``items``: (place in the caller's list of ids, text). Items without words have no window."""
    vocabulary: dict[bytes, int] = {}
    rows, item, start, size = [], [], [], []
    for place, text in items:
        numbers = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        k = min(window, len(numbers))
        for s in range(len(numbers) - k + 1 if k else 0):
            rows.append(numbers[s:s + k] + [0] * (window - k))
            item.append(place), start.append(s), size.append(k)
    if not rows:
        return None
    table = np.array(rows, np.uint32)
    keys = _keys(table)
    order = np.argsort(keys, kind="stable")
    keys, table, size = keys[order], table[order], np.array(size)[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    heads = table[:, 0].astype(np.uint64) << np.uint64(32) | table[:, min(1, window - 1)]
    return Tests(vocabulary, table[first], size[first], np.r_[first, len(keys)], np.array(item)[order], np.array(start)[order],
                 np.unique(heads), int(size.min()), window)


def _spans(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges b .. b + n of rows a: (row, value) of every member."""
    which = np.repeat(np.arange(len(a)), n)
    return which, b[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def search_shard(numbers: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of every occurrence of a test window in a shard; 0 in ``numbers`` separates documents and stands for
    words that no test item has."""
    window, n = tests.window, len(numbers)
    padded = np.r_[numbers, np.zeros(window, np.uint32)]
    able = padded[:n] > 0
    for k in range(1, tests.shortest):
        able &= padded[k:n + k] > 0
    place = np.flatnonzero(able)
    second = padded[place + 1] if window > 1 else padded[place]
    head = padded[place].astype(np.uint64) << np.uint64(32)
    known = np.isin(head | second, tests.heads)
    if tests.shortest == 1:
        known |= np.isin(head, tests.heads)
    place = place[known]
    follow = padded[place[:, None] + np.arange(window)]
    follow[np.logical_or.accumulate(follow == 0, axis=1)] = 0
    keys = _keys(follow)
    order = np.argsort(keys, kind="stable")  # the suffix array of the shard
    place, keys = place[order], keys[order]
    beyond = tests.keys.copy()
    beyond[np.arange(window) >= tests.sizes[:, None]] = 0xFFFFFFFF
    low = np.searchsorted(keys, _keys(tests.keys), "left")
    high = np.searchsorted(keys, _keys(beyond), "right")
    key, at = _spans(low, low, high - low)
    return key, place[at]


def longest(item: np.ndarray, start: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Joins window matches that continue each other: (item, start, place, length) of the longest matches."""
    order = np.lexsort((place, place - start, item))
    item, start, place, size = item[order], start[order], place[order], size[order]
    new = np.r_[True, (item[1:] != item[:-1]) | (place[1:] - start[1:] != place[:-1] - start[:-1]) | (place[1:] != place[:-1] + 1)] if len(item) else np.empty(0, bool)
    head = np.flatnonzero(new)
    tail = np.r_[head[1:], len(item)] - 1 if len(head) else head
    return item[head], start[head], place[head], place[tail] + size[tail] - place[head]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_FOUND = pa.list_(pa.struct([("item", pa.string()), ("item_start", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))
_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND_SQL = "array<struct<item: string, item_start: bigint, start: bigint, length: bigint>>"
_RANGES_SQL = "array<struct<start: bigint, end: bigint>>"


def _find(texts: list[bytes | None], tests: Tests | None) -> tuple[list[int], dict[int, list]]:
    """Words of every text of a shard, and per text with matches (item, item_start, start, length) of the longest ones."""
    lengths, parts = [], []
    get = tests.vocabulary.get if tests else {}.get
    for text in texts:
        own = words_of(text)
        lengths.append(len(own))
        parts += [np.fromiter((get(w, 0) for w in own), np.uint32, len(own)), np.zeros(1, np.uint32)]
    hits: dict[int, list] = {}
    if tests and texts:
        base = np.cumsum([0] + [n + 1 for n in lengths])
        key, place = search_shard(np.concatenate(parts), tests)
        row, at = _spans(key, tests.first[key], tests.first[key + 1] - tests.first[key])
        item, start, where, size = longest(tests.items[at], tests.starts[at], place[row], tests.sizes[key][row])
        doc = np.searchsorted(base, where, "right") - 1
        for d, *hit in zip(doc.tolist(), item.tolist(), start.tolist(), (where - base[doc]).tolist(), size.tolist()):
            hits.setdefault(d, []).append(hit)
    return lengths, hits


def _shards(batch: pa.RecordBatch, text: pa.Array) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of a batch and of its texts of about SHARD_BYTES."""
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    full = np.cumsum(sizes, dtype=np.int64) // SHARD_BYTES
    cuts = [0, *(np.flatnonzero(full[1:] != full[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a), text.slice(a, b - a)


def _pass(block, id_col: str, last: bool):
    """Adds the matches of one broadcast block of tests to rows (id, _text, spans, found)."""
    def shard(part: pa.RecordBatch) -> pa.RecordBatch:
        names, tests = block.value
        texts, spans, found = (part.column(c).to_pylist() for c in ("_text", "spans", "found"))
        lengths, hits = _find(texts, tests)
        for d, new in hits.items():
            found[d] = (found[d] or []) + [{"item": names[i], "item_start": s, "start": w, "length": n} for i, s, w, n in new]
            old = [(x["start"], x["end"]) for x in spans[d] or []]
            spans[d] = [{"start": a, "end": b} for a, b in _merged(old + [(w, w + n) for *_, w, n in new])]
        columns = {id_col: part.column(id_col), "n_words": pa.array(lengths, pa.int64()),
                   "spans": pa.array([x or [] for x in spans], _RANGES), "found": pa.array([x or [] for x in found], _FOUND)}
        if not last:
            columns["_text"] = part.column("_text")
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in _shards(batch, batch.column("_text")):
                yield shard(part)
    return stage


def _blocks(tests: DataFrame, item_col: str, item_text: str, window: int, pass_bytes: int) -> Iterator:
    """Broadcasts of (item ids as text, index), one for about ``pass_bytes`` bytes of tests."""
    tests = tests.filter(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(
        F.col(item_col).cast("string").alias("_item"), F.col(item_text).cast("binary").alias("_t"))
    passes = 1 + tests.agg(F.coalesce(F.sum(F.octet_length("_t")), F.lit(0))).first()[0] // pass_bytes
    for k in range(passes):
        rows = tests.filter(F.pmod(F.xxhash64("_item", "_t"), F.lit(passes)) == k).collect()
        index = index_tests([(i, bytes(r["_t"])) for i, r in enumerate(rows)], window)
        yield tests.sparkSession.sparkContext.broadcast(([r["_item"] for r in rows], index)), k == passes - 1


def matches(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
            item_text: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row for every row of ``docs``: id_col, n_words, spans (ranges of hit words, end exclusive, apart from each
    other) and matches (item_col, item_start, start, length: the longest verbatim matches of at least ``window`` words, or
    of a whole shorter item).

    A null text has no words; a test item without words or without an id matches nothing; repeated rows come out as often
    as they came in; equal items all match. Without tests every document comes out clean. Other columns are not looked at.
    Tests are broadcast in blocks of about ``pass_bytes`` bytes, one pass each, so what a task holds has a fixed bound."""
    item_kind = tests.schema[item_col].dataType
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text"),
                      F.lit(None).cast(_RANGES_SQL).alias("spans"), F.lit(None).cast(_FOUND_SQL).alias("found"))
    for block, last in _blocks(tests, item_col, item_text, window, pass_bytes):
        schema = f"`{id_col}` {kind}, n_words bigint, spans {_RANGES_SQL}, found {_FOUND_SQL}" + ("" if last else ", _text binary")
        out = out.select(id_col, "_text", "spans", "found").mapInArrow(_pass(block, id_col, last), schema)
    named = F.transform("found", lambda m: F.struct(
        m["item"].cast(item_kind).alias(item_col), m["item_start"].alias("item_start"), m["start"].alias("start"), m["length"].alias("length")))
    return out.select(id_col, "n_words", "spans", named.alias("matches"))


def clean(docs: DataFrame, tests: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
          pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of ``docs`` without any match, unchanged, whatever their columns are called. Texts are read in place, shard by
    shard, and only rows that stay go back. A null or empty text has no match; repeated rows stay or go alike; without tests, or for
    an empty table, nothing goes."""
    def keep(block):
        def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, text in _shards(batch, batch.column(text_col).cast(pa.binary())):
                    _, hits = _find(text.to_pylist(), block.value[1])
                    stays = np.ones(part.num_rows, bool)
                    stays[list(hits)] = False
                    yield part.filter(pa.array(stays))
        return stage

    for block, _ in _blocks(tests, item_col, item_text, window, pass_bytes):
        docs = docs.mapInArrow(keep(block), docs.schema)
    return docs
