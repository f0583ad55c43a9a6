"""Near duplicates against all pairs by exact Jaccard."""

from __future__ import annotations

import numpy as np

from carefold.llm import neardup, simhash


def text_of(numbers) -> str:
    return " ".join(f"w{i}" for i in numbers)


def jaccard(a: str, b: str) -> float:
    x, y = (set(zip(*(t.split()[i:] for i in range(neardup.WORDS)))) for t in (a, b))
    return len(x & y) / len(x | y)


def brute_kept(rows: list[tuple[int, str]]) -> list[int]:
    label = {k: k for k, _ in rows}
    for i, (a, t) in enumerate(rows):
        for b, u in rows[:i]:
            if label[a] != label[b] and jaccard(t, u) >= neardup.SIMILARITY:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return sorted(set(label.values()))


def kept(spark, rows):
    return sorted(r["doc_id"] for r in neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def around_the_limit() -> list[tuple[int, str]]:
    """40 pairs of 500 shingles, every other one a little above 0.8 and the rest a little below."""
    rows = []
    for k in range(40):
        base = list(range(k * 10_000, k * 10_000 + 504))
        cut = 54 if k % 2 else 58
        rows += [(2 * k, text_of(base)), (2 * k + 1, text_of(base[:504 - cut] + [10**7 + k * 1000 + i for i in range(cut)]))]
    return rows


def test_long_texts_are_decided_by_exact_jaccard(spark):
    rows = around_the_limit()
    assert set(kept(spark, rows)) >= set(brute_kept(rows)) and 40 < len(brute_kept(rows)) < 80


def test_no_pair_over_the_similarity_is_missed(spark):
    rows = around_the_limit()
    assert kept(spark, rows) == brute_kept(rows)


def family(rng, n, shared, own):
    """Texts that share a long passage (too little for a link), and for some of them a copy with a few words changed."""
    rows, base = [], [int(x) for x in rng.integers(0, 10**6, shared)]
    for k in range(n):
        mine = [10**7 + 10**4 * k + i for i in range(own)]
        rows.append(base + mine)
        if k % 3 == 0:
            rows.append(base + mine[:-(k % 40) - 1] + [10**8 + 10**4 * k + i for i in range(k % 40 + 1)])
    order = rng.permutation(len(rows))
    return [(int(order[i]), text_of(r)) for i, r in enumerate(rows)]


def test_partners_are_found_among_many_that_share_passages(spark):
    rng = np.random.default_rng(5)
    rows = family(rng, 60, 300, 100) + [(1000 + k, text_of(range(9 * 10**8 + 12 * k // 7, 9 * 10**8 + 12 * k // 7 + 12))) for k in range(40)]
    assert kept(spark, rows) == brute_kept(rows)


def test_a_shingle_of_many_sets_is_searched_in_tiles_without_loss(spark):
    n = 60
    shared = spark.createDataFrame([(7, k, 100, 0, 0, n) for k in range(n)], "key long, row long, size int, place int, first long, n long")
    found = spark.createDataFrame([(k, k // 2 * 2) for k in range(n)], "node long, component long")
    got = sorted((r["a"], r["b"]) for r in neardup.links_between(shared, found, group_rows=8).collect())
    assert got == sorted((a, b) for a in range(n) for b in range(a) if a // 2 != b // 2)


def test_the_gray_index_ties_close_copies(spark):
    """Candidates come from operator 1's index: codes two bits apart in one part are connected."""
    code = np.zeros((2, neardup.PARTS), np.uint64)
    code[:, 0] = np.array([0x0123456789ABCDEF, 0x0123456789ABCDEF ^ 1 << 3 ^ 1 << 40], np.uint64)
    code[1, 1:] = np.uint64(2**64 - 1)
    sets = spark.createDataFrame([(k, bytearray(c.tobytes()), 500) for k, c in enumerate(code)], "_set long, _code binary, _size int")
    assert [(r["a"], r["b"]) for r in neardup.candidate_links(sets).collect()] == [(1, 0)]
    assert neardup.linked is simhash.linked


def sets_at(rng, sizes, common):
    """Sets of hashes that have ``common`` of them in common with the first."""
    first = rng.integers(0, 2**64, sizes[0], np.uint64)
    return [np.unique(first)] + [np.unique(np.r_[first[:common], rng.integers(0, 2**64, n - common, np.uint64)]) for n in sizes[1:]]


def test_sketches_bound_what_two_sets_have_in_common():
    rng = np.random.default_rng(11)
    for n, m, common in [(1, 1, 0), (1, 1, 1), (32, 33, 20), (100, 90, 90), (500, 400, 10), (700, 900, 650), (20_000, 19_000, 18_000), (30_000, 70_000, 5)]:
        x, y = sets_at(rng, [n, m], common)
        by_bits = neardup.most_by_bits(*(np.frombuffer(neardup.bits(s), np.uint64) for s in (x, y)), len(x), len(y))
        by_spread = neardup.most_by_spread(*(np.frombuffer(neardup.spread(s), np.uint8).reshape(1, -1) for s in (x, y)))[0]
        assert min(by_bits, by_spread) >= common
        if n == 500:
            assert by_bits < 300 and by_spread < 400


def test_links_out_of_reach_are_dropped_before_whole_sets_are_made(spark, monkeypatch):
    """Texts that share a long passage are candidates, but their whole sets never leave the texts."""
    rng = np.random.default_rng(6)
    rows, made = family(rng, 60, 300, 150), []
    real = neardup.similar
    monkeypatch.setattr(neardup, "similar", lambda links, *more: (made.append(links.count()), real(links, *more))[1])
    assert kept(spark, rows) == brute_kept(rows)
    true = sum(jaccard(t, u) >= neardup.SIMILARITY for i, (_, t) in enumerate(rows) for _, u in rows[:i])
    assert sum(made) <= 2 * true


def cloud(rng, n):
    """Near copies of one text of 200 words, pairs of which lie on both sides of the limit; most are no link."""
    base = [int(x) for x in rng.integers(0, 10**6, 200)]
    rows = []
    for k in range(n):
        mine = list(base)
        for at in rng.choice(200, int(rng.integers(1, 6)), replace=False):
            mine[at] = 10**7 + 1000 * k + int(at)
        rows.append((k, text_of(mine)))
    return rows


def test_rows_for_a_group_of_near_copies_grow_with_its_size_and_not_its_square(spark, monkeypatch):
    """Counts the links that are sent to sketches, whole sets and the work folder."""
    made = []
    seen = lambda df: (made.append(df.count()) if df.columns == ["a", "b"] else None, df)[1]
    for name in ("promising", "similar", "cut_lineage"):
        real = getattr(neardup, name)
        monkeypatch.setattr(neardup, name, lambda df, *more, real=real, **named: real(seen(df), *more, **named))
    total = []
    for n in (75, 300):
        rows = cloud(np.random.default_rng(3), n)
        made.clear()
        left = kept(spark, rows)
        total.append(sum(made))
        if n == 75:
            assert left == brute_kept(rows) and 1 < len(left) < n
    assert total[1] <= 2 * 4 * total[0] and total[1] <= 20 * 300


def joined(pairs, n) -> list[int]:
    labels = simhash.Labels(n)
    labels.join(*np.array(sorted(pairs), np.int64).reshape(-1, 2).T)
    return labels.of.tolist()


def test_stars_connect_what_all_pairs_connect(spark):
    rng = np.random.default_rng(8)
    posts = sorted({(int(k), int(r)) for k, r in zip(rng.integers(0, 40, 150), rng.integers(0, 120, 150))})
    size = [100 + 20 * (r % 5) for r in range(120)]
    n = {k: sum(k == x for x, _ in posts) for k, _ in posts}
    shared = spark.createDataFrame([(k, r, size[r], 0, 0, n[k]) for k, r in posts], "key long, row long, size int, place int, first long, n long")
    found = spark.createDataFrame([(r, r // 3 * 3) for r in range(0, 120, 2)], "node long, component long")
    every, stars = ([(r["a"], r["b"]) for r in neardup.links_between(shared, found, group_rows=2, stars=s).collect()] for s in (False, True))
    assert joined(every, 120) == joined(stars, 120) and len(set(joined(every, 120))) < 100
    assert len(neardup.links_between(shared, found, stars=True).coalesce(1).collect()) <= len(every)


def test_clumps_are_solved_in_tiles_as_by_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (3, 100), np.uint64)
    whole = [np.unique(np.r_[base[k % 3][rng.permutation(100)[:100 - k % 17]], rng.integers(0, 2**63, k % 23, np.uint64)]) for k in range(60)]
    label = [k if k % 4 else k % 3 for k in range(60)]
    true = [(a, b) for a in range(60) for b in range(a) if (s := len(np.intersect1d(whole[a], whole[b]))) >= 0.8 * (len(whole[a]) + len(whole[b]) - s)]
    known = [(k, x) for k, x in enumerate(label) if k != x]
    sets = spark.createDataFrame([(k, len(w)) for k, w in enumerate(whole)], "_set long, _size int")
    hashes = spark.createDataFrame([(k, bytearray(w.tobytes())) for k, w in enumerate(whole)], "_set long, _hashes binary")
    clumps = spark.createDataFrame([(k, k % 3) for k in range(60)], "node long, component long")
    found = spark.createDataFrame(known, "node long, component long")
    for piece_hashes in (1 << 19, 500):
        got = [(r["a"], r["b"]) for r in neardup.links_in_clumps(clumps, sets, hashes, found, piece_hashes=piece_hashes).collect()]
        assert set(got) <= set(true) and joined(got + known, 60) == joined(true + known, 60)
        assert piece_hashes < 1000 or len(got) < 60 < len(true)


def test_bitmaps_connect_all_sets_that_may_reach_the_similarity():
    """Sizes around 32, 64, ... hashes, where bitmaps of two lengths meet; stars connect what all pairs within the bound connect."""
    rng = np.random.default_rng(12)
    for size in (30, 33, 70, 130):
        base = rng.integers(0, 2**63, size, np.uint64)
        sets = [np.unique(np.r_[base[rng.permutation(size)[:size - k % 7]], rng.integers(0, 2**63, k % 5, np.uint64)]) for k in range(40)]
        bitmaps, sizes = [np.frombuffer(neardup.bits(x), np.uint64) for x in sets], np.array([len(x) for x in sets])
        label = np.arange(40) // 3 * 3
        for piece in (np.zeros(40, int), np.arange(40) % 2):
            may = [(i, j) for i in range(40) for j in range(i) if label[i] != label[j] and (piece[i] != piece[j] or not piece.any())
                   and neardup.most_by_bits(bitmaps[i], bitmaps[j], sizes[i], sizes[j]) >= neardup._needed(sizes[i], sizes[j], 0.8)]
            got = neardup.pairs_among(bitmaps, sizes, label, piece)
            assert joined(got, 40) == joined(may, 40) and len(got) < 40 < len(may)
