"""Exact top-k inner-product search by distributed histogram selection.

Candidates and queries are dealt into blocks of bounded size that meet pairwise in one shuffle; every pair is scored as one
matrix product. A pass adds up, per query, a histogram of all scores over the range in which the k-th best can still lie, and
the global histogram narrows that range to one bin; passes go on until the bin is one integer wide, which is the k-th best
score itself. A last pass keeps what reaches it and breaks ties by the smaller id. A block reports only bins that can matter:
those not below its own k-th best, at most k a query, so what is shuffled does not depend on the block size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from carefold.session import cut_lineage

#: Rows that one task scores at a time.
CANDIDATE_ROWS, QUERY_ROWS = 8192, 1024
#: Bins of a query's histogram in a pass.
BINS = 4096
#: Scale that components are multiplied with before they are rounded down.
SCALE = 256


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id_col, _v, _row): components floor(scale * x) of every vector without nulls and non-finite components, and a row number."""
    v = F.col(vector_col)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return df.filter(fine & F.col(id_col).isNotNull()).select(
        id_col, F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("_v"), F.monotonically_increasing_id().alias("_row"))


def _matrix(table: pa.Table, width: int, kind) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    lists = table.column("_v").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), kind)
    begin = np.r_[0, ends[:-1]].astype(int)
    row = np.repeat(np.arange(len(lists)), ends - begin)
    out[row, np.arange(len(flat)) - begin[row]] = flat
    return out


def _scores(candidates: pa.Table, queries: pa.Table, width: int, kind):
    """(queries from .. to, their scores, which entries count) piece by piece; a query's own row does not count."""
    c, q = _matrix(candidates, width, kind), _matrix(queries, width, kind)
    rows, own = candidates.column("_row").to_numpy(), queries.column("_row").to_numpy()
    for a in range(0, len(q), 64):
        yield a, (q[a:a + 64] @ c.T).astype(np.int64), own[a:a + 64, None] != rows[None, :]


def _kth(scores: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th best valid score, the least number if it has fewer."""
    least = np.iinfo(np.int64).min
    held = np.where(valid, scores, least)
    return np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k] if held.shape[1] >= k else np.full(len(held), least)


def top_k(df: DataFrame, k: int, is_query, id_col: str = "vec_id", vector_col: str = "embedding", bins: int = BINS,
          candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, id_col, score): for every row that the column ``is_query`` picks, the ``k`` best of all other rows by
    integer inner product, ties to the smaller id; all rows if there are fewer.

    Vectors that are null or hold null or non-finite components take no part, nor do null ids. Rows are told apart by
    position, so rows that repeat an id are candidates of each other, and a repeated query row is answered each time.
    Vectors of different length are filled up with zeros. No queries, no rows."""
    rows = cut_lineage(integer_vectors(df, id_col, vector_col).withColumn("_query", F.coalesce(is_query, F.lit(False))))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("_query").cast("long")), F.lit(0)).alias("q"), F.coalesce(F.max(F.size("_v")), F.lit(0)).alias("w"),
                     F.coalesce(F.max(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), F.lit(0.0)).alias("s")).first()
    bound = int(total["s"]) + 1  # no inner product is larger than the largest squared length
    if bound >= 2**62:
        raise ValueError("the inner products do not fit into a long")
    kind, width = (np.float64 if bound < 2**53 else np.int64), max(1, total["w"])
    shards, groups = max(1, math.ceil(total["n"] / candidate_rows)), max(1, math.ceil(total["q"] / query_rows))
    deal = lambda by, n: F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
    left = rows.select("_row", id_col, "_v", deal("_row", shards).alias("_shard"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"))
    asked = rows.filter("_query").select("_row", F.col(id_col).alias("query_id"), "_v", deal("_row", groups).alias("_group"))

    def meet(state: DataFrame, work, schema: str) -> DataFrame:
        right = asked.join(state, "_row").withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        right = right.select(*[F.col(c).alias(c) for c in right.columns])
        keys = ("_shard", "_group")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)

    rounds = max(1, math.ceil(math.log(2 * bound + 2) / math.log(bins)))
    while bins ** rounds < 2 * bound + 2:
        rounds += 1
    state = asked.select("_row", F.lit(-bound).cast("long").alias("low"), F.lit(0).cast("long").alias("above"))

    def counter(wide: int):
        def count(c: pa.Table, q: pa.Table) -> pa.Table:
            out = {"_row": [], "bin": [], "n": []}
            if c.num_rows and q.num_rows:
                lows, own = q.column("low").to_numpy(), q.column("_row").to_numpy()
                for a, scores, valid in _scores(c, q, width, kind):
                    low = lows[a:a + 64]
                    floor = low + (np.maximum(_kth(scores, valid, k), low) - low) // wide * wide  # the bin of the block's own k-th best
                    i, j = np.nonzero(valid & (scores >= floor[:, None]) & (scores < (low + wide * bins)[:, None]))
                    pair, n = np.unique(np.stack([i, (scores[i, j] - low[i]) // wide]), axis=1, return_counts=True)
                    out["_row"].append(own[a + pair[0]]), out["bin"].append(pair[1]), out["n"].append(n)
            return pa.table({x: pa.array(np.concatenate(v) if v else np.empty(0, np.int64), pa.int64()) for x, v in out.items()})
        return count

    for step in reversed(range(rounds)):
        wide = bins ** step
        histogram = meet(state, counter(wide), "_row long, bin long, n long").groupBy("_row", "bin").agg(F.sum("n").alias("n")).join(state, "_row")
        down = Window.partitionBy("_row").orderBy(F.desc("bin"))
        upto = histogram.withColumn("_sum", F.sum("n").over(down) + F.col("above")).withColumn("_all", F.sum("n").over(Window.partitionBy("_row")) + F.col("above"))
        hit = upto.filter((F.col("_sum") >= F.least(F.lit(k), "_all")) & (F.col("_sum") - F.col("n") < F.least(F.lit(k), "_all")))
        state = cut_lineage(hit.select("_row", (F.col("low") + F.col("bin") * wide).alias("low"), (F.col("_sum") - F.col("n")).alias("above")))

    def keep(c: pa.Table, q: pa.Table) -> pa.Table:
        out = []
        if c.num_rows and q.num_rows:
            low, own, rows_, ids = q.column("low").to_numpy(), q.column("_row").to_numpy(), c.column("_row").to_numpy(), c.column(id_col).to_numpy()
            for a, scores, valid in _scores(c, q, width, kind):
                i, j = np.nonzero(valid & (scores >= low[a:a + 64, None]))
                s = scores[i, j]
                order = np.lexsort((rows_[j], ids[j], -s, i))
                i, j, s = i[order], j[order], s[order]
                first = np.searchsorted(i, i, "left")
                top = np.arange(len(i)) - first < k
                out.append((own[a + i[top]], rows_[j[top]], ids[j[top]], s[top]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 4
        return pa.table(dict(zip(("_row", "_other", "id", "score"), (pa.array(x, pa.int64()) for x in columns))))

    best = meet(state, keep, "_row long, _other long, id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("_row").orderBy(F.desc("score"), "id", "_other"))).filter(F.col("rank") <= k)
    named = asked.select("_row", "query_id")
    return ranked.join(named, "_row").select(F.col("query_id").cast("long").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
