"""Exact top-k inner products by no-random-access aggregation.

Vectors are dealt to blocks by a hash of the row.  In a part of a block each dimension is a list of rows sorted by
component, read from its best end on for each query.  Reading goes on to the same depth in all lists at once; a
component that has not been read is at best the last value read there.  So a row's upper bound is the query's inner
product with the row, cut off at the last values read, and that of a row not seen at all is the product with these values
themselves.

1. A first pass resolves each query against one block: its k-th score is the query's bar.  A smaller block of that size
   among all rows can only hold a lower k-th score, so the bar is a lower bound of the k-th best score of all.
2. The second pass carries the bar into all blocks.  Lists are read in steps (`DEPTHS`).  A query stops where even a row
   not seen at all cannot reach its bar and the rows whose upper bound reaches it are few (`FEW`); only these can qualify,
   and their scores are resolved.  A query that never stops has read the lists to the end, which resolves all rows.  The
   bar rises with each part of the block.
3. The k best of each block are merged per query.

All queries of a block are bounded together by products of matrices.  Queries are a stated share of the rows against all
rows, in blocks of both, so a task's work has a fixed size; no block depends on how vectors are distributed.

Components become floor(256 * x), so scores and bounds are whole numbers, exact while below 2**53.

Defined results: vectors that are null or hold a null or non-finite component take no part; vectors of different
length are not compared; equal rows (id and vector) count once; different vectors with one vec_id are rows of their own,
as queries (their results are ranked together) and as candidates (an id may come twice), but never candidates of each
other; a row with a null vec_id takes no part; a query without candidates has no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from fieldbook.llm.job import cut

#: Rows and queries of a block, and of the parts it is worked through in.
BLOCK, QUERIES, PART = 8192, 4096, 1024
#: Depths of reading, as shares of a list.
DEPTHS = (0.25, 0.5, 0.625, 0.75)
#: The share of a part's rows that is few enough to be resolved.
FEW = 1 / 32
SCALE = 256
RESULT = "query_id long, vec_id long, score long"


def candidates(queries: np.ndarray, bars: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of every row that may reach its query's bar, and of some more."""
    n = len(rows)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    rising = np.sort(rows, axis=0)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    left = np.arange(len(queries))
    for share in DEPTHS:
        depth = int(n * share)
        if not depth or not len(left):
            continue
        top, bottom = rising[n - depth], rising[depth - 1]  # the last values read from either end
        some = left[up[left] @ top + down[left] @ bottom < bars[left]]  # these need no row that has not been seen
        if len(some):
            upper = up[some] @ np.maximum(rows, top).T + down[some] @ np.minimum(rows, bottom).T
            alive = upper >= bars[some, None]
            stops = alive.sum(axis=1) <= max(1, n * FEW)
            q, r = np.nonzero(alive & stops[:, None])
            out.append((some[q], r, np.einsum("ij,ij->i", queries[some[q]], rows[r])))
            left = np.setdiff1d(left, some[stops], assume_unique=True)
    if len(left):  # read to the end
        out.append((np.repeat(left, n), np.tile(np.arange(n), len(left)), (queries[left] @ rows.T).ravel()))
    return tuple(np.concatenate(x) for x in zip(*out))


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, by score and then id."""
    order = np.lexsort((ids, -score, query))
    begins = np.flatnonzero(np.diff(query[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return order[rank < k]


def best_in_block(queries: np.ndarray, own: np.ndarray, bars: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row id, score) of the k best rows of every query that reach its bar; rows with the query's own id are left out."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), PART):
        some, bar = np.arange(at, min(at + PART, len(queries))), bars[at : at + PART].copy()
        kept = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        for begin in range(0, len(rows), PART):
            part = ids[begin : begin + PART]
            q, r, score = candidates(queries[some], bar, rows[begin : begin + PART])
            good = (part[r] != own[some[q]]) & (score >= bar[q])
            q, vec, score = (np.concatenate(x) for x in zip(kept, (q[good], part[r[good]], score[good])))
            top = best(q, vec, score, k)
            kept = q, vec, score = q[top], vec[top], score[top]
            n = np.bincount(q, minlength=len(some))
            full = np.flatnonzero(n >= k)
            bar[full] = np.maximum(bar[full], score[np.cumsum(n)[full] - 1])
        found.append((some[kept[0]], kept[1], kept[2]))
    return tuple(np.concatenate(x) for x in zip(*found))


def search(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """query_id, rank, vec_id and score: for each vec_id divisible by `every` the k best other rows."""
    x = F.col("embedding")
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = (vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(fine & (F.size(x) > 0))
            .select("vec_id", whole.alias("v")).dropDuplicates(["vec_id", "v"]))
    rows = cut(rows)
    is_query = F.col("vec_id") % every == 0
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).head()
    blocks, sets = -(-size["n"] // BLOCK) or 1, -(-size["q"] // QUERIES) or 1
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n))
    every_one = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = rows.where(is_query).withColumn("qs", deal(sets)).withColumn("bar", F.lit(float("-inf")))
    right = rows.withColumn("block", deal(blocks))

    def task(q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        parts = []
        for t in (q, c):
            v = t.column("v").combine_chunks()
            ends = np.asarray(v.offsets) - (v.offsets[0].as_py() if len(v) else 0)
            parts.append((t.column("vec_id").to_numpy(), np.asarray(v.flatten()), ends))
        (qi, qv, qo), (ci, cv, co) = parts
        for d in np.intersect1d(np.diff(qo), np.diff(co)).tolist():
            a, b = np.flatnonzero(np.diff(qo) == d), np.flatnonzero(np.diff(co) == d)
            take = lambda v, o, at: v[o[at][:, None] + np.arange(d)]
            place, vec, score = best_in_block(take(qv, qo, a), qi[a], q.column("bar").to_numpy()[a], take(cv, co, b), ci[b], k)
            out.append((qi[a][place], vec, score))
        whole = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0)] * 3
        return pa.table({"query_id": whole[0].astype(np.int64), "vec_id": whole[1].astype(np.int64), "score": whole[2].astype(np.int64)})

    def against(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.groupBy("qs", "block").cogroup(right.groupBy("qs", "block")).applyInArrow(task, RESULT)

    ranked = lambda found: found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= k)
    if blocks > 1:
        first = against(asked.withColumn("block", F.lit(0).cast("long")), right.where("block = 0").withColumn("qs", every_one(sets)))
        bars = ranked(first).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bar"))
        asked = cut(asked.drop("bar").join(bars, "vec_id", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf")))))
    found = against(asked.withColumn("block", every_one(blocks)), right.withColumn("qs", every_one(sets)))
    return ranked(found).select("query_id", "rank", "vec_id", "score")
