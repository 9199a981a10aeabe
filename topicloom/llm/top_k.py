"""Exact top-k by inner product, by reading sorted lists without random access.

Vectors are dealt to shards and queries to blocks, both of bounded size, and every block
meets every shard in a task of its own. Within a task every dimension is a list of the
shard's vectors, sorted by what they add to the score. The lists are read from the best
entry on, some rows of all lists at a time. What was read of a vector, with the least and
the greatest that the unread lists can still add, bounds its score from below and above.
Reading stops when nobody outside a small share of the vectors can be among the best; final
scores are resolved then, whatever the size of the shard. The best of all shards are merged.

Defined cases: vectors that are null, or hold a null or non-finite component, and rows
without an id take no part. A shorter vector counts as ending in zeros; an empty one has
score 0 with all. Rows with the id of the query are its own; repeated query ids count once,
other repeated rows are candidates each. Scores must fit in 64 bits. Other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.store import stored

#: Vectors of a shard and queries of a block.
SHARD_ROWS = 8_192
BLOCK_QUERIES = 512
#: Reading stops when no more than k vectors, or one of so many, are left.
LEFT = 32
#: Parts in which the lists are read.
READS = 6


def whole_numbers(vectors: DataFrame, key: str, vector: str, scale: int = 1024) -> DataFrame:
    """(id, x): components scaled and rounded down, for the vectors that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                      & (F.abs(x.cast("double")) < float("inf")))
    taking_part = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite)
    return taking_part.select(
        F.col(key).cast("long").alias("id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("x"),
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    out = np.zeros((len(lists), width), dtype=np.int64)
    sizes = np.diff(np.asarray(lists.offsets))
    row = np.repeat(np.arange(len(lists)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = np.asarray(lists.flatten())
    return out


def _width(table: pa.Table) -> int:
    return pc.max(pc.list_value_length(table.column("x"))).as_py() or 0


def sorted_lists(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows in rising order, their values) for every dimension."""
    order = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T)
    return order, np.take_along_axis(rows.T, order, axis=1)


def read_lists(
    left: np.ndarray, n: int, query: np.ndarray, k: int, lists: tuple[np.ndarray, np.ndarray]
) -> tuple[np.ndarray, int]:
    """(rows of ``left`` that can be among the k best, entries read of each list).

    Bounds are floating-point numbers with a margin for rounding.
    """
    order, values = lists
    used = np.flatnonzero(query)
    few, end = max(k, n // LEFT), 0
    if len(left) > few and len(used):
        weight = query[used].astype(np.float64)
        least = np.minimum(values[used, 0] * weight, values[used, -1] * weight)
        margin = 1e-9 * float((np.abs(weight) * np.abs(values[used][:, [0, -1]]).max(axis=1)).sum())
        read, seen = np.zeros(n), np.zeros((len(used), n))
        step = max(1, -(-n // READS))
        for begin in range(0, n, step):
            end = min(begin + step, n)
            frontier = np.empty(len(used))
            for j, d in enumerate(used):
                rising = weight[j] < 0
                part = slice(begin, end) if rising else slice(n - end, n - begin)
                at = order[d, part]
                read[at] += values[d, part] * weight[j]
                seen[j, at] = 1.0
                frontier[j] = values[d, end - 1 if rising else n - end] * weight[j]
            worst, best = np.stack([least, frontier]) @ seen
            lower = (read + (least.sum() - worst))[left]
            upper = (read + (frontier.sum() - best))[left]
            bar = np.partition(lower, len(lower) - k)[len(lower) - k]
            # No other vector can reach the k-th lower bound any more, not even by a tie.
            left = left[upper >= bar - margin]
            if len(left) <= few:
                break
    return left, end


def best_of_shard(
    ids: np.ndarray, rows: np.ndarray, own: int, query: np.ndarray, k: int,
    lists: tuple[np.ndarray, np.ndarray],
) -> list[tuple[int, int]]:
    """(id, score) of the k best rows for one query, by sequential reads of ``sorted_lists``.

    Final scores are exact.
    """
    left, _ = read_lists(np.flatnonzero(ids != own), len(rows), query, k, lists)
    score = rows[left] @ query
    best = np.lexsort((ids[left], -score))[:k]
    return [(int(ids[left[i]]), int(score[i])) for i in best]


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, id, score): the k rows with the greatest inner product per query."""
    chosen = vectors.where(is_query).select(F.col(key).cast("long").alias("id")).distinct()
    whole = stored(
        whole_numbers(vectors, key, vector).join(
            chosen.withColumn("query", F.lit(True)), "id", "left"), "vectors")
    queries = whole.where("query").dropDuplicates(["id"]).select("id", "x")
    shards = max(1, -(-whole.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_queries))
    mixed = F.xxhash64(F.col("id"), F.lit("shard"))
    dealt = whole.select(
        "id", "x", F.pmod(mixed, F.lit(shards)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    asked = queries.select(
        "id", "x", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if queries.num_rows and rows.num_rows:
            width = max(_width(queries), _width(rows))
            weights, matrix = _matrix(queries.column("x"), width), _matrix(rows.column("x"), width)
            ids = np.asarray(rows.column("id"), dtype=np.int64)
            lists = sorted_lists(matrix)
            for own, weight in zip(queries.column("id").to_pylist(), weights):
                best = best_of_shard(ids, matrix, own, weight, k, lists)
                found.extend((own, vec, score) for vec, score in best)
        names = ("query_id", "id", "score")
        return pa.table({n: pa.array([f[i] for f in found], pa.int64())
                         for i, n in enumerate(names)})

    best = asked.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInArrow(
        run, "query_id long, id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(key), "score")
