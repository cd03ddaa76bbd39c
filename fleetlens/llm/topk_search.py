"""Exact top-k by inner product with Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are dealt into blocks of ``block`` rows, queries into blocks of ``query_block``; each pair of blocks is one
bounded group. A block of vectors is sorted once along every dimension. All its queries then read the lists in step,
from the top for positive and from the bottom for negative components: what a list shows first is scored in full, and
the threshold is the score that a vector with the entries read last in all lists would have. A query stops when the
threshold is below its k-th best score; an equal one goes on, since a tie may go to a smaller id.

A first pass over one block gives each query a k-th best score to beat, so that in most blocks few rows are read. The
winners of the blocks meet in one top-k a query.

Defined cases: vectors that are null or hold null, NaN or infinity, and rows without an id, take no part; a missing
last component counts as 0; repeated rows count once; of a query's own rows none is a candidate; equal scores go to
the smaller id; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import stage

K, BLOCK, QUERY_BLOCK, STEP = 5, 8192, 512, 16
LEVELS = 256


def levels(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, v``: whole numbers floor(256 x) of the vectors that take part, each (id, v) once."""
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite))
    return rows.select("id", F.transform("x", lambda c: F.floor(c * LEVELS).cast("long")).alias("v")).distinct()


def matrix(column: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    """A list column as rows of one width; what is missing is 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


class SortedLists:
    """A block of vectors with the rows of every dimension in descending order of their entries."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.lists = np.argsort(-self.rows, axis=0, kind="stable").T.astype(np.int32)
        self.entries = np.take_along_axis(self.rows, self.lists.T, axis=0).T if len(rows) else self.rows.T

    def search(self, query_id: int, query: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, of those that score ``floor`` at least; rows with the query's id are left out.

        Scores are whole numbers below 2^53, so sums of doubles are exact.
        """
        n, used = len(self.ids), np.flatnonzero(query)
        own = np.searchsorted(self.ids, query_id), np.searchsorted(self.ids, query_id, side="right")
        seen = np.zeros(n, bool)
        seen[own[0] : own[1]] = True
        ids, scores = np.empty(0, self.ids.dtype), np.empty(0)
        lists, entries, weights = self.lists[used], self.entries[used], query[used]
        down = weights > 0
        depth, step = 0, STEP
        while depth < n:
            to = min(n, depth + step)
            shown = np.concatenate([lists[down, depth:to].ravel(), lists[~down, n - to : n - depth].ravel()]) if len(used) else np.arange(n)
            new = np.zeros(n, bool)
            new[shown] = True
            new &= ~seen
            seen |= new
            found = np.flatnonzero(new)
            if len(found):
                got = self.rows[found] @ query
                better = got >= floor
                ids, scores = np.concatenate([ids, self.ids[found[better]]]), np.concatenate([scores, got[better]])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            if not len(used):
                break
            threshold = weights[down] @ entries[down, to - 1] + weights[~down] @ entries[~down, n - to]
            floor = max(floor, scores[-1]) if len(scores) == k else floor
            if threshold < floor:
                break
            depth, step = to, step * 2
        return ids, scores


def exact_top_k(
    vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """Per query row its k best vectors: query_id, rank from 1, vec_id, score. Both tables have id and v.

    A shuffle carries each block of vectors to each block of queries; both numbers follow from counted rows.
    """
    schema = "query_id long, query_no long, vec_id long, score long"
    n, m = vectors.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-m // query_block))
    no = F.xxhash64("id", "v")
    data = vectors.withColumn("b", F.pmod(no, F.lit(blocks)).cast("int"))
    asked = queries.withColumn("no", no).withColumn("q", F.pmod(F.xxhash64("v", "id"), F.lit(query_blocks)).cast("int"))

    def pairs(side: DataFrame, other: str, count: int) -> DataFrame:
        return side.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["query_id", "query_no", "vec_id", "score"], [pa.int64()] * 4
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        a, b = matrix(left["v"]), matrix(right["v"])
        width = max(a.shape[1], b.shape[1])
        a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
        lists = SortedLists(left["id"].to_numpy().astype(np.int64), a)
        floors = right["floor"].to_pylist() if "floor" in right.column_names else [None] * len(b)
        out: list[list] = [[], [], [], []]
        for q, number, row, floor in zip(right["id"].to_pylist(), right["no"].to_pylist(), b, floors):
            ids, scores = lists.search(q, row, k, -np.inf if floor is None else floor)
            for column, values in zip(out, ([q] * len(ids), [number] * len(ids), ids.tolist(), scores.tolist())):
                column.extend(values)
        return pa.table([pa.array(out[0], kinds[0]), pa.array(out[1], kinds[1]), pa.array(out[2], kinds[2]), pa.array(np.array(out[3], np.int64), kinds[3])], names)

    def run(side: DataFrame, block_count: int, ask: DataFrame, query_count: int) -> DataFrame:
        # both sides may come from one table: under new names they share no column ids
        left, right = (t.select(*[F.col(c).alias(c) for c in t.columns]) for t in (pairs(side, "q", query_count), pairs(ask, "b", block_count)))
        return left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(search, schema)

    first = run(data.filter("b = 0"), 1, asked, query_blocks)
    if blocks > 1:
        first = stage(first, "first-winners")
        floors = first.groupBy("query_id", "query_no").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor"))
        floors = floors.filter(F.col("n") == k).select(F.col("query_id").alias("id"), F.col("query_no").alias("no"), "floor")
        rest = run(data.filter("b > 0").withColumn("b", F.col("b") - 1), blocks - 1, asked.join(floors, ["id", "no"], "left"), query_blocks)
        first = first.union(rest)
    best = Window.partitionBy("query_id", "query_no").orderBy(F.col("score").desc(), "vec_id")
    ranked = first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH c AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM c),
s AS (SELECT q.vec_id AS query_id, q.v AS qv, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
