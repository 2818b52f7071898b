"""Exact top-k by inner product with a pivot table.

Every vector's Euclidean distances to the pivots are computed once, with its
block. By the triangle inequality |d(q, p) - d(x, p)| is a lower bound of
d(q, x) for every pivot p; the largest over all pivots turns into an upper
bound of the inner product, (|q|^2 + |x|^2 - bound^2) / 2. A query evaluates a
block's candidates with the highest bounds first, and then those of the others
that can still reach its k-th best, so the answer is exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.vectors import BestLists, sample, search, usable

#: Pivots, and the vectors among which they are chosen.
PIVOTS, PIVOT_SAMPLE = 24, 512
#: Candidates with the highest bounds, evaluated before the others are looked at.
STEP = 64
#: Queries of a lane whose bounds are computed together.
TOGETHER = 16
#: What distances in single precision may be off, as a part of the lengths involved.
ROUNDING = 2.0**-20


def choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice of up to ``n`` distinct vectors."""
    if not len(x):
        return x
    chosen = [int(np.argmax(((x - x.mean(0)) ** 2).sum(1)))]
    gap = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)) and gap.max() > 0:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Rows: vectors, columns: pivots, then the squared length."""
    squared = (x * x).sum(1)
    d2 = squared[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.column_stack([np.sqrt(np.maximum(d2, 0)), squared])


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * x) + 0.0  # no negative zeros


def pivot_index(x: np.ndarray, pivots: np.ndarray) -> bytes:
    """A block's squared lengths, then its distances to each pivot in single precision."""
    table = pivot_distances(x, pivots)
    return table[:, -1].tobytes() + table[:, :-1].T.astype(np.float32).tobytes()


def largest_gaps(table: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The largest |d(q, p) - d(x, p)| over the pivots p; rows: queries, columns: vectors."""
    most = np.zeros((len(own), table.shape[1]), table.dtype)
    gap = np.empty_like(most)
    for k, distances in enumerate(table):
        np.subtract(distances, own[:, k, None], out=gap)
        np.maximum(most, np.abs(gap, out=gap), out=most)
    return most


def pivot_visit(pivots: np.ndarray):
    """How a lane looks through a block; vectors are quantised."""
    reach = np.sqrt((pivots * pivots).sum(1).max(initial=0))
    lowest = np.finfo(np.float64).min

    def visit(queries, query_ids, x, ids, extra, best: BestLists) -> None:
        n = len(ids)
        squared = np.frombuffer(extra, np.float64, n)
        table = np.frombuffer(extra, np.float32, offset=8 * n).reshape(-1, n)
        own = pivot_distances(queries, pivots)
        to_pivots = own[:, :-1].astype(np.float32)
        longest = np.sqrt(max(own[:, -1].max(), squared.max()))
        off = ROUNDING * (reach + longest)
        if longest * longest < 2**24:  # whole numbers, all partial sums too: exact
            x, queries = x.astype(np.float32), queries.astype(np.float32)
        for at in range(0, len(queries), TOGETHER):
            part = slice(at, at + TOGETHER)
            lower = largest_gaps(table, to_pivots[part])
            lower = np.maximum(lower.astype(np.float64) - off, 0)
            upper = (own[part, -1:] + squared - lower * lower) / 2 + 0.5  # scores are whole numbers
            upper[query_ids[part, None] == ids] = -np.inf
            scores = None
            for q, up in enumerate(upper, at):
                left = np.flatnonzero(up >= best.bar(q, lowest))
                if len(left) > STEP:
                    first = left[np.argpartition(-up[left], STEP - 1)[:STEP]]
                    best.add(q, (x[first] @ queries[q]).astype(np.int64), ids[first])
                    up[first] = -np.inf
                    left = np.flatnonzero(up >= best.bar(q, lowest))
                if 4 * len(left) < n:
                    best.add(q, (x[left] @ queries[q]).astype(np.int64), ids[left])
                else:  # most of the block: its products with all these queries at once
                    scores = queries[part] @ x.T if scores is None else scores
                    left = np.flatnonzero((up >= best.bar(q, lowest)) & (scores[q - at] >= best.bar(q, lowest)))
                    best.add(q, scores[q - at][left].astype(np.int64), ids[left])

    return visit


def pivot_topk(df: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id",
               vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows for which ``is_query`` (a
    condition on ``id``) holds, over all rows; score is the inner product of
    floor(scale * x), a whole number.

    Rows with a null id, a null vector, null or non-finite components, or
    another than the most common dimension take no part. A query gets all
    candidates if there are fewer than ``k``; ties go to the smaller id;
    repeated ids are ranked each, and a query never meets its own id. Of several
    query rows that share an id, the smallest vector is searched for.
    """
    vectors = usable(df, id_col, vector_col, zero=True)
    x = sample(vectors, PIVOT_SAMPLE)
    dim = x.shape[1] if x.ndim == 2 else 1
    pivots = choose_pivots(quantised(x.reshape(-1, dim), scale), PIVOTS)
    return search(vectors, is_query, k, lambda b: pivot_index(b, pivots), pivot_visit(pivots), dim, "bigint",
                  lambda b: quantised(b, scale))


def op5_pivot_table(spark, sf_dir: str) -> DataFrame:
    """The 5 best of every 50th vector among all vectors."""
    return pivot_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
