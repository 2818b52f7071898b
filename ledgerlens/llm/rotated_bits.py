"""Approximate nearest neighbours from randomly rotated one-bit codes.

A vector x = c + r * o (c: the centroid, r: its distance, o: a unit vector) is
rotated by a random orthogonal matrix and kept as the signs of the rotated o,
packed into bits, with three scalars: r, the overlap a of o with its code, and
the width e of the error that a random rotation leaves. For a query the inner
product with o is estimated as <code, q> / a, with a standard error of about
|q - part along the code| * sqrt((1 - a^2) / a^2 / (D - 1)). A block's
candidates whose estimate plus ``RERANK`` errors reaches the query's k-th best
are reranked by their exact inner product, so only reranked scores are returned.
The k highest estimates of a block come first, so that the k-th best stands high
before the others are looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.vectors import BestLists, sample, search, usable

#: Vectors that the centroid is fitted on.
CENTROID_SAMPLE = 2_000
#: Standard errors added to an estimate. 4 leaves out one in ten thousands.
EPSILON = 4.0
#: Standard errors up to which a candidate is reranked: one leaves out a true
#: neighbour at the k-th place one time in six, and those above it more rarely.
RERANK = 1.0


def random_rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centroid: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits, one row of (r, a, e) per vector)."""
    dim = x.shape[1]
    rest = x - centroid
    r = np.sqrt((rest * rest).sum(1))
    o = (rest / np.where(r > 0, r, 1)[:, None]) @ rotation
    signs = o >= 0
    a = np.maximum(np.abs(o).sum(1) / np.sqrt(dim), 1e-9)
    e = np.sqrt(np.maximum(1 - a * a, 0)) / a / np.sqrt(max(dim - 1, 1))
    return np.packbits(signs, axis=1), np.column_stack([r, np.where(r > 0, a, 1.0), np.where(r > 0, e, 0.0)])


def estimates(queries: np.ndarray, bits: np.ndarray, scalars: np.ndarray, centroid: np.ndarray,
              rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner products, errors): rows are queries, columns vectors."""
    dim = queries.shape[1]
    codes = (np.unpackbits(bits, axis=1)[:, :dim].astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    turned = (queries @ rotation).astype(np.float32)
    r, a, e = scalars.T
    estimate = (queries @ centroid)[:, None] + (turned @ codes.T) * (r / a)[None]
    error = np.sqrt((queries * queries).sum(1))[:, None] * (r * e)[None]
    return estimate, error


def exact(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, summed alike for equal vectors wherever they stand."""
    return (x * query).sum(1)


def bits_visit(centroid: np.ndarray, rotation: np.ndarray, epsilon: float):
    width = -(-len(centroid) // 8)

    def visit(queries, query_ids, x, ids, extra, best: BestLists) -> None:
        n = len(ids)
        bits = np.frombuffer(extra, np.uint8, n * width).reshape(n, width)
        scalars = np.frombuffer(extra, np.float64, offset=n * width).reshape(n, 3)
        for at in range(0, len(queries), 128):
            part = queries[at : at + 128]
            estimate, error = estimates(part, bits, scalars, centroid, rotation)
            upper = estimate + epsilon * error + 1e-6 * np.abs(estimate)
            for j, query in enumerate(part):
                q = at + j
                up = upper[j]
                up[ids == query_ids[q]] = -np.inf
                k = min(best.k, n)
                first = np.argpartition(-np.where(np.isfinite(up), estimate[j], -np.inf), k - 1)[:k]
                first = first[np.isfinite(up[first]) & (up[first] >= best.bar(q, -np.inf))]
                if not len(first):
                    continue
                best.add(q, exact(x[first], query), ids[first])
                up[first] = -np.inf
                more = np.flatnonzero(up >= best.bar(q, -np.inf)) if best.bar(q, -np.inf) > -np.inf else np.flatnonzero(np.isfinite(up))
                if len(more):
                    best.add(q, exact(x[more], query), ids[more])

    return visit


def nearest_by_bits(df: DataFrame, is_query, k: int = 20, epsilon: float = RERANK, id_col: str = "vec_id",
                    vector_col: str = "embedding", seed: int = 11) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows for which ``is_query`` (a
    condition on ``id``) holds, over all rows; score is the inner product in
    double precision.

    Rows with a null id, a null or zero vector, null or non-finite components,
    or another than the most common dimension take no part. A query gets all
    candidates if there are fewer than ``k``; ties go to the smaller id;
    repeated ids are ranked each, and a query never meets its own id. Of several
    query rows that share an id, the smallest vector is searched for.
    """
    vectors = usable(df, id_col, vector_col, zero=False)
    x = sample(vectors, CENTROID_SAMPLE)
    dim = x.shape[1] if x.ndim == 2 else 1
    centroid = x.mean(0) if len(x) else np.zeros(dim)
    rotation = random_rotation(dim, seed)

    def index(block: np.ndarray) -> bytes:
        bits, scalars = encode(block, centroid, rotation)
        return bits.tobytes() + scalars.tobytes()

    return search(vectors, is_query, k, index, bits_visit(centroid, rotation, epsilon), dim, "double")


def op3_rotated_bits(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector among all vectors."""
    return nearest_by_bits(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)
