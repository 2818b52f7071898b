"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X (n x d) are stored once in blocks. A step takes one pass over
them: every task multiplies its blocks by the new right vector (its part of the
left vector u = Xv), then by u again, and only sums of d + k numbers leave it.

* A left vector is never gathered or stored: u_j = X p_j for a vector p_j of d
  numbers, so a task can rebuild its part of any of them. That gives the inner
  products with all earlier left vectors in the same pass.
* Full reorthogonalisation on both sides: right vectors among themselves, left
  vectors by those inner products; if they took away more than roundoff, the
  corrected vector is passed over the rows again.
* The small bidiagonal matrix B, X V = U B, goes through a dense SVD: its right
  vectors, turned by V, are the components, its values s the deviations
  (eigenvalue s^2 / n of the covariance).

It ends when the wanted components' residuals are at roundoff, or when all d
directions are done (as few dimensions need). If a residual vector vanishes, the
recurrence goes on from a new vector at right angles to all before, so repeated
eigenvalues come out too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import ship, stored

#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Bytes of one block of stored vectors.
BLOCK_BYTES = 1 << 15
#: Steps beyond the wanted number of components before convergence is looked at.
SPARE = 40
#: Deviations below this share of the largest count as none (a dependent direction).
NO_DEVIATION = 1e-7
#: Entries whose scaled value a double does not hold to the unit are taken as not finite.
LARGEST = float(1 << 52)


def _rows(b: pa.RecordBatch, dim: int | None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, lengths and scaled values (long) of a batch's usable vectors, of
    length ``dim`` if given."""
    v = b.column("v")
    flat = v.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) * SCALE
    fine = np.abs(values) < LARGEST  # false for nan
    lengths = np.asarray(v.value_lengths().fill_null(0))
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~fine)])
    keep = (bad[ends] == bad[ends - lengths]) & np.asarray(v.is_valid()) & (lengths > 0)
    if dim is not None:
        keep &= lengths == dim
    x = np.floor(values[np.repeat(keep, lengths)]).astype(np.int64) + SHIFT
    return b.column("id").filter(pa.array(keep)), lengths[keep], x


def common_length(vectors: DataFrame) -> int:
    """The most frequent length of the usable vectors (ties: the longer); 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, n = np.unique(_rows(b, None)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(n, pa.int64())], ["d", "n"])

    first = vectors.mapInArrow(run, "d long, n long").groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return first["d"] if first else 0


def vector_blocks(vectors: DataFrame, dim: int) -> DataFrame:
    """``ids, data``: blocks of vectors of length ``dim``, entries as scaled longs."""
    per_block = max(1, BLOCK_BYTES // (8 * dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, _, x = _rows(b, dim)
            x = x.reshape(-1, dim)
            cuts = range(0, len(x), per_block)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[k : k + per_block] for k in cuts], pa.list_(pa.int64())),
                 pa.array([x[k : k + per_block].tobytes() for k in cuts], pa.binary())], ["ids", "data"])

    return vectors.mapInArrow(run, "ids array<long>, data binary")


@dataclass(frozen=True)
class Centre:
    """Number of vectors and exact sums of each dimension."""

    n: int
    sums: tuple[int, ...]

    def exact(self, data) -> np.ndarray:
        """n * x - S of a block: longs, or Python numbers where those are too small."""
        x = np.frombuffer(data, np.int64).reshape(-1, len(self.sums))
        reach = max(self.n * int(np.abs(x).max(initial=0)), max(map(abs, self.sums)))
        if reach < 1 << 61:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def rows(self, data) -> np.ndarray:
        """x - S / n of a block, as doubles."""
        return (self.exact(data) / self.n).astype(np.float64)


def _summed(blocks: DataFrame, part, name: str) -> np.ndarray:
    """The sum over all blocks of ``part(block) -> array``: one array a task,
    added up place by place in a shuffle, so the driver gets one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for data in b.column("data"):
                one = part(data.as_buffer())
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["at", "x"])

    rows = blocks.select("data").mapInArrow(run, f"at int, x {name}").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(rows.num_rows, np.int64 if name == "long" else np.float64)
    out[rows.column("at").to_numpy()] = rows.column("x").to_numpy()
    return out


def centre(blocks: DataFrame, dim: int) -> Centre | None:
    """Exact count and sums; None without vectors."""
    def part(data) -> np.ndarray:
        x = np.frombuffer(data, np.int64).reshape(-1, dim)
        # in halves, so that no sum of 2**31 rows leaves the range of a long
        return np.concatenate([[len(x)], (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])

    got = _summed(blocks, part, "long")
    if not len(got):
        return None
    high, low = got[1 : dim + 1], got[dim + 1 :]
    return Centre(int(got[0]), tuple((int(h) << 32) + int(l) for h, l in zip(high, low)))


def bidiagonalise(blocks: DataFrame, middle: Centre, wanted: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Deviations s (falling) and components (columns) of the centred rows:
    at most ``wanted``, only those with a deviation."""
    dim = len(middle.sums)
    rng = np.random.default_rng(seed)

    def fresh(basis: np.ndarray) -> np.ndarray | None:
        """A unit vector at right angles to the columns of ``basis``."""
        if basis.shape[1] >= dim:
            return None
        v = rng.standard_normal(dim)
        for _ in range(3):
            v -= basis @ (basis.T @ v)
            v /= np.linalg.norm(v)
        return v

    def products(p: np.ndarray, earlier: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """|u|^2, X'u and the inner products with earlier left vectors, u = Xp."""
        shipped = blocks.sparkSession.sparkContext.broadcast((middle, p, earlier))  # d x (k + 1) numbers

        def part(data) -> np.ndarray:
            mid, new, old = shipped.value
            x = mid.rows(data)
            u = x @ new
            return np.concatenate([[u @ u], x.T @ u, (x @ old).T @ u])

        got = _summed(blocks, part, "double")
        shipped.unpersist()
        return got[0], got[1 : dim + 1], got[dim + 1 :]

    right, left, turned = (np.zeros((dim, 0)) for _ in range(3))  # V, P (U = X P), X'U
    diagonal, above = [], []
    v, beta, scale = fresh(right), 0.0, 0.0
    while v is not None:
        right = np.column_stack([right, v])
        p = v - beta * left[:, -1] if diagonal and diagonal[-1] > 0 else v
        norm2, y, inner = products(p, left)
        first = norm2
        for _ in range(3):
            # take the earlier left vectors out of u; a correction that matters is passed over the rows again
            p, y, norm2 = p - left @ inner, y - turned @ inner, norm2 - inner @ inner
            if inner @ inner <= 1e-16 * first:
                break
            norm2, y, inner = products(p, left)
        alpha = float(np.sqrt(max(norm2, 0.0)))
        scale = max(scale, alpha)
        above.append(beta)
        if alpha <= 1e-9 * scale or alpha == 0:  # no new left direction: this right vector is in X's null space
            diagonal.append(0.0)
            left, turned = np.column_stack([left, np.zeros(dim)]), np.column_stack([turned, np.zeros(dim)])
            v, beta = fresh(right), 0.0
            continue
        diagonal.append(alpha)
        left, turned = np.column_stack([left, p / alpha]), np.column_stack([turned, y / alpha])
        w = y / alpha
        for _ in range(3):
            w = w - right @ (right.T @ w)
        beta = float(np.linalg.norm(w))
        if right.shape[1] >= dim:
            break
        if beta <= 1e-12 * scale:
            v, beta = fresh(right), 0.0
            continue
        v = w / beta
        if right.shape[1] >= wanted + SPARE:
            u_small, s_small, _ = np.linalg.svd(np.diag(diagonal) + np.diag(above[1:], 1))
            if (beta * np.abs(u_small[-1, :wanted]) <= 1e-13 * s_small[0]).all():
                break
    if not diagonal:
        return np.zeros(0), np.zeros((dim, 0))
    _, s, turn = np.linalg.svd(np.diag(diagonal) + np.diag(above[1:], 1))
    k = int((s[:wanted] > NO_DEVIATION * s[0]).sum()) if s[0] > 0 else 0
    return s[:k], right @ turn[:k].T


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """``<id_col>, component, n, deviation, whitened, explained,
    identity_error`` for each usable row and component.

    Rows whose vector is null, empty or holds null or non-finite entries (or
    ones too large to scale exactly) take no part, nor do vectors of another
    than the most frequent length (ties: the longer). Null ids and repeated rows
    get rows of their own. Directions without deviation are left out, so equal
    vectors, a single one or none give no rows. ``deviation`` is null where a
    long does not hold it. Other columns are ignored.
    """
    spark = df.sparkSession
    ship(spark)
    schema = (f"`{id_col}` long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    vectors = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    dim = common_length(vectors)
    blocks = stored(vector_blocks(vectors, dim), "vector-blocks") if dim else None
    middle = centre(blocks, dim) if dim else None
    s, axes = bidiagonalise(blocks, middle, components) if middle else (np.zeros(0), None)
    k = len(s)
    if not k:
        return spark.createDataFrame([], schema)
    turn = axes / (s / np.sqrt(middle.n))  # onto unit variance
    shipped = spark.sparkContext.broadcast((middle, turn))

    def total(data) -> np.ndarray:
        x = shipped.value[0].rows(data)
        y = x @ shipped.value[1]
        return np.concatenate([[(x * x).sum()], (y.T @ y).ravel()])

    sums = _summed(blocks, total, "double") / middle.n
    error = float(np.abs(sums[1:].reshape(k, k) - np.eye(k)).max())
    explained = s * s / middle.n / sums[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mid, onto = shipped.value
        for b in batches:
            for ids, data in zip(b.column("ids"), b.column("data")):
                exact = mid.exact(data.as_buffer())
                if exact.dtype == object or int(np.abs(exact).max()) ** 2 * exact.shape[1] >= 1 << 63:
                    own = [sum(int(e) ** 2 for e in row) for row in exact]
                    own = pa.array([o if o < 1 << 63 else None for o in own], pa.int64())
                else:
                    own = pa.array((exact * exact).sum(1))
                m = len(own)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [ids.values.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, mid.n)), own.take(each), pa.array((mid.rows(data.as_buffer()) @ onto).ravel()),
                     pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.mapInArrow(run, schema)


def op12_lanczos_whitening(spark, sf_dir: str) -> DataFrame:
    """Every usable embedding on the first 32 components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
