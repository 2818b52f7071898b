"""Blocks of vectors, and a query set searched against all of them.

Candidates become rows of up to ``BLOCK`` vectors (ids, what is kept of the
vectors, and what an index precomputes for them). Queries are dealt into lanes
of about ``LANE`` vectors. Every candidate block meets every lane once, in a cell
of a grid: about ``CELL_BLOCKS`` blocks or more by up to ``CELL_LANES`` lanes.
Blocks are copied once for each column of cells, lanes once for each row, and
there are no more rows than let the queries' copies be as many as the table's.

Both sides are dealt to their cells by one exchange, each cell a task, lanes
first; a task holds the lanes of its cell with a running best list of each query
and reads the blocks one by one. Nothing is joined, so no side is ever broadcast,
however small its size is taken to be. The lists of a query are merged by one
window at the end. No vector passes the driver, apart from an index's bounded
training sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import ship, smallest_hashes

BLOCK, LANE = 4_096, 1_024
#: Blocks (about, at least) and lanes (at most) that meet in one cell.
CELL_BLOCKS, CELL_LANES = 2, 256
#: Lanes that a task holds with their best lists at most.
HELD = 256


def usable(df: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """``id, v`` (doubles) of the rows with an id and a vector of finite
    components, of the most common dimension; zero vectors only with ``zero``."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(fine)
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0))


def _pack(ids: list, data: list) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(ids), np.concatenate(data)


def _columns(b: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    v = b.column("v")
    return b.column("id").to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _raw(x: np.ndarray) -> bytes:
    """The vectors' bytes, in the narrowest of three types that loses nothing."""
    with np.errstate(over="ignore", invalid="ignore"):
        for kind in (np.int16, np.float32):
            narrow = x.astype(kind)
            if np.array_equal(narrow, x) and (kind != np.int16 or not np.signbit(x[x == 0]).any()):
                return narrow.tobytes()
    return x.tobytes()


def _vectors(data: bytes, n: int, dim: int) -> np.ndarray:
    """``n`` vectors of ``_raw`` as doubles; their width tells the type."""
    kind = {2: np.int16, 4: np.float32, 8: np.float64}[len(data) // (n * dim)]
    return np.frombuffer(data, kind).reshape(n, dim).astype(np.float64)


def candidate_blocks(vectors: DataFrame, dim: int, keep: Callable[[np.ndarray], np.ndarray],
                     index: Callable[[np.ndarray], bytes], rows: int) -> DataFrame:
    """``row, ids, data, extra``: blocks of vectors as ``keep`` leaves them, with
    what ``index`` gives for each block, dealt in turn to the grid's rows.

    A task that is run again must meet its vectors in the same order, as a
    table's scan does; store vectors that come out of a shuffle first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, data, held = [], [], 0
        row = int(TaskContext.get().partitionId() * 0.6180339887 % 1 * rows)  # tasks begin far apart

        def out() -> pa.RecordBatch:
            i, x = _pack(ids, data)
            x = keep(x)
            return pa.RecordBatch.from_arrays([pa.array([row % rows], pa.int32()), pa.array([i], pa.list_(pa.int64())),
                                               pa.array([_raw(x)], pa.binary()), pa.array([index(x)], pa.binary())],
                                              ["row", "ids", "data", "extra"])

        for b in batches:
            i, x = _columns(b, dim)
            for at in range(0, len(i), BLOCK):
                ids.append(i[at : at + BLOCK])
                data.append(x[at : at + BLOCK])
                held += len(ids[-1])
                if held >= BLOCK:
                    yield out()
                    ids, data, held, row = [], [], 0, row + 1
        if held:
            yield out()

    return vectors.mapInArrow(run, "row int, ids array<bigint>, data binary, extra binary")


def query_lanes(queries: DataFrame, dim: int, keep: Callable[[np.ndarray], np.ndarray], lanes: int) -> DataFrame:
    """``lane, ids, data``: the distinct queries, dealt over the lanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[list, list]] = {}
        for b in batches:
            i, x = _columns(b, dim)
            lane = b.column("lane").to_numpy(zero_copy_only=False)
            for k in np.unique(lane):
                own = found.setdefault(int(k), ([], []))
                own[0].append(i[lane == k])
                own[1].append(x[lane == k])
        for k, (ids, data) in found.items():
            i, x = _pack(ids, data)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([i], pa.list_(pa.int64())),
                                              pa.array([_raw(keep(x))], pa.binary())], ["lane", "ids", "data"])

    one_each = queries.groupBy("id").agg(F.min("v").alias("v"))
    dealt = one_each.withColumn("lane", F.pmod(F.xxhash64("id"), F.lit(lanes)))
    return dealt.repartitionById(lanes, F.col("lane").cast("int")).mapInArrow(run, "lane bigint, ids array<bigint>, data binary")


class BestLists:
    """The best ``k`` (score, id) found so far of each query of a lane: highest
    score first, ties to the smaller id."""

    def __init__(self, n: int, k: int, dtype):
        self.k = k
        self.scores = [np.empty(0, dtype) for _ in range(n)]
        self.ids = [np.empty(0, np.int64) for _ in range(n)]

    def bar(self, q: int, low):
        """A candidate below this cannot enter the list; ``low`` while it is not full."""
        return self.scores[q][-1] if len(self.scores[q]) == self.k else low

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.scores[q]) == self.k:
            enter = scores >= self.scores[q][-1]
            scores, ids = scores[enter], ids[enter]
        if not len(scores):
            return
        s, i = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        order = np.lexsort((i, -s))[: self.k]
        self.scores[q], self.ids[q] = s[order], i[order]


def search(vectors: DataFrame, is_query, k: int, index: Callable[[np.ndarray], bytes], visit: Callable, dim: int,
           score_type: str, keep: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best ``k`` of each query.

    ``visit(queries, query_ids, x, ids, extra, best)`` shows a block to a lane
    and adds to its ``BestLists``. Rows with a query's own id are its own.
    Candidates and queries reach ``index`` and ``visit`` as ``keep`` leaves them.
    """
    ship(vectors.sparkSession)
    n, asked = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    lanes = max(1, -(-asked // LANE))
    columns = -(-lanes // min(CELL_LANES, HELD))
    rows = max(1, min(-(-n // (BLOCK * CELL_BLOCKS)), columns * n // max(asked, 1)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = (F.col("row") * columns + F.col("column")).cast("int").alias("cell")
    blocks = (candidate_blocks(vectors, dim, keep, index, rows).withColumn("column", every(columns))
              .select(cell, F.lit(None).cast("bigint").alias("lane"), "ids", "data", "extra"))
    dealt = (query_lanes(vectors.where(is_query), dim, keep, lanes)
             .withColumn("column", F.col("lane") % columns).withColumn("row", every(rows))
             .select(cell, "lane", "ids", "data", F.lit(None).cast("binary").alias("extra")))
    meet = (blocks.union(dealt).repartitionById(rows * columns, "cell")
            .sortWithinPartitions("cell", F.col("lane").asc_nulls_last(), F.col("ids")[0]))
    dtype = np.int64 if score_type == "bigint" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, np.ndarray, BestLists]] = []
        now = None

        def out() -> Iterator[pa.RecordBatch]:
            for _, ids, best in held:
                n = [len(s) for s in best.scores]
                if sum(n):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids, n)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))],
                        ["query_id", "vec_id", "score"])

        for b in batches:
            for r in range(b.num_rows):
                if now != b.column("cell")[r].as_py():
                    yield from out()
                    now, held = b.column("cell")[r].as_py(), []
                ids = b.column("ids")[r].values.to_numpy()
                data = b.column("data")[r].as_py()
                if b.column("lane")[r].is_valid:
                    held.append((data, ids.copy(), BestLists(len(ids), k, dtype)))
                    continue
                x, extra = _vectors(data, len(ids), dim), b.column("extra")[r].as_py()
                for raw, q_ids, best in held:
                    visit(_vectors(raw, len(q_ids), dim), q_ids, x, ids, extra, best)
        yield from out()

    found = meet.mapInArrow(run, f"query_id bigint, vec_id bigint, score {score_type}")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def sample(vectors: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` vectors, the ones with the smallest hashes."""
    rows = smallest_hashes(vectors, n, "id", "v").select("v").toPandas()["v"]
    return np.array([list(v) for v in rows], np.float64)
