import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import pivot_topk, rotated_bits, vectors
from tests.oracle_compare import canon, duck

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, every, k, score, zero):
    rows = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]
    out = {}
    for q, v in {i: v for i, v in sorted(rows, key=lambda r: (r[0], r[1]), reverse=True) if i % every == 0}.items():
        found = sorted(((-score(v, w), i) for i, w in rows if i != q))[:k]
        out[q] = [(i, -s) for s, i in found]
    return out


def f32(v):
    return [float(np.float32(x)) for x in v]


def whole(v, w):
    return sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(v, w))


def inner(v, w):
    return float((np.array(v) * np.array(w)).sum())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    centers = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    out = [(k, f32([x + rng.gauss(0, 0.4) for x in rng.choice(centers)])) for k in range(700)]
    same = out[20][1]
    out += [(700 + k, same) for k in range(60)]  # ties of one common vector
    out += [(800, None), (None, same), (801, [None] * 12), (802, [float("nan")] + [0.0] * 11), (803, [float("inf")] * 12),
            (804, [0.0] * 12), (850, [0.0] * 12), (805, [1.0, 2.0]), (806, []), (20, f32([0.5] * 12))]
    return out


@pytest.mark.parametrize("block", [64, 4096])
def test_pivot_table_is_exact(spark, rows, monkeypatch, clashing, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "LANE", 5)
    monkeypatch.setattr(vectors, "HELD", 2)
    got = {}
    for r in pivot_topk.pivot_topk(clashing(table(spark, rows)), F.col("id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = brute([r for r in rows if r[1] is None or len(r[1]) == 12], 50, 5, whole, True)
    assert {q: [v[k] for k in sorted(v)] for q, v in got.items()} == want


def test_pivot_bounds_hold():
    rng = np.random.default_rng(1)
    x, q = np.floor(256 * rng.normal(size=(200, 8))), np.floor(256 * rng.normal(size=8))
    pivots = pivot_topk.choose_pivots(x, 7)
    assert len(np.unique(pivots, axis=0)) == 7
    table_, own = pivot_topk.pivot_distances(x, pivots), pivot_topk.pivot_distances(q[None], pivots)[0]
    lower = np.abs(table_[:, :-1] - own[:-1]).max(1)
    assert np.all(lower <= np.sqrt(((x - q) ** 2).sum(1)) + 1e-6)


def test_op5_equals_its_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duck(d)
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{d}/embeddings.parquet')")
    df, res = pivot_topk.op5_pivot_table(spark, d), con.sql(pivot_topk.OP5_SQL)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(res.columns, res.fetchall())


def test_bits_recall_scores_and_ties(spark, rows, monkeypatch, clashing):
    monkeypatch.setattr(vectors, "BLOCK", 100)
    got = {}
    for r in rotated_bits.nearest_by_bits(clashing(table(spark, rows)), F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = brute([r for r in rows if r[1] is None or len(r[1]) == 12], 20, 20, inner, False)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        assert sorted(found) == list(range(1, 21))
        listed = [found[k] for k in sorted(found)]
        assert listed == sorted(listed, key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in listed} & {i for i, _ in want[q]})
    assert hits >= 0.99 * 20 * len(want)


def test_recall_on_the_sample(spark):
    d = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    x, ids = np.vstack(df["embedding"]).astype(np.float64), df["vec_id"].to_numpy()
    hits = total = 0
    for q, group in rotated_bits.op3_rotated_bits(spark, d).toPandas().groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(set(ids[np.argsort(-s)[:20]]) & set(group["vec_id"]))
        total += 20
    assert hits / total >= 0.9


def test_estimates_are_unbiased_within_their_errors():
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(3000, 64)), rng.normal(size=(20, 64))
    c, rotation = x.mean(0), rotated_bits.random_rotation(64)
    assert np.allclose(rotation @ rotation.T, np.eye(64), atol=1e-9)
    bits, scalars = rotated_bits.encode(x, c, rotation)
    estimate, error = rotated_bits.estimates(q, bits, scalars, c, rotation)
    off = (estimate - q @ x.T) / error
    assert bits.shape == (3000, 8) and abs(off.mean()) < 0.05 and 0.5 < off.std() < 1.2
    assert np.mean(np.abs(off) > rotated_bits.EPSILON) < 1e-3


def test_few_and_no_vectors(spark):
    few = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (100, [0.0, 0.0])]
    got = pivot_topk.pivot_topk(table(spark, few), F.col("id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [
        (0, 1, 50), (0, 2, 100), (50, 1, 0), (50, 2, 100), (100, 1, 0), (100, 2, 50)]
    got = rotated_bits.nearest_by_bits(table(spark, few), F.col("id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 50), (100, 1, 0)][:1]
    for f in (pivot_topk.pivot_topk, rotated_bits.nearest_by_bits):
        assert f(table(spark, few).limit(0), F.col("id") % 20 == 0).count() == 0


def test_reranked_share_and_recall(monkeypatch):
    """What the error bounds leave to rerank, and what it costs in recall, over one block."""
    import pyarrow.parquet as pq
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pandas()
    x, ids = np.vstack(t["embedding"]).astype(np.float64), t["vec_id"].to_numpy()
    c, rotation = x.mean(0), rotated_bits.random_rotation(x.shape[1])
    bits, scalars = rotated_bits.encode(x, c, rotation)
    of = ids % 20 == 0
    reranked = []
    monkeypatch.setattr(rotated_bits, "exact", lambda a, q: reranked.append(len(a)) or (a * q).sum(1))
    best = vectors.BestLists(int(of.sum()), 20, np.float64)
    rotated_bits.bits_visit(c, rotation, rotated_bits.RERANK)(x[of], ids[of], x, ids, bits.tobytes() + scalars.tobytes(), best)
    true = x[of] @ x.T
    true[ids[of][:, None] == ids[None]] = -np.inf
    hits = sum(len(set(b) & set(ids[np.argsort(-s)[:20]])) for b, s in zip(best.ids, true))
    assert sum(reranked) / (len(x) * of.sum()) < 0.5 and hits / (20 * of.sum()) >= 0.99


@pytest.mark.parametrize("cell", [(1, 1), (3, 2), (100, 100)])
def test_every_block_meets_every_lane_once(spark, rows, monkeypatch, cell):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    monkeypatch.setattr(vectors, "LANE", 3)
    monkeypatch.setattr(vectors, "CELL_BLOCKS", cell[0])
    monkeypatch.setattr(vectors, "CELL_LANES", cell[1])
    fine = [r for r in rows if r[0] is not None and r[1] and len(r[1]) == 12 and all(v is not None and math.isfinite(v) for v in r[1])]
    df = spark.createDataFrame(fine, "id long, v array<double>").repartition(3)

    def count(queries, query_ids, x, ids, extra, best):  # one entry a candidate seen, none lost to the list's length
        for q in range(len(queries)):
            best.add(q, np.ones(len(ids), np.int64), ids)

    got = vectors.search(df, F.col("id") % 50 == 0, 2000, lambda b: b"", count, 12, "bigint")
    seen = {r["query_id"]: (r["n"], r["d"]) for r in got.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("d")).collect()}
    assert seen == {i: (len(fine), len({r[0] for r in fine})) for i in {r[0] for r in fine} if i % 50 == 0}


@pytest.mark.parametrize("search", [pivot_topk.pivot_topk, rotated_bits.nearest_by_bits])
def test_nothing_is_broadcast(spark, rows, search):
    """The copies of the queries once passed the driver, as their table is small before it is copied."""
    found = search(table(spark, rows), F.col("id") % 20 == 0)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def see_all(queries, query_ids, x, ids, extra, best):
    for q in range(len(queries)):
        best.add(q, np.ones(len(ids), np.int64), ids)


@pytest.mark.parametrize("n, every, rows, columns", [(220, 50, 11, 1), (480, 1, 8, 8)])
def test_copies_of_queries_are_no_more_than_of_the_table(spark, monkeypatch, n, every, rows, columns):
    for name, value in (("BLOCK", 10), ("LANE", 30), ("CELL_LANES", 2), ("CELL_BLOCKS", 2)):
        monkeypatch.setattr(vectors, name, value)
    df = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(n)], "id long, v array<double>").repartition(3)
    dealt, deal = [], type(df).repartitionById
    monkeypatch.setattr(type(df), "repartitionById", lambda self, parts, by: dealt.append(parts) or deal(self, parts, by))
    got = vectors.search(df, F.col("id") % every == 0, 1000, lambda b: b"", see_all, 2, "bigint")
    assert dealt[-1] == rows * columns and rows * len(range(0, n, every)) <= columns * n
    seen = got.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("d")).collect()
    assert len(seen) == len(range(0, n, every)) and {(r["n"], r["d"]) for r in seen} == {(n, n)}


@pytest.mark.parametrize("x, width", [
    ([[1.0, -300.0]], 2), ([[1.0, -0.0]], 4), ([[0.5, 2.0**100]], 4), ([[0.1, 1.0]], 8), ([[1e300, 1.0]], 8), ([[40000.0, 1.0]], 4)])
def test_vectors_travel_narrow_and_whole(x, width):
    x = np.array(x)
    raw = vectors._raw(x)
    back = vectors._vectors(raw, 1, 2)
    assert len(raw) == 2 * width and back.dtype == np.float64 and back.tobytes() == x.tobytes()


@pytest.mark.parametrize("times", [1e-3, 300.1, 1e4])
def test_pivot_table_is_exact_at_any_length(spark, rows, monkeypatch, times):
    """Bounds in single precision, products in single or double precision."""
    monkeypatch.setattr(vectors, "BLOCK", 128)
    monkeypatch.setattr(pivot_topk, "STEP", 3)
    long = [(i, [times * x for x in v]) for i, v in rows if i is not None and v and len(v) == 12 and all(x is not None and math.isfinite(x) for x in v)]
    got = {}
    for r in pivot_topk.pivot_topk(spark.createDataFrame(long, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert {q: [v[k] for k in sorted(v)] for q, v in got.items()} == brute(long, 50, 5, whole, True)
