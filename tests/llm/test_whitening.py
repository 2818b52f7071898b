import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import whitening

VECS = "vec_id long, embedding array<float>"


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + k, None if v is None else [None if c is None else float(c) for c in v])
                                  for k, v in enumerate(vectors)], VECS).repartition(3)


def brute(vectors, k):
    x = np.floor(64 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return c @ u / np.sqrt(e), e / (c * c).sum() * n, ((n * x - s) ** 2).sum(1)


def check(spark, vectors, k=32, want=None):
    rows = whitening.whiten(frame(spark, vectors), components=k).toPandas()
    white, explained, deviation = brute(vectors, want or k)
    got = rows.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((got * white).sum(0))
    assert np.abs(got * sign - white).max() < 1e-7
    assert np.abs(rows.drop_duplicates("component").sort_values("component").explained / explained - 1).max() < 1e-8
    assert (rows.drop_duplicates("vec_id").sort_values("vec_id").deviation.to_numpy() == deviation).all()
    assert rows.identity_error.nunique() == 1 and rows.identity_error[0] < 1e-6 and (rows.n == len(vectors)).all()
    return rows


def test_equals_dense_eigenvectors(spark):
    rng = np.random.default_rng(1)
    check(spark, rng.standard_normal((300, 20)) * np.linspace(1, 30, 20))
    check(spark, rng.standard_normal((200, 48)), k=32)


def test_stops_early_when_few_components_are_wanted(spark, monkeypatch):
    monkeypatch.setattr(whitening, "SPARE", 12)
    rng = np.random.default_rng(2)
    wide = rng.standard_normal((250, 120)) * np.r_[np.full(4, 60.0) * [4, 3, 2, 1.5], np.ones(116)]
    passes = []
    real = whitening._summed
    monkeypatch.setattr(whitening, "_summed", lambda *a: passes.append(1) or real(*a))
    check(spark, wide, k=4)
    assert len(passes) < 60


def test_dependent_repeated_and_constant_directions(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((80, 4)) * [1, 2, 4, 8]
    rows = check(spark, np.column_stack([x, x[:, 0], np.ones(80)]), want=4)  # rank 4 of 6
    assert rows.component.max() == 4
    # one eigenvalue six times: the recurrence breaks off at once and starts again
    cross = np.concatenate([np.eye(6), -np.eye(6)]) * 4
    rows = whitening.whiten(frame(spark, cross)).toPandas()
    white = rows.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert white.shape == (12, 6) and np.abs(white.T @ white / 12 - np.eye(6)).max() < 1e-9
    assert np.abs(rows.explained - 1 / 6).max() < 1e-12
    few = rng.standard_normal((3, 10))
    assert check(spark, few, want=2).component.max() == 2  # fewer vectors than dimensions


def test_nulls_odd_lengths_ties_and_empty(spark):
    rng = np.random.default_rng(4)
    good = [list(v) for v in rng.standard_normal((30, 5))]
    odd = [None, [], [1, None, 2, 3, 4], [float("nan")] * 5, [float("inf"), 1, 2, 3, 4], [1e30] * 5, [1, 2], [1] * 9]
    df = frame(spark, good + odd).unionByName(frame(spark, [good[0], good[0]], 1000)).unionByName(
        frame(spark, [good[1]]).withColumn("vec_id", F.lit(None).cast("long")))
    for name in ("id", "v", "data", "component", "n", "at", "x"):
        df = df.withColumn(name, F.lit("clash"))
    rows = whitening.whiten(df).toPandas()
    assert len(rows) == 33 * 5 and (rows.n == 33).all() and rows.vec_id.isna().sum() == 5
    white, _, _ = brute(good + [good[0], good[0], good[1]], 5)
    one = rows[rows.component == 1].groupby("vec_id").whitened
    assert one.nunique().max() == 1 and np.allclose(abs(one.first().loc[1000]), abs(white[0, 0]))
    for none in (df.limit(0), frame(spark, [[1, 2]]), frame(spark, [[3, 4]] * 5), frame(spark, [None, []])):
        out = whitening.whiten(none)
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_exact_beyond_longs():
    big = whitening.Centre(3, (3 << 60, 0))
    data = np.array([[1 << 60, 5]], np.int64).tobytes()
    assert big.exact(data).tolist() == [[0, 15]]


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_whole_table(spark, sf):
    from ledgerlens.llm.queries import QUERIES
    path = f"/root/testdata/{sf}"
    rows = QUERIES["op12_lanczos_whitening"](spark, path).toPandas()
    vectors = [r.embedding for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()
               if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    assert len(rows) == 32 * len(vectors)
    _, explained, _ = brute(vectors, 32)
    assert np.abs(rows.drop_duplicates("component").sort_values("component").explained / explained - 1).max() < 1e-9
    assert rows.identity_error[0] < 1e-9
