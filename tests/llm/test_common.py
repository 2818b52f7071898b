import random

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import common


def test_smallest_hashes_do_not_depend_on_thinning(spark):
    df = spark.range(20_000).withColumn("x", F.col("id") % 7)
    want = [r.id for r in df.orderBy(F.xxhash64("id"), "id").limit(50).collect()]
    for parts in (1, 9):
        assert [r.id for r in common.smallest_hashes(df.repartition(parts), 50, "id").collect()] == want
    assert common.smallest_hashes(df.limit(30), 50, "id").count() == 30
    assert common.smallest_hashes(df.limit(0), 50, "id").count() == 0


def test_passing_tables_go_but_for_the_kept_one(spark):
    from pathlib import Path

    from ledgerlens.session import ensure_checkpoint_dir

    def there():
        return {p.name.rsplit("-", 1)[0] for p in Path(ensure_checkpoint_dir(spark).removeprefix("file:")).glob("scope-*")}

    with common.passing_tables(spark):
        with common.passing_tables(spark):
            inner = common.stored(spark.range(5), "scope-inner")
            kept = common.stored(inner.withColumn("x", F.lit(1)), "scope-kept", keep=True)
            assert there() == {"scope-inner", "scope-kept"}
        assert there() == {"scope-kept"} and kept.count() == 5
        try:
            with common.passing_tables(spark):
                common.stored(spark.range(5), "scope-failed")
                raise ValueError
        except ValueError:
            assert there() == {"scope-kept"}
    assert there() == set()


def test_members_are_never_missed(spark):
    df = spark.range(3000).select(F.xxhash64("id").alias("h"))
    inside = np.array([r.h for r in df.collect()], np.int64)
    members = common.Members(df, "h")
    assert members.test(inside).all()
    others = np.random.default_rng(0).integers(-(1 << 63), 1 << 63, 20_000)
    assert members.test(others).mean() < 0.15
    assert not common.Members(df.limit(0), "h").test(others).any()


def test_full_filters_let_through_more_never_less(spark, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BITS", 10)
    df = spark.range(500).select(F.xxhash64("id").alias("h"))
    members = common.Members(df, "h")
    assert members.log2 == 10 and members.test(np.array([r.h for r in df.collect()], np.int64)).all()


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    edges += [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2000 + k) for k in range(1, 60)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_word_hashes_are_the_same_in_any_block(monkeypatch):
    rng = random.Random(1)
    data = np.frombuffer(" ".join("".join(rng.choices("abcé", k=rng.randint(1, 30))) for _ in range(400)).encode(), np.uint8)
    starts, ends = common.spaced_words(data)
    words = [data[s:e].tobytes() for s, e in zip(starts, ends)]
    assert words == data.tobytes().split()
    whole = common.word_hashes(data, starts, ends)
    assert len(set(whole.tolist())) == len(set(words))
    for block in (1, 50, 333):
        monkeypatch.setattr(common, "_BLOCK", block)
        assert np.array_equal(common.word_hashes(data, starts, ends), whole)
    alone = np.array([common.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] for w in words])
    assert np.array_equal(alone, whole)


def test_shingles_of_short_and_blank_texts():
    h = np.array([1, 2, 3, 4, 5], np.uint64)
    assert len(common.shingle_hashes(h[:0], 4)) == 0 and len(common.shingle_hashes(h[:3], 4)) == 1
    assert len(common.shingle_hashes(h, 4)) == 2 and len(common.shingle_hashes(np.repeat(h[:1], 9), 4)) == 1
    assert common.shingle_hashes(h[:3], 4)[0] != common.shingle_hashes(np.append(h[:3], h[2]), 4)[0]
