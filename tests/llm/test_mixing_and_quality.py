import collections
import random

import duckdb
import numpy as np
import pytest

from ledgerlens.llm import mixing, quality
from ledgerlens.llm.common import SPACED_WORD
from tests.oracle_compare import canon


def fill(sizes, weights=(5, 2, 1), share=1.5):
    """Targets by repeated resharing, as the contract words it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {s: 0.0 for s in sizes}, share * sum(sizes.values()), set(sizes)
    while left > 1e-9 and open_:
        total, more = sum(w[s] for s in open_), 0.0
        for s in sorted(open_, key=order.index):
            target[s] += left * w[s] / total
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                more += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
        left = more
    return target


@pytest.fixture
def rows():
    rng = random.Random(1)
    out = [(k, " ".join("w" * rng.randint(1, 9) for _ in range(rng.choice([0, 1, 5, 40, 300]))),
            rng.choice(["hot"] * 6 + ["b", "a", "é", None, "Z"])) for k in range(400)]
    return out + [(400, None, "hot"), (401, "   ", None), (None, "a b c", "a"), (7, "again this id", "b"), (7, "again this id", "b")]


def test_mix_meets_the_targets(documents, clashing, rows):
    got = mixing.mix(clashing(documents(rows))).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want, taken = fill(sizes), collections.Counter()
    known = {(i, s, len((t or "").split())) for i, t, s in rows}
    for r in got:
        assert (r.doc_id, r.source, r.size) in known and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(p["words"] for p in r.passes)
        assert all(0 <= p["position"] <= 1 for p in r.passes)
        assert [p["position"] for p in r.passes] == sorted(p["position"] for p in r.passes)
        taken[r.source] += r.taken
    for s in sizes:
        assert taken[s] == round(want[s] + 1e-9) or abs(taken[s] - want[s]) <= 0.5
    again = mixing.mix(documents(rows).repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken, str(r.passes))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_schedules_are_inverted(spark):
    from pyspark.sql import functions as F
    shares = np.linspace(0, 1, 41)
    df = spark.createDataFrame([(float(x), k) for x in shares for k in range(3)], "x double, cls int")
    for r in df.select("x", "cls", mixing.inverse_demand(F.col("x"), F.col("cls")).alias("t")).collect():
        knots = mixing.SCHEDULES[r.cls]
        grid = np.linspace(0, 1, 20001)
        rate = np.interp(grid, *zip(*knots))
        area = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2 * np.diff(grid))])
        assert np.interp(r.t, grid, area / area[-1]) == pytest.approx(r.x, abs=1e-6)


def test_slices_do_not_change_the_result(documents, rows, monkeypatch):
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    whole = sorted(map(key, mixing.mix(documents(rows)).collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    assert sorted(map(key, mixing.mix(documents(rows)).collect())) == whole


def test_mixed_documents_hold_the_words_taken(documents, rows):
    docs = documents(rows)
    plan = mixing.mix(docs).collect()
    out = mixing.mixed_documents(docs).collect()
    assert out and set(out[0].asDict()) == set(docs.columns)
    want = collections.Counter()
    for r in plan:
        want[r.source] += r.taken
    got = collections.Counter()
    texts = collections.defaultdict(list)
    for i, t, _ in rows:
        texts[i].append(t or "")
    for r in out:
        got[r.source] += len(r.text.split())
        assert any(t.startswith(r.text) for t in texts[r.doc_id]) and r.n_chars == len(r.text)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_mix_of_nothing(documents):
    assert mixing.mix(documents([(1, "x")]).limit(0)).count() == 0
    empty = mixing.mix(documents([(1, None), (2, "")])).collect()
    assert [(r.size, r.taken) for r in empty] == [(0, 0), (0, 0)]


def test_op7_equals_its_sql(spark):
    from tests.oracle_compare import duck
    d = "/root/testdata/sf0.001"
    con = duck(d)
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet')")
    df = mixing.op7_curriculum_mix(spark, d)
    res = con.sql(mixing.OP7_SQL)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(res.columns, res.fetchall())


def test_word_pattern_matches_python():
    import re
    assert re.findall(SPACED_WORD, "a\xa0b c\x1cd\te\x0bf") == ["a\xa0b", "c\x1cd", "e", "f"]


def _junk(rng):
    return " ".join(rng.choice(["buy", "win", "now"]) + rng.choice(["***", "!!", "$$$"]) for _ in range(rng.randint(3, 60)))


def _prose(rng):
    return " ".join(rng.choice("the of tale and river quiet stone was Many come, under.".split()) for _ in range(rng.randint(3, 60)))


def test_ranker_separates_held_out_documents(spark, documents, clashing):
    rng = random.Random(2)
    rows = [(k, _junk(rng) if k % 4 == 0 else _prose(rng)) for k in range(400)] + [(None, "x"), (400, None), (401, ""), (3, "a repeated id")]
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(0, 400, 2)] + [(1, None, 0), (None, 1, 0), (9999, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    docs = clashing(documents(rows)).drop("score")
    ranker = quality.train(docs, labels)
    got = quality.quality_scores(docs, ranker, keep=("doc_id", "text")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    for r in got:
        if r.doc_id is not None and r.doc_id < 400 and len(r.text) > 20:
            assert (r.score >= 0.3) == (r.doc_id % 4 != 0)
    assert len({r.score for r in got if not r.text}) == 1
    kept = quality.keep_good(docs, ranker)
    assert kept.columns == docs.columns and kept.where("doc_id % 8 = 0 AND length(text) > 20").count() == 0


def test_training_is_repeatable_and_held_out_labels_do_not_matter(spark, documents):
    from zlib import crc32
    rng = random.Random(4)
    rows = [(k, _junk(rng) if k % 3 == 0 else _prose(rng)) for k in range(150)]
    docs = documents(rows)
    make = lambda flip: spark.createDataFrame(
        [(k, int((k % 3 != 0) ^ (flip and crc32(str(k).encode()) % 5 == 0))) for k in range(150)], "doc_id long, quality int")
    a, b = quality.train(docs, make(False)), quality.train(docs.repartition(5), make(True))
    assert np.array_equal(a.weights, b.weights) and a.cut == b.cut


def test_cut_covers_all_labelled_rows(spark, documents):
    from zlib import crc32
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(1500):
        good = rng.random() < 6 / 7
        junk = min(max(rng.gauss(0.4 if good else 0.6, 0.15), 0), 1)
        rows.append((k, " ".join(rng.choice(["buy***", "win!!", "now$$$"]) if rng.random() < junk else rng.choice(["river", "stone", "tale"])
                                 for _ in range(40))))
        labels.append((k, int(good)))
    labelled = spark.createDataFrame(labels, "doc_id long, quality int")
    train = [k for k in range(1500) if crc32(str(k).encode()) % 5]
    label = np.array([labels[k][1] for k in train])

    def scores(m):
        return m.raw(np.vstack([quality.features(np.frombuffer(rows[k][1].encode(), np.uint8)) for k in train]))

    m = quality.train(documents(rows), labelled, max_per_label=60)
    z = scores(m)
    wrong = lambda cut: ((z >= cut) != label).sum()
    assert wrong(m.cut) <= min(wrong(c) for c in z) + 1
    m = quality.train(documents(rows), labelled, max_per_label=60, quantile=0.25)
    assert np.mean(scores(m) < m.cut) == pytest.approx(0.25, abs=0.01)
    assert m.quantile == pytest.approx(np.mean(scores(m) < m.cut), abs=0.002)


def test_repeated_ids_bring_no_more_rows_to_the_driver(spark, documents, monkeypatch):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["river", "stone", "a", "!!"]) for _ in range(20))) for k in range(100)]
    rows += [(k, f"again {j}") for k in range(100) for j in range(30)]  # every id thirty times more
    labelled = spark.createDataFrame([(k, k % 2) for k in range(100)] + [(3, 0), (None, 1)], "doc_id long, quality int")
    seen, real = [], quality.fit_pairs
    monkeypatch.setattr(quality, "fit_pairs", lambda good, bad, **o: seen.append((len(good), len(bad))) or real(good, bad, **o))
    m = quality.train(documents(rows), labelled, max_per_label=10)
    assert seen == [(10, 10)] and 0 <= m.quantile <= 1


def test_quality_of_a_very_long_text(spark, documents):
    m = quality.train(documents([(k, "good text " * 5 if k % 2 else "$$$ !!!") for k in range(40)]),
                      spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in quality.quality_scores(documents([(1, "good text " * 200_000), (2, "$$$ !!! " * 200_000)]), m).collect()}
    assert got[1] > 0.3 > got[2]


def test_without_labels_nothing_is_preferred(spark, documents):
    docs = documents([(1, "a b"), (2, None)])
    ranker = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.quality_scores(docs, ranker).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), ranker).count() == 0


def test_held_out_accuracy_on_the_sample(spark):
    d = "/root/testdata/sf0.01"
    got = quality.op10_bradley_terry(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.97


def test_bradley_terry_gradient_is_zero_at_the_fit():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0.7, 1, (80, 4)), rng.normal(0, 1, (50, 4))
    m = quality.fit_pairs(good, bad, pairs_per_row=2, l2=0.05)
    assert np.mean(m.raw(good)) > np.mean(m.raw(bad))
    assert m.score(np.vstack([good, bad])).min() >= 0
    cut = m.score((m.mean + 0 * m.mean)[None])[0]
    assert 0 < cut < 1
