import collections
import random

import pytest

from ledgerlens.llm import tgm_join


def shingles(text, size):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, size, percent):
    """Components by comparing all pairs."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    known = [(i, s) for i, s in sets if i is not None and s]
    for a in range(len(known)):
        for b in range(a):
            (i, s), (j, t) = known[a], known[b]
            if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)):
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    return collections.Counter((i, len(s), None if i is None else find(i)) for i, s in sets)


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.45:  # a near copy
            w = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                if w:
                    w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
        else:
            w = [word() for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 20, 60, 120]))]
            if kind > 0.7:  # a passage that many share
                at = rng.randrange(len(w) + 1)
                w[at:at] = passage
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    base = [word() for _ in range(80)]
    for k in range(60):  # one large group of near copies, many of them too far apart
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(80)] = word()
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000 + k, " ".join(base)) for k in range(25)]
    rows += [(3000, None), (3001, ""), (3002, " \t\n"), (3003, "One"), (3004, "one"), (3005, "a B c"), (3006, "A b  C"), (None, "no id here"), (None, "no id here")]
    rows += [(0, dict(rows)[0])]
    return rows


@pytest.mark.parametrize("seed,size,percent,cap", [(1, 4, 85, 32), (2, 4, 85, 2), (3, 5, 80, 1), (4, 2, 60, 3)])
def test_components_equal_all_pairs(documents, clashing, monkeypatch, seed, size, percent, cap):
    monkeypatch.setattr(tgm_join, "CAP", cap)
    rows = corpus(seed)
    got = tgm_join.jaccard_components(clashing(documents(rows)), size=size, percent=percent).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, size, percent)


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_linked_sets_share_what_the_bound_says(percent):
    rng = random.Random(percent)
    seen = 0
    for _ in range(4000):
        n = rng.randint(1, 60)
        x = set(rng.sample(range(400), n))
        y = (x - set(rng.sample(sorted(x), rng.randint(0, max(1, n // 5))))) | set(rng.sample(range(400), rng.randint(0, max(1, n // 6))))
        both = len(x & y)
        if y and 100 * both >= percent * (len(x) + len(y) - both):
            kx, ky = (set(sorted(s)[: tgm_join.kept_length(len(s), percent)]) for s in (x, y))
            assert len(kx & ky) >= max(tgm_join.least_shared(len(x), percent), tgm_join.least_shared(len(y), percent))
            px, py = (set(sorted(s)[: tgm_join.prefix_length(len(s), percent)]) for s in (x, y))
            assert px & py
            seen += 1
    assert seen > 300


def test_keep_one_each(documents):
    rows = corpus(7) + [(5000, "two texts share this id and differ"), (5000, "completely other words under the same id here")]
    docs = documents(rows)
    kept = tgm_join.keep_one_each(docs)
    assert kept.columns == docs.columns
    parts = brute(rows, 4, 85)
    want = {c for _, _, c in parts}
    got = collections.Counter(r.doc_id for r in kept.collect())
    assert {i for i in got if i is not None} == {c for c in want if c is not None}
    assert got[5000] == 2  # unrelated texts under one id both stay
    assert got[None] == 2 and all(n == 1 for i, n in got.items() if i not in (None, 5000))


def near_copies(seed=9):
    """A, a near copy of it, and an unrelated text."""
    rng = random.Random(seed)
    a = [f"w{rng.randrange(10_000)}" for _ in range(200)]
    return " ".join(a), " ".join([*a[:-1], "changed"]), " ".join(f"v{k}" for k in range(200))


@pytest.mark.parametrize("id_type", ["long", "string", "int"])
def test_rows_that_share_an_id_are_judged_by_their_own_text(spark, id_type):
    a, near, other = near_copies()
    first, second, third = (1, 5, -7) if id_type != "string" else ("1", "5", "7")
    rows = [(first, a, 10), (second, near, 11), (second, other, 12), (second, other, 13), (third, "", 14), (third, "x y", 15), (None, a, 16)]
    df = spark.createDataFrame(rows, f"doc_id {id_type}, text string, rows int").repartition(3)
    kept = tgm_join.keep_one_each(df)
    assert kept.schema == df.schema
    got = sorted((str(r.doc_id), r.text) for r in kept.collect())
    assert got == sorted((str(i), t) for i, t in ((first, a), (second, other), (third, ""), (third, "x y"), (None, a)))
    found = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in tgm_join.jaccard_components(df).collect())
    assert found == {(first, 197, first): 1, (second, 197, first): 1, (second, 197, second): 2, (third, 0, third): 1, (third, 1, third): 1,
                     (None, 197, None): 1}


def test_a_very_long_text_and_its_near_copy(documents):
    a = " ".join(f"w{k}" for k in range(60_000))
    got = tgm_join.jaccard_components(documents([(1, a), (2, a + " end"), (3, a[: len(a) // 2])])).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_nothing_to_join(documents):
    assert tgm_join.jaccard_components(documents([(1, "x")]).limit(0)).count() == 0
    got = tgm_join.jaccard_components(documents([(1, None), (2, ""), (3, "alone in the world")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 0, 1), (2, 0, 2), (3, 1, 3)]
