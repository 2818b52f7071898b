import random
import re
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import phrase_index
from ledgerlens.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle_compare import canon

ITEMS = "item_id long, text string"


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def windows(items, size):
    out = set()
    for i, t in items:
        w = words(t)
        if w:
            out |= {(i, tuple(w[k : k + size])) for k in range(max(1, len(w) - size + 1))}
    return out


def brute(docs, items, size=10, slop=0):
    out = []
    found = windows(items, size)
    for d, t in docs:
        w, hit, names, near = words(t), set(), set(), set()
        for i, terms in found:
            n = len(terms)
            for s in range(-slop, len(w) + slop):
                if w[max(s, 0) : s + n] == list(terms) and s >= 0:
                    hit |= set(range(s, s + n))
                    names.add(i)
                if all(term in w[max(0, s + k - slop) : max(0, s + k + slop + 1)] for k, term in enumerate(terms)):
                    near.add(i)
        text = lambda x: tuple(sorted(str(i) for i in x if i is not None))
        out.append((d, len(w), len(hit), text(names), text(near)))
    return sorted(map(str, out))


def result(df, items, **options):
    rows = phrase_index.contamination(df, items, **options).collect()
    return sorted(str((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(r.near_items))) for r in rows)


@pytest.fixture
def case():
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(30)]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    items = [(k, text(rng.choice((0, 1, 2, 3, 4, 7, 9)))) for k in range(25)] + [(3, "w1, W2"), (None, "w3 w4"), (90, None), (91, "absent words"), (92, "w1 w2")]
    docs = [(k, text(rng.choice((0, 1, 5, 40)))) for k in range(40)]
    for k in range(20):  # whole items, items with a word put in, left out or swapped
        w = words(rng.choice([t for _, t in items if t]))
        cut = rng.randrange(len(w)) if w else 0
        docs.append((100 + k, " ".join([text(3), *w[:cut], *([text(1)] if k % 2 else []), *w[cut:], text(3)])))
    docs += [(None, docs[-1][1]), (None, None), (500, docs[-2][1]), (500, docs[-2][1]), (500, "w1 w2 w3"), (501, None), (502, "")]
    return docs, items


@pytest.mark.parametrize("rows", [1 << 18, 0])
def test_phrases_and_proximity_equal_brute_force(spark, documents, clashing, case, monkeypatch, rows):
    monkeypatch.setattr(phrase_index, "BROADCAST_ROWS", rows)  # 0: nothing is broadcast
    monkeypatch.setattr(phrase_index, "SALTS", 3)
    docs, items = case
    item_df = spark.createDataFrame(items, ITEMS)
    df = clashing(documents(docs)).withColumn("term", F.lit(1)).withColumn("window", F.lit(2)).withColumn("d", F.lit(3))
    slop = 1 if rows else 0
    got = result(df, item_df, size=4, slop=slop)
    want = brute(docs, items, 4, slop)
    assert got == want
    assert sum("()" not in r for r in want) > 10


def test_empty_tables(spark, documents):
    items = spark.createDataFrame([(1, "a b c")], ITEMS)
    assert phrase_index.contamination(documents([(1, "a")]).limit(0), items).count() == 0
    for none in (items.limit(0), spark.createDataFrame([(1, None), (2, "  ")], ITEMS)):
        rows = phrase_index.contamination(documents([(1, "a b c")]), none).collect()
        assert [(r.n_words, r.n_hit, r["items"]) for r in rows] == [(3, 0, [])]


def test_hit_at_the_end_of_a_very_long_text(spark, documents):
    item = " ".join(f"t{k}" for k in range(14))
    long = "x " * 200_000 + item
    rows = phrase_index.contamination(documents([(1, long), (2, long[:-1])]), spark.createDataFrame([(7, item), (8, item)], ITEMS)).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows}
    assert got == {1: (200_014, 14, ["7", "8"]), 2: (200_014, 13, ["7", "8"])}


def test_equals_sql(spark):
    path = "/root/testdata/sf0.001"
    df = QUERIES["op13_positional_index"](spark, path)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    res = con.sql(ORACLE_SQL["op13_positional_index"])
    assert got == canon(res.columns, res.fetchall())
    clean = [r for r in df.collect() if not r.contaminated]
    assert clean and all(r.items_sha256 == sha256(b"").hexdigest() and r.n_items == 0 for r in clean)
