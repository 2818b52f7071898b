import collections
import math
import random
import re
from zlib import crc32

import numpy as np
import pytest

from ledgerlens.llm import license_scan, lm_scoring
from tests.oracle_compare import canon, duck


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower(text)), None]  # None: the end


def fold(i):
    return 0 if i is None else crc32(str(i).encode()) % 10


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(30)] + ["Été", "the", "The", "of"]
    out = [(k, " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.choice([0, 1, 7, 60])))) for k in range(240)]
    return out + [(240, None), (241, ""), (242, "unseen words only"), (None, "no id w1"), (5, "same id the of"), (5, "same id the of"),
                  (243, "w1 w2 w3\x1cw4"), (244, "w3 w4 " * 900)]


def brute(rows, vocabulary, weights):
    """Counts and probabilities by dictionaries, given the operator's mixture weights."""
    train = [tokens(t) for i, t in rows if fold(i)]
    c = collections.Counter(w for d in train for w in d)
    n, v = sum(c.values()), len(c)
    sizes = sorted((x for w, x in c.items() if w is not None), reverse=True)
    least = next((s for s in sorted(set(sizes)) if sum(x >= s for x in sizes) <= vocabulary), math.inf)
    known = {w for w, x in c.items() if w is None or x >= least}
    group = lambda w: w if w in known else "<rare>"
    pairs, contexts, ones = collections.Counter(), collections.Counter(), collections.Counter()
    for d in train:
        before = "<start>"
        for w in map(group, d):
            pairs[before, w] += 1
            contexts[before] += 1
            ones[w] += 1
            before = w
    share = v - len(known) + 1
    out = []
    for i, text in rows:
        base = score = 0.0
        before = "<start>"
        for raw in tokens(text):
            w = group(raw)
            part = 1 / share if w == "<rare>" else 1.0
            ctx = contexts[before]
            l2, l1, l0 = weights[0 if not ctx else 1 + int(math.log2(ctx))]
            score += math.log10(l2 * pairs[before, w] / max(ctx, 1) * part + l1 * ones[w] / n * part + l0 / (v + 1))
            base += math.log10((c[raw] + 0.1) / (n + 0.1 * (v + 1)))
            before = w
        toks = tokens(text)
        out.append((str(i), len(toks), sum(c[w] > 0 for w in toks), round(base, 6), round(score, 6)))
    return n, sorted(out)


@pytest.mark.parametrize("vocabulary,dense,chunk", [(1 << 20, 1024, 1_000_000), (20, 8, 500), (0, 3, 90), (25, 3, 200)])
def test_scores_equal_a_dictionary_model(documents, rows, clashing, monkeypatch, vocabulary, dense, chunk):
    monkeypatch.setattr(lm_scoring, "DENSE", dense)
    monkeypatch.setattr(lm_scoring, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 700)
    docs = clashing(documents(rows))
    model = lm_scoring.train(docs, vocabulary=vocabulary)
    got = lm_scoring.score(docs, model).collect()
    n, want = brute(rows, vocabulary, model.weights)
    assert model.vocabulary.tokens == n
    found = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got)
    assert [f[:3] for f in found] == [w[:3] for w in want]
    assert np.allclose([f[3:] for f in found], [w[3:] for w in want], atol=2e-6)


@pytest.mark.parametrize("cache,dense,chunk", [(20, 8, 500), (0, 3, 90), (25, 1024, 1_000_000)])
def test_types_outside_the_cache_keep_their_counts(documents, rows, clashing, monkeypatch, cache, dense, chunk):
    monkeypatch.setattr(lm_scoring, "DENSE", dense)
    monkeypatch.setattr(lm_scoring, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 700)
    docs = clashing(documents(rows))
    model = lm_scoring.train(docs, cache=cache)
    assert len(model.vocabulary.words) <= cache
    assert np.allclose(model.weights, lm_scoring.train(docs).weights, atol=1e-9)
    _, want = brute(rows, 1 << 20, model.weights)
    found = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6))
                   for r in lm_scoring.score(docs, model).collect())
    assert [f[:3] for f in found] == [w[:3] for w in want]
    assert np.allclose([f[3:] for f in found], [w[3:] for w in want], atol=2e-6)


def test_probabilities_add_up_to_one(documents, rows):
    model = lm_scoring.train(documents(rows), vocabulary=20)
    voc, m = model.vocabulary, model.weights
    words = np.arange(1, len(voc.counts))  # the end, the class, the words
    for v in (0, 2, 3, 10):
        c = model.dense[v, words]
        p = 10 ** lm_scoring.log_mixture(voc, m, np.full(len(words), v), words, c)
        many = np.where(words == lm_scoring.RARE, voc.class_types, 1)
        assert (p * many).sum() == pytest.approx(1, abs=1e-6)


def test_weights_beat_the_base_on_held_out_documents(spark):
    got = lm_scoring.op1_deleted_interpolation(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in got) > 0.9 * sum(r.base_score for r in got)


def test_em_finds_the_mixture_of_made_up_events():
    rng = np.random.default_rng(0)
    p2, p1 = 2.0 ** rng.integers(0, 10, 400), 2.0 ** rng.integers(0, 8, 400)
    cells = (np.int64(3) << 24) | ((1 + (lm_scoring.GRID * np.log2(p2) + 512).astype(np.int64)) << 12) | (
        1 + (lm_scoring.GRID * np.log2(p1) + 512).astype(np.int64))
    n = rng.integers(1, 20, 400).astype(float)
    w = lm_scoring.learn_weights(cells, n)[3]
    value = lambda w: (n * np.log(w[0] * p2 + w[1] * p1 + w[2])).sum()
    grid = [(a, b, 1 - a - b) for a in np.linspace(0, 1, 41) for b in np.linspace(0, 1 - a, 41)]
    assert value(w) >= max(map(value, grid)) - 1e-2


def test_packing_round_trips():
    arrays = (np.arange(5), np.empty(0, np.int64), np.array([1.5, -2]), np.array([3], np.int32))
    for a, b in zip(arrays, lm_scoring.unpack(lm_scoring.pack(*arrays))):
        assert a.dtype == b.dtype and np.array_equal(a, b)


def test_lm_of_nothing(documents):
    empty = documents([(1, "x")]).limit(0)
    assert lm_scoring.score(empty, lm_scoring.train(empty)).count() == 0
    got = lm_scoring.score(documents([(1, "a b"), (2, None)]), lm_scoring.train(empty)).collect()
    assert all(math.isfinite(r.score) and r.n_known == 0 for r in got)


# --- license scan ---

def brute_scan(rows):
    out = []
    for i, text in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        places = [(label, k) for p, label in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        found, best = set(), 0.0
        pairs = [f"{x} {y}" for x, y in zip(w, w[1:])]
        for label, t in license_scan.TEMPLATES:
            needed, t = license_scan.needed_tokens(t), set(license_scan.template_tokens(t))
            most = max((len(t & set(pairs[s : s + 2 * len(t)])) for s in range(len(pairs))), default=0)
            if most >= needed:
                found.add(label)
                best = max(best, most / len(t))
        base = {p[0] for p in places}
        starts = [p[1] for p in places]
        out.append((str(i), len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                    ",".join(sorted(base | found)), 1.0 if places else best))
    return sorted(out, key=str)


def test_scan_equals_brute_force(documents, clashing):
    rng = random.Random(9)
    pool = "the license mit apache general public under released gnu version 2 0 of und mit Lizenz copy".split()
    rows = [(k, " ".join(rng.choices(pool, k=rng.choice([0, 3, 30, 150])))) for k in range(120)]
    for k, (_, t) in enumerate(license_scan.TEMPLATES):
        words = t.split()
        filler = " ".join(rng.choices("plain words that say nothing at all here".split(), k=rng.choice([0, 31, 32, 33, 100])))
        rows.append((200 + k, f"{filler}\n{t.title()}. {filler}"))
        rows.append((300 + k, " ".join(words[: len(words) // 2])))
    rows += [(400, None), (401, ""), (402, "!!!"), (None, "Released under the MIT License."), (403, "MITé license"), (404, "mit-license apache.license"),
             (0, rows[0][1]), (0, "an Apache License, again")]
    got = license_scan.scan(clashing(documents(rows))).collect()
    assert sorted(((str(r.doc_id), *tuple(r)[1:]) for r in got), key=str) == brute_scan(rows)
    assert license_scan.scan(documents(rows).limit(0)).count() == 0


def test_op2_equals_its_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duck(d)
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet')")
    df, res = license_scan.op2_license_containment(spark, d), con.sql(license_scan.OP2_SQL)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(res.columns, res.fetchall())


def labels_of(documents, texts):
    return {r.doc_id: (r.labels, r.score) for r in license_scan.scan(documents(list(enumerate(texts)))).collect()}


def test_scattered_words_are_no_license(documents):
    texts = ["all of the guests have rights to the hall and the seats were reserved for them",
             "a cc list by mail was under review sa said 4 of 0 were licensed", "an act the mit students were released license plates under the rain"]
    assert set(labels_of(documents, texts).values()) == {("", 0.0)}


def test_score_does_not_depend_on_where_a_notice_starts(documents):
    grant = dict(license_scan.TEMPLATES[1:2])["mit"].split()
    changed = [*grant[:9], "certain", *grant[9:]]  # one word put in
    texts = ["x " * k + " ".join(changed) + " y" * (k % 7) for k in range(130)]
    found = set(labels_of(documents, texts).values())
    assert len(found) == 1 and found.pop()[0] == "mit"


def test_very_long_text_with_a_notice_at_its_end(documents):
    text = "plain words " * 200_000 + license_scan.TEMPLATES[7][1]
    assert labels_of(documents, [text])[0][0] == license_scan.TEMPLATES[7][0]


def test_templates_fit_into_a_block():
    assert all(2 * len(license_scan.template_tokens(t)) <= license_scan.BLOCK for _, t in license_scan.TEMPLATES)
    with pytest.raises(ValueError):
        license_scan.template_tokens("alone")


def test_places_of_words_by_their_first_bits():
    """The same places as by binary search, also where many words share their first bits."""
    import pickle

    import numpy as np

    from ledgerlens.llm import lm_scoring as lm

    g = np.random.default_rng(1)
    ends = np.array([-(1 << 63), (1 << 63) - 1, -1, 0, 1], np.int64)
    for n in (1, 5, 3_000):
        words = np.unique(np.concatenate([g.integers(-(1 << 63), (1 << 63) - 1, n), np.arange(n) * 7, ends[: n - 1]]))
        voc = pickle.loads(pickle.dumps(lm.Vocabulary(words, np.arange(len(words)) + lm.FIRST, np.ones(3), np.ones(3), 1, 1, 1, True)))
        asked = np.concatenate([words, words[1:] - 1, g.integers(-(1 << 63), (1 << 63) - 1, 5_000), ends])
        found = np.isin(asked, words)
        assert (voc.of(asked) == np.where(found, np.searchsorted(words, asked) + lm.FIRST, lm.RARE)).all()
    keys, gone = g.integers(0, 50, 1_000), g.integers(0, 2, 1_000).astype(bool)
    got, c, d, first = lm.summed_first(keys, gone)
    want, want_c = np.unique(keys, return_counts=True)
    assert (got == want).all() and (c == want_c).all() and (keys[first] == got).all()
    assert (d == [gone[keys == k].sum() for k in got]).all()
    assert [len(x) for x in lm.summed_first(keys[:0], gone[:0])] == [0] * 4
