import collections
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from ledgerlens.llm import packing, token_counts
from ledgerlens.llm.common import FastEncoder, public_byte_bpe

BPE = public_byte_bpe()
TOK = Tokenizer.from_file(BPE["json_path"])
WIDTHS = token_counts.token_widths(TOK)


def n_tokens(text):
    return len(TOK.encode(text or "", add_special_tokens=False).ids)


def test_fast_encoder_equals_the_library():
    fast = FastEncoder(BPE["ranks_path"], dict(BPE["specials"]), BPE["pattern"])
    texts = [f"a{c}b 1{c}2 .{c}  {c}{c} \n{c}x  " for c in map(chr, [*range(1, 0xD800, 7), *range(0xE000, 0x30000, 41)])]
    texts += ["", "a<|endoftext|>b  <|endoftext|>  c", "\0a\0", " " * 1000 + "x", "aaaa" * 5000, "I'll we're 's'LL"]
    for text, e in zip(texts, TOK.encode_batch(texts, add_special_tokens=False)):
        assert fast.ids(text).tolist() == e.ids


def spliced(text, chunk, overlap):
    """What the operator's windows do, in one process: None where it must widen."""
    pieces = token_counts.cut(text, chunk, overlap)
    views = [token_counts.overlap_views(TOK, WIDTHS, p, k + 1 == len(pieces), chunk, overlap) for k, p in enumerate(pieces)]
    total, since = 0, 0
    for k, (n, _, _, tail_pos, tail_cum) in enumerate(views):
        if k + 1 == len(views):
            return total + n - since
        _, head_pos, head_cum, _, _ = views[k + 1]
        common = np.intersect1d(tail_pos, head_pos)
        if not len(common):
            return None
        total += tail_cum[list(tail_pos).index(common[0])] - since
        since = head_cum[list(head_pos).index(common[0])]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 'lre\n\t1.é漢<|endoftext|>!"), max_size=400), st.integers(30, 90))
def test_splices_are_exact_or_refused(text, chunk):
    found = spliced(text, chunk, 28)
    assert found is None or found == n_tokens(text)


def test_splices_hold_special_strings():
    text = "some words <|endoftext|> and more of them  " * 60
    found = [spliced(text, c, 40) for c in range(60, 140)]
    assert sum(f is not None for f in found) > 60
    assert all(f in (None, n_tokens(text)) for f in found)


def test_counts_of_short_long_and_stubborn_texts(spark, documents, clashing):
    rng = random.Random(3)
    words = " ".join(rng.choice(["the", "cat's", "1234", "naïve", "x!", "\n\n", "  "]) for _ in range(3000))
    rows = [(1, words), (1, words), (2, None), (3, ""), (None, "no id"), (4, "a" * 5000), (5, words[:700] + " " * 3000 + words[:700]),
            (6, "<|endoftext|>" * 40), (7, words), (8, "short")]
    docs = clashing(documents(rows))
    got = token_counts.token_counts(docs, **BPE, chunk_chars=400, overlap_chars=60).collect()
    want = collections.Counter((i, len((t or "").encode()), n_tokens(t)) for i, t in rows)
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    plain = token_counts.token_counts(docs, BPE["json_path"], chunk_chars=400, overlap_chars=60).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in plain) == want


def test_counts_of_an_empty_table(documents, spark):
    assert token_counts.token_counts(documents([(1, "x")]).limit(0), **BPE).count() == 0


def check_packing(rows, got, capacity):
    want = collections.Counter()
    for i, text in rows:
        ids = np.array([*TOK.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % capacity or min(len(ids), capacity)
        starts = [0, *range(first, len(ids), capacity)]
        for k, s in enumerate(starts):
            part = ids[s : (starts + [len(ids)])[k + 1]]
            want[i, k, s, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_is_whole_gapless_and_tight(documents, clashing):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["the", "of", "zebra", "1 2"]) for _ in range(rng.choice([3, 20, 60, 200])))) for k in range(300)]
    rows += [(300, None), (301, ""), (302, "a b " * 500), (None, "no id"), (5, rows[5][1]), (5, "another text, same id")]
    got = packing.pack(clashing(documents(rows)), 128, **BPE).collect()
    n = check_packing(rows, got, 128)
    assert n <= -(-sum(r.length for r in got) // 128) + 4
    assert packing.pack(documents(rows).limit(0), 128, **BPE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=120))
def test_histogram_packing_covers_all_and_beats_first_fit(lengths):
    capacity = 40
    counts = np.bincount(lengths, minlength=capacity + 1)
    patterns = packing.pack_histogram(counts, capacity)
    packed = collections.Counter()
    for items, times in patterns:
        assert sum(items) <= capacity and times > 0
        for x in items:
            packed[x] += times
    assert packed == collections.Counter(lengths)
    bins = []
    for x in sorted(lengths, reverse=True):  # first-fit decreasing
        k = next((k for k, used in enumerate(bins) if used + x <= capacity), None)
        if k is None:
            bins.append(x)
        else:
            bins[k] += x
    assert sum(t for _, t in patterns) <= len(bins) + 1


def test_smallest_gives_way_to_a_tighter_pair():
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = 1, 1, 2
    assert packing.build_bin(counts, 10) == [6, 2, 2]  # greedy takes 6 and 3, then 2 and 2 fill the gap of 4


def test_numbering_groups_do_not_change_the_result(documents, monkeypatch):
    rows = [(k, "same words here") for k in range(60)]
    monkeypatch.setattr(packing, "GROUP_ROWS", 7)
    check_packing(rows, packing.pack(documents(rows), 64, **BPE).collect(), 64)


@pytest.mark.parametrize("n", [1, 7, 8, 9, 16, 17])
def test_only_the_first_piece_is_shorter(n):
    parts = packing.cut_ids(np.arange(n), 8)
    assert [len(p) for _, p in parts][1:] == [8] * (len(parts) - 1)
    assert np.concatenate([p for _, p in parts]).tolist() == list(range(n))
