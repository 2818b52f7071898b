"""Deleted-interpolation bigram language model: training and scoring.

The probability of a token mixes three maximum-likelihood estimates,

    p(w | v) = l2[b] * c(v, w) / c(v) + l1[b] * c(w) / N + l0[b] / (V + 1),

with weights by the bucket b of the context's frequency c(v) (powers of two).
The weights are learned by expectation-maximisation on held-out counts: one
fold of the training documents is deleted from the counts, and its n-grams are
predicted by the estimates from the rest. The final estimates use all training
documents. Every type is modelled with its own counts. Where ``vocabulary`` is
given, it is part of the model: types beyond that many most frequent ones share
one class in the n-grams and share its probability evenly, unseen types
included; their own counts are kept for the additive base score.

How the work is dealt out:

* Unigram counts: combined in each task, then summed by word. The frequent
  words (bounded, a cache) are broadcast; the others' counts stay in shards.
* Pairs of the ``DENSE`` most frequent words, the only ones that can be hot, are
  counted in a fixed matrix per task and summed by row.
* All other pairs and rare words are counted in shards by a hash of their key:
  every task sends a shard one packed, sorted, compressed array per million
  tokens. Shards number in proportion to the corpus, so each stays small.
* Pairs with a word outside the cache are open: they are keyed by a hash of both
  words, in the shard of that word (the context, if both are), where its own
  count is too. So only the following word of a pair of two such words is looked
  up in another place: its count is joined for EM, and meets the pair's by chunk.
* Scoring sends a shard the pairs that a chunk of documents asks for, and gets
  back one partial sum per document; partial sums meet by chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import held_out, id_bucket, lower_bytes, mix64, ship, spaced_words, stored, word_hashes

START, END, RARE, FIRST = 0, 1, 2, 3  # ids of the document's start and end, of the rare class, of the first word
BITS = 24  # of an id in a pair's key
DENSE = 1_024
INDEX_BITS = 20  # of a hash that lead to its place among the frequent words
CHUNK_TOKENS, CHUNK_DOCS = 1_000_000, 20_000
SHARD_TOKENS = 2_000_000
#: Steps per factor of two, to which ratios of estimates are rounded for EM.
GRID = 8

_END_HASH = np.int64(0x656E64)  # an arbitrary constant for the end token's counts


# --- packed arrays ---------------------------------------------------------

def pack(*arrays: np.ndarray) -> bytes:
    """Integer or float arrays, byte plane by byte plane, compressed."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
        body = pa.compress(planes, codec="zstd", asbytes=True) if planes else b""
        out.append(np.array([len(a), a.dtype.itemsize, ord(a.dtype.kind), len(body)], np.int64).tobytes() + body)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, width, kind, size = np.frombuffer(data, np.int64, 4, at)
        at += 32
        dtype = np.dtype(f"{chr(kind)}{width}")
        if n:
            planes = pa.decompress(data[at : at + size], int(n * width), codec="zstd", asbytes=True)
            out.append(np.frombuffer(planes, np.uint8).reshape(width, n).T.copy().view(dtype).ravel())
        else:
            out.append(np.empty(0, dtype))
        at += size
    return out


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and the sum of each value array by key."""
    order = np.argsort(keys)  # sums do not depend on the order of equal keys
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(keys) else v for v in values)


def gaps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=keys.dtype.type(0))


# --- tokens ----------------------------------------------------------------

def text_words(text: str | None) -> np.ndarray:
    data = lower_bytes(np.frombuffer((text or "").encode(), np.uint8))
    return word_hashes(data, *spaced_words(data)).view(np.int64)


@dataclass(frozen=True)
class Vocabulary:
    """Frequent words and totals; ids run from FIRST by falling frequency."""

    words: np.ndarray  # sorted hashes
    ids: np.ndarray  # their ids
    counts: np.ndarray  # training count by id
    deleted: np.ndarray  # count in the deleted fold by id
    tokens: int  # all training tokens, ends included
    types: int  # distinct training tokens, the end included
    class_types: int  # types that share the rare class, one for all unseen
    whole: bool  # no rare class: RARE only says that a word is not among these
    index: np.ndarray | None = None  # first place by the first bits of a hash

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(hashes), RARE, np.int64)
        at = self.places(hashes)
        return np.where(self.words[at] == hashes, self.ids[at], RARE)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where each hash is among the words, if anywhere. Hashes are spread
        evenly, so their first bits lead to within a few places."""
        if self.index is None:
            heads = np.arange(-(1 << INDEX_BITS - 1), 1 << INDEX_BITS - 1) << np.int64(64 - INDEX_BITS)
            object.__setattr__(self, "index", np.searchsorted(self.words, heads))
        at = np.minimum(self.index[(hashes >> np.int64(64 - INDEX_BITS)) + (1 << INDEX_BITS - 1)], len(self.words) - 1)
        left = np.flatnonzero(self.words[at] < hashes)
        while len(left):
            at[left] += 1
            left = left[at[left] < len(self.words)]
            left = left[self.words[at[left]] < hashes[left]]
        return np.minimum(at, len(self.words) - 1)

    def __getstate__(self):
        return self.__dict__ | {"index": None}  # made again where it is used


def chunk_pairs(voc: Vocabulary, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context ids, word ids, document index, word hashes) of every token of a
    chunk; hashes are those of the words, without ends."""
    sizes = np.array([len(d) for d in docs], np.int64)
    hashes = np.concatenate(docs) if docs else np.empty(0, np.int64)
    ends = np.cumsum(sizes + 1) - 1
    w = np.empty(len(hashes) + len(docs), np.int64)
    inner = np.ones(len(w), bool)
    inner[ends] = False
    w[inner], w[ends] = voc.of(hashes), END
    v = np.concatenate(([START], w[:-1])) if len(w) else w
    v[ends[:-1] + 1] = START
    return v, w, np.repeat(np.arange(len(docs)), sizes + 1), hashes


def open_pairs(voc: Vocabulary, v: np.ndarray, w: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the open pairs in a chunk, their contexts, their words): a
    word is its id, or its hash where it has none."""
    if not voc.whole:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero((v == RARE) | (w == RARE))
    words = w.copy()
    words[w == RARE] = hashes[w[w != END] == RARE]
    return at, np.where(v[at] == RARE, words[at - 1], v[at]), words[at]


def open_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit hashes of open pairs."""
    return mix64(mix64(v.view(np.uint64)) + np.uint64(0x9E3779B97F4A7C15) * w.view(np.uint64)).view(np.int64)


def look(table: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key of a sorted table, 0 for others."""
    if not len(table):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return np.where(table[at] == wanted, values[at], 0)


def _chunks(batches: Iterator[pa.RecordBatch], *columns: str):
    """Lists of word arrays, and of the other columns, a chunk at a time."""
    docs, rest, held = [], [[] for _ in columns], 0
    for b in batches:
        for r, text in enumerate(b.column("text")):
            docs.append(text_words(text.as_py()))
            held += len(docs[-1]) + 1
            for k, c in enumerate(columns):
                rest[k].append(b.column(c)[r])
            if held >= CHUNK_TOKENS or len(docs) >= CHUNK_DOCS:
                yield docs, rest
                docs, rest, held = [], [[] for _ in columns], 0
    if docs:
        yield docs, rest


# --- training --------------------------------------------------------------

def count_words(training: DataFrame) -> DataFrame:
    """``word, c, d``: counts in ``text, deleted``, all and in the deleted fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for docs, (deleted,) in _chunks(batches, "deleted"):
            size = np.array([len(x) for x in docs])
            out = np.repeat(np.array([x.as_py() for x in deleted]), size).astype(np.int64)
            words = np.concatenate(docs)
            part = summed(np.append(words, _END_HASH), np.append(np.ones(len(words), np.int64), len(docs)),
                          np.append(out, sum(x.as_py() for x in deleted)))
            total = part if total is None else summed(*(np.concatenate(x) for x in zip(total, part)))
            if len(total[0]) >= CHUNK_TOKENS:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in total], ["word", "c", "d"])
                total = None
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in total], ["word", "c", "d"])

    return (training.mapInArrow(run, "word bigint, c bigint, d bigint").groupBy("word")
            .agg(F.sum("c").alias("c"), F.sum("d").alias("d")))


def choose_vocabulary(counts: DataFrame, size: int, whole: bool = False) -> Vocabulary:
    """The words with at least some count, the smallest for which they are at
    most ``size``; counts over 255 are told apart by their first 8 bits, so
    that the steps are fewer than 8,000 whatever the corpus."""
    end = counts.where(F.col("word") == F.lit(int(_END_HASH))).first()
    words = counts.where(F.col("word") != F.lit(int(_END_HASH)))
    rest = "greatest(length(bin(c)) - 8, 0)"
    steps = sorted(((r["at_least"], r["n"], r["tokens"]) for r in words.groupBy(
        F.expr(f"shiftleft(shiftright(c, {rest}), {rest})").alias("at_least")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("c").alias("tokens")).collect()), reverse=True)
    least, held = None, 0
    for c, n, _ in steps:
        if held + n > size:
            break
        least, held = c, held + n
    docs, deleted_docs = (end["c"], end["d"]) if end else (0, 0)
    taken = words.where(F.col("c") >= least) if least is not None else words.limit(0)
    t = taken.toArrow()  # at most ``size`` rows
    word, c, d = (t.column(k).to_numpy() for k in ("word", "c", "d"))
    order = np.lexsort((word, -c))
    word, c, d = word[order], c[order], d[order]
    types, tokens = sum(n for _, n, _ in steps) + bool(end), sum(t for _, _, t in steps) + docs
    by_word = np.argsort(word)
    rare = words.where(F.col("c") < least) if least is not None else words
    rare_c, rare_d = rare.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("d"), F.lit(0))).first()
    return Vocabulary(word[by_word], (np.arange(len(word)) + FIRST)[by_word],
                      np.concatenate(([docs, docs, rare_c], c)).astype(np.int64),
                      np.concatenate(([deleted_docs, deleted_docs, rare_d], d)).astype(np.int64),
                      int(tokens), int(types), int(types) - len(word) - bool(end) + 1, whole)


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return v << np.int64(BITS) | w


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(keys.view(np.uint64)) % np.uint64(shards)).astype(np.int64)


def by_shard(shard: np.ndarray, *arrays: np.ndarray):
    """(shard, arrays of its entries) of each shard that occurs."""
    small = shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard  # sorted by radix
    order = np.argsort(small, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(shard[part[0]]), [a[part] for a in arrays]


def open_owner(ids: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The word in whose shard an open pair is, by its context's id."""
    return np.where(ids == RARE, v, w)


def by_open_key(v: np.ndarray, w: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted keys of open pairs, their counts, deleted ones, and a place of each."""
    return summed_first(open_keys(v, w), gone)


def summed_first(keys: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, how often each occurs, how often where ``gone``, and a place of each."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    d = np.add.reduceat(gone[order].astype(np.int64), first) if len(keys) else np.empty(0, np.int64)
    return sorted_keys[first], np.diff(np.append(first, len(keys))), d, order[first]


def count_pairs(training: DataFrame, voc, shards: int) -> DataFrame:
    """``r, kind, payload``: packed (keys, counts, deleted counts) by shard; the
    dense pairs of context k in shard -1 - k. Kind 1 are the open pairs, with
    the contexts and words of those that the deleted fold holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = voc.value
        dense = np.zeros((2, DENSE * DENSE), np.int64)
        for docs, (deleted,) in _chunks(batches, "deleted"):
            v, w, doc, hashes = chunk_pairs(vocabulary, docs)
            gone = np.array([x.as_py() for x in deleted], bool)[doc]
            at, ov, ow = open_pairs(vocabulary, v, w, hashes)
            okeys, oc, od, ofirst = by_open_key(ov, ow, gone[at])
            ov, ow = ov[ofirst], ow[ofirst]
            open_rows = [(r, pack(gaps(k), c.astype(np.int32), d.astype(np.int32), a[d > 0], b[d > 0])) for r, (k, c, d, a, b) in
                         by_shard(shard_of(open_owner(v[at][ofirst], ov, ow), shards), okeys, oc, od, ov, ow)]
            v, w, gone = np.delete(v, at), np.delete(w, at), np.delete(gone, at)
            hot = (v < DENSE) & (w < DENSE)
            cell = v[hot] * DENSE + w[hot]
            dense[0] += np.bincount(cell, minlength=DENSE * DENSE)
            dense[1] += np.bincount(cell[gone[hot]], minlength=DENSE * DENSE)
            keys = pair_keys(v[~hot], w[~hot])
            keys, c, d, _ = summed_first(keys, gone[~hot])
            rows = [(r, pack(gaps(k), c.astype(np.int32), d.astype(np.int32)))
                    for r, (k, c, d) in by_shard(shard_of(keys, shards), keys, c, d)]
            yield batch(rows, open_rows)
        rows = []
        for k in np.flatnonzero(dense[0].reshape(DENSE, DENSE).any(1)):
            c, d = dense.reshape(2, DENSE, DENSE)[:, k]
            at = np.flatnonzero(c)
            rows.append((-1 - int(k), pack(gaps(at), c[at], d[at])))
        yield batch(rows, [])

    def batch(rows, open_rows) -> pa.RecordBatch:
        both = rows + open_rows
        return pa.RecordBatch.from_arrays(
            [pa.array([r for r, _ in both], pa.int64()), pa.array([0] * len(rows) + [1] * len(open_rows), pa.int32()),
             pa.array([p for _, p in both], pa.binary())], ["r", "kind", "payload"])

    return training.mapInArrow(run, "r bigint, kind int, payload binary")


def bucket_of(context_counts: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + the whole part of log2."""
    return np.where(context_counts > 0, 1 + np.floor(np.log2(np.maximum(context_counts, 1))), 0).astype(np.int64)


def estimates(voc: Vocabulary, v, w, c, d=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bigram estimate, unigram estimate, context bucket) of pairs with count
    c; with d, their counts in the deleted fold, by the counts of the rest."""
    counts, tokens = voc.counts, voc.tokens
    if d is not None:
        counts, tokens, c = counts - voc.deleted, rest_tokens(voc), c - d
    share = np.where(w == RARE, 1.0 / voc.class_types, 1.0)
    context = counts[v]
    return c / np.maximum(context, 1) * share, counts[w] / max(tokens, 1) * share, bucket_of(context)


def rest_tokens(voc: Vocabulary) -> int:
    """Training tokens outside the deleted fold."""
    return voc.tokens - int(voc.deleted[1:].sum())


def ratio_code(voc: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Ratio to the uniform estimate in steps of 1/GRID of a factor of two."""
    with np.errstate(divide="ignore"):
        step = np.round(GRID * np.log2(p * (voc.types + 1)))
    return np.where(p > 0, 1 + np.clip(step + (1 << 9), 0, (1 << 11) - 3), 0).astype(np.int64)


def events(voc: Vocabulary, v, w, c, d) -> tuple[np.ndarray, np.ndarray]:
    """Held-out pairs as (cell of the EM grid, count): the bucket, and the two
    ratios to the uniform estimate."""
    held = d > 0
    v, w, c, d = v[held], w[held], c[held], d[held]
    p2, p1, bucket = estimates(voc, v, w, c, d)
    return summed((bucket << 24) | (ratio_code(voc, p2) << 12) | ratio_code(voc, p1), d)


def open_events(voc: Vocabulary, keys, c, d, held_v, held_w, words, word_rest):
    """``events`` of a shard's open pairs: cells and counts where both words'
    counts are at hand, and (words, cells without their ratio, counts) of those
    whose following word is in another place. ``word_rest`` are the counts of
    the shard's ``words`` outside the deleted fold."""
    _, first = np.unique(open_keys(held_v, held_w), return_index=True)
    v, w = held_v[first], held_w[first]
    keys_held = open_keys(v, w)
    n, left = look(keys, d, keys_held), look(keys, c - d, keys_held)
    rest = voc.counts - voc.deleted
    id_v, id_w = is_id(voc, v), is_id(voc, w)
    context, word = look(words, word_rest, v), look(words, word_rest, w)
    context[id_v], word[id_w] = rest[v[id_v]], rest[w[id_w]]
    cells = (bucket_of(context) << 24) | (ratio_code(voc, left / np.maximum(context, 1)) << 12)
    far = ~id_v & ~id_w
    near_cells, near_n = summed(cells[~far] | ratio_code(voc, word[~far] / max(rest_tokens(voc), 1)), n[~far])
    return near_cells, near_n, w[far], cells[far], n[far]


def is_id(voc: Vocabulary, words: np.ndarray) -> np.ndarray:
    return (words >= 0) & (words < len(voc.counts))


def grid_ratios(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, bigram ratio, unigram ratio) of EM cells."""
    def ratio(code):
        return np.where(code > 0, 2.0 ** ((code - 1 - (1 << 9)) / GRID), 0.0)
    return cells >> 24, ratio((cells >> 12) & 0xFFF), ratio(cells & 0xFFF)


def learn_weights(cells: np.ndarray, n: np.ndarray, buckets: int = 64, steps: int = 100) -> np.ndarray:
    """EM for the weights (bigram, unigram, uniform) of every bucket. A bucket
    without held-out events takes those of all events together."""
    bucket, p2, p1 = grid_ratios(cells)
    p = np.column_stack([p2, p1, np.ones(len(p1))])

    def em(rows):
        weights = np.array([0.4, 0.5, 0.1])
        for _ in range(steps):
            part = p[rows] * weights
            part *= (n[rows] / part.sum(1))[:, None]
            new = np.maximum(part.sum(0) / n[rows].sum(), 1e-9)
            new /= new.sum()
            if np.abs(new - weights).max() < 1e-7:
                break
            weights = new
        return np.maximum(weights, (0, 0, 1e-6)) / np.maximum(weights, (0, 0, 1e-6)).sum()

    pooled = em(np.arange(len(n))) if len(n) else np.array([0.0, 0.9, 0.1])
    out = np.tile(pooled, (buckets, 1))
    for b in np.unique(bucket):
        out[b] = em(np.flatnonzero(bucket == b))
    out[0] = np.array([0.0, *(pooled[1:] / pooled[1:].sum())])  # nothing follows an unseen context
    return out


@dataclass(frozen=True)
class Model:
    """A trained model: what is broadcast, and the stored shards of the rest."""

    vocabulary: Vocabulary
    weights: np.ndarray
    dense: np.ndarray  # counts of pairs of ids below DENSE
    shards: int
    pairs: DataFrame  # r, payload: packed (key gaps, counts)
    open: DataFrame  # r, payload: packed (open key gaps, counts)
    rare: DataFrame  # r, payload: packed (word hash gaps, counts, deleted counts)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, vocabulary: int | None = None,
          cache: int = 1 << 20) -> Model:
    """Learn from the rows outside the held-out fold (crc32 of the id modulo
    ``folds`` is 0; rows without an id are held out). Fold 1 is the one deleted
    for EM. Null texts are empty documents; repeated rows count each time.
    Every type is modelled, or at most ``vocabulary`` of them and a rare class;
    ``cache`` bounds the words that are broadcast and changes no result."""
    spark = docs.sparkSession
    ship(spark)
    training = (docs.where(~held_out(id_col, folds))
                .select(F.col(text_col).alias("text"), (id_bucket(id_col, folds) == 1).alias("deleted")))
    counts = stored(count_words(training), "word-counts")
    voc = choose_vocabulary(counts, min(cache if vocabulary is None else vocabulary, (1 << BITS) - FIRST), vocabulary is None)
    sent = spark.sparkContext.broadcast(voc)
    shards = max(1, -(-voc.tokens // SHARD_TOKENS))

    def shard_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, c, d = (b.column(k).to_numpy() for k in ("word", "c", "d"))
            rows = []
            for r, (word, c, d) in by_shard(shard_of(word, shards), word, c, d):
                order = np.argsort(word)
                rows.append((r, pack(gaps(word[order]), c[order], d[order])))
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.binary())],
                                             ["r", "payload"])

    rare_words = counts.where(F.col("word") != F.lit(int(_END_HASH)))
    if len(voc.words):
        rare_words = rare_words.where(F.col("c") < int(voc.counts[FIRST:].min()))
    rare = rare_words.select("word", "c", "d").mapInArrow(shard_rare, "r bigint, payload binary")

    def add_up(group: pa.Table, own: pa.Table) -> pa.Table:
        vocabulary = sent.value
        rows = {k: [unpack(p.as_py()) for i, p in zip(group.column("kind"), group.column("payload")) if i.as_py() == k] for k in (0, 1)}
        if not group.num_rows:
            return SUMS.empty_table()
        r, none = group.column("r")[0].as_py(), np.empty(0, np.int64)

        def merged(parts):
            return summed(*(np.concatenate([none, *x]) for x in ([np.cumsum(p[0]) for p in parts], *(
                [p[k].astype(np.int64) for p in parts] for k in (1, 2)))))

        keys, c, d = merged(rows[0])
        v, w = (np.full(len(keys), -1 - r), keys) if r < 0 else (keys >> BITS, keys & ((1 << BITS) - 1))
        cells, n = events(vocabulary, v, w, c, d)
        okeys, oc, od = merged(rows[1])
        words, word_rest = word_table(own.column("payload"), lambda c, d: c - d)
        more, more_n, far_word, far_cell, far_n = open_events(vocabulary, okeys, oc, od, *(
            np.concatenate([none, *(p[k] for p in rows[1])]) for k in (3, 4)), words, word_rest)
        cells, n = summed(np.concatenate([cells, more]), np.concatenate([n, more_n]))
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(
            (r, pack(gaps(keys), c), pack(gaps(okeys), oc), cells, n, far_word, far_cell, far_n), SUMS.types)], schema=SUMS)

    pairs = stored(count_pairs(training, sent, shards).groupBy("r").cogroup(rare.groupBy("r")).applyInArrow(
        add_up, "r bigint, payload binary, open binary, cells array<bigint>, n array<bigint>, "
        "far_word array<bigint>, far_cell array<bigint>, far_n array<bigint>"), "pair-counts")

    def far_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        for b in batches:
            cell, rest, n = (b.column(k).to_numpy() for k in ("cell", "rest", "n"))
            cells, n = summed(cell | ratio_code(vocabulary, rest / max(rest_tokens(vocabulary), 1)), n)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(n, pa.int64())], ["cell", "n"])

    near = pairs.select(F.explode(F.arrays_zip("cells", "n")).alias("e")).select(F.col("e.cells").alias("cell"), F.col("e.n").alias("n"))
    far = (pairs.select(F.explode(F.arrays_zip("far_word", "far_cell", "far_n")).alias("e"))
           .select(F.col("e.far_word").alias("word"), F.col("e.far_cell").alias("cell"), F.col("e.far_n").alias("n"))
           .join(rare_words.select("word", (F.col("c") - F.col("d")).alias("rest")), "word")
           .select("cell", "rest", "n").mapInArrow(far_cells, "cell bigint, n bigint"))
    # EM cells: at most buckets x ratio steps x ratio steps, whatever the corpus
    grid = (near.unionByName(far) if voc.whole else near).groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toArrow()
    weights = learn_weights(grid.column("cell").to_numpy(), grid.column("n").to_numpy().astype(np.float64))
    dense = np.zeros((DENSE, DENSE), np.int64)
    for row in pairs.where("r < 0").select("r", "payload").collect():  # at most DENSE rows
        at, c = unpack(row["payload"])
        dense[-1 - row["r"], np.cumsum(at)] = c

    held = pairs.where("r >= 0")
    return Model(voc, weights, dense, shards, held.select("r", "payload"), held.select("r", F.col("open").alias("payload")), rare)


#: What one shard's pairs add up to.
SUMS = pa.schema([("r", pa.int64()), ("payload", pa.binary()), ("open", pa.binary()), *(
    (k, pa.list_(pa.int64())) for k in ("cells", "n", "far_word", "far_cell", "far_n"))])


def word_table(payloads, value=lambda c, d: c) -> tuple[np.ndarray, np.ndarray]:
    """Sorted words of a shard's ``rare`` payloads, and a value of their counts."""
    parts = [unpack(p.as_py()) for p in payloads]
    none = np.empty(0, np.int64)
    return summed(np.concatenate([none, *(np.cumsum(p[0]) for p in parts)]), np.concatenate([none, *(value(p[1], p[2]) for p in parts)]))


# --- scoring ---------------------------------------------------------------

def asked_once(v: np.ndarray, w: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """(context, word, document, times) of each open pair and document."""
    keys = open_keys(v, w)
    order = np.lexsort((doc, keys))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(keys[order]) != 0) | (np.diff(doc[order]) != 0)
    first = np.flatnonzero(new)
    return v[order[first]], w[order[first]], doc[order[first]], np.diff(np.append(first, len(order)))


def log_mixture(voc: Vocabulary, weights: np.ndarray, v, w, c) -> np.ndarray:
    """log10 p(w | v) of pairs with count c."""
    return log_mixed(voc, weights, *estimates(voc, v, w, c))


def log_mixed(voc: Vocabulary, weights: np.ndarray, p2, p1, bucket) -> np.ndarray:
    m = weights[bucket]
    return np.log10(m[:, 0] * p2 + m[:, 1] * p1 + m[:, 2] / (voc.types + 1))


def log_open(voc: Vocabulary, weights: np.ndarray, context, word, c) -> np.ndarray:
    """log10 p(w | v) of open pairs with count c, by the counts of both words."""
    return log_mixed(voc, weights, c / np.maximum(context, 1), word / max(voc.tokens, 1), bucket_of(context))


def log_base(voc: Vocabulary, c) -> np.ndarray:
    """log10 of the additive base probability of tokens with count c."""
    return np.log10((c + 0.1) / (voc.tokens + 0.1 * (voc.types + 1)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_tokens, n_known, base_score, score`` of every row's whole text.

    A null or empty text has the end token only. Rows are scored each, repeated
    ones and those without an id too; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = spark.sparkContext.broadcast((model.vocabulary, model.weights, model.dense))
    shards = model.shards
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per chunk: its own row (what the broadcast part answers, in shard
        chunk mod shards) and a row of questions for every shard."""
        voc, weights, dense = sent.value
        task = TaskContext.get().partitionId()
        for k, (docs, (ids,)) in enumerate(_chunks(batches, "id")):
            v, w, doc, hashes = chunk_pairs(voc, docs)
            known, n = w != RARE, len(docs)
            base = np.bincount(doc[known], log_base(voc, voc.counts[w[known]]), n)
            own_known = np.bincount(doc[known & (w != END)], minlength=n) + (voc.counts[END] > 0)
            sizes, rare, rare_doc = np.bincount(doc, minlength=n), hashes[w[w != END] == RARE], doc[w == RARE]
            at, ov, ow = open_pairs(voc, v, w, hashes)
            ov, ow, odoc, otimes = asked_once(ov, ow, doc[at])
            far = ~is_id(voc, ov) & ~is_id(voc, ow)
            fv, fw, fdoc, ftimes = ov[far], ow[far], odoc[far], otimes[far]
            place = np.arange(len(fv))
            ov, ow, odoc, otimes = ov[~far], ow[~far], odoc[~far], otimes[~far]
            v, w, doc = np.delete(v, at), np.delete(w, at), np.delete(doc, at)
            hot = (v < DENSE) & (w < DENSE)
            total = np.bincount(doc[hot], log_mixture(voc, weights, v[hot], w[hot], dense[v[hot], w[hot]]), n)
            keys = pair_keys(v[~hot], w[~hot])
            # one question for each pair and document
            order = np.lexsort((doc[~hot], keys))
            keys, asker = keys[order], doc[~hot][order]
            first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (asker[1:] != asker[:-1])))) if len(keys) else order
            times = np.diff(np.append(first, len(keys)))
            keys, asker = keys[first], asker[first]
            order = np.argsort(rare, kind="stable")
            rare, rare_doc = rare[order], rare_doc[order]
            chunk = task << 32 | k
            kinds = ((keys, keys, asker, times), (rare, rare, rare_doc), (open_owner(np.where(is_id(voc, ov), START, RARE), ov, ow), ov, ow, odoc, otimes),
                     (fv, fv, fw, place), (fw, fw, place))
            asked = [dict(by_shard(shard_of(owner, shards), *arrays)) for owner, *arrays in kinds]
            rows = []
            for r in sorted(set().union(*asked)):
                (q, q_doc, q_times), (u, u_doc), single, double, follow = (
                    part.get(r) or [a[:0] for a in arrays] for part, (_, *arrays) in zip(asked, kinds))
                rows.append((r, pack(gaps(q), q_doc.astype(np.int32), q_times.astype(np.int32), gaps(u), u_doc.astype(np.int32),
                                     *single[:2], *(x.astype(np.int32) for x in single[2:]), *double[:2], double[2].astype(np.int32),
                                     follow[0], follow[1].astype(np.int32))))
            own = pack(sizes, own_known, base, total, fdoc, ftimes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * (len(rows) + 1), pa.int64()), pa.array([chunk % shards, *(r for r, _ in rows)], pa.int64()),
                 pa.array([[i.as_py() for i in ids], *[None] * len(rows)], pa.list_(b_type)),
                 pa.array([n] * (len(rows) + 1), pa.int64()), pa.array([own, *(p for _, p in rows)], pa.binary())],
                ["chunk", "r", "ids", "n", "payload"])

    b_type = pa.string() if id_type == "string" else pa.int32() if id_type == "int" else pa.int64()
    columns = f"chunk bigint, r bigint, ids array<{id_type}>, n bigint, payload binary"
    questions = texts.mapInArrow(ask, columns)

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        voc, weights, _ = sent.value
        keys = counts = okeys = ocounts = np.empty(0, np.int64)
        rare_parts = []
        for kind, payload in zip(known.column("kind"), known.column("payload")):
            if kind.as_py() == 1:
                rare_parts.append(payload)
                continue
            gap, c = unpack(payload.as_py())
            if kind.as_py() == 0:
                keys, counts = np.cumsum(gap), c
            else:
                okeys, ocounts = np.cumsum(gap), c
        words, word_counts = word_table(rare_parts)

        def count_of(w):
            """Counts of words that are in the cache or in this shard."""
            ids = is_id(voc, w)
            c = look(words, word_counts, w)
            c[ids] = voc.counts[w[ids]]
            return c

        out = {c: [] for c in ("chunk", "ids", "payload")}
        for chunk, ids, n, payload in zip(*(asked.column(c) for c in ("chunk", "ids", "n", "payload"))):
            out["chunk"].append(chunk.as_py())
            out["ids"].append(ids.as_py())
            if ids.is_valid:
                out["payload"].append(payload.as_py())
                continue
            gap, asker, times, rare_gap, rare_doc, ov, ow, odoc, otimes, fv, fw, place, follow, follow_place = unpack(payload.as_py())
            pair, n = np.cumsum(gap), n.as_py()
            v, w = pair >> BITS, pair & ((1 << BITS) - 1)
            total = np.bincount(asker, times * log_mixture(voc, weights, v, w, look(keys, counts, pair)), n)
            total = total + np.bincount(odoc, otimes * log_open(voc, weights, count_of(ov), count_of(ow), look(okeys, ocounts, open_keys(ov, ow))), n)
            c = look(words, word_counts, np.cumsum(rare_gap))
            out["payload"].append(pack(np.zeros(n, np.int64), np.bincount(rare_doc[c > 0], minlength=n),
                                       np.bincount(rare_doc, log_base(voc, c), n), total, place, count_of(fv), look(okeys, ocounts, open_keys(fv, fw)),
                                       follow_place, count_of(follow)))
        return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "ids": pa.array(out["ids"], pa.list_(b_type)),
                         "payload": pa.array(out["payload"], pa.binary())})

    tables = (model.pairs.select("r", F.lit(0).alias("kind"), "payload")
              .unionByName(model.rare.select("r", F.lit(1).alias("kind"), "payload"))
              .unionByName(model.open.select("r", F.lit(2).alias("kind"), "payload")))
    parts = questions.groupBy("r").cogroup(tables.groupBy("r")).applyInArrow(
        answer, f"chunk bigint, ids array<{id_type}>, payload binary")

    def put_together(group: pa.Table) -> pa.Table:
        voc, weights, _ = sent.value
        ids, sums, far, found = None, None, None, []
        for i, payload in zip(group.column("ids"), group.column("payload")):
            part, rest = (x := unpack(payload.as_py()))[:4], x[4:]
            if i.is_valid:
                ids, far = i.as_py(), rest
            else:
                found.append(rest)
            sums = part if sums is None else [a + b for a, b in zip(sums, part)]
        doc, times = far
        context, c, word = np.zeros((3, len(doc)), np.int64)
        for place, v, pair, follow, w in found:
            context[place], c[place], word[follow] = v, pair, w
        sums[3] = sums[3] + np.bincount(doc, times * log_open(voc, weights, context, word, c), len(ids))
        return pa.table([pa.array(ids, b_type), *(pa.array(s.astype(t)) for s, t in zip(sums, ("i8", "i8", "f8", "f8")))],
                        names=["id", "n_tokens", "n_known", "base_score", "score"])

    whole = parts.groupBy("chunk").applyInArrow(
        put_together, f"id {id_type}, n_tokens bigint, n_known bigint, base_score double, score double")
    return whole.withColumnRenamed("id", id_col)


def op1_deleted_interpolation(spark, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, learnt outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs)
    return score(docs, model).select(
        "doc_id", held_out("doc_id", 10).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")
