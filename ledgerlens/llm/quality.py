"""Quality scores from Bradley-Terry preference pairs.

Every text gets a feature vector (shares of character kinds, repetition, word
shape). Training pairs a better document (label 1) with a worse one (label 0)
and fits the Bradley-Terry model: the log odds that the first is preferred are
the difference of the documents' linear scores, so the logistic loss is taken
on feature differences and needs no intercept. The cut is a quantile of
the scores of all labelled training rows (``PairwiseRanker.quantile`` is the
share of them below it), the one with the fewest of them on the wrong side, and ``score`` is the chance of beating a
document at that cut, shifted so that the cut itself scores ``threshold``.

The weights are fitted on a bounded sample of labelled rows (``max_per_label``,
the ones with the smallest hashes); the cut is read off a histogram of the
scores of all labelled training rows; scoring is one distributed pass over all
texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import held_out, ship, smallest_hashes, spaced_words, word_hashes

_KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9), "line": (10, 13),
          "stop": b".", "comma": b",", "bang": b"!", "pipe": b"|", "sharp": b"#", "dollar": b"$", "percent": b"%",
          "ampersand": b"&", "star": b"*", "quote": b"'\"`", "bracket": b"()[]{}<>", "sign": b"+=~^_\\/@;:?-",
          "high": range(128, 256), "control": [*range(9), 11, 12, *range(14, 32), 127]}
_KIND_OF = np.zeros(256, np.int64)
for _k, _chars in enumerate(_KINDS.values()):
    _KIND_OF[list(_chars)] = _k

FEATURES = (*(f"share_{k}" for k in _KINDS), *(f"root_{k}" for k in _KINDS), "capital_words", "root_capital_words",
            "marked_words", "root_marked_words", "repeats", "root_repeats", "distinct", "word_bytes", "log_words", "empty")

#: Steps of the score, over the fitting rows' range, between which cuts are told apart.
BINS = 1 << 16


def features(data: np.ndarray) -> np.ndarray:
    """Feature vector of one whole text, given as UTF-8 bytes."""
    out = np.zeros(len(FEATURES))
    starts, ends = spaced_words(data)
    if not len(starts):
        out[-1] = 1.0
        return out
    n, k = len(starts), len(_KINDS)
    shares = np.bincount(_KIND_OF[data], minlength=k) / len(data)
    hashes = word_hashes(data, starts, ends)
    second = data[np.minimum(starts + 1, ends - 1)]
    last = data[ends - 1]
    capital = np.mean((second >= 65) & (second <= 90))
    marked = np.mean(np.isin(last, np.frombuffer(b"!#$%&*|~^", np.uint8)))
    repeats = np.mean(hashes[1:] == hashes[:-1]) if n > 1 else 0.0
    out[:k], out[k : 2 * k] = shares, np.sqrt(shares)
    out[2 * k :] = (capital, capital**0.5, marked, marked**0.5, repeats, repeats**0.5, len(np.unique(hashes)) / n,
                    min(np.mean(ends - starts), 50.0) / 10, np.log1p(n) / 10, 0.0)
    return out


def with_features(rows: DataFrame, id_type: str) -> DataFrame:
    """``id, f`` of ``id, text``: the features of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(np.frombuffer((t.as_py() or "").encode(), np.uint8)) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(f, pa.list_(pa.float64()))], ["id", "f"])

    ship(rows.sparkSession)
    return rows.mapInArrow(run, f"id {id_type}, f array<double>")


@dataclass(frozen=True)
class PairwiseRanker:
    """Bradley-Terry weights over standardised features, and the score of the cut."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    threshold: float
    quantile: float = 0.0  # the share of the training scores below the cut

    def raw(self, f: np.ndarray) -> np.ndarray:
        return ((f - self.mean) / self.scale) @ self.weights

    def score(self, f: np.ndarray) -> np.ndarray:
        """Chance of beating the cut, so shifted that the cut scores ``threshold``."""
        z = self.raw(f) - self.cut + np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_pairs(better: np.ndarray, worse: np.ndarray, pairs_per_row: int = 8, l2: float = 1e-3, steps: int = 30,
              quantile: float | None = None, threshold: float = 0.3, seed: int = 7) -> PairwiseRanker:
    """Fit on the feature rows of better and worse documents.

    Each row of the larger side meets ``pairs_per_row`` random rows of the
    other. The loss is the mean logistic loss of the pairs plus an L2 term,
    minimised by Newton steps. ``quantile`` of the training scores is the cut;
    None takes the one with the fewest training rows on the wrong side.
    Without rows of both labels nothing is preferred: all scores are 0.5.
    """
    both = np.vstack([better, worse])
    if not len(better) or not len(worse):
        k = len(FEATURES)
        return PairwiseRanker(np.zeros(k), np.ones(k), np.zeros(k), float(np.log(threshold / (1 - threshold))), threshold)
    mean, scale = both.mean(0), both.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    good, bad = (better - mean) / scale, (worse - mean) / scale
    rng = np.random.default_rng(seed)
    larger = max(len(good), len(bad))
    first = np.tile(np.arange(len(good)), pairs_per_row * -(-larger // len(good)))[: larger * pairs_per_row]
    second = np.tile(np.arange(len(bad)), pairs_per_row * -(-larger // len(bad)))[: larger * pairs_per_row]
    diff = good[first] - bad[rng.permutation(second)]
    w = np.zeros(both.shape[1])

    def loss(w):
        return np.mean(np.logaddexp(0, -(diff @ w))) + l2 / 2 * w @ w

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))
        grad = -(diff * p[:, None]).mean(0) + l2 * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + (l2 + 1e-9) * np.eye(len(w))
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-9:
            break
    scores = np.concatenate([good @ w, bad @ w])
    if quantile is None:
        grid = np.linspace(0, 1, 1001)
        cuts = np.quantile(scores, grid)
        errors = len(bad) - np.searchsorted(np.sort(bad @ w), cuts) + np.searchsorted(np.sort(good @ w), cuts)
        # the middle of the best quantiles
        best = np.flatnonzero(errors == errors.min())
        quantile = float(grid[best[len(best) // 2]])
    return PairwiseRanker(mean, scale, w, float(np.quantile(scores, quantile)), threshold, quantile)


def score_counts(rows: DataFrame, known: DataFrame, ranker: PairwiseRanker, low: float, high: float) -> np.ndarray:
    """(quality x score bin) counts of the rows of ``id, text`` with a known
    ``id, quality``: bin k > 0 holds the scores from the k-th of ``BINS`` edges
    on, which run from ``low`` to ``high``; bin 0 holds what is below them."""
    edges = np.linspace(low, high, BINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                f = np.vstack([features(np.frombuffer((t.as_py() or "").encode(), np.uint8)) for t in b.column("text")])
                # row by row, so that a row's bin does not depend on its batch
                z = ((f - ranker.mean) / ranker.scale * ranker.weights).sum(1)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.searchsorted(edges, z, "right"))], ["id", "bin"])

    id_type = rows.schema["id"].dataType.simpleString()
    counts = np.zeros((2, BINS + 1), np.int64)
    for r in (rows.mapInArrow(run, f"id {id_type}, bin bigint").join(known, "id").groupBy("quality", "bin")
              .agg(F.count(F.lit(1)).alias("n")).collect()):  # at most 2 * (BINS + 1) rows
        counts[r["quality"], r["bin"]] = r["n"]
    return counts


def cut_of(counts: np.ndarray, low: float, high: float, quantile: float | None = None) -> tuple[float, float]:
    """The cut and its quantile, the share of the counted rows below it: the
    first edge with a share of ``quantile`` below it, or without one the edge
    with the fewest rows on the wrong side (the middle one of the best)."""
    edges = np.linspace(low, high, BINS)
    below = np.cumsum(counts, 1)[:, :-1]
    if quantile is not None:
        at = min(np.searchsorted(below.sum(0), quantile * counts.sum()), BINS - 1)
    else:
        errors = counts[0].sum() - below[0] + below[1]
        best = np.flatnonzero(errors == errors.min())
        at = best[len(best) // 2]
    return float(edges[at]), float(below[:, at].sum() / counts.sum())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5,
          max_per_label: int = 10_000, **fit) -> PairwiseRanker:
    """Learn from the labelled rows outside the held-out fold (crc32 of the id
    modulo ``folds`` is 0): the weights from at most ``max_per_label`` ids of each
    label, the cut from all rows.

    An id with labels of both kinds counts as good. Of documents that share a
    sampled id, the one with the smallest features stands for it; the cut
    counts them all. Labels of another kind than 0 and 1 and null ids are left out.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    known = (labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("quality"))
             .where("quality IN (0, 1) AND id IS NOT NULL").where(~held_out("id", folds))
             .groupBy("id").agg(F.max("quality").alias("quality")))
    taken = reduce(DataFrame.unionByName, (smallest_hashes(known.where(F.col("quality") == q), max_per_label, "id") for q in (1, 0)))
    every = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = every.join(F.broadcast(taken.select("id")), "id", "left_semi")
    # one feature row of each sampled id, so at most 2 * max_per_label, however often an id repeats
    one_each = with_features(texts, id_type).groupBy("id").agg(F.min("f").alias("f"))
    rows = one_each.join(F.broadcast(taken), "id").orderBy("id").toPandas()
    side = {q: np.vstack([np.zeros((0, len(FEATURES))), *(r[None] for r in map(np.asarray, rows.loc[rows["quality"] == q, "f"]))])
            for q in (0, 1)}
    ranker = fit_pairs(side[1], side[0], **fit)
    if not len(side[0]) or not len(side[1]):
        return ranker
    scores = ranker.raw(np.vstack([side[1], side[0]]))
    low, high = float(scores.min()), float(scores.max())
    counts = score_counts(every.where("id IS NOT NULL").where(~held_out("id", folds)), known, ranker, low, high)
    cut, share = cut_of(counts, low, high, fit.get("quantile"))
    return replace(ranker, cut=cut, quantile=share)


def quality_scores(docs: DataFrame, ranker: PairwiseRanker, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
                   score_col: str = "score") -> DataFrame:
    """The ``keep`` columns and ``score_col`` of every row.

    Null and empty texts share one feature vector, so all get the same score.
    Repeated rows are scored each; no other column reaches the score. A kept
    column may have any name but ``score_col``.
    """
    ship(docs.sparkSession)
    kept = [f for c in keep for f in docs.schema.fields if f.name == c]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{score_col}` double"])
    names = [*(f.name for f in kept), score_col]
    at = next((k for k, f in enumerate(kept) if f.name == text_col), len(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                f = np.vstack([features(np.frombuffer((t.as_py() or "").encode(), np.uint8)) for t in b.column(at)])
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(ranker.score(f))], names)

    columns = [F.col(f"`{f.name}`") for f in kept] + ([F.col(f"`{text_col}`").alias("text to score")] if at == len(kept) else [])
    return docs.select(*columns).mapInArrow(run, schema)


def keep_good(docs: DataFrame, ranker: PairwiseRanker, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score the threshold or more, all columns."""
    score = "quality score of " + ",".join(docs.columns)  # clashes with no column
    scored = quality_scores(docs, ranker, text_col, tuple(docs.columns), score)
    return scored.where(F.col(f"`{score}`") >= ranker.threshold).select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_bradley_terry(spark, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ranker = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_scores(docs, ranker).select(
        "doc_id", held_out("doc_id", 5).alias("held_out"), "score", (F.col("score") >= ranker.threshold).cast("int").alias("predicted"))
