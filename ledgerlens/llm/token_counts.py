"""Token counts of whole documents, huge ones by overlap resynchronisation.

A document of up to ``chunk_chars`` characters is encoded in one go. A longer
one is cut into chunks that run ``overlap_chars`` into the next one; chunks are
encoded in separate tasks, each with the byte offsets of its pre-token
boundaries. Neighbours are spliced at the first boundary that both see.

Why that is exact: the pre-tokeniser scans from left to right, never looks
back, and looks at most ``LOOKAHEAD`` characters past a boundary; merges stay
inside a pre-token. So a boundary that lies that far before a chunk's end is
final, and where both neighbours have a boundary at one place, everything after
it is the same in both. If a pair of neighbours shares no boundary (one huge
run without spaces, say), its document is encoded again with chunks and
overlaps ``widen`` times as large, until one chunk covers the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import fast_encoder, json_tokenizer, ship, stored

#: Characters past a boundary that can still move it: the longest special
#: string has 13, a contraction 3, a run of spaces 1.
LOOKAHEAD = 16

_PIECE = T.StructType([T.StructField("h", T.LongType()), T.StructField("n_chars", T.LongType()),
                       T.StructField("i", T.IntegerType()), T.StructField("last", T.BooleanType()),
                       T.StructField("piece", T.StringType())])
_ENCODED = T.StructType([T.StructField("h", T.LongType()), T.StructField("n_chars", T.LongType()),
                         T.StructField("i", T.IntegerType()), T.StructField("last", T.BooleanType()),
                         T.StructField("total", T.LongType()),
                         *(T.StructField(f"{end}_{what}", T.ArrayType(T.LongType()))
                           for end in ("head", "tail") for what in ("pos", "cum"))])


def cut(text: str, chunk: int, overlap: int) -> list[str]:
    """Chunks of ``chunk`` characters, each but the last with ``overlap`` more."""
    n = max(1, -(-len(text) // chunk))
    return [text[i * chunk : (i + 1) * chunk + overlap if i + 1 < n else len(text)] for i in range(n)]


def boundaries(tokenizer, widths: np.ndarray, piece: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Byte offsets of the pre-token starts of a chunk, the number of tokens
    before each, and the number of all its tokens."""
    e = tokenizer.encode(piece, add_special_tokens=False)
    ids = np.asarray(e.ids, np.int64)
    if not len(ids):
        return np.zeros(1, np.int64), np.zeros(1, np.int64), 0
    words = np.asarray(e.word_ids, np.int64)
    at = np.concatenate(([0], np.flatnonzero(np.diff(words) != 0) + 1))
    ends = np.concatenate(([0], np.cumsum(widths[ids])))
    return ends[at], at, len(ids)


def token_widths(tokenizer) -> np.ndarray:
    """Bytes of text that each id stands for (a byte-level vocabulary writes
    one character a byte; added tokens stand for their own text)."""
    vocab = tokenizer.get_vocab(with_added_tokens=False)
    widths = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True) + 1, np.int64)
    for token, i in vocab.items():
        widths[i] = len(token)
    for i, added in tokenizer.get_added_tokens_decoder().items():
        widths[i] = len(added.content.encode())
    return widths


def overlap_views(tokenizer, widths, piece: str, last: bool, chunk: int, overlap: int) -> tuple:
    """What a chunk knows of its two overlaps: (tokens, head positions, head
    counts, tail positions, tail counts), positions in bytes from the start of
    that overlap, boundaries that later text could move left out."""
    pos, cum, total = boundaries(tokenizer, widths, piece)
    settled = len(piece.encode()) if last else len(piece[: max(0, len(piece) - LOOKAHEAD)].encode())
    head = (pos <= len(piece[:overlap].encode())) & (pos <= settled)
    start = len(piece[:chunk].encode())
    tail = (pos >= start) & (pos <= settled) if not last else np.zeros(len(pos), bool)
    return total, pos[head], cum[head], pos[tail] - start, cum[tail]


def _chunked_counts(keyed: DataFrame, json_path: str, chunk: int, overlap: int) -> DataFrame:
    """``h, n_chars, n_tokens`` of distinct long texts; n_tokens is null where
    some pair of neighbours shares no settled boundary."""

    def cut_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for h, n, text in zip(b["h"], b["n_chars"], b["text"]):
                pieces = cut(text, chunk, overlap)
                for at in range(0, len(pieces), 64):
                    part = pieces[at : at + 64]
                    yield pd.DataFrame({"h": h, "n_chars": n, "i": np.arange(at, at + len(part), dtype=np.int32),
                                        "last": [at + k + 1 == len(pieces) for k in range(len(part))], "piece": part})

    def encode_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = json_tokenizer(json_path)
        widths = token_widths(tokenizer)
        for b in batches:
            rows = [overlap_views(tokenizer, widths, p, last, chunk, overlap) for p, last in zip(b["piece"], b["last"])]
            out = b[["h", "n_chars", "i", "last"]].copy()
            for k, name in enumerate(("total", "head_pos", "head_cum", "tail_pos", "tail_cum")):
                out[name] = [r[k] for r in rows]
            yield out

    pieces = keyed.mapInPandas(cut_all, _PIECE).repartition("h", "i")
    seen = pieces.mapInPandas(encode_all, _ENCODED)
    # a document's chunks: at most 2 GB of text by chunk_chars, a few small arrays each
    chain = "PARTITION BY h, n_chars ORDER BY i"
    spliced = (seen
               .withColumn("next_head", F.expr(f"lead(head_pos) OVER ({chain})"))
               .withColumn("meet", F.array_min(F.array_intersect("tail_pos", "next_head")))
               .withColumn("came", F.expr(f"lag(meet) OVER ({chain})"))
               .withColumn("upto", F.when(F.col("last"), F.col("total")).otherwise(
                   F.expr("tail_cum[CAST(array_position(tail_pos, meet) AS INT) - 1]")))
               .withColumn("since", F.when(F.col("i") == 0, F.lit(0)).otherwise(
                   F.expr("head_cum[CAST(array_position(head_pos, came) AS INT) - 1]"))))
    return (spliced.groupBy("h", "n_chars")
            .agg(F.sum(F.col("upto") - F.col("since")).alias("sum"),
                 F.bool_and(F.col("upto").isNotNull() & F.col("since").isNotNull()).alias("whole"))
            .select("h", "n_chars", F.when(F.col("whole"), F.col("sum")).alias("n_tokens")))


def token_counts(docs: DataFrame, json_path: str, ranks_path: str | None = None, specials=(), pattern: str = "",
                 id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 32_768,
                 overlap_chars: int = 1_024, widen: int = 4) -> DataFrame:
    """Tokens of every row's whole text: ``<id_col>, n_bytes, n_tokens``.

    One row per input row, repeated rows and null ids included. A null or empty
    text has 0 bytes and 0 tokens. Other columns of ``docs`` are ignored, so
    their names cannot clash. With ``ranks_path`` (the same vocabulary as
    ranks) texts of one chunk are counted by the faster encoder.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = F.char_length("text") > chunk_chars

    def count_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ranks_path:
            fast = fast_encoder(ranks_path, specials, pattern)
            count = lambda text: len(fast.ids(text))
        else:
            tokenizer = json_tokenizer(json_path)
            count = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
        for b in batches:
            n = pa.array((count(t.as_py()) for t in b.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), n], ["id", "n_bytes", "n_tokens"])

    id_type = docs.schema[id_col].dataType.simpleString()
    out = f"id {id_type}, n_bytes bigint, n_tokens bigint"
    short = (rows.where(~long).select("id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
             .mapInArrow(count_short, out))

    # equal long texts are encoded once; 64-bit hash and length name a text
    named = rows.where(long).select("id", "text", F.xxhash64("text").alias("h"),
                                    F.char_length("text").cast("long").alias("n_chars"))
    found, chunk, overlap = None, chunk_chars, overlap_chars
    owners = stored(named.select("id", "h", "n_chars", F.octet_length("text").cast("long").alias("n_bytes")), "long-ids")
    waiting = owners.groupBy("h", "n_chars").agg(F.min("id").alias("id"))
    while not waiting.isEmpty():
        texts = (named.join(waiting, ["h", "n_chars"], "left_semi")
                 .groupBy("h", "n_chars").agg(F.any_value("text").alias("text")))
        part = stored(_chunked_counts(texts, json_path, chunk, overlap), "long-counts")
        good = part.where("n_tokens IS NOT NULL")
        found = good if found is None else found.unionByName(good)
        waiting = part.where("n_tokens IS NULL")
        chunk, overlap = chunk * widen, overlap * widen
    counts = short
    if found is not None:
        counts = counts.unionByName(owners.join(found, ["h", "n_chars"]).select("id", "n_bytes", "n_tokens"))
    return counts.withColumnRenamed("id", id_col)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document by the public 50k byte-level BPE."""
    from ledgerlens.llm.common import public_byte_bpe
    counts = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), **public_byte_bpe())
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
