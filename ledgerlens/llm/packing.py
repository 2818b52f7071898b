"""Best-two-fit packing of token pieces into fixed-length sequences.

Pieces of one length are interchangeable, so the packing is decided on the
histogram of lengths (at most ``capacity`` numbers, whatever the corpus) and
then dealt out to the pieces:

1. Tokenise, cut documents longer than a sequence, store one row per piece.
2. Count pieces by length. Build bins on the counts: fill greedily with the
   largest length that fits; then, while it helps, take out the bin's smallest
   document and put in the two unpacked ones whose sum fits the gap so opened
   most tightly. A bin is repeated while the lengths in it last, which is what
   packing one bin at a time would do, so few distinct patterns arise.
3. Number the pieces of each length (in salted groups of bounded size, whose
   starts come from a small prefix sum) and look up their slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import fast_encoder, json_tokenizer, ship, stored

#: Rows that one numbering group holds on average.
GROUP_ROWS = 50_000


def cut_ids(ids: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(start, ids) of a document's pieces: only the first may be shorter."""
    first = len(ids) % capacity or min(len(ids), capacity)
    starts = [0, *range(first, len(ids), capacity)]
    return [(s, ids[s : first if s == 0 else s + capacity]) for s in starts]


def best_pair(counts: np.ndarray, room: int, above: int) -> tuple[int, int] | None:
    """Two available lengths with the largest sum in (above, room], if any."""
    top = np.flatnonzero(counts[: room])  # a partner needs at least 1
    top = top[top > 0]
    if not len(top):
        return None
    # largest available length <= x, for every x
    below = np.zeros(room + 1, np.int64)
    below[top] = top
    below = np.maximum.accumulate(below)
    partner = below[room - top]
    same = (partner == top) & (counts[top] < 2)
    if same.any():
        partner = np.where(same, below[np.maximum(top - 1, 0)], partner)
    total = np.where(partner > 0, top + partner, 0)
    k = int(np.argmax(total))
    return (int(top[k]), int(partner[k])) if total[k] > above else None


def build_bin(counts: np.ndarray, capacity: int) -> list[int]:
    """Lengths of the next bin, largest first; ``counts`` by length is left as it was."""
    counts = counts.copy()
    gap, items = capacity, []

    def take(length: int) -> None:
        nonlocal gap
        counts[length] -= 1
        gap -= length
        items.append(length)

    while gap > 0:
        fits = np.flatnonzero(counts[1 : gap + 1])
        if not len(fits):
            break
        take(int(fits[-1]) + 1)
    while gap > 0 and len(items) > 1:
        smallest = items[-1]
        pair = best_pair(counts, gap + smallest, smallest)
        if pair is None:
            break
        items.pop()
        counts[smallest] += 1
        gap += smallest
        for length in pair:
            take(length)
        items.sort(reverse=True)
    return items


def pack_histogram(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, how many such bins), covering all of ``counts``."""
    counts = counts.astype(np.int64).copy()
    patterns = []
    while counts.any():
        items = build_bin(counts, capacity)
        lengths, uses = np.unique(items, return_counts=True)
        times = int((counts[lengths] // uses).min())
        counts[lengths] -= uses * times
        patterns.append((items, times))
    return patterns


def slots_of(patterns: list[tuple[list[int], int]], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank:
    the pieces of a length from that rank on go to consecutive sequences."""
    used, base, rows = np.zeros(capacity + 1, np.int64), 0, []
    for items, times in patterns:
        offset = 0
        for length in items:
            rows.append((length, used[length], base, offset))
            used[length] += times
            offset += length
        base += times
    out = np.array(rows, np.int64).reshape(-1, 4)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def token_pieces(docs: DataFrame, capacity: int, json_path: str, ranks_path: str | None = None, specials=(),
                 pattern: str = "", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
                 with_ids: bool = False) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` (and ``ids``) of every row's
    token ids, ``end_id`` at the end. Null text: empty, so just ``end_id``."""
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32
        if ranks_path:
            encode = fast_encoder(ranks_path, specials, pattern).ids
        else:
            tokenizer = json_tokenizer(json_path)
            encode = lambda t: np.asarray(tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
        for b in batches:
            row, out = [], []
            for r, text in enumerate(b.column("text")):
                ids = np.append(encode(text.as_py()), end_id).astype("<u4")
                for k, (start, part) in enumerate(cut_ids(ids, capacity)):
                    row.append(r)
                    out.append((k, start, len(part), crc32(part.tobytes()), part if with_ids else None))
            cols = list(zip(*out)) if out else [()] * 5
            arrays = [b.column("id").take(pa.array(row, pa.int64())), pa.array(cols[0], pa.int32()),
                      *(pa.array(c, pa.int64()) for c in cols[1:4])]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int64) for x in cols[4]], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .mapInArrow(pieces, schema + (", ids array<bigint>" if with_ids else "")))


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (stored rows with id, piece, length, ids_crc32) with
    ``sequence_id`` and ``offset``. Every row is packed, repeated rows each."""
    spark = pieces.sparkSession
    # at most ``capacity`` rows reach the driver
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    slots = slots_of(pack_histogram(counts, capacity), capacity)
    groups = spark.createDataFrame([(int(k), int(-(-counts[k] // GROUP_ROWS))) for k in np.flatnonzero(counts)],
                                   "length bigint, n_groups bigint")
    salted = pieces.join(F.broadcast(groups), "length").withColumn(
        "salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), "n_groups"))
    starts = (salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("first", F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n"))
              .select("length", "salt", "first"))
    ranked = (salted.withColumn("k", F.row_number().over(
                  W.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")) - 1)
              .join(starts, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("k")))
    key = slots[:, 0] << np.int64(48) | slots[:, 1]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, length << np.int64(48) | rank, "right") - 1
            sequence = slots[at, 2] + rank - slots[at, 1]
            kept = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence), pa.array(slots[at, 3])],
                                             [*kept, "sequence_id", "offset"])

    own = pieces.schema.fields
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), "sequence_id bigint", "offset bigint"])
    return ranked.select(*(f.name for f in own), "rank").mapInArrow(deal, schema)


def pack(docs: DataFrame, capacity: int = 1024, id_col: str = "doc_id", **tokenizer) -> DataFrame:
    """``<id_col>, piece, start, length, ids_crc32, sequence_id, offset`` of
    every piece of every row. Columns of ``docs`` other than the id and the
    text are ignored; null ids and repeated rows are packed like any other."""
    pieces = stored(token_pieces(docs, capacity, id_col=id_col, **tokenizer), "pieces")
    return pack_pieces(pieces, capacity).withColumnRenamed("id", id_col)


def op9_best_two_fit(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    from ledgerlens.llm.common import public_byte_bpe
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), 1024, **public_byte_bpe())
