"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import base64
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import ensure_checkpoint_dir, remove_folder

#: Fixed character sets of the query contracts, as regular expressions.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make a session fit for this package's Python stages.

    The package goes to the executors, once an application (as --py-files does).
    Rows here carry whole texts, sets or blocks of vectors, so a session that
    still has Spark's default of 10,000 rows an Arrow batch gets 1,000.
    """
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, "1000")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    import ledgerlens
    package = os.path.dirname(os.path.abspath(ledgerlens.__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="ledgerlens-py-"), "ledgerlens_py")
    archive = shutil.make_archive(out, "zip", os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


_scopes: list[list[str]] = []


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that ``stored`` writes inside, but for those it keeps.

    For a result that is itself stored before the end: what it was made from
    then takes no more room. Scopes may be nested; a driver thread's tables go
    to the scope that was opened last.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove_folder(spark, path)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back.

    This cuts the lineage, is computed once, survives lost executors, and stays
    columnar, so later readers scan only the columns they use. Inside
    ``passing_tables`` it goes when the scope ends, with ``keep`` when the scope
    around that one does.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    owners = _scopes[:-1] if keep else _scopes
    if owners:
        owners[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def smallest_hashes(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """The ``n`` rows of ``df`` with the smallest hashes of ``columns`` (all, if
    there are fewer): a sample that does not depend on partitions or order.

    Rows are thinned out by their hash first, to about 4 * n, so that what
    meets in one place does not grow with the table.
    """
    spread = 1 << 40
    hashed = df.withColumn("the hash", F.xxhash64(*columns))
    total = df.count()
    if total > 4 * n:
        # the smallest of signed hashes: those up to this quantile
        hashed = hashed.where(F.shiftright("the hash", 24) < int(spread * 4 * n / total) - spread // 2)
    return hashed.orderBy("the hash", *columns).limit(n).drop("the hash")


#: Bits of a membership filter at most (16 MB); fuller ones let more through.
FILTER_BITS = 27


class Members:
    """A bounded one-sided membership test of 64-bit values: true for every
    member, and for few others while members are fewer than 2**FILTER_BITS / 16.

    The bits are gathered by one aggregation, at most 2**FILTER_BITS / 64 rows,
    and are broadcast to thin out rows before an exact join or count.
    """

    def __init__(self, values: DataFrame, column: str):
        spark = values.sparkSession
        n = values.count()
        self.log2 = min(FILTER_BITS, max(10, (16 * n).bit_length()))
        at = F.pmod(F.col(column), F.lit(1 << self.log2))
        rows = (values.groupBy(F.shiftright(at, 6).alias("slot"))
                .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({column}, 64) AS int))")).alias("bits")).toArrow())
        words = np.zeros(1 << (self.log2 - 6), np.int64)
        words[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy()
        self._words = spark.sparkContext.broadcast(words)

    def __getstate__(self):
        return {"log2": self.log2, "_words": self._words}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def test(self, values: np.ndarray) -> np.ndarray:
        at = values.astype(np.int64, copy=False) & np.int64((1 << self.log2) - 1)
        return (self._words.value[at >> 6] >> (at & 63)) & 1 == 1


def lower_ascii(col):
    """A-Z to a-z; every other character stays."""
    return F.translate(col, UPPER, LOWER)


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z in an array of UTF-8 bytes."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def id_bucket(id_col, n: int):
    """crc32 of the id's decimal text, modulo ``n``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def held_out(id_col, n: int):
    """Whether an id is in the held-out fold (remainder 0); a null id is."""
    return F.coalesce(id_bucket(id_col, n) == 0, F.lit(True))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Odd multipliers of the 64-bit hashes (splitmix64 constants).
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the byte hash's base and of its inverse, modulo 2**64."""
    if "n" not in _powers or len(_powers["n"]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        base = int(_GOLD)
        inverse = pow(base, -1, 1 << 64)
        for key, b in (("n", base), ("inv", inverse)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["n"], _powers["inv"]


def spaced_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the maximal runs of non-space bytes."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~_SPACE[data]
    step = np.diff(word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


#: Bytes hashed at a time, so that the tables of powers stay small.
_BLOCK = 1 << 20


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the disjoint, ascending byte ranges, from
    prefix sums over blocks of ``data``."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
        part = data[base : ends[j - 1]]
        powers, inverse = _power_table(len(part))
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers[: len(part)], out=prefix[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix64(((prefix[e] - prefix[s]) * inverse[s]) ^ ((e - s).astype(np.uint64) * _GOLD))
        i = j
    return out


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles (or of the whole
    sequence where it is shorter); empty without words."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    width = min(size, n)
    h = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        h = mix64(h * _GOLD + words[k : n - width + 1 + k])
    return np.unique(h)


_encoders: dict[tuple[str, ...], object] = {}


def json_tokenizer(path: str):
    """The tokenizers library's tokenizer of a .json file, one per process."""
    key = ("json", path)
    if key not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        _encoders[key] = Tokenizer.from_file(path)
    return _encoders[key]


class FastEncoder:
    """Ids of a byte-level BPE .json file by way of its vocabulary as ranks.

    Same ids as the .json file's own library (tests/llm compares them over all
    code points and the sample texts) at about a fifth of the time. Special
    strings inside texts become their special ids, as that library's default.
    """

    def __init__(self, ranks_path: str, specials: dict[str, int], pattern: str):
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._e = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials)

    def ids(self, text: str) -> np.ndarray:
        return self._e.encode_to_numpy(text, allowed_special="all")


def fast_encoder(ranks_path: str, specials: tuple[tuple[str, int], ...], pattern: str) -> FastEncoder:
    key = ("ranks", ranks_path, str(specials), pattern)
    if key not in _encoders:
        _encoders[key] = FastEncoder(ranks_path, dict(specials), pattern)
    return _encoders[key]


def public_byte_bpe() -> dict:
    """The public 50k byte-level BPE: paths and pre-tokenisation of its files."""
    import public_tokenizers
    return {"json_path": public_tokenizers.path("byte_bpe_50k.json"),
            "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"),
            "specials": (("<|endoftext|>", 50256),), "pattern": public_tokenizers.PATTERN}


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest reachable node) of ``src, dst`` edges.

    Minimum labels move over the edges and then jump to their label's label,
    so a component needs about log(diameter) rounds. Labels are stored each
    round; a hub's messages are combined before they are shuffled.
    """
    both = stored(edges.where("src <> dst").select("src", "dst")
                  .union(edges.where("src <> dst").select(F.col("dst"), F.col("src"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("src").alias("node"))
                    .agg(F.least(F.min("dst"), F.first("src")).alias("component")), "labels")
    while True:
        heard = (both.join(labels.withColumnRenamed("node", "dst"), "dst")
                 .groupBy(F.col("src").alias("node")).agg(F.min("component").alias("heard")))
        nearer = labels.join(heard, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "heard").alias("near"))
        far = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        new = stored(nearer.join(far, "near", "left")
                     .select("node", "old", F.least("near", F.coalesce("far", "near")).alias("component")), "labels")
        labels = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            return labels
