"""Exact n-gram Jaccard join with a token-group matrix.

Documents link when the Jaccard similarity of their shingle sets reaches the
threshold; the result is each document's component.

1. One scan turns texts into sets of 64-bit shingle hashes and keeps, per
   document, the set's size, digest, min-hashes and its smallest hashes: the
   prefix of which a linked set must share one, and half as many more. How many
   of these a linked document must share at least follows from its size
   (``least_shared``); documents that share fewer have no partner. Equal sets
   become one class.
2. Similar documents form groups: the classes of a min-hash bucket are compared
   with the bucket's smallest document, and those that link join its group.
3. The token-group matrix has an entry for every kept token and every group
   whose token union holds it: the sizes of the members with that token, and
   how many of their tokens, at most, can still match from there on. Two groups
   qualify at a token when that bound reaches the overlap that the smallest
   sizes demand. Only qualifying groups are opened: their members with that
   token meet, pass the same bound themselves, and are verified on whole sets.
4. A column with more than ``CAP`` groups (a passage that many documents share)
   is not opened: in the global order it comes after all others. Documents with
   so many crowded tokens that ``least_shared`` of them could be all that a pair
   has in common go through step 3 once more, with their whole sets in order of
   rising frequency; there every qualifying column is opened, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Members, connected_components, lower_bytes, mix64, passing_tables, ship, shingle_hashes, spaced_words, stored, word_hashes

INTEGERS = ("tinyint", "smallint", "int", "bigint")

#: Groups in a matrix column beyond which it is left to the frequency order.
CAP = 32
#: Min-hashes by which similar documents are brought together.
MIN_HASHES = 4

_SEEDS = (np.arange(1, MIN_HASHES + 3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    data = lower_bytes(np.frombuffer((text or "").encode(), np.uint8))
    return shingle_hashes(word_hashes(data, *spaced_words(data)), size)


def prefix_length(n: int, percent: int) -> int:
    """Tokens of an ``n``-token set one of which any linked set must share."""
    return n - -(-percent * n // 100) + 1 if n else 0


def kept_length(n: int, percent: int) -> int:
    """Tokens that are kept of an ``n``-token set: the prefix and half as many more."""
    p = prefix_length(n, percent)
    return min(n, p + -(-p // 2))


def least_shared(n: int, percent: int) -> int:
    """How many kept tokens of an ``n``-token set any linked set has among its
    own kept ones, at least.

    Below the smaller one of two linked sets' largest kept hashes, both keep all
    their tokens. The set whose largest it is lacks a partner for at most
    prefix_length - 1 of its kept tokens; the sets' sizes differ by the
    threshold at most, and the count grows with the size, so the smallest
    possible partner gives the bound for both.
    """
    m = -(-percent * n // 100)
    return kept_length(m, percent) - prefix_length(m, percent) + 1 if n else 0


def _summaries(docs: DataFrame, id_type: str, size: int, percent: int) -> DataFrame:
    """``id, n, least, d1, d2, keys, kept`` of every row of ``id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, least, d1, d2, keys, kept = [], [], [], [], [], []
            for text in b.column("text"):
                h = shingle_set(text.as_py(), size)
                n.append(len(h))
                least.append(least_shared(len(h), percent))
                with np.errstate(over="ignore"):
                    d1.append(int(mix64(h ^ _SEEDS[-1]).sum(dtype=np.uint64).view(np.int64)))
                    d2.append(int(mix64(h ^ _SEEDS[-2]).sum(dtype=np.uint64).view(np.int64)))
                keys.append([int(mix64(h ^ s).min().view(np.int64)) for s in _SEEDS[:MIN_HASHES]] if len(h) else [])
                kept.append(h[: kept_length(len(h), percent)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *(pa.array(x, pa.int64()) for x in (n, least, d1, d2)),
                 *(pa.array(x, pa.list_(pa.int64())) for x in (keys, kept))], ["id", "n", "least", "d1", "d2", "keys", "kept"])

    return docs.mapInArrow(run, f"id {id_type}, n bigint, least bigint, d1 bigint, d2 bigint, keys array<bigint>, kept array<bigint>")


def _shared_entries(rows: DataFrame, id_type: str) -> DataFrame:
    """``id, n, least, d1, d2, pos, token`` of the kept tokens that several rows keep
    (and, the filter being one-sided, of a few others)."""
    tokens = rows.select(F.explode("kept").alias("token"))
    shared = stored(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df >= 2").select("token"), "shared-tokens")
    members = Members(shared, "token")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = b.column("kept")
            tokens = kept.flatten().to_numpy(zero_copy_only=False)
            size = kept.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
            at = np.flatnonzero(members.test(tokens))
            row = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(row) for c in ("id", "n", "least", "d1", "d2")),
                                              pa.array(pos[at].astype(np.int64)), pa.array(tokens[at])],
                                             ["id", "n", "least", "d1", "d2", "pos", "token"])

    return rows.where("n > 0 AND id IS NOT NULL").select("id", "n", "least", "d1", "d2", "kept").mapInArrow(
        run, f"id {id_type}, n bigint, least bigint, d1 bigint, d2 bigint, pos bigint, token bigint")


def _whole_sets(docs: DataFrame, ids: DataFrame, id_type: str, size: int) -> DataFrame:
    """``id, tokens`` of the rows of ``id, text`` whose id is in ``ids``."""
    members = Members(ids.select(F.xxhash64("id").alias("h")), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = pa.array(members.test(b.column("h").to_numpy(zero_copy_only=False)))
            sets = [shingle_set(text.as_py(), size).view(np.int64) for text in b.column("text").filter(mask)]
            yield pa.RecordBatch.from_arrays([b.column("id").filter(mask), pa.array(sets, pa.list_(pa.int64()))], ["id", "tokens"])

    found = docs.where("id IS NOT NULL").select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(run, f"id {id_type}, tokens array<bigint>")
    return found.join(ids, "id", "left_semi")


def _not_alone(sets: DataFrame, shared: Members, id_type: str, percent: int) -> DataFrame:
    """The rows of ``sets`` that have tokens outside ``shared`` fewer than their prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = (t.values.to_numpy() for t in b.column("tokens"))
            keep = [len(t) - int(shared.test(t).sum()) < prefix_length(len(t), percent) for t in rows]
            yield b.filter(pa.array(keep, pa.bool_()))

    return sets.select("id", "tokens").mapInArrow(run, f"id {id_type}, tokens array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, id_type: str, percent: int) -> DataFrame:
    """The linked ones of the pairs ``x, y``, by their whole sets, as ``src, dst``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("tx"), b.column("ty")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("x").filter(mask), b.column("y").filter(mask)], ["src", "dst"])

    left = sets.select(F.col("id").alias("x"), F.col("tokens").alias("tx"))
    right = sets.select(F.col("id").alias("y"), F.col("tokens").alias("ty"))
    return pairs.join(left, "x").join(right, "y").select("x", "y", "tx", "ty").mapInArrow(run, f"src {id_type}, dst {id_type}")


def _in_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` (with id) with their group g: that of ``groups``, else their own."""
    return rows.join(groups.select(F.col("node").alias("id"), "component"), "id", "left").withColumn(
        "g", F.coalesce("component", "id")).drop("component")


def matrix_candidates(entries: DataFrame, columns: DataFrame, percent: int) -> DataFrame:
    """Pairs ``x < y`` of documents of different groups that qualify at one of
    ``columns``, from ``token, id, g, n, rest`` (rest: how many of the document's
    tokens do not come before this one in the global order)."""

    def needed(n1, n2):  # overlap that sizes n1 and n2 demand
        return F.ceil((n1 + n2) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))

    entries = entries.join(columns, "token", "left_semi")
    matrix = entries.groupBy("token", "g").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rest").alias("rest"))
    a, b = (matrix.select("token", *(F.col(c).alias(f"{c}{k}") for c in ("g", "lo", "hi", "rest"))) for k in (1, 2))
    qualify = (a.join(b, "token").where("g1 < g2")
               .where(F.col("hi1") * 100 >= F.col("lo2") * percent).where(F.col("hi2") * 100 >= F.col("lo1") * percent)
               .where(F.least("rest1", "rest2") >= needed(F.col("lo1"), F.col("lo2")))
               .select("token", "g1", "g2"))
    m1, m2 = (entries.select("token", F.col("g").alias(f"g{k}"), F.col("id").alias(f"id{k}"), F.col("n").alias(f"n{k}"),
                             F.col("rest").alias(f"rest{k}")) for k in (1, 2))
    opened = (qualify.join(m1, ["token", "g1"]).join(m2, ["token", "g2"])
              .where(F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent)
              .where(F.least("rest1", "rest2") >= needed(F.col("n1"), F.col("n2"))))
    return opened.select(F.least("id1", "id2").alias("x"), F.greatest("id1", "id2").alias("y")).distinct()


def _row_key(id_col: str, text_col: str, id_type: str) -> Column:
    """A text that names a row by its id and its text, in the order of ids (of
    their texts, if they are no integers); null for a null id."""
    i = F.col(f"`{id_col}`")
    if id_type in INTEGERS:
        i = F.lpad((i.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(i.cast("string"), F.lit("\0"), F.hex(F.xxhash64(F.coalesce(f"`{text_col}`", F.lit("")))))


def _id_of(key: Column, id_type: str) -> Column:
    """The id in a row's key."""
    i = F.substring_index(key, "\0", 1) if id_type in INTEGERS else F.substring(key, 1, F.length(key) - F.length(F.substring_index(key, "\0", -1)) - 1)
    if id_type in INTEGERS:
        i = i.cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")
    return i.cast(id_type)


def _ids_shared(docs: DataFrame, id_col: str, text_col: str) -> bool:
    """Whether rows with one id have different texts."""
    h = F.xxhash64(F.coalesce(f"`{text_col}`", F.lit("")))
    return not (docs.where(F.col(f"`{id_col}`").isNotNull()).groupBy(f"`{id_col}`").agg(F.min(h).alias("low"), F.max(h).alias("high"))
                .where("low <> high").isEmpty())


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4,
                       percent: int = 85) -> DataFrame:
    """``<id_col>, n_shingles, component_id`` of every row.

    A null, empty or blank text has an empty set, links with nothing and is its
    own component. Rows with a null id link with nothing and have a null
    component. Repeated rows are classes like other copies; of rows that share
    an id but not the text, each is judged by its own text: where there are
    any, rows are joined by a key of id and text, and the component is the
    smallest id among its rows. Other columns of ``docs`` are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    if not _ids_shared(docs, id_col, text_col):
        return _components(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), id_type, id_col, size, percent)
    keyed = docs.select(_row_key(id_col, text_col, id_type).alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = _components(keyed, "string", "id", size, percent)
    return found.select(_id_of(F.col("id"), id_type).alias(id_col), "n_shingles", _id_of(F.col("component_id"), id_type).alias("component_id"))


def _components(texts: DataFrame, id_type: str, id_col: str, size: int, percent: int) -> DataFrame:
    """The components of ``id, text``, an id for each text."""
    spark = texts.sparkSession
    ship(spark)
    rows = stored(_summaries(texts, id_type, size, percent), "sets")
    classes = rows.where("n > 0 AND id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"))
    entries = stored(_shared_entries(rows, id_type).join(classes, ["d1", "d2", "n"]).where("id = rep")
                     .select("id", "n", "least", "pos", "token"), "entries")

    def columns_of(e: DataFrame) -> DataFrame:
        """``token, width``: how many groups have the token, two at least."""
        return e.groupBy("token").agg(F.countDistinct("g").alias("width")).where("width >= 2")

    def can_link(e: DataFrame) -> DataFrame:
        """Ids with enough of their kept tokens in ``e`` to have a partner."""
        return e.groupBy("id", "least").agg(F.count(F.lit(1)).alias("k")).where("k >= least").select("id")

    several = columns_of(entries.withColumn("g", F.col("id"))).select("token")
    active = stored(can_link(entries.join(several, "token", "left_semi")), "active")
    entries = entries.join(active, "id", "left_semi")
    sets = stored(_whole_sets(texts, active, id_type, size), "whole-sets")

    # groups of similar documents
    keyed = rows.join(active, "id", "left_semi").select("id", F.posexplode("keys").alias("k", "key"))
    leaders = keyed.groupBy("k", "key").agg(F.min("id").alias("x"), F.count(F.lit(1)).alias("m")).where("m >= 2")
    near = keyed.join(leaders, ["k", "key"]).where("id <> x").select("x", F.col("id").alias("y")).distinct()
    links = stored(_verified(near, sets, id_type, percent), "links")

    # columns that are narrow enough are opened; documents in many others go on
    groups = connected_components(links)
    grouped = stored(_in_groups(entries, groups), "entries")
    columns = stored(columns_of(grouped), "columns")
    wide = grouped.join(columns.where(F.col("width") > CAP), "token", "left_semi")
    crowded = wide.groupBy("id").agg(F.count(F.lit(1)).alias("late"))
    grouped_rest = (grouped.join(crowded, "id", "left")
                    .withColumn("rest", F.col("n") - F.col("pos") + F.coalesce("late", F.lit(0))))
    pairs = matrix_candidates(grouped_rest, columns.where(F.col("width") <= CAP).select("token"), percent)
    links = links.union(stored(_verified(pairs, sets, id_type, percent), "links"))
    again = stored(can_link(wide), "crowded")
    if not again.isEmpty():
        whole = sets.join(again, "id", "left_semi")
        several = stored(whole.select(F.explode("tokens").alias("token")).groupBy("token")
                         .agg(F.count(F.lit(1)).alias("df")).where("df >= 2"), "frequencies")
        # most drop out here: more of their tokens stand alone than a linked set may lack
        tokens = _not_alone(whole, Members(several, "token"), id_type, percent).select(
            "id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
        # tokens of one document only come first: they fill the places before ``pos``
        ordered = (tokens.join(several, "token").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
                   .withColumn("alone", F.col("n") - F.size("t"))
                   .withColumn("reach", F.expr(f"n - cast(ceil(n * {percent} / 100) AS int) + 1 - alone"))
                   .where("reach > 0")
                   .select("id", "n", "alone", F.posexplode(F.slice("t", F.lit(1), F.col("reach"))).alias("k", "t"))
                   .select("id", "n", (F.col("n") - F.col("k") - F.col("alone")).alias("rest"), F.col("t.token").alias("token")))
        ordered = stored(_in_groups(ordered, groups), "entries")
        pairs = matrix_candidates(ordered, columns_of(ordered).select("token"), percent)
        links = links.union(stored(_verified(pairs, sets, id_type, percent), "links"))
    components = connected_components(links)
    return (rows.join(classes, ["d1", "d2", "n"], "left")
            .join(components.withColumnRenamed("node", "rep"), "rep", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id")))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """``docs`` without near duplicates: of each component the row with the
    smallest id stays. Rows that share an id are judged each by its own text, so
    an unlinked one stays; of rows that share id and text, one stays. Rows with
    empty texts are components of their own; rows without an id all stay.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    key = "row key of " + ",".join(docs.columns)  # clashes with no column
    if _ids_shared(docs, id_col, text_col):
        id_type, named = "string", _row_key(id_col, text_col, id_type)
    else:
        named = F.col(f"`{id_col}`")
    keyed = docs.withColumn(key, named)
    with passing_tables(docs.sparkSession):  # sets, entries and links go before the rows travel
        texts = keyed.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
        found = stored(_components(texts, id_type, "id", size, percent), "components", keep=True)
    first = found.where("id = component_id").groupBy(F.col("id").alias(key)).agg(F.count(F.lit(1)).alias("rows"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    once = keyed.join(first.where("rows = 1").select(f"`{key}`"), key, "left_semi").select(*own)
    more = keyed.join(first.where("rows > 1").select(f"`{key}`"), key, "left_semi")
    picked = more.groupBy(f"`{key}`").agg(F.min_by(F.struct(*own), F.struct(F.xxhash64(f"`{text_col}`"), F.hash(*own))).alias("row")).select("row.*")
    return once.unionByName(picked).unionByName(docs.where(F.col(f"`{id_col}`").isNull()))


def op6_token_group_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents by 4-word shingles at Jaccard 0.85."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
