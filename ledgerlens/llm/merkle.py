"""Merkle manifest of a dataset, leaf coordinates by rank in bitmaps.

Leaves stand in trees, one a group (a language), by ascending id. No sort finds
a leaf's place:

* Ids become bits. The 64 ids of a word are one long, OR-ed together by an
  aggregation with map-side combine; only words with a bit are kept (a
  compressed bitmap), each with what follows from its popcount.
* A directory of popcounts has four levels of 16 id bits each, so a prefix sum
  never orders more than 65,536 entries. A rank query is the directory's count
  before a word plus the popcount of the lower bits in it.
* Leaves go to slot arrays of 2**LEVELS places, keyed by (group, upper bits of the
  place), and drop into their slot. One array is reduced over LEVELS levels at
  once; the arrays' tops fill the next round's arrays.
* On the way down, an array's path to the root (its upper siblings) is worked out
  once and joined with the arrays below it.

Repeated ids count as often as they occur, in the order of their leaves (rows
with equal leaves are interchangeable); null ids come first.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import ship, stored

#: Levels that one slot array reduces; it has 2**LEVELS places.
LEVELS = 8
#: The part of the id space before all ids, where null ids go.
NULL_PART = -32769
#: Different leaves of one id that one window orders, about.
TIED = 2_000

ALONE, RIGHT, LEFT = b"\0", b"\1", b"\2"  # where a node's sibling is


def field(c: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, ``:`` and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*columns: Column) -> Column:
    """The digest (32 bytes) of the fields."""
    return F.unhex(F.sha2(F.concat(*(field(c) for c in columns)), 256))


# --- places ---------------------------------------------------------------------------------------------------------

def _parts(id_col: str) -> dict[str, Column]:
    """The directory's keys of an id: its upper 16, 32 and 48 bits, word and bit."""
    i, null = F.col(id_col), F.col(id_col).isNull()
    out = {f"c{k}": F.when(null, F.lit(NULL_PART << (16 * (3 - k)))).otherwise(F.shiftright(i, 16 * k)) for k in (3, 2, 1)}
    low = F.when(null, F.lit(0)).otherwise(i.bitwiseAND(F.lit(0xFFFF)))
    return out | {"word": F.shiftright(low, 6).cast("int"), "bit": low.bitwiseAND(F.lit(63)).cast("int")}


def directory(ids: DataFrame) -> DataFrame:
    """``grp, c1, word, bits, more, before``, stored: the words of the groups'
    bitmaps, from ``grp, id, n`` (distinct ids and how many rows have them).

    ``more`` lists the (bit, surplus) of repeated ids, ``before`` is the number
    of rows of the group in words before this one.
    """
    parts = _parts("id")
    words = (ids.select("grp", "n", *(c.alias(k) for k, c in parts.items())).groupBy("grp", "c3", "c2", "c1", "word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.sum("n").alias("rows"),
        F.collect_list(F.when(F.col("n") > 1, F.struct("bit", (F.col("n") - 1).alias("surplus")))).alias("more")))
    words = stored(words, "bitmap-words")

    def before(order: str, *within: str) -> Column:
        return F.sum("rows").over(W.partitionBy("grp", *within).orderBy(order)) - F.col("rows")

    keys, base = ["grp", "c3", "c2", "c1"], None
    for depth in (2, 3, 4):  # parts, chunks of chunks, chunks: each level's base and its own prefix sum
        own, within = keys[:depth], keys[1 : depth - 1]
        level = words.groupBy(*own).agg(F.sum("rows").alias("rows"))
        level = level.select(*own, before(own[-1], *within).alias("before"))
        if base is not None:
            level = level.join(base.withColumnRenamed("before", "base"), own[:-1]).select(
                *own, (F.col("before") + F.col("base")).alias("before"))
        base = stored(level, "popcounts")
    inside = words.withColumn("inside", before("word", "c3", "c2", "c1"))
    return stored(inside.join(base, keys).select("grp", "c1", "word", "bits", "more", (F.col("before") + F.col("inside")).alias("before")),
                  "bitmap")


def rank(ids: DataFrame, bitmap: DataFrame) -> DataFrame:
    """``grp, id, at``: how many rows of its group have a smaller id."""
    parts = _parts("id")
    lower = F.expr("~shiftleft(-1L, bit)")
    ones = F.bit_count(F.col("bits").bitwiseAND(lower)).cast("long")
    surplus = F.aggregate(F.filter("more", lambda m: m["bit"] < F.col("bit")), F.lit(0).cast("long"), lambda a, m: a + m["surplus"])
    asked = ids.select("grp", "id", *(parts[k].alias(k) for k in ("c1", "word", "bit")))
    return asked.join(bitmap, ["grp", "c1", "word"]).select("grp", "id", (F.col("before") + ones + surplus).alias("at"))


def _tied(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (``grp, id, leaf, m`` and more) of ids with several leaves, with
    ``after``: the rows of the id with smaller leaves. Leaves are dealt by their
    first bits, so that a window orders about ``TIED`` of them."""
    bits = min(16, max(0, (most // TIED).bit_length()))
    part = F.shiftright(F.conv(F.substring(F.hex("leaf"), 1, 4), 16, 10).cast("int"), 16 - bits)
    dealt = rows.withColumn("part", part)
    sums = dealt.groupBy("grp", "id", "part").agg(F.sum("m").alias("rows"))
    sums = sums.select("grp", "id", "part", (F.sum("rows").over(W.partitionBy("grp", "id").orderBy("part")) - F.col("rows")).alias("base"))
    inside = F.sum("m").over(W.partitionBy("grp", "id", "part").orderBy("leaf")) - F.col("m")
    same = (F.col("a.grp") == F.col("b.grp")) & F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.part") == F.col("b.part"))
    return (dealt.withColumn("inside", inside).alias("a").join(sums.alias("b"), same)
            .select(*(F.col(f"a.{c}") for c in rows.columns), (F.col("a.inside") + F.col("b.base")).alias("after")))


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (``grp, id, leaf, m``: m equal rows, and more) with ``at``, the
    place of the first of them among the group's leaves."""
    ids = stored(rows.groupBy("grp", "id").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("leaves")), "ids")
    ranks = rank(ids, directory(ids)).alias("r")
    most = ids.agg(F.max("leaves")).first()[0] or 0
    if most > 1:
        several = F.broadcast(ids.where("leaves > 1")) if ids.where("leaves > 1").count() <= 1 << 18 else ids.where("leaves > 1")
        on = (F.col("a.grp") == F.col("i.grp")) & F.col("a.id").eqNullSafe(F.col("i.id"))
        one = rows.alias("a").join(several.alias("i"), on, "left_anti").withColumn("after", F.lit(0).cast("long"))
        rows = one.unionByName(_tied(rows.alias("a").join(several.alias("i"), on, "left_semi"), most))
    else:
        rows = rows.withColumn("after", F.lit(0).cast("long"))
    same = (F.col("a.grp") == F.col("r.grp")) & F.col("a.id").eqNullSafe(F.col("r.id"))
    return rows.alias("a").join(ranks, same).select(
        *(F.col(f"a.{c}") for c in rows.columns if c != "after"), (F.col("a.after") + F.col("r.at")).alias("at"))


# --- trees ----------------------------------------------------------------------------------------------------------

def digest(*nodes: bytes) -> bytes:
    """The parent of child digests: SHA-256 of their hex texts."""
    return sha256("".join(n.hex() for n in nodes).encode()).digest()


def levels_of(nodes: list[bytes], n: int, levels: int) -> list[list[bytes]]:
    """The levels that one slot array reduces, of a tree that has ``n`` nodes at
    its bottom: down to one node where the array is the whole tree, else ``levels``."""
    out = [nodes]
    while len(out[-1]) > 1 or (n > 1 << levels and len(out) <= levels):
        row = out[-1]
        out.append([digest(*row[k : k + 2]) for k in range(0, len(row), 2)])
    return out


def steps_of(levels: list[list[bytes]], slot: int) -> bytes:
    """The siblings of a slot, level by level, each after a byte for its side."""
    out = []
    for row in levels[:-1]:
        out.append(LEFT + row[slot - 1] if slot & 1 else RIGHT + row[slot + 1] if slot + 1 < len(row) else ALONE)
        slot >>= 1
    return b"".join(out)


def walk(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The (side, sibling) of each level of a path."""
    k = 0
    while k < len(path):
        side = path[k : k + 1]
        width = 0 if side == ALONE else 32
        yield side, path[k + 1 : k + 1 + width]
        k += 1 + width


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings lead to."""
    node = leaf
    for side, other in walk(path):
        node = digest(other, node) if side == LEFT else digest(node, other) if side == RIGHT else digest(node)
    return node


def proof(path: bytes) -> str:
    """SHA-256 of the siblings' hex texts along a path."""
    return sha256("".join(other.hex() for _, other in walk(path)).encode()).hexdigest()


def slot_arrays(nodes: DataFrame, sizes: DataFrame, levels: int) -> DataFrame:
    """``grp, block, n, slots``, stored: nodes (``grp, at, node``) in their slots,
    ``n`` the nodes of the whole level (``sizes``: ``grp, n``)."""
    entry = F.struct(F.col("at").bitwiseAND(F.lit((1 << levels) - 1)).cast("int").alias("slot"), F.col("node"))
    arrays = nodes.groupBy("grp", F.shiftright("at", levels).alias("block")).agg(F.collect_list(entry).alias("slots"))
    return stored(arrays.join(sizes, "grp"), "slot-arrays")


def _slots(entries: list[dict]) -> list[bytes]:
    out = [b""] * len(entries)
    for e in entries:
        out[e["slot"]] = e["node"]
    return out


def tops(arrays: DataFrame, levels: int, fill=_slots) -> DataFrame:
    """``grp, at, node``: the top node of every slot array, at its block's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = [levels_of(fill(s.as_py()), n.as_py(), levels)[-1][0] for s, n in zip(b.column("slots"), b.column("n"))]
            yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("block"), pa.array(nodes, pa.binary())], ["grp", "at", "node"])

    return arrays.select("grp", "block", "slots", "n").mapInArrow(run, "grp string, at long, node binary")


def paths_below(arrays: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """``grp, block, path, top, root`` of the arrays whose tops are these arrays'
    nodes, from the same of these (``above``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rows = levels_of(_slots(r["slots"]), r["n"], levels)
                m = len(rows[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["grp"]] * m), pa.array([(r["block"] << levels) + k for k in range(m)], pa.int64()),
                     pa.array([steps_of(rows, k) + r["path"] for k in range(m)], pa.binary()),
                     pa.array([r["top"]] * m, pa.binary()), pa.array([r["root"]] * m, pa.binary())],
                    ["grp", "block", "path", "top", "root"])

    return arrays.join(above, ["grp", "block"]).mapInArrow(run, "grp string, block long, path binary, top binary, root binary")


def rounds(first: DataFrame, sizes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Slot arrays of the rounds above the arrays whose tops are ``first``, and
    the subroots (``grp, node``). ``sizes``: ``grp, n`` of the arrays' own nodes."""
    out, nodes = [], stored(first, "tops")
    sizes = stored(sizes.select("grp", F.ceil(F.col("n") / (1 << levels)).cast("long").alias("n")), "sizes")
    while (sizes.agg(F.max("n")).first()[0] or 0) > 1:
        out.append(slot_arrays(nodes, sizes, levels))
        nodes = stored(tops(out[-1], levels), "tops")
        sizes = stored(sizes.select("grp", F.ceil(F.col("n") / (1 << levels)).cast("long").alias("n")), "sizes")
    return out, nodes.select("grp", "node")


def _in_order(groups: DataFrame) -> DataFrame:
    """``grp, node`` with ``at``, the group's place among all: a range sort whose
    partitions' row counts are the offsets."""
    marked = stored(groups.repartitionByRange("grp").sortWithinPartitions("grp").withColumn("_at", F.monotonically_increasing_id()), "groups")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    offsets = marked.groupBy(part.alias("part")).count().select("part", (F.sum("count").over(W.orderBy("part")) - F.col("count")).alias("base"))
    return marked.withColumn("part", part).join(offsets, "part").select("grp", "node", (F.col("base") + place).alias("at"))


def _fill_leaves(entries: list[dict]) -> list[dict]:
    """The leaf entries in their slots; a run of equal rows takes one slot each."""
    out = [None] * sum(e["run"] for e in entries)
    for e in entries:
        out[e["slot"] : e["slot"] + e["run"]] = [e] * e["run"]
    return out


def _leaf_digests(entries: list[dict]) -> list[bytes]:
    return [e["node"] for e in _fill_leaves(entries)]


def manifest(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``id, grp, leaf, subroot, root, proof_sha256, folded_root, verified`` of
    each row of ``grp, id, leaf, claimed``.

    ``id`` is a long or null, ``grp`` a string that is never null; groups stand
    by its bytes. ``claimed`` is the leaf to be verified against the tree of
    ``leaf`` (null: the leaf itself). ``levels`` are what one slot array reduces;
    they do not change the result. An empty table has an empty manifest.
    """
    ship(leaves.sparkSession)
    # equal rows are one row with a count before they travel
    rows = stored(leaves.groupBy("grp", "id", "leaf", "claimed").agg(F.count(F.lit(1)).alias("m")), "leaves")
    fan, at, last = 1 << levels, F.col("at"), F.col("at") + F.col("m") - 1
    runs = (placed(rows).withColumn("block", F.explode(F.sequence(F.shiftright(at, levels), F.shiftright(last, levels))))
            .withColumn("from", F.greatest(at, F.col("block") * fan)).withColumn("to", F.least(last, F.col("block") * fan + fan - 1)))
    entry = F.struct((F.col("from") - F.col("block") * fan).cast("int").alias("slot"), (F.col("to") - F.col("from") + 1).cast("int").alias("run"),
                     "id", F.col("leaf").alias("node"), "claimed")
    sizes = stored(rows.groupBy("grp").agg(F.sum("m").alias("n")), "sizes")
    bottom = stored(runs.groupBy("grp", "block").agg(F.collect_list(entry).alias("slots")).join(sizes, "grp"), "leaf-slots")

    upper, subroots = rounds(tops(bottom, levels, _leaf_digests), sizes, levels)
    # the groups' own tree: one more group, whose nodes are the subroots
    ordered = stored(_in_order(subroots), "subroots")
    whole = ordered.select(F.lit("").alias("grp"), "at", "node")
    count = stored(whole.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "sizes")
    ground = slot_arrays(whole, count, levels)
    higher, root = rounds(tops(ground, levels), count, levels)

    path = root.select("grp", F.lit(0).cast("long").alias("block"), F.lit(b"").alias("path"), F.lit(b"").alias("top"), F.col("node").alias("root"))
    for arrays in reversed([ground, *higher]):
        path = stored(paths_below(arrays, path, levels), "paths")
    path = path.select(F.col("block").alias("at"), "path", "root").join(ordered, "at").select(
        "grp", F.lit(0).cast("long").alias("block"), "path", F.col("node").alias("top"), "root")
    for arrays in reversed(upper):
        path = stored(paths_below(arrays, path, levels), "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = {c: b.column(c)[k].as_py() for c in ("grp", "n", "slots", "path", "top", "root")}
                entries = _fill_leaves(r["slots"])
                rows = levels_of([e["node"] for e in entries], r["n"], levels)
                out = []
                for slot, e in enumerate(entries):
                    path = steps_of(rows, slot) + r["path"]
                    end = folded(e["claimed"] or e["node"], path)
                    out.append((e["id"], e["node"].hex(), proof(path), end.hex(), end == r["root"]))
                m, (ids, nodes, proofs, ends, fine) = len(out), zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([r["grp"]] * m), pa.array(nodes), pa.array([r["top"].hex()] * m),
                     pa.array([r["root"].hex()] * m), pa.array(proofs), pa.array(ends), pa.array(fine)],
                    ["id", "grp", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return bottom.join(path, ["grp", "block"]).mapInArrow(
        run, "id long, grp string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def document_leaves(docs: DataFrame, tampered=None) -> DataFrame:
    """``grp, id, leaf, claimed`` of documents: a group for each language (null
    first), digests of the five columns. Where ``tampered`` holds, ``claimed``
    is the leaf of the document with one character more counted. Null in any
    column has its own digest, and other columns are ignored."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = F.try_add(F.col("n_chars"), F.lit(1))
    claimed = leaf_of(*(more if k == 3 else c for k, c in enumerate(columns)))
    return docs.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("grp"), F.col("doc_id").cast("long").alias("id"),
                       leaf_of(*columns).alias("leaf"),
                       (F.when(tampered, claimed) if tampered is not None else F.lit(None).cast("binary")).alias("claimed"))


def op11_bitmap_merkle(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents; every seventh (by crc32) is tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    return manifest(document_leaves(docs, chosen)).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _sql(levels: int = 40) -> str:
    """The trees in SQL: windows number the leaves; one relation for each level."""
    def tree(name: str, source: str) -> str:
        """Relations ``name``_l (g, lv, i, h, n) of all levels above ``source`` (g, i, h, n)."""
        return f"""
{name}_l AS (
  SELECT g, 0 AS lv, i, h, n FROM {source}
  UNION ALL
  SELECT g, lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2
  FROM {name}_l WHERE n > 1 AND lv < {levels} GROUP BY g, lv, i // 2),
{name}_s AS (
  SELECT s.g, s.i AS leaf, lv.lv, (s.i >> lv.lv) & 1 AS is_right, o.h AS other
  FROM {source} s JOIN (SELECT DISTINCT g, lv FROM {name}_l WHERE n > 1) lv ON s.g = lv.g
  LEFT JOIN {name}_l o ON o.g = s.g AND o.lv = lv.lv AND o.i = xor(s.i >> lv.lv, 1))"""

    def f(c: str) -> str:
        return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"

    return f"""
WITH RECURSIVE
d AS (SELECT *, coalesce('=' || lang, '') AS g,
             sha256({f('doc_id')} || {f('source')} || {f('lang')} || {f('n_chars')} || {f('text')}) AS leaf,
             sha256({f('doc_id')} || {f('source')} || {f('lang')} || {f('(n_chars + 1)')} || {f('text')}) AS other FROM documents),
e AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
             count(*) OVER (PARTITION BY g) AS n FROM d),
crc AS (
  SELECT DISTINCT doc_id, doc_id::VARCHAR AS s, 0 AS k, 4294967295::BIGINT AS c FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, s, k + 1, xor(c >> 8, t) FROM (
    SELECT doc_id, s, k, c, list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END,
                                        xor(c, ascii(s[k + 1])::BIGINT) & 255) AS t
    FROM crc WHERE k < length(s))),
bad AS (SELECT doc_id FROM crc WHERE k = length(s) AND xor(c, 4294967295) % 7 = 0),
leaves AS (SELECT g, i, leaf AS h, n FROM e),
{tree('a', 'leaves')},
subs AS (SELECT g, h FROM a_l WHERE n = 1),
tops AS (SELECT 'all' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS n FROM subs),
{tree('b', 'tops')},
whole AS (SELECT h AS root FROM b_l WHERE n = 1),
names AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i FROM subs),
steps AS (
  SELECT g, leaf, lv, is_right, other FROM a_s
  UNION ALL
  SELECT e.g, e.i, 1000 + b_s.lv, b_s.is_right, b_s.other FROM e JOIN names ON e.g = names.g JOIN b_s ON b_s.leaf = names.i),
proofs AS (SELECT g, leaf, string_agg(coalesce(other, ''), '' ORDER BY lv) AS siblings FROM steps GROUP BY g, leaf),
numbered AS (SELECT *, row_number() OVER (PARTITION BY g, leaf ORDER BY lv) AS k FROM steps),
fold AS (
  SELECT g, i, 1 AS k, CASE WHEN doc_id IN (SELECT doc_id FROM bad) THEN other ELSE leaf END AS h FROM e
  UNION ALL
  SELECT f.g, f.i, f.k + 1, CASE WHEN s.other IS NULL THEN sha256(f.h) WHEN s.is_right = 1 THEN sha256(s.other || f.h) ELSE sha256(f.h || s.other) END
  FROM fold f JOIN numbered s ON s.g = f.g AND s.leaf = f.i AND s.k = f.k),
ends AS (SELECT g, i, arg_max(h, k) AS folded_root FROM fold GROUP BY g, i)
SELECT e.doc_id, e.leaf, names.subroot, whole.root, sha256(coalesce(proofs.siblings, '')) AS proof_sha256,
       ends.folded_root, ends.folded_root = whole.root AS verified
FROM e JOIN names ON e.g = names.g CROSS JOIN whole JOIN ends ON ends.g = e.g AND ends.i = e.i
LEFT JOIN proofs ON proofs.g = e.g AND proofs.leaf = e.i
"""


OP11_SQL = _sql()
