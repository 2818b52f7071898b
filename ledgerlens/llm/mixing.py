"""Time-varying mixing of sources to target weights, DataFrame functions only.

Each source has a weight schedule over the run's time [0, 1]: a piecewise
linear rate. Its integral, scaled to the source's target, says how many of its
words the run has asked for by time t. A document that starts at a cumulative
word count c of its source (in a fixed pseudo-random order, repeated in passes)
is trained on when that demand reaches c: its position is the inverse of the
integral at c. Documents are then range-sorted by position.

The running count within a source is taken in two levels, so a source that
holds a third of all rows is split: sums of fine hash ranges, a prefix sum over
the ranges, and a running sum inside each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import SPACED_WORD, stored

#: Documents that one hash range holds on average.
RANGE_ROWS = 2_000

#: Schedules by weight class: (time, relative rate) knots, time from 0 to 1.
#: Heavy sources come early, light ones late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.4), (0.5, 0.8), (1.0, 2.0)))


def n_words(text: Column) -> Column:
    """Maximal runs of non-space characters; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_passes: int = 2) -> DataFrame:
    """``sources`` (``source, source_size`` and any other column) with ``cls``
    and ``target``.

    Sources by code point, null last, weigh ``weights`` in turn. The target is
    min(max_passes * size, level * weight), the level such that targets sum to
    ``share`` times all sizes: what repeated resharing of the excess ends at.
    The input has one row per source, a list of the size of a configuration.
    """
    ranked = sources.withColumn("cls", F.pmod(
        F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))).cast("int"))
    capped = (ranked
              .withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("cls") + 1))
              .withColumn("cap", (F.col("source_size") * max_passes).cast("double"))
              .withColumn("fill", F.col("cap") / F.col("weight")))
    by_fill = W.orderBy("fill", "cls", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(by_fill), F.lit(0.0))
             ) / (F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(by_fill), F.lit(0.0)))
    # the right level is the first one under its own row's fill
    levels = capped.withColumn("level", level).withColumn(
        "water", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(W.partitionBy())["level"])
    return levels.select(*sources.columns, "cls",
                         F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))


def inverse_demand(share: Column, cls: Column, schedules=SCHEDULES) -> Column:
    """The time by which a fraction ``share`` of a source's words is asked for."""
    branches = None
    for k, knots in enumerate(schedules):
        area = [0.0]
        for (t0, r0), (t1, r1) in zip(knots, knots[1:]):
            area.append(area[-1] + (t1 - t0) * (r0 + r1) / 2)
        y, time = share * F.lit(area[-1]), None
        for i in reversed(range(len(knots) - 1)):
            (t0, r0), (t1, r1) = knots[i], knots[i + 1]
            rest, twice_slope = y - F.lit(area[i]), 2 * (r1 - r0) / (t1 - t0)
            # root of r0*s + slope*s*s/2 = rest, in the form without cancellation
            at = F.lit(t0) + rest * 2 / (F.lit(r0) + F.sqrt(F.greatest(F.lit(r0 * r0) + rest * twice_slope, F.lit(0.0))))
            time = at if time is None else F.when(y < F.lit(area[i + 1]), at).otherwise(time)
        branches = F.when(cls == k, time) if branches is None else branches.when(cls == k, time)
    return F.least(F.greatest(branches, F.lit(0.0)), F.lit(1.0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=(5, 2, 1), share: float = 1.5, max_passes: int = 2, schedules=SCHEDULES,
        carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``id, source, size, source_size, target, taken,
    passes, carried`` with ``passes`` an array of (pass, words, position), one
    entry for each time the document is (partly) trained on.

    A source's taken words are exactly its target, rounded: the document at the
    edge gives only its first words. Null texts have size 0 and are never
    taken; null sources are a source of their own; null ids, repeated rows and
    ties are each dealt a place of their own; extra columns are ignored unless
    named in ``carry``, and then kept in a struct.
    """
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("source_key"),  # never null
        n_words(F.col(text_col)).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("order_key"),
        F.struct(*(F.col(f"`{c}`") for c in carry) or (F.lit(None).alias("none"),)).alias("carried"))
    small = stored(sized.drop("carried"), "sizes")
    targets = stored(source_targets(small.groupBy("source_key", "source").agg(F.sum("size").alias("source_size")),
                                    weights, share, max_passes).drop("source"), "targets")

    # hash ranges, as many as all documents need, so that a hot source is split
    n_ranges = -(-small.count() // RANGE_ROWS) or 1
    at = F.conv(F.substring("order_key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    piece = F.floor(at * n_ranges).alias("range")
    sums = stored(small.groupBy("source_key", piece).agg(F.sum("size").alias("w"))
                  .withColumn("before", F.sum("w").over(W.partitionBy("source_key").orderBy("range")) - F.col("w"))
                  .select("source_key", "range", "before"), "range-sums")
    inside = W.partitionBy("source_key", "range").orderBy("order_key", F.col("id").asc_nulls_first(), "size").rowsBetween(
        W.unboundedPreceding, -1)
    # documents travel once, to their range; the tables joined to them are small
    rows = (sized if carry else small.withColumn("carried", F.lit(None))).select("*", piece)
    started = (rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
               .join(sums, ["source_key", "range"]).join(targets, "source_key")
               .withColumn("start", F.col("inside") + F.col("before")))
    goal = F.round("target").cast("long")
    entries = []
    for p in range(max_passes):
        start = F.col("start") + F.col("source_size") * p
        words = F.greatest(F.lit(0), F.least(F.col("size"), goal - start)).cast("long")
        position = inverse_demand(F.when(F.col("target") > 0, start / F.col("target")).otherwise(0.0), F.col("cls"), schedules)
        entries.append(F.struct(F.lit(p).alias("pass"), words.alias("words"), position.alias("position")))
    passes = F.filter(F.array(*entries), lambda e: e["words"] > 0)
    return (started.withColumn("passes", passes)
            .select("id", "source", "size", "source_size", "target",
                    F.aggregate("passes", F.lit(0).cast("long"), lambda a, e: a + e["words"]).alias("taken"), "passes", "carried")
            .withColumnRenamed("id", id_col))


def in_training_order(mixed: DataFrame, position: str = "position", tie_break: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Range-sorted by position, null (never trained on) last: partitions
    follow each other in time. ``tie_break`` splits a run of equal positions."""
    by = (F.col(position).asc_nulls_last(), *(F.col(c) for c in tie_break))
    return mixed.repartitionByRange(*by).sortWithinPartitions(*by)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, spaces between kept."""
    edge = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
    return F.array_join(F.slice(F.split(text, edge), F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars",
                    **options) -> DataFrame:
    """The documents that the mix trains on, in training order, with the columns
    of ``docs``: a row for each pass, its text cut to the words taken. Documents
    of which no word is taken are not in it."""
    own = tuple(docs.columns)
    taken = mix(docs, id_col, text_col, carry=own, **options).select("carried", "size", F.explode("passes").alias("p"))
    text = F.when(F.col("p.words") < F.col("size"), first_words(F.col(f"carried.`{text_col}`"), F.col("p.words"))).otherwise(
        F.col(f"carried.`{text_col}`"))
    rows = in_training_order(taken.withColumn("position", F.col("p.position")).withColumn("id", F.col(f"carried.`{id_col}`")),
                             tie_break=("id",)).withColumn("cut", text)
    return rows.select(*(F.col("cut").alias(c) if c == text_col
                         else F.char_length("cut").cast(docs.schema[c].dataType).alias(c) if c == n_chars_col
                         else F.col(f"carried.`{c}`").alias(c) for c in own))


def op7_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    """Every document with its taken words and first training position."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    position = F.get(F.col("passes"), F.lit(0))["position"]
    return in_training_order(mixed.select("doc_id", "size", "source_size", "target", "taken", position.alias("position")))


def _position_sql(share: str, schedules=SCHEDULES) -> str:
    """``inverse_demand`` as SQL text, operation by operation."""
    lit = lambda x: f"{float(x)!r}::DOUBLE"
    out = "CASE cls"
    for k, knots in enumerate(schedules):
        area = [0.0]
        for (t0, r0), (t1, r1) in zip(knots, knots[1:]):
            area.append(area[-1] + (t1 - t0) * (r0 + r1) / 2)
        y, time = f"({share} * {lit(area[-1])})", ""
        for i in reversed(range(len(knots) - 1)):
            (t0, r0), (t1, r1) = knots[i], knots[i + 1]
            rest = f"({y} - {lit(area[i])})"
            at = (f"({lit(t0)} + {rest} * 2 / ({lit(r0)} + sqrt(greatest({lit(r0 * r0)} + {rest} * "
                  f"{lit(2 * (r1 - r0) / (t1 - t0))}, {lit(0)}))))")
            time = f"CASE WHEN {y} < {lit(area[i + 1])} THEN {at} ELSE {time} END" if time else at
        out += f" WHEN {k} THEN {time}"
    return f"least(greatest({out} END, {lit(0)}), {lit(1)})"


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5(doc_id::VARCHAR) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS cls FROM d GROUP BY source),
w AS (SELECT *, CASE cls WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
f AS (SELECT *, (2 * source_size)::DOUBLE AS cap, (2 * source_size)::DOUBLE / weight AS fill FROM w),
l AS (SELECT a.source, a.fill,
        ((SELECT sum(source_size) FROM f) * 1.5::DOUBLE
          - coalesce((SELECT sum(b.cap) FROM f b WHERE (b.fill, b.cls, b.source) < (a.fill, a.cls, a.source)), 0))
        / ((SELECT sum(weight) FROM f)
          - coalesce((SELECT sum(b.weight) FROM f b WHERE (b.fill, b.cls, b.source) < (a.fill, a.cls, a.source)), 0)) AS level
      FROM f a),
t AS (SELECT f.source, f.source_size, f.cls,
             least(cap, (SELECT level FROM l WHERE level <= fill ORDER BY fill, level LIMIT 1) * weight) AS target FROM f),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.cls,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, greatest(0, least(size, round(target)::BIGINT - start)) AS first_pass,
             greatest(0, least(size, round(target)::BIGINT - start - source_size)) AS second_pass FROM c)
SELECT doc_id, size, source_size, target, (first_pass + second_pass)::BIGINT AS taken,
       CASE WHEN first_pass > 0 THEN {position} END AS position
FROM p
""".replace("{position}", _position_sql("(start / target)"))
