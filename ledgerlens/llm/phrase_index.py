"""Benchmark decontamination by a positional inverted index, DataFrame functions only.

* Index: one posting (document, position, term) for every document word that
  some test item uses. The index is partitioned by document, so a frequent
  term's list is spread over all tasks.
* A test item is cut into windows of consecutive words. The terms of a window
  are ordered by how often the corpus has them; a window with a term that the
  corpus lacks is dropped.
* Intersection: the postings of a window's rarest term, each moved back by the
  term's offset, are the candidate places. They are joined with the postings of
  the second rarest term at its offset, and what is left with those of all
  other terms. A place where every term stands is an exact phrase match.
* With a ``slop``, a term may stand up to that many words off its offset
  (words put in, left out or swapped): a proximity match.

Test items are usually few, but nothing rests on it: a table made from them is
broadcast only up to ``BROADCAST_ROWS`` rows, beyond that it is joined by a
shuffle in which each term is dealt over ``SALTS`` tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import LOWER, UPPER, WORD, lower_ascii, stored

#: Words of a window; an item of fewer words is one window.
WINDOW_WORDS = 10
#: Rows of a stored narrow table that may be broadcast (some 16 MB).
BROADCAST_ROWS = 1 << 18
#: Tasks over which one term's postings are dealt when its table is not broadcast.
SALTS = 32

DOC = ["d", "h"]


def words_of(text: Column) -> Column:
    """Lower-case words of a whole text; none for null."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def count_words(text: Column) -> Column:
    """``size(words_of(text))`` without the array: A-Z count as they are."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60"))), F.lit(0)).cast("long")


def with_doc_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``d, h, id, text``: (d, h) names a distinct row by its id and its text."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    number = F.xxhash64(F.col("id").cast("string"))
    return known.select(F.coalesce(number, F.lit(0)).alias("d"), F.xxhash64(F.col("id").isNull(), "id", "text").alias("h"), "id", "text")


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with a stored ``table`` on ``key``: by broadcast while the
    table is small, else by a shuffle that deals each key over ``SALTS`` tasks."""
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (rows.withColumn("salt", F.pmod(F.hash(*DOC, *(c for c in ("pos", "start") if c in rows.columns)), F.lit(SALTS)))
            .join(salted, [key, "salt"]).drop("salt"))


class Windows:
    """Distinct windows of the test items.

    ``plain``: ``window, terms``; ``members``: ``window, item`` (distinct);
    ``vocabulary``: ``term, word``. Items without words have no window, a null
    id is kept as a null ``item``.
    """

    def __init__(self, items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW_WORDS):
        words = (items.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("words"))
                 .where(F.size("words") > 0).distinct())
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
        cut = stored(words.select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s + 1, F.lit(size)))).alias("terms"))
                     .distinct(), "item-windows")
        # numbers are given once, in a stored table, so that they stay
        number = F.monotonically_increasing_id()
        spelt = stored(cut.select("terms").distinct().withColumn("window", number), "spelt-windows")
        self.members = stored(cut.join(spelt, "terms").select("window", "item"), "window-items")
        self.vocabulary = stored(spelt.select(F.explode("terms").alias("word")).distinct().withColumn("term", number), "vocabulary")
        self.plain = stored(spelt.select("window", F.posexplode("terms").alias("offset", "word"))
                            .join(self.vocabulary, "word").select("window", "offset", "term"), "windows")


def positional_index(docs: DataFrame, windows: Windows, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``d, h, pos, term``, stored: the postings of the windows' terms, once for
    each distinct row of ``docs``."""
    keyed = with_doc_key(docs, id_col, text_col)
    again = stored(keyed.groupBy(*DOC).count().where("count > 1").select(*DOC), "repeated-rows")
    if not again.isEmpty():  # repeated rows meet only after each task has kept one of them
        once = keyed.join(again, DOC, "left_semi").groupBy(*DOC).agg(F.first("id").alias("id"), F.first("text").alias("text"))
        keyed = keyed.join(again, DOC, "left_anti").unionByName(once)
    places = keyed.select(*DOC, F.posexplode(words_of(F.col("text"))).alias("pos", "word"))
    return stored(lookup(places, windows.vocabulary, "word").select(*DOC, "pos", "term"), "postings")


def term_order(postings: DataFrame, windows: Windows) -> DataFrame:
    """``window, steps``, stored: a window's (n, offset, term), the term that
    the corpus has least often first; no row where the corpus lacks a term."""
    counts = stored(postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term-counts")
    return stored(windows.plain.join(counts, "term", "left").groupBy("window")
                  .agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("steps"), F.count("n").alias("seen"))
                  .where(F.col("seen") == F.size("steps")).select("window", "steps"), "term-order")


def matches(postings: DataFrame, windows: Windows, slop: int = 0) -> DataFrame:
    """``d, h, window, start, length, exact``, stored: every place of every window.

    The term at offset k of a window must stand at start + k, or with a
    ``slop`` at most that many words away from there. ``exact`` says that all
    stand at their own offsets. Places are distinct.
    """
    order = term_order(postings, windows)
    away = F.explode(F.sequence(F.lit(-slop), F.lit(slop)))

    def step(k: int) -> Column:  # a window of fewer terms repeats its last step
        return F.get("steps", F.least(F.lit(k), F.size("steps") - 1))

    def steps_of(k: int) -> DataFrame:
        return order.select("window", step(k)["offset"].alias("offset"), step(k)["term"].alias("term"))

    def standing(wanted: DataFrame, terms: DataFrame) -> DataFrame:
        """The wanted (term, pos) that postings have; only postings of ``terms`` travel."""
        wanted = stored(wanted, "wanted")
        side = lookup(postings, stored(terms.select("term").distinct(), "wanted-terms"), "term").select(*DOC, "pos", "term")
        on = [*DOC, "pos", "term"]
        if wanted.count() <= BROADCAST_ROWS:
            return side.join(F.broadcast(wanted), on)
        return wanted.join(side, on)

    first = stored(steps_of(0), "rarest")
    places = stored(lookup(postings, first, "term").withColumn("off", away)
                    .select(*DOC, "window", (F.col("pos") - F.col("offset") + F.col("off")).alias("start")).distinct(), "places")
    second = stored(steps_of(1), "second")
    wanted = (lookup(places, second, "window").withColumn("off", away)
              .select(*DOC, "window", "start", (F.col("start") + F.col("offset") + F.col("off")).alias("pos"), "term"))
    places = standing(wanted, second).select(*DOC, "window", "start").distinct()
    rest = order.select("window", F.size("steps").alias("length"), F.explode("steps").alias("s")).select(
        "window", "length", "s.offset", "s.term")
    wanted = (lookup(stored(places, "places"), stored(rest, "steps"), "window").withColumn("off", away)
              .select(*DOC, "window", "start", "length", "offset", (F.col("start") + F.col("offset") + F.col("off")).alias("pos"), "term",
                      (F.col("off") == 0).alias("there")))
    found = (standing(wanted, rest).groupBy(*DOC, "window", "start", "length", "offset").agg(F.max("there").alias("there"))
             .groupBy(*DOC, "window", "start", "length").agg(F.count(F.lit(1)).alias("n"), F.min("there").alias("exact"))
             .where(F.col("n") == F.col("length")))
    return stored(found.select(*DOC, "window", "start", "length", "exact"), "matches")


def covered_words(found: DataFrame) -> DataFrame:
    """``d, h, n_hit``: how many positions the matched windows of a document
    cover, a running maximum of ends over its starts."""
    spans = found.groupBy(*DOC, "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    before = F.max("end").over(W.partitionBy(*DOC).orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("before", F.lit(0))))
    return spans.withColumn("before", before).groupBy(*DOC).agg(F.sum(new).cast("long").alias("n_hit"))


def found_items(found: DataFrame, windows: Windows) -> DataFrame:
    """``d, h, items``: the distinct ids, as sorted strings, of the items of
    which a window stands in the document. Items without an id have no name."""
    named = stored(windows.members.where(F.col("item").isNotNull()), "named-items")
    pairs = lookup(found.withColumn("pos", F.col("start")).select(*DOC, "window", "pos").distinct(), named, "window")
    return (pairs.select(*DOC, F.col("item").cast("string").alias("item")).distinct()
            .groupBy(*DOC).agg(F.array_sort(F.collect_list("item")).alias("items")))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", size: int = WINDOW_WORDS, slop: int = 0) -> DataFrame:
    """``<id_col>, n_words, n_hit, items, near_items`` of every row of ``docs``.

    ``n_hit`` counts the words inside occurrences of item windows, ``items``
    lists the items with such windows. With a ``slop``, ``near_items`` lists
    those with a proximity match (else it is the same list). Null and empty
    texts and items have no words. Repeated rows and null ids get a row each;
    repeated items count once, and an item with a null id is searched but not
    listed. Other columns are ignored.
    """
    windows = Windows(items, item_col, item_text_col, size)
    postings = positional_index(docs, windows, id_col, text_col)
    found = matches(postings, windows)
    listed = found_items(found, windows)
    near = found_items(matches(postings, windows, slop), windows) if slop else listed
    hits = stored(near.withColumnRenamed("items", "near_items").join(listed, DOC, "full").join(covered_words(found), DOC, "full"), "hits")
    rows = with_doc_key(docs, id_col, text_col).select(*DOC, "id", count_words(F.col("text")).alias("n_words"))
    none = F.array().cast("array<string>")
    return rows.join(hits, DOC, "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))


def op13_positional_index(spark, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    rows = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), {WINDOW_WORDS}) AS n, array_to_string(w[p : p + least(len(w), {WINDOW_WORDS}) - 1], ' ') AS phrase
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW_WORDS}, 0) + 2)) AS p FROM i WHERE len(w) > 0)),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d),
f AS (SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS phrase FROM p, (SELECT DISTINCT n FROM g) WHERE p + n - 1 <= len(w)),
m AS (SELECT r, p, g.n, item_id FROM f JOIN g ON f.phrase = g.phrase AND f.n = g.n),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN t ON d.r = t.r
"""
