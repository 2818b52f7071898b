"""License scan: phrase places, and an exact set-similarity join with templates.

Tokens are pairs of consecutive words, so the order of words counts. A text
meets a template where some window of the template's ``width`` (twice its
distinct tokens) holds at least ``THRESHOLD`` of its distinct tokens, wherever
the window starts. To find all of them, a text is cut into regions of
``BLOCK + STRIDE`` tokens, a new one every ``STRIDE``: every window of up to
``BLOCK`` tokens lies whole in one. The join between regions and templates is
exact:

* Tokens are ordered by their frequency over all regions of the corpus, rarest
  first. A region that meets the threshold holds one of the first
  |T| - needed + 1 tokens of the template (prefix filter).
* A region with fewer tokens than needed cannot match (length filter).
* From the place of that common token in both orders follows how many tokens can
  still agree (positional filter).
* What is left is counted in full, window by window.

Only tokens of templates take part in an overlap, so a region is kept as the
sorted list of the template tokens in it, and with its text's tokens only where
it holds enough of them. Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import LOWER, UPPER, WORD, lower_ascii, stored

BLOCK, STRIDE, THRESHOLD = 64, 32, 0.9

#: Fixed phrases and labels of the base scan.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Fixed wording of public license notices (each of 2 to BLOCK / 2 words).
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("all-rights-reserved", "all rights reserved"),
)


def template_tokens(template: str) -> list[str]:
    """Distinct pairs of consecutive words of a template."""
    words = template.split()
    found = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
    if not 0 < 2 * len(found) <= BLOCK:
        raise ValueError(f"a template needs 2 to {BLOCK // 2} words: {template!r}")
    return found


def needed_tokens(template: str, threshold: float = THRESHOLD) -> int:
    """Distinct tokens of a template that a matching window must hold."""
    return -(-round(len(template_tokens(template)) * threshold * 1000) // 1000)


def text_words(text: Column) -> Column:
    """Lower-case words of a whole text; none for null."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _places(words: Column, phrases) -> Column:
    """Array of (label, start) of every place of every phrase."""
    found = []
    for phrase, label in phrases:
        parts = phrase.split()
        starts = F.sequence(F.lit(0), F.size(words) - len(parts))
        there = F.filter(starts, lambda i: _all_at(words, parts, i))
        # only texts that hold the phrase's rarest, last word are walked
        found.append(F.when(F.array_contains(words, parts[-1]) & (F.size(words) >= len(parts)),
                            F.transform(there, lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("start")))
                            ).otherwise(F.array().cast("array<struct<label:string,start:bigint>>")))
    return F.concat(*found)


def _all_at(words: Column, parts: list[str], i: Column) -> Column:
    out = None
    for k, part in enumerate(parts):
        one = F.get(words, i + k) == part
        out = one if out is None else out & one
    return out


def text_tokens(words: Column) -> Column:
    """Pairs of consecutive words, in order; none for fewer than two words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def region_matches(regions: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``key, labels, containment`` of every key with a region that meets a
    template, from ``key, hits, tokens`` (hits: the distinct template tokens
    among the region's tokens)."""
    spark = regions.sparkSession
    # the global order: as many rows as templates have tokens, whatever the corpus
    counted = {r["token"]: r["f"] for r in regions.select(F.explode("hits").alias("token")).groupBy("token")
               .agg(F.count(F.lit(1)).alias("f")).collect()}
    order = sorted({w for _, t in templates for w in template_tokens(t)}, key=lambda w: (counted.get(w, 0), w))
    place = {w: k for k, w in enumerate(order)}
    prefixes = []
    for label, template in templates:
        own, needed = sorted(template_tokens(template), key=place.get), needed_tokens(template, threshold)
        prefixes += [(label, own, needed, 2 * len(own), i, w) for i, w in enumerate(own[: len(own) - needed + 1])]
    prefix = spark.createDataFrame(prefixes, "label string, own array<string>, needed int, width int, i int, token string")
    # a region's own tokens in the global order, each with its place
    listed = F.array(*(F.lit(w) for w in order))
    rare = F.array(*(F.lit(w) for w in sorted({p[-1] for p in prefixes})))
    rows = regions.where(F.arrays_overlap("hits", rare)).withColumn("hits", F.filter(listed, lambda w: F.array_contains("hits", w))).select(
        "key", "tokens", "hits", F.posexplode("hits").alias("j", "token"))
    size = F.size("own")
    candidates = (rows.join(F.broadcast(prefix), "token")
                  .where(F.size("tokens") >= F.col("needed"))
                  .where(1 + F.least(size - F.col("i") - 1, F.size("hits") - F.col("j") - 1) >= F.col("needed"))
                  .where(F.size(F.array_intersect("hits", "own")) >= F.col("needed")))
    # the best window starts at a token of the template
    starts = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.array_contains("own", F.get("tokens", i)))
    overlap = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect("own", F.slice("tokens", i + 1, F.col("width"))))))
    return (candidates.withColumn("overlap", overlap).where(F.col("overlap") >= F.col("needed"))
            .groupBy("key").agg(F.collect_set("label").alias("labels"), F.max(F.col("overlap") / size).alias("containment")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES,
         threshold: float = THRESHOLD) -> DataFrame:
    """``<id_col>, n_words, n_base, first_word, last_word, base_labels, labels,
    score`` of every row's whole text.

    ``score`` is 1 where a phrase stands, else the largest containment of a
    matching template, else 0. A null or empty text has no words, no labels
    (empty strings) and score 0; a text of one word has no tokens. Repeated rows and null ids get a row each;
    other columns are ignored.
    """
    vocabulary = F.array(*(F.lit(w) for w in sorted({w for _, t in templates for w in template_tokens(t)})))
    least = min(needed_tokens(t, threshold) for _, t in templates)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    words = rows.select("id", F.concat_ws(":", F.col("id").cast("string"), F.hex(F.xxhash64("text"))).alias("key"), text_words(F.col("text")).alias("words"))
    words = words.select("*", text_tokens(F.col("words")).alias("tokens"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("tokens") - 1, F.lit(0)), F.lit(STRIDE))
    region = lambda s: F.slice("tokens", s + 1, F.lit(BLOCK + STRIDE))
    hits = F.filter(F.transform(starts, lambda s: F.struct(s.alias("start"), F.array_intersect(region(s), vocabulary).alias("hits"))),
                    lambda b: F.size(b["hits"]) >= least)
    regions = F.transform(hits, lambda b: F.struct(b["hits"].alias("hits"), region(b["start"]).alias("tokens")))
    places = _places(F.col("words"), phrases)
    found = stored(words.select("id", "key", F.size("words").cast("long").alias("n_words"), places.alias("places"), regions.alias("regions")),
                   "license-regions")
    matches = region_matches(found.select("key", F.explode("regions").alias("b")).select("key", "b.hits", "b.tokens"), templates, threshold)
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    start = F.transform("places", lambda p: p["start"])
    both = F.array_sort(F.array_distinct(F.concat(base, F.coalesce("labels", F.array().cast("array<string>")))))
    return (found.join(matches, "key", "left").select(
        F.col("id").alias(id_col), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score")))


def op2_license_containment(spark, sf_dir: str) -> DataFrame:
    """License labels and places of every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    rows = ", ".join(f"({k}, '{label}', {template_tokens(t)!r}, {needed_tokens(t)})" for k, (label, t) in enumerate(TEMPLATES))
    tests = []
    for phrase, label in PHRASES:
        there = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(phrase.split()))
        tests.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {there}), lambda i: {{'l': '{label}', 's': (i - 1)::BIGINT}})")
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, len(w)::BIGINT AS n_words, {" || ".join(tests)} AS places FROM d),
t(k, label, own, needed) AS (VALUES {rows}),
v AS (SELECT k, label, needed, len(own) AS size, unnest(own) AS token FROM t),
b AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] AS token FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
h AS (SELECT doc_id, i, k, label, needed, size, token FROM b JOIN v USING (token)),
m AS (SELECT x.doc_id, x.label, count(DISTINCT y.token) / x.size::DOUBLE AS containment
      FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.k = y.k AND y.i >= x.i AND y.i < x.i + 2 * x.size
      GROUP BY x.doc_id, x.k, x.label, x.i, x.needed, x.size HAVING count(DISTINCT y.token) >= x.needed),
g AS (SELECT doc_id, list(DISTINCT label) AS found, max(containment) AS best FROM m GROUP BY doc_id)
SELECT p.doc_id, n_words, len(places)::BIGINT AS n_base,
       list_min(list_transform(places, lambda x: x.s)) AS first_word, list_max(list_transform(places, lambda x: x.s)) AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(places, lambda x: x.l))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_transform(places, lambda x: x.l) || coalesce(found, []))), ',') AS labels,
       CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM p LEFT JOIN g ON p.doc_id = g.doc_id
"""


OP2_SQL = _sql()
