"""License scans by diagonal voting. DataFrame functions only.

All rolling word k-grams of the texts are joined with the positions of the templates' k-grams. A match votes for the diagonal
(position in the text less position in the template); neighbouring diagonals are merged, as a few words more or fewer shift
them, and a span is verified by how many of the template's k-grams it holds and how densely. Results depend on the text
alone: votes are gathered by text, so that copies, which vote alike, add up to one row before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept_names, table

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Longer templates, wordings of public licenses; these may be found in part.
TEMPLATES = {
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
    "either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the "
    "implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details": "gpl",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
    "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
    "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license": "apache",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
    "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
    "software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must "
    "retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of "
    "conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    "this work is licensed under a creative commons attribution": "cc-by",
    "all rights reserved": "proprietary",
}
#: Words of a k-gram (a shorter template is one), how far a match may shift, the share of a span's places that must match, and its k-grams.
K, SHIFT, SHARE, LEAST = 3, 2, 0.7, 6


#: A run of what is neither ASCII punctuation, space nor control: `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`, A-Z being letters
#: like a-z. Its characters are named one by one, as Java looks those up in a table and tests ranges one after the other.
WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"


def words(text: str) -> Column:
    """Words of the text as they stand, in capitals or not; null has none."""
    return F.regexp_extract_all(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.lit(WORD), F.lit(0))


def lowered(word: Column) -> Column:
    """The word with A-Z, and nothing else, lower-cased; lower() does just that where all is ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def template_grams(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """(template, label, base, grams, k, at, first, second, third); constants, so it can be broadcast whatever the corpus is."""
    rows = []
    for i, (text, label, base) in enumerate([(t, x, True) for t, x in phrases.items()] + [(t, x, False) for t, x in templates.items()]):
        w = text.split(" ")
        k = min(K, len(w))
        for j in range(len(w) - k + 1):
            gram = [*w[j : j + k], *[""] * (K - k)]
            rows.append((i, label, base, len(w) - k + 1, k, j, *gram))
    # As literals: the texts' own session makes the rows, nothing is sent from the driver's Python.
    names = ["template", "label", "base", "grams", "k", "at", "first", "second", "third"]
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])))


def scan(docs: DataFrame, keep: list[str], text: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, shift: int = SHIFT, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """The columns keep, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score, places.

    places are the verified spans, "label:first word-last word". Base places are those where a phrase stands word for word. A
    template counts where a span over diagonals up to shift apart holds least of its k-grams (a shorter template: all) and share of
    the span's places match; score is the largest such share (1 at a base place, 0 without any label).
    Null and empty texts have no words, counts of 0 and no labels; equal texts have equal results, and repeated rows stay. A
    kept column with a result's name gets `_source` appended.
    """
    spark = docs.sparkSession
    if short := [x for x in [*phrases, *templates] if len(x.split(" ")) < 2]:
        raise ValueError(f"templates need two words or more: {', '.join(short)}")
    key = F.md5(F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")))
    grams = template_grams(spark, phrases, templates).withColumn("h", F.xxhash64("first", "second"))
    tokens = words(text)
    # Words are found once in each text (a filter on their number would find them again, below the projection), and beside each
    # word stand its text's words. Most places are left out before the join, where no template has the first or second word.
    places = docs.select(key.alias("__key"), tokens.alias("w")).select("__key", "w", F.posexplode_outer("w").alias("pos", "word"))
    after = lambda i: lowered(F.get("w", F.col("pos") + i))
    firsts, seconds = (sorted({t.split(" ")[i + j] for t in [*phrases, *templates] for j in range(max(1, len(t.split(" ")) + 1 - K))}) for i in (0, 1))
    pairs = places.where(lowered(F.col("word")).isin(firsts)).where(after(1).isin(seconds)).select("__key", "pos", lowered(F.col("word")).alias("a"), after(1).alias("b"), after(2).alias("c"))
    # A gram is found by the hash of its first two words and decided by all of them; a template of two words has no third.
    same = (F.xxhash64("a", "b") == F.col("h")) & (F.col("a") == F.col("first")) & (F.col("b") == F.col("second")) & ((F.col("third") == "") | (F.col("c") == F.col("third")))
    votes = pairs.join(F.broadcast(grams), same).select("__key", "template", "label", "base", "grams", "k", (F.col("pos") - F.col("at")).alias("diagonal"), "at")
    of = ["__key", "template", "label", "base", "grams", "k"]
    diagonals = votes.groupBy(*of, "diagonal").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    # Of a diagonal, runs of places: what lies far apart on it is no span.
    far = lambda a, i: (i == 0) | (F.get(a, i) - F.get(a, i - 1) > LEAST)
    cuts = F.filter(F.transform("ats", lambda x, i: F.when(far(F.col("ats"), i), i)), lambda i: i.isNotNull())
    runs = diagonals.withColumn("cuts", F.concat(cuts, F.array(F.size("ats"))))
    pieces = F.transform(F.slice("cuts", 1, F.size("cuts") - 1), lambda c, j: F.slice("ats", c + 1, F.get("cuts", j + 1) - c))
    runs = runs.select(*of, "diagonal", F.explode(pieces).alias("ats"))
    runs = runs.select(*of, "diagonal", F.size("ats").alias("n"), (F.col("diagonal") + F.array_min("ats")).alias("start"), (F.col("diagonal") + F.array_max("ats") + F.col("k") - 1).alias("stop"))
    # Neighbouring diagonals, of one text and template only: runs that follow each other with a small shift are one span.
    line = Window.partitionBy("__key", "template").orderBy("start", "diagonal")
    before = lambda c: F.lag(c).over(line)
    fresh = before("start").isNull() | F.col("base") | (F.abs(F.col("diagonal") - before("diagonal")) > shift) | (F.col("start") - before("stop") > LEAST)
    merged = runs.withColumn("span", F.sum(fresh.cast("int")).over(line))
    found = merged.groupBy(*of, "span").agg(F.sum("n").alias("n"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    found = found.withColumn("part", F.least(F.lit(1.0), F.col("n") / (F.col("stop") - F.col("start") + 2 - F.col("k"))))
    found = found.where(F.when(F.col("base"), F.col("n") == F.col("grams")).otherwise((F.col("n") >= F.least(F.col("grams"), F.lit(least))) & (F.col("part") >= share)))
    own = F.when(F.col("base"), F.col("start"))
    texts = found.groupBy("__key").agg(
        F.count(own).alias("n_base"), F.min(own).alias("first_word"), F.max(own).alias("last_word"), F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set("label")).alias("labels"), F.max("part").alias("score"), F.array_sort(F.collect_set(F.concat_ws(":", "label", F.concat_ws("-", "start", "stop")))).alias("places"),
    )
    names = [f"c{i}" for i in range(len(keep))]
    # A group of copies is joined to one row; it is dealt out to so many tasks, and the results, few and narrow, are repeated.
    salts = 16
    narrow = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], key.alias("__key"), F.size(tokens).cast("long").alias("n_words"), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).alias("__salt"))
    texts = texts.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    none = F.array().cast("array<string>")
    results = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "places", "score"]
    return narrow.join(texts, ["__key", "__salt"], "left").select(
        *[F.col(n).alias(c) for n, c in zip(names, kept_names(keep, results))], "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        *[F.coalesce(c, none).alias(c) for c in ("base_labels", "labels", "places")], F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
