"""License scans over a positional rare-token index, in DataFrame operations only.

The index holds, for every template, its rare words with their positions (postings). The rarity of a licence word is its
inverse document frequency over the scanned texts. Of each text the positions of its own highest-IDF licence words are
looked up; a posting puts the template's start at the word's place less the posting's, and postings that agree on the
start are added up. A start with enough of the template's words, of those as rare as the ones looked up in this text, is
verified: the template's mandatory key phrases must stand there. A phrase is found by its rarest word, which is always
looked up, and must stand there with all of its words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

RARE = 24  # different licence words of a text that are looked up, the rarest first; those of phrases come on top


@dataclass(frozen=True)
class Template:
    """share: of the template's rare words that must agree on its start; phrases: those that must stand within it."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    share: float = 0.6


#: The contract's phrases and labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Passages of public licence notices. Fixed values.
TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted",)),
    Template("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ("apache license",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("gnu general public license",)),
    Template("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice shall be included",)),
    Template("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", ("the software is provided as is",)),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", ("unless required by applicable law",)),
    Template("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability", ("in the hope that it will be useful",)),
    Template("gpl", "you should have received a copy of the gnu general public license along with this program", ("gnu general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    Template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", ("redistributions in binary form",)),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", ("endorse or promote products",)),
    Template("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", ("person or organization",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", ("in no event will the authors",)),
    Template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
    Template("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights", ("dedicated the work to the public domain",)),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("all-rights-reserved", "all rights reserved", ("all rights reserved",), 1.0),
)


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased, and of characters beyond ASCII; an empty array without any."""
    spaced = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def catalogue(templates=TEMPLATES, phrases=PHRASES) -> list[tuple[int, str, bool, list[str], list[list[str]], float]]:
    """id, label, whether it is a phrase, words, key phrases, share."""
    rows = [(label, True, p.split(), [p.split()], 1.0) for p, label in phrases]
    rows += [(t.label, False, t.text.split(), [p.split() for p in t.phrases], t.share) for t in templates]
    return [(i, *r) for i, r in enumerate(rows)]


def rarity(words: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """IDF of each licence word over the texts of `words` (column w)."""
    one = words.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect("w", F.array(*map(F.lit, vocabulary))))).alias("word"))
    seen = {r.word: r["count"] for r in one.groupBy("word").count().collect()}  # one row for each licence word at most
    return {w: math.log((1 + seen.get("", 0)) / (1 + seen.get(w, 0))) for w in vocabulary}


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES, rare: int = RARE) -> DataFrame:
    """key, n_words, places: an array of (start, label, is_phrase, score) by start, words from 0; one row for each row of df.

    Templates may have any number of words. Rows that share key and text give equal rows; places of one start come by label.
    Null and empty texts have no words and no places. score: the share of the template's looked-up words that stand in
    place, 1 for a phrase. A template's start may lie before the text if its opening words are missing.
    """
    entries = catalogue(templates, phrases)
    vocabulary = sorted({w for e in entries for w in e[3]})
    plain = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_t"))
    idf = rarity(plain.select(words_of(F.col("_t")).alias("w")), vocabulary)
    place = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (-idf[w], w)))}
    index, detail = [], []
    for i, label, is_phrase, words, keys, share in entries:
        chosen = sorted(range(len(words)), key=lambda p: (place[words[p]], p))[: 1 if is_phrase else max(2, len(words) * 3 // 5)]
        index += [(words[p], i, p, k) for k, p in enumerate(chosen)]
        detail.append((i, label, is_phrase, len(words), [" " + " ".join(k) + " " for k in keys], [place[words[p]] for p in chosen], share))
    spark, longs = df.sparkSession, 1 + max(x[3] for x in index) // 64
    posting = spark.createDataFrame(index, "word string, template int, offset int, bit int").join(
        spark.createDataFrame(detail, "template int, label string, is_phrase boolean, long int, keys array<string>, places array<int>, share double"), "template"
    )
    # As long as the templates' rare words: the catalogue bounds it, not the corpus.
    names = ["template", "offset", "bit", "label", "is_phrase", "long", "keys", "places", "share"]
    posting = posting.groupBy("word").agg(F.max("long").alias("reach"), F.collect_list(F.struct(*names)).alias("found"))

    listed = sorted({x[0] for x in index})
    anchors = {words[min(range(len(words)), key=lambda p: (place[words[p]], p))] for _, _, is_phrase, words, _, _ in entries if is_phrase}
    ranks = F.create_map(*[F.lit(x) for w in listed for x in (w, place[w])])
    reach = {w: max(len(entries[i][3]) for v, i, _, _ in index if v == w) for w in listed}
    reach = F.create_map(*[F.lit(x) for w in listed for x in (w, reach[w])])
    split = plain.select("_key", F.xxhash64("_t").alias("_x"), words_of(F.col("_t")).alias("w"))
    rows = split.withColumn("n", F.size("w")).withColumn("own", F.array_sort(F.transform(F.array_intersect("w", F.array(*map(F.lit, listed))), lambda x: F.element_at(ranks, x))))
    rows = rows.withColumn("cut", F.when(F.size("own") > rare, F.element_at("own", rare)).otherwise(F.lit(len(vocabulary))))
    looked = lambda x: x["word"].isin(*anchors) | (F.element_at(ranks, x["word"]) <= F.col("cut"))
    hits = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("pos"), x.alias("word"))), lambda x: x["word"].isin(*listed) & looked(x))
    # A hit takes the words around it along, as far as its templates reach, so that the text itself goes no further.
    around = lambda x: F.slice("w", F.greatest(x["pos"] - F.element_at(reach, x["word"]), F.lit(0)) + 1, 2 * F.element_at(reach, x["word"]))
    hits = F.transform(hits, lambda x: F.struct(x["pos"].alias("pos"), x["word"].alias("word"), around(x).alias("near")))
    none = F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("array<string>").alias("near")))
    # A row for the text itself, whose template is -1, carries its number of words.
    each = rows.select("_key", "_x", "n", "cut", F.explode(F.concat(none, hits)).alias("h")).select("_key", "_x", "n", "cut", "h.*")
    own = F.array(F.struct(F.lit(-1).alias("template"), *[F.lit(None).cast(f"{t}").alias(c) for c, t in (("offset", "int"), ("bit", "int"), ("label", "string"), ("is_phrase", "boolean"), ("long", "int"), ("keys", "array<string>"), ("places", "array<int>"), ("share", "double"))]))
    met = each.join(F.broadcast(posting), "word", "left").select("_key", "_x", "n", "cut", "pos", "near", "reach", F.explode(F.coalesce("found", own)).alias("f")).select("_key", "_x", "n", "cut", "pos", "near", "reach", "f.*")
    # An anchor that is looked up for its phrase only says nothing of other templates.
    met = met.where((F.col("template") < 0) | F.col("is_phrase") | (F.get("places", F.col("bit")) <= F.col("cut")))
    start = F.col("pos") - F.col("offset")
    from_ = start - F.greatest(F.col("pos") - F.col("reach"), F.lit(0))  # the template's start among the words around
    stretch = F.concat(F.lit(" "), F.array_join(F.slice("near", F.greatest(from_, F.lit(0)) + 1, F.greatest(F.col("long") + F.least(from_, F.lit(0)), F.lit(0))), " "), F.lit(" "))
    keyed = F.forall("keys", lambda k: F.contains(stretch, k))
    size = F.size(F.filter("places", lambda p: F.col("is_phrase") | (p <= F.col("cut"))))
    votes = met.select("_key", "_x", "n", "template", start.alias("start"), "label", "is_phrase", size.alias("size"), "share", "bit", F.when(F.col("template") >= 0, keyed).alias("ok"))
    # A bit for each of a template's rare words, in as many numbers as the longest template needs.
    agreed = sum((F.bit_count(F.bit_or(F.expr(f"IF(bit div 64 = {j}, shiftleft(1L, bit % 64), 0L)"))) for j in range(longs)), F.lit(0))
    starts = votes.groupBy("_key", "_x", "template", "start", "label", "is_phrase", "size", "share").agg(
        F.max("n").alias("n"), F.count("*").alias("rows"), agreed.alias("votes"), F.max("ok").alias("ok")
    )
    good = F.col("ok") & (F.col("votes") >= F.ceil(F.col("share") * F.col("size")))
    found = F.struct("start", "label", "is_phrase", F.try_divide("votes", "size").alias("score"))
    per = starts.groupBy("_key", "_x").agg(
        F.max("n").cast("long").alias("n_words"), F.sum(F.when(F.col("template") < 0, F.col("rows"))).alias("copies"), F.array_sort(F.collect_list(F.when(good, found))).alias("places")
    )
    # Equal rows are numbered in two steps, so that no array is as long as their number.
    block = 1 << 12
    blocks = per.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {block}"))))
    whole = blocks.withColumn("_c", F.explode(F.sequence(F.col("_b") * block + 1, F.least("copies", (F.col("_b") + 1) * block))))
    return whole.select(F.col("_key").alias(key), "n_words", "places")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence phrases and notices of every document; null and empty texts have no words, places or labels.

    Rows that share doc_id and text give equal rows; score is the best place's, 0 without one. Labels of one start are sorted
    and count once. An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.filter("places", lambda p: p["is_phrase"])
    starts = F.transform(base, lambda p: p["start"].cast("long"))
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda p: p["label"]))), ",")
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )
