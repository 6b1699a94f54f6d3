"""License scans by MinHash over overlapping windows; DataFrame functions only.

Texts become lower-case words of letters and digits, and shingles of five words. Templates are licence notices of a few
words up to whole texts. For each size class c, templates of 2**(c-2) to 2**(c-1) shingles, a document is covered by
windows of 2**c shingles that overlap by half, so any passage as long as such a template lies whole in one window. A
window is a candidate for a template if they agree on one of the MinHash bands. A passage with SIMILARITY of a template's
shingles shares at least 0.8 * 2**(c-2) of the at most 1.2 * 2**c shingles of both; the number of bands (rows of one
hash) follows from this worst case and the wanted probability of a collision, 1 - (1 - j)**bands >= RECALL. Candidates are verified by exact
containment: distinct template shingles, as text, found in the window.

A band can only agree if the window has the very shingle that gives the template its least hash. So the template side's
shingles are pushed into the scan of documents as a set: windows without any of them can't collide and are not hashed.
That set and the bands' table go with the plan as constants of at most bands * TEMPLATES_AT_ONCE entries; a larger
library is scanned in as many blocks. Only the windows that collide leave the scan, and only their counts are shuffled.

Defined results: null, empty and short texts (fewer than five words) have no shingles and no rows; repeated rows give
repeated rows of results, one for each document row and licence, with the first passage's place; an empty table gives
an empty table; very long texts have more windows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrain.llm._common import table

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999
TEMPLATES_AT_ONCE = 100

#: Notices as licences prescribe or suggest them, licence and words.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def word_array(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once; a column that a lambda mentions would be evaluated for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(items: Column) -> Column:
    """0-based places of an array's shingles."""
    n = F.size(items) - F.lit(SHINGLE_WORDS)
    return F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))


def _shingle_texts(words: Column) -> Column:
    return _let(words, lambda w: F.transform(_places(w), lambda i: F.array_join(F.slice(w, i + 1, SHINGLE_WORDS), " ")))


def _shingle_hashes(words: Column) -> Column:
    """Hash of each shingle, made of its words' hashes."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return _let(hashed, lambda h: F.transform(_places(h), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE_WORDS)])))


def bands_for(recall: float = RECALL, similarity: float = SIMILARITY) -> int:
    """Bands of one row that collide with this probability in the worst case of a window twice to four times as long."""
    worst = similarity * 0.25 / (1 + (1 - similarity) * 0.25)
    return math.ceil(math.log(1 - recall) / math.log(1 - worst))


def _band_hash(shingle: Column, band: Column) -> Column:
    return F.xxhash64(shingle, band)


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """template_id, license, shingles (texts), hashes, class; notices of fewer than five words have no shingle and no row."""
    rows = [(k, name, text) for k, (name, text) in enumerate(templates)]
    words = spark.createDataFrame(rows, "template_id int, license string, text string").select("template_id", "license", word_array(F.col("text")).alias("words"))
    df = words.select("template_id", "license", F.array_distinct(_shingle_texts(F.col("words"))).alias("shingles"), F.array_distinct(_shingle_hashes(F.col("words"))).alias("hashes"))
    size = F.size("shingles")
    # class c: at most 2**(c-1) shingles
    return df.where(size > 0).withColumn("class", (F.ceil(F.log2(size.cast("double"))) + 1).cast("int"))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, license, template, containment, first_word: a row for each document and template found in it.

    containment is that of the best window, first_word the place of the first shingle that any such window shares.
    """
    blocks = [templates[k : k + TEMPLATES_AT_ONCE] for k in range(0, len(templates), TEMPLATES_AT_ONCE)] or [()]
    return reduce(DataFrame.unionByName, [_scan_block(docs, b, similarity) for b in blocks])


def _scan_block(docs: DataFrame, templates: Sequence[tuple[str, str]], similarity: float) -> DataFrame:
    spark = docs.sparkSession
    bands = bands_for(similarity=similarity)
    known = template_table(spark, templates)
    every_band = F.sequence(F.lit(0), F.lit(bands - 1))
    # each band's least hash and the shingle that has it
    least = F.array_min(F.transform("hashes", lambda h: F.struct(_band_hash(h, F.col("band")).alias("value"), h.alias("shingle"))))
    signed = known.withColumn("band", F.explode(every_band)).withColumn("least", least)
    # the library's own rows, not the corpus's: bands for each of TEMPLATES_AT_ONCE templates
    library = signed.select("template_id", "class", F.xxhash64("class", "band", "least.value").alias("key"), F.col("least.shingle").alias("anchor")).collect()
    classes, anchors = sorted({r["class"] for r in library}), sorted({r.anchor for r in library})
    owners: dict[int, list[int]] = {}
    for r in library:
        owners.setdefault(r.key, []).append(r.template_id)
    keys = sorted(owners)
    table_of_keys = F.map_from_arrays(F.array(*map(F.lit, keys)).cast("array<bigint>"), F.array(*[F.array(*map(F.lit, owners[k])) for k in keys]).cast("array<array<int>>"))

    def parsed(words: Column) -> Column:
        return _let(words, lambda w: _let(_shingle_hashes(w), lambda sh: F.struct(w.alias("words"), sh.alias("sh"), hits(sh).alias("hits"))))

    def hits(sh: Column) -> Column:
        return F.filter(F.transform(sh, lambda h, i: F.when(h.isin(anchors), i)), lambda i: i.isNotNull())

    def windows(c: int) -> Column:
        # the two windows of class c over each hit: class and first shingle
        step = 1 << (c - 1)
        both = F.flatten(F.transform("p.hits", lambda i: F.array(F.floor(i / step) * step, F.greatest(F.floor(i / step) - 1, F.lit(0)) * step)))
        return F.transform(F.array_distinct(both), lambda s: F.struct(F.lit(c).alias("class"), s.cast("int").alias("first")))

    # explode_outer of one element holds the parsed text as a value; a projection could be evaluated again for each use
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode_outer(F.array(parsed(word_array(F.col("text"))))).alias("p"))
    # rows are numbered, so that repeated documents stay apart
    found = texts.where(F.size("p.hits") > 0).withColumn("row", F.monotonically_increasing_id())
    none = F.array().cast("array<struct<class:int,first:int>>")
    spread = found.withColumn("w", F.explode(F.concat(none, *[windows(c) for c in classes])))
    length = F.pow(F.lit(2), F.col("w.class")).cast("int")
    cut = spread.select("row", "doc_id", "w", F.slice("p.words", F.col("w.first") + 1, length + SHINGLE_WORDS - 1).alias("words"), F.slice("p.sh", F.col("w.first") + 1, length).alias("sh"))

    def signature(sh: Column) -> Column:
        return F.transform(every_band, lambda b: F.xxhash64(F.col("w.class"), b, F.array_min(F.transform(sh, lambda h: _band_hash(h, b)))))

    collided = F.filter(_let(F.col("sh"), signature), lambda k: k.isin(keys))
    owned = F.array_distinct(F.flatten(F.transform(collided, lambda k: F.element_at(table_of_keys, k))))
    candidates = cut.select("row", "doc_id", F.col("w.first").alias("first"), "words", F.explode(owned).alias("template_id"))
    named = known.select("template_id", F.col("license").alias("license"), "shingles")
    joined = candidates.join(F.broadcast(named), "template_id").withColumn("own", _shingle_texts(F.col("words")))
    verified = joined.withColumn("matched", F.array_intersect("shingles", "own"))
    verified = verified.withColumn("containment", F.size("matched") / F.size("shingles")).where(F.col("containment") >= similarity)
    # where the passage begins: the first of its shingles in the window
    at = F.col("first") + _let(F.struct("matched", "own"), lambda x: F.array_min(F.transform(x["matched"], lambda m: F.array_position(x["own"], m)))).cast("int") - 1
    placed = verified.select("row", "doc_id", "template_id", "license", "containment", at.alias("at"))
    return placed.groupBy("row", "doc_id", "template_id", "license").agg(
        F.max("containment").alias("containment"), F.min("at").alias("first_word")
    ).select("doc_id", "license", F.element_at(F.array(*[F.lit(t) for _, t in templates] or [F.lit("")]), F.col("template_id") + 1).alias("template"), "containment", "first_word")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan of the whole documents table for TEMPLATES; see the module for nulls, repeated rows and empty tables."""
    return scan(table(spark, sf_dir, "documents"))
