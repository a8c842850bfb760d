"""License scans: MinHash bands over overlapping windows of text retrieve license templates, exact shingle containment
verifies them. DataFrame functions only.

Words are lower-cased runs of letters and digits; a shingle is ``SHINGLE`` words. A text's windows hold ``WINDOW`` shingles and begin at every
``STRIDE``-th word; a template's windows begin at every word. Each of ``BANDS`` bands is one MinHash coordinate of a window.
A template of one shingle lies whole in at least one window of the text, with similarity 1/WINDOW or more: it is missed with a chance of
(1 - 1/WINDOW)**BANDS, 1e-4 at 4 and 32, in each of the WINDOW/STRIDE windows that hold it. A longer one has equal windows.

A template of fewer words than a shingle is looked up as a run of words at every word of the text. Where it is a whole line
(``\\n``-split) its place is the line and no word.

A candidate is confirmed where at least ``CONTAINMENT`` of the template's distinct shingles lie within ``PAD`` words of the
window, on either side, and for a template of more words than that within as many more as it has; of the templates that a window confirms,
those with the most count. The headers of sibling licenses differ in a few words only. So a template that shares at least ``SIBLING`` of the shingles of either with one of another license is decided by the
shingles in which the two differ: ``CONTAINMENT`` of its own must be there in one copy, or a greater share of them than of the other's. (The SQL has
the same templates without this rule; they agree where no text is nearer to two siblings than to one of them.)

The templates are a table (license, template), such as ``read_templates`` makes of a folder of texts; without one they are the usual notices and
the license texts in ``templates/``. They are compared in blocks of about ``BLOCK_WINDOWS`` windows, so what is broadcast has a bound; a longer
template is a block of its own.

Edge cases: null and empty texts and templates match nothing; repeated rows are
reported alike, each; documents of equal id and text count as one; an empty table of either kind gives an empty result; other
columns are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqspark.llm.common import cut, discard

SHINGLE, WINDOW, STRIDE, BANDS = 5, 4, 2, 32
CONTAINMENT = 0.8
SIBLING = 0.5
PAD = 256
BLOCK_WINDOWS = 25_000
TEXTS = Path(__file__).parent / "templates"

#: The usual notices of common licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without prior written permission."),
)


def _words(text: Column) -> Column:
    """Hashes of the words."""
    found = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")
    return F.transform(found, lambda w: F.xxhash64(w))


def _shingle(words: str, at: Column) -> Column:
    """The hash of the shingle at a place, null past the end."""
    word = lambda k: F.get(F.col(words), at + k)
    return F.when(at <= F.size(words) - SHINGLE, F.xxhash64(*[word(k) for k in range(SHINGLE)]))


def _starts(words: str, n: int) -> Column:
    """The places of a text at which n words begin, null where it has fewer. A filter on their number would move below the words and build them
    twice."""
    return F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n))


def _banded(windows: DataFrame, words: str, keep: Sequence[str]) -> DataFrame:
    """A row for each window (its first word is ``at``) and band: the columns in keep, at, band_key."""
    some = windows.select(*keep, "at", *[_shingle(words, F.col("at") + k).alias(f"s{k}") for k in range(WINDOW)])
    some = some.withColumn("band", F.explode(F.array(*[F.lit(k) for k in range(BANDS)])))
    hashed = [F.when(F.col(f"s{k}").isNotNull(), F.xxhash64(f"s{k}", "band")) for k in range(WINDOW)]
    return some.select(*keep, "at", F.xxhash64("band", F.least(*hashed)).alias("band_key"))


def _template_windows(known: DataFrame) -> DataFrame:
    """template_id, band_key of the windows at every word of the templates."""
    some = known.where(F.size("words") >= SHINGLE)
    some = some.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - SHINGLE)))
    return _banded(some, "words", ["template_id"]).select("template_id", "band_key").distinct()


def _text_windows(rows: DataFrame, shingles: list[int]) -> DataFrame:
    """doc_id, h, at, band_key of the windows of texts. One without a shingle of the templates has no MinHash coordinate in common with them, so
    it is left out before it is banded. shingles: those of a block of templates, whose number has its bound."""
    some = rows.withColumn("place", F.explode(_starts("words", SHINGLE)))
    some = some.where(_shingle("words", F.col("place")).isin(shingles))
    first = F.greatest(F.col("place") - WINDOW + 1, F.lit(0))
    starts = F.sequence(first + F.pmod(first, F.lit(STRIDE)), F.col("place") - F.pmod(F.col("place"), F.lit(STRIDE)), F.lit(STRIDE))
    return _banded(some.withColumn("at", F.explode(starts)), "words", ["doc_id", "h"])


def known_templates() -> list[tuple[str, str]]:
    """(license, template) of the usual notices and of the license texts of this library."""
    return [*TEMPLATES, *((f.stem, f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt")))]


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """license (the file's stem), template of a folder of texts."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return files.select(F.regexp_extract("file", r"([^/]+?)(?:\.[a-z]+)?$", 1).alias("license"), F.col("value").alias("template"))


def _numbered(spark: SparkSession, templates: DataFrame | Sequence[tuple[str, str]]) -> DataFrame:
    """template_id, license, template, block. Ids follow license and template; the window holds their lengths and digests, not the texts."""
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame(list(templates), "license string, template string")
    rows = templates.select("license", "template").where("template IS NOT NULL").distinct().withColumn("_digest", F.sha2("template", 256))
    rows = cut(rows.withColumn("_windows", F.size(_words(F.col("template")))))
    order = Window.partitionBy(F.lit(1)).orderBy("license", "_digest")
    ids = rows.select("license", "_digest", "_windows").withColumn("template_id", F.row_number().over(order) - 1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ids = ids.withColumn("block", F.floor((F.sum("_windows").over(upto) - F.col("_windows")) / BLOCK_WINDOWS).cast("int")).drop("_windows")
    return rows.drop("_windows").join(ids, ["license", "_digest"]).select("template_id", "license", "template", "block")


def _template_shingles(templates: DataFrame) -> DataFrame:
    words = templates.withColumn("words", _words(F.col("template"))).where(F.size("words") > 0)
    at = F.sequence(F.lit(0), F.size("words") - SHINGLE)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(SHINGLE)]))
    whole = F.array(F.xxhash64("words"))
    return words.withColumn("shingles", F.when(F.size("words") < SHINGLE, whole).otherwise(F.array_distinct(hashes)))


def _with_siblings(known: DataFrame) -> DataFrame:
    """known with siblings: for each sibling of another license the shingles of the template that it lacks, and the other way round. Siblings share
    SIBLING of the shingles of either, so a whole license is none of a notice."""
    one = known.select("template_id", "license", F.size("shingles").alias("size"), F.explode("shingles").alias("s"))
    two = one.select(F.col("template_id").alias("_id"), F.col("license").alias("_license"), F.col("size").alias("_size"), "s")
    pairs = one.join(two, "s").where("license != _license").groupBy("template_id", "_id", "size", "_size").agg(F.count("*").alias("n"))
    pairs = pairs.where(F.col("n") >= SIBLING * F.greatest("size", "_size")).select("template_id", "_id")
    pairs = pairs.join(known.select("template_id", F.col("shingles").alias("mine")), "template_id")
    pairs = pairs.join(known.select(F.col("template_id").alias("_id"), F.col("shingles").alias("theirs")), "_id")
    differ = F.struct(F.array_except("mine", "theirs").alias("mine"), F.array_except("theirs", "mine").alias("theirs"))
    return known.join(pairs.groupBy("template_id").agg(F.collect_list(differ).alias("siblings")), "template_id", "left")


def _decided(shingles: Column, siblings: Column, region: Column) -> Column:
    """Whether a template is not taken for one of its siblings, in one part of the region that holds a copy and little more: two siblings
    side by side have between them all that tells a third from each. A template that lies whole in its sibling has no shingle of
    its own and is never rejected: its text is there."""
    eighth = F.greatest(F.floor(F.size(shingles) / 8), F.lit(1)).cast("int")
    share = lambda of, part: F.when(F.size(of) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(of, part)) / F.size(of))
    wins = lambda x, part: (share(x["mine"], part) >= CONTAINMENT) | (share(x["mine"], part) > share(x["theirs"], part))
    starts = F.sequence(F.lit(1), F.size(region), eighth)
    return siblings.isNull() | F.exists(starts, lambda i: F.forall(siblings, lambda x: wins(x, F.slice(region, i, F.size(shingles) + 2 * eighth))))


def _place(text: Column, at: Column, n: int) -> Column:
    """The place of a run of n words: -1 less the number of the line that it is the whole of, else its first word."""
    sizes = F.transform(F.split(text, "\n", -1), lambda line: F.size(_words(line)))
    start = F.struct(F.lit(0).alias("word"), F.lit(0).alias("line"), F.lit(None).cast("int").alias("whole"))

    def step(s: Column, size: Column) -> Column:
        whole = F.when((s["word"] == at) & (size == n), s["line"]).otherwise(s["whole"])
        return F.struct((s["word"] + size).alias("word"), (s["line"] + 1).alias("line"), whole.alias("whole"))

    return F.aggregate(sizes, start, step, lambda s: F.coalesce(-1 - s["whole"], at))


def scan(docs: DataFrame, templates: DataFrame | Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, license, n_places (windows at which one of its templates is confirmed), first_word (null for short lines alone), containment (the best)."""
    known = cut(_template_shingles(_numbered(docs.sparkSession, known_templates() if templates is None else templates)))
    # siblings may be in different blocks
    known = cut(_with_siblings(known))
    blocks = sorted(r["block"] for r in known.select("block").distinct().collect())
    out = None
    for i in blocks or [0]:
        part = _scanned(docs, known.where(F.col("block") == i))
        out = part if out is None else out.unionByName(part)
    keys = ["doc_id", "h", "copies", "license"]
    out = out.groupBy(*keys).agg(F.countDistinct("at").alias("n_places"), F.min(F.when(F.col("at") >= 0, F.col("at"))).alias("first_word"), F.max("containment").alias("containment"))
    # a row for each of the equal documents
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", "license", "n_places", "first_word", "containment")


def _scanned(docs: DataFrame, known: DataFrame) -> DataFrame:
    bands = _template_windows(known)
    shingles = [r["s"] for r in known.where(F.size("words") >= SHINGLE).select(F.explode("shingles").alias("s")).distinct().collect()]
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), _words(F.col("text")).alias("words"))
    met = _text_windows(rows, shingles).join(F.broadcast(bands), "band_key")
    met = met.groupBy("doc_id", "h", "at", "template_id").count().select("doc_id", "h", "at", "template_id")
    met = cut(met)
    # the texts of the documents that have candidates, once for equal ones; their number has no bound, so they are not broadcast
    asked = met.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct().hint("merge")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    texts = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left_semi")
    texts = texts.groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    texts = texts.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "copies", _words(F.col("text")).alias("words"))
    at = F.sequence(F.lit(0), F.size("words") - SHINGLE)
    texts = texts.select("_id", "_h", "copies", F.transform(at, lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(SHINGLE)])).alias("text_shingles"))
    near = met.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    near = near.join(F.broadcast(known.select("template_id", "license", "shingles", "siblings", F.size("words").alias("n_words"))), "template_id")
    pad = F.when(F.col("n_words") > PAD, F.col("n_words") + PAD).otherwise(PAD)
    first = F.greatest(F.col("at") - pad, F.lit(0))
    near = near.withColumn("region", F.slice("text_shingles", first + 1, F.col("at") + pad - first + 1))
    contained = F.size(F.array_intersect("shingles", "region")) / F.size("shingles")
    near = near.select("doc_id", "h", "copies", "at", "license", contained.alias("containment"), "shingles", "siblings", "region").where(F.col("containment") >= CONTAINMENT)
    near = near.where(_decided(F.col("shingles"), F.col("siblings"), F.col("region"))).drop("shingles", "siblings", "region")
    best = F.max("containment").over(Window.partitionBy("doc_id", "h", "at"))
    near = near.withColumn("best", best).where("containment = best").drop("best")

    # templates of fewer words than a shingle: containment is equality
    short = known.where(F.size("words") < SHINGLE).select("template_id", "license", F.size("words").alias("n"), F.element_at("shingles", 1).alias("shingle"))
    lengths = sorted(r["n"] for r in short.select("n").distinct().collect())
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text", _words(F.col("text")).alias("words"))
    equal = near.where("false")
    for n in lengths:
        runs = rows.withColumn("at", F.explode(_starts("words", n)))
        run = F.xxhash64(F.array(*[F.get(F.col("words"), F.col("at") + k) for k in range(n)]))
        runs = runs.withColumn("shingle", run).join(F.broadcast(short.where(F.col("n") == n).drop("n")), "shingle")
        runs = runs.select("doc_id", "h", _place(F.col("text"), F.col("at"), n).alias("at"), "license", "template_id")
        runs = runs.groupBy("doc_id", "h", "at", "license", "template_id").agg(F.count("*").alias("copies"))
        equal = equal.unionByName(runs.select("doc_id", "h", "copies", "at", "license", F.lit(1.0).alias("containment")))
    return near.unionByName(equal)
