"""Licence notices in texts, by MinHash bands over overlapping windows and exact containment.

A text is a sequence of words (lower case, punctuation taken as space), and every five
neighbouring words are a shingle. Two kinds of windows run over it. Narrow windows hold one
shingle and start at every word; wide windows hold eight and start at every eighth word.
Templates are cut into the same windows, but at every word, so of a template of 15 shingles or
more, wherever it stands, a whole wide text window falls on a template window; shorter templates
use the narrow windows. Each window has six minima of hash functions, each a band of its own:
windows with a similarity of 0.8 meet in a band with a probability over 0.9999. A narrow
window's minima are all those of its one shingle, so it has one band.

A window that meets a template is verified: the share of the template's shingles that stand in
the text around it has to reach the threshold. Where two templates rest on the same words, the
one that is contained more is reported. The templates are a list of fixed size,
so their bands are broadcast. Only column expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.texts import only

WIDTH = 5
WIDE = 8
BANDS = 6
_WORD_SIGNS = r"[^\p{L}\p{N}]+"

#: Notices of common licences, as their publishers word them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation",
    ),
    (
        "LGPL",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation",
    ),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-2.0", "Released under the GNU General Public License, version 2."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "Released under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "Released under the GNU Lesser General Public License, version 3."),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    (
        "AGPL-3.0",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, "
        "specifically designed to ensure cooperation with the community in the case of network server software.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software.",
    ),
)


def words_of(text: Column) -> Column:
    """The words of a text, punctuation taken as space, in lower case; null has none."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _WORD_SIGNS, " ")
    return F.split(F.trim(spaced), " ")


def _shingle(words: Column, start: Column) -> Column:
    return F.xxhash64(*[F.get(words, start + i) for i in range(WIDTH)])


def shingles_of(words: Column) -> Column:
    """The hashes of all shingles of a short array of words."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - WIDTH, F.lit(0)))
    found = F.transform(starts, lambda i: _shingle(words, i))
    return F.when(F.size(words) >= WIDTH, F.array_distinct(found)).otherwise(F.array().cast("array<bigint>"))


def _wide_keys(shingles: list[Column]) -> list[Column]:
    """A key for each band of a wide window: the least of its shingles' hashes."""
    return [F.xxhash64(F.lit(band), F.least(*[F.xxhash64(s, F.lit(band)) for s in shingles])) for band in range(BANDS)]


def template_bands(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> tuple[DataFrame, DataFrame]:
    """The templates (``template``, ``license``, ``n_words``, ``shingles``), and ``key`` and ``template`` of their windows."""
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    given = spark.createDataFrame(rows, "template int, license string, text string")
    given = given.select("template", "license", words_of(F.col("text")).alias("words"))
    known = given.select("template", "license", F.size("words").alias("n_words"), shingles_of(F.col("words")).alias("shingles"), "words")
    known = known.where(F.size("shingles") > 0)
    starts = F.explode(F.sequence(F.lit(0), F.col("n_words") - WIDTH))
    placed = known.select("template", "n_words", "words", starts.alias("start"))
    wide = [_shingle(F.col("words"), F.col("start") + i) for i in range(WIDE)]
    long = F.col("n_words") - WIDTH + 1 >= 2 * WIDE - 1
    narrow_keys = placed.where(~long).select(_shingle(F.col("words"), F.col("start")).alias("key"), "template")
    wide_rows = placed.where(long & (F.col("start") + WIDE + WIDTH - 1 <= F.col("n_words")))
    wide_keys = wide_rows.select(F.explode(F.array(*_wide_keys(wide))).alias("key"), "template")
    return known.drop("words"), narrow_keys.union(wide_keys).distinct()


def license_notices(
    df: DataFrame,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    id_column: str = "doc_id",
    text_column: str = "text",
    percent: int = 80,
) -> DataFrame:
    """The licences whose notices stand in a text.

    A notice is found if ``percent`` per cent of a template's distinct five-word shingles stand
    in the text within a template's length of a window that met it. Returns a row per document
    and template: ``key`` (names the document, by its text if it has no id), ``id``,
    ``license``, ``template`` (number in ``templates``), ``contained`` (share of the
    shingles), ``first_word`` (where the window starts; the first of the best). A place of a
    template is left out if at least half of its shingles there are shingles of one that is
    contained more; its other places stay, and so do notices side by side. Templates of less than five words are
    not searched. Null and empty texts have no notices. Rows that repeat an id give one row.
    """
    spark = df.sparkSession
    known, bands = template_bands(spark, templates)
    rows = only(df, {"id": id_column, "text": text_column}).withColumn("text", F.col("text").cast("string"))
    worded = rows.select("id", F.when(F.col("id").isNull(), F.sha2("text", 256)).alias("digest"), words_of(F.col("text")).alias("words"))
    last = F.greatest(F.size("words") - 1, F.lit(0))
    windows = worded.select("id", "digest", "words", F.explode(F.sequence(F.lit(0), last, F.lit(WIDE))).alias("start"))
    named = [f"s{i}" for i in range(WIDE)]
    windows = windows.select("*", *[_shingle(F.col("words"), F.col("start") + i).alias(s) for i, s in enumerate(named)])
    keys = F.array(*[F.col(s) for s in named], *_wide_keys([F.col(s) for s in named]))
    met = windows.select("id", "digest", "words", "start", F.explode(keys).alias("key")).join(F.broadcast(bands), "key")
    near = met.join(F.broadcast(known), "template")
    before = F.greatest(F.col("start") - F.col("n_words"), F.lit(0))
    around = F.slice(F.col("words"), before + 1, 2 * F.col("n_words") + F.lit(2 * WIDE + WIDTH))
    near = near.select("id", "digest", "license", "template", "start", "shingles", before.alias("before"), around.alias("around"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("around") - WIDTH, F.lit(0)))
    near = near.where(F.size("around") >= WIDTH).withColumn("here", F.transform(starts, lambda i: _shingle(F.col("around"), i)))
    share = F.size(F.array_intersect("shingles", "here")) / F.size("shingles")
    stands = F.transform("here", lambda s, i: F.when(F.array_contains("shingles", s), F.col("before") + i))
    found = near.select("id", "digest", "license", "template", "start", share.alias("contained"), F.array_compact(stands).alias("hits"))
    good = found.where(F.round(F.col("contained") * 1_000_000) >= percent * 10_000).distinct()
    key = F.coalesce(F.concat(F.lit("id:"), F.col("id").cast("string")), F.concat(F.lit("text:"), F.col("digest")))
    good = good.select(key.alias("key"), "id", "license", "template", "start", "contained", F.explode("hits").alias("hit"))
    # the most contained template on each shingle of a text
    top = F.max("contained").over(Window.partitionBy("key", "hit"))
    places = good.withColumn("beaten", (top > F.col("contained")).cast("int")).groupBy("key", "id", "license", "template", "start", "contained")
    left = places.agg(F.sum("beaten").alias("beaten"), F.count("*").alias("hits")).where("2 * beaten < hits")
    best = F.max(F.struct("contained", (-F.col("start")).alias("back"))).alias("best")
    out = left.groupBy("key", "id", "license", "template").agg(best)
    return out.select("key", "id", "license", "template", F.col("best.contained").alias("contained"), (-F.col("best.back")).alias("first_word"))
