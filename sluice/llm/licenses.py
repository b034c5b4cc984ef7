"""License scans: MinHash bands over overlapping windows, then exact containment.

Texts and templates become word shingles. A window that shares no shingle with any template
can match none, so only windows around shared shingles are sketched. Windows have the
length of a template and overlap by three quarters; their MinHash bands are joined with the
templates' bands, and a candidate counts if the window and its margin hold at least
``containment`` of the template's shingles.

With bands of two rows, a window that shares half of all shingles with a template agrees on
one of 24 bands with probability 1 - (1 - 0.25) ** 24 = 0.999.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import keep

SHINGLE = 3
BANDS = 24
ROWS = 2
CONTAINMENT = 0.8

# Name and wording of public licence notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under"
        " the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY"
        " KIND, either express or implied. See the License for the specific language governing"
        " permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files (the Software), to deal in the Software"
        " without restriction, including without limitation the rights to use, copy, modify,"
        " merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
        " permit persons to whom the Software is furnished to do so.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
        " without fee is hereby granted, provided that the above copyright notice and this"
        " permission notice appear in all copies.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Licensed under the ISC License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("GPL-3.0", "Licensed under the GNU GPL, version 3."),
)


def lower_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def shingles(words: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of ``size`` words. ``words`` is a stored column: it is read per word."""
    tail = F.slice(words, size, F.greatest(F.size(words) - (size - 1), F.lit(0)))
    return F.transform(
        tail, lambda w, i: F.xxhash64(*[F.get(words, i + j) for j in range(size - 1)], w)
    )


def bands(window: Column, n_bands: int = BANDS, rows: int = ROWS) -> Column:
    """(band, key) of a window's MinHash: the least hash under ``n_bands * rows`` seeds."""
    low = lambda seed: F.array_min(F.transform(window, lambda h: F.xxhash64(h, F.lit(seed))))
    return F.array(
        *[
            F.struct(
                F.lit(b).alias("band"),
                F.xxhash64(*[low(b * rows + r) for r in range(rows)]).alias("key"),
            )
            for b in range(n_bands)
        ]
    )


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """``t``, ``name``, ``shingles`` and ``n`` of every template: one row per given text."""
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    frame = spark.createDataFrame(rows, "t int, name string, text string")
    frame = frame.withColumn("words", lower_words(F.col("text")))
    frame = frame.select("t", "name", F.array_distinct(shingles(F.col("words"))).alias("shingles"))
    return frame.withColumn("n", F.size("shingles")).where("n > 0")


def scan_licenses(
    docs: DataFrame,
    text: str = "text",
    templates=TEMPLATES,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """License notices of every text; one output row per input row.

    Returns ``row`` (the input columns but the text) and ``licenses``: an array, by name,
    of (name, first_shingle, n_shingles, containment), the best window of each name, the
    first one among equals. Null, empty and shorter texts have none. Templates are a fixed
    list, so their tables are broadcast; windows are sketched once per distinct text.
    """
    slim = docs.drop(text)
    rest = F.struct(*[F.col(f"`{c}`") for c in slim.columns]) if slim.columns else F.struct(F.lit(0))
    known = template_table(docs.sparkSession, templates)
    wanted = known.agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("w")).scalar()
    value = F.col(f"`{text}`")
    base = docs.select(rest.alias("row"), value.alias("body"), lower_words(value).alias("words"))
    base = base.withColumn("s", shingles(F.col("words")))
    base = base.withColumn("near", F.arrays_overlap("s", wanted))
    found = base.select(
        "row",
        F.when(F.col("near"), F.sha2("body", 256)).alias("key"),
        F.when(F.col("near"), F.col("s")).alias("s"),
    )
    found = keep(found, "license-shingles")

    texts = found.where(F.col("key").isNotNull()).select("key", "s").dropDuplicates(["key"])
    spots = texts.select("key", "s", F.posexplode("s").alias("at", "h"))
    terms = known.select("t", "n", F.explode("shingles").alias("th"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 4).cast("int"))
    # Windows on the template's grid that hold a shared shingle.
    windows = (
        spots.select("key", "at", "h")
        .join(F.broadcast(terms), F.col("h") == F.col("th"))
        .select(
            "key",
            "t",
            "n",
            step.alias("step"),
            F.explode(
                F.sequence(
                    F.floor(F.greatest(F.lit(0), F.col("at") - F.col("n") + 1) / step),
                    F.floor(F.col("at") / step),
                )
            ).alias("cell"),
        )
        .select("key", "n", "step", (F.col("cell") * F.col("step")).cast("int").alias("first"))
        .distinct()
    )
    cut = windows.join(texts, "key").select(
        "key",
        "first",
        F.col("n").alias("len"),
        F.slice("s", F.col("first") + 1, F.col("n")).alias("window"),
        F.slice(
            "s",
            F.greatest(F.lit(1), F.col("first") + 1 - F.col("step")),
            F.col("n") + 2 * F.col("step"),
        ).alias("wide"),
    )
    sketched = cut.select("key", "first", "len", "wide", F.explode(bands(F.col("window"))).alias("x"))
    side = known.select(
        "t", "name", "n", F.col("shingles").alias("ts"), F.explode(bands(F.col("shingles"))).alias("y")
    )
    hits = sketched.join(
        F.broadcast(side),
        (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("len") == F.col("n")),
    )
    share = F.size(F.array_intersect("ts", "wide")) / F.col("n")
    hits = hits.select("key", "name", "first", "len", share.alias("share")).where(F.col("share") >= containment)
    best = hits.groupBy("key", "name").agg(
        F.max(F.struct("share", (-F.col("first")).alias("back"), "len")).alias("m")
    )
    item = F.struct(
        "name",
        (-F.col("m.back")).alias("first_shingle"),
        F.col("m.len").alias("n_shingles"),
        F.col("m.share").alias("containment"),
    )
    per_key = best.groupBy(F.col("key").alias("_key")).agg(F.sort_array(F.collect_list(item)).alias("licenses"))
    empty = F.array().cast("array<struct<name:string,first_shingle:int,n_shingles:int,containment:double>>")
    # Texts without a shared shingle have no key, and are not joined.
    some = found.where(F.col("key").isNotNull()).select("row", "key")
    some = some.join(per_key, F.col("key") == F.col("_key"), "left").select("row", "licenses")
    others = found.where(F.col("key").isNull()).select("row", F.lit(None).alias("licenses"))
    return some.unionByName(others).select("row", F.coalesce("licenses", empty).alias("licenses"))
