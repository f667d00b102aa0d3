"""License scans by MinHash bands over overlapping text windows (native
DataFrame code only).

Texts and license templates are reduced to lower-case words of letters and
digits and to shingles of five words. A template part of L words is looked for
in windows of W words with stride W/4, W the smallest of a geometric series
with W >= L + W/4; so one window always holds an occurrence whole, and its
Jaccard similarity with the part is at least (L-4)/(W-4) > 0.2. Windows and
parts get ``BANDS`` MinHash bands of one row each: the chance that a window
with that similarity meets no band is below (1 - 0.2)^BANDS, 0.0002 for 40.
Retrieved parts are verified by exact shingle containment (0.8 of the
template's shingles).

A window can only meet a part in a band if it holds one of the part's
shingles, so texts (and windows) without any shingle of any template are
passed over before the MinHash values are taken; this loses nothing and keeps
the costly part to texts with license-like words.

Edge cases: null, empty and shorter texts than a shingle match nothing;
templates of fewer than five words are refused; repeated rows give one result
per (id, license) of the equal ids together; an empty table gives an empty
result; other columns are ignored. No text is shuffled: only windows of
matching texts are (shingle hashes), by (id, window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written
from .text import let, window_hashes

SHINGLE = 5
BANDS = 40
MIN_CONTAINMENT = 0.8
PART_WORDS = 96
# window sizes (words); stride is a quarter of each
SIZES = (8, 12, 20, 32, 52, 84, 136)
# License notices to look for: public wordings, fixed values.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files (the \"Software\"), to deal in the "
            "Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software "
                   "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                   "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the "
            "terms of the GNU General Public License as published by the Free Software "
            "Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, "
            "are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, "
                "v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International "
                  "License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
                     "International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def license_words(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.array_remove(F.split(plain, " "), "")


def window_size(part_words: int) -> int:
    return next(w for w in SIZES if w >= part_words + w // 4)


def template_parts(spark: SparkSession, templates: list[tuple[str, str]]) -> list[dict]:
    """Parts of the templates with their window size and distinct shingle
    hashes; bounded by the template list, a parameter."""
    rows = spark.createDataFrame(
        [(i, name, text) for i, (name, text) in enumerate(templates)],
        "template_id int, license string, text string").select(
            "template_id", "license", license_words(F.col("text")).alias("w"))
    parts = []
    for r in rows.select("template_id", "license", F.size("w").alias("n"),
                         window_hashes(F.col("w"), SHINGLE).alias("h")).collect():
        if r["n"] < SHINGLE:
            raise ValueError(f"template {r['template_id']} has fewer than {SHINGLE} words")
        # parts overlap by the shingle's width, so no shingle is lost
        step = PART_WORDS - SHINGLE + 1
        for k, at in enumerate(range(0, len(r["h"]), step)):
            hashes = r["h"][at:at + step]
            parts.append({"template_id": r["template_id"], "license": r["license"], "part": k,
                          "size": window_size(len(hashes) + SHINGLE - 1),
                          "total": len(set(r["h"])), "shingles": sorted(set(hashes))})
    return parts


def _bands(rows: DataFrame, keys: list[str], hashes: str) -> DataFrame:
    """MinHash bands: one row (keys, band, value) per window and band."""
    shingles = rows.select(*keys, F.explode(hashes).alias("s"))
    least = shingles.groupBy(*keys).agg(
        *[F.min(F.xxhash64("s", F.lit(j))).alias(f"b{j}") for j in range(BANDS)])
    return least.select(*keys, F.posexplode(
        F.array(*[F.col(f"b{j}") for j in range(BANDS)])).alias("band", "value"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and license template found: ``id, template_id,
    license, containment`` (share of the template's shingles, the best window
    of each part), ``first_word`` (position of the earliest window's first
    template shingle)."""
    spark = docs.sparkSession
    parts = template_parts(spark, templates)
    known = sorted({s for p in parts for s in p["shingles"]})
    sizes = sorted({p["size"] for p in parts})
    table = written(spark.createDataFrame(
        [(p["template_id"], p["license"], p["part"], p["size"], p["total"], p["shingles"])
         for p in parts],
        "template_id int, license string, part int, size int, total int, shingles array<bigint>"),
        "templates")
    lit_known = F.array(*[F.lit(s).cast("bigint") for s in known])

    hashed = docs.select(F.col(id_col).alias("id"),
                         window_hashes(license_words(F.col(text_col).cast("string")), SHINGLE)
                         .alias("h"))
    matching = written(hashed.filter(F.arrays_overlap("h", lit_known)), "license-texts")
    places = F.filter(F.transform("h", lambda s, p: F.when(F.array_contains(lit_known, s), p)),
                      lambda p: p.isNotNull())

    def starts(size: int) -> Column:
        """Numbers of the windows of one size that hold a template shingle."""
        stride, span = size // 4, size - SHINGLE + 1
        of_place = F.transform(F.col("places"), lambda p: F.sequence(
            F.greatest(F.lit(0), F.ceil((p - span + 1) / stride).cast("int")),
            F.floor(p / stride).cast("int")))
        return F.transform(F.array_distinct(F.flatten(of_place)),
                           lambda k: F.struct(F.lit(size).alias("size"), (k * stride).alias("start")))

    windows = (matching.withColumn("places", places)
               .withColumn("window", F.explode(F.flatten(F.array(*[starts(s) for s in sizes]))))
               .select(F.monotonically_increasing_id().alias("w_id"), "id", "window.size",
                       "window.start",
                       F.expr(f"slice(h, window.start + 1, window.size - {SHINGLE - 1})")
                       .alias("shingles")))
    windows = written(windows, "license-windows")
    left = _bands(windows, ["w_id", "size"], "shingles")
    right = _bands(table.withColumnRenamed("size", "t_size"),
                   ["template_id", "part", "t_size"], "shingles").withColumnsRenamed(
                       {"band": "t_band", "value": "t_value"})
    right = written(right, "template-bands")
    retrieved = left.join(right, (F.col("band") == F.col("t_band"))
                          & (F.col("value") == F.col("t_value"))
                          & (F.col("size") == F.col("t_size"))).select(
        "w_id", "template_id", "part").distinct()
    checked = (retrieved.join(windows.select("w_id", "id", "start",
                                             F.col("shingles").alias("seen")), "w_id")
               .join(table, ["template_id", "part"])
               .withColumn("common", F.array_intersect("seen", "shingles"))
               .select("id", "template_id", "license", "part", "total",
                       F.size("common").alias("found"),
                       (F.col("start") + F.array_position("seen", F.get("common", F.lit(0))) - 1)
                       .alias("first_word")))
    best = checked.groupBy("id", "template_id", "license", "total", "part").agg(
        F.max("found").alias("found"),
        F.min_by("first_word", F.struct(-F.col("found"), "first_word")).alias("first_word"))
    return (best.groupBy("id", "template_id", "license", "total").agg(
        F.sum("found").alias("found"), F.min("first_word").alias("first_word"))
        .filter(F.col("found") >= MIN_CONTAINMENT * F.col("total"))
        .select("id", "template_id", "license",
                (F.col("found") / F.col("total")).alias("containment"),
                F.col("first_word").cast("long").alias("first_word")))
