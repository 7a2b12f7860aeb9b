"""License scans by MinHash over overlapping windows, then exact containment; in DataFrame operations only.

Templates and documents are cut into all windows of a few widths, a template into those of the largest width that it has. A window's MinHash is kept in bands of one minimum each, so windows whose
5-word shingles have a similarity of s collide in one of four bands with a probability of 1 - (1 - s)**4: 0.996 at 0.75, 1 for equal ones. Collisions name a template; its shingles are then
counted exactly in the document. A collision needs a common shingle, so only documents that have one of any template are cut into windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, written
from .decontam import GRAM, _hashed, _positions, words_of

WIDTHS, BANDS = (5, 8, 12), 4
CONTAINED = 0.75

#: License notices to look for.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


def _bands(grams: Column, width: int, gram: int, bands: int) -> Column:
    """The distinct keys of all windows of a width: structs (width, band, least)."""
    n, per = F.size(grams), width - gram + 1
    if per == 1:
        return F.transform(F.array_distinct(grams), lambda g: F.struct(F.lit(width).alias("width"), F.lit(0).alias("band"), g.alias("least")))

    def of(band: int) -> Column:
        mixed = F.transform(grams, lambda g: F.xxhash64(g, F.lit(band)))
        # bound to a name by a transform of one element, so that it is computed once
        least = F.transform(F.array(mixed), lambda m: F.array_distinct(F.transform(_positions(n, per), lambda i: F.least(*(F.get(m, i + k) for k in range(per))))))[0]
        return F.transform(least, lambda x: F.struct(F.lit(width).alias("width"), F.lit(band).alias("band"), x.alias("least")))

    return F.concat(*map(of, range(bands)))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, contained: float = CONTAINED, widths: tuple[int, ...] = WIDTHS, bands: int = BANDS, gram: int = GRAM) -> DataFrame:
    """doc_id, license, n_found, n_shingles, start: for each document (doc_id, text) and template whose shingles it contains to the share contained, within one and a half times the template's length.

    n_found is the most of the template's n_shingles distinct ones that lie together, start the first such place, in words. A template must have five words. A null or empty text has no
    license; null ids are left out; rows that repeat an id are searched each, and the best counts; a text of clean prose isn't listed. Other columns aren't read.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    known = _hashed(known.select("license", words_of(F.col("text")).alias("words")), gram).where(f"size(words) >= {gram}")
    fits = lambda w: (F.size("words") >= w) & ((F.size("words") < min([x for x in widths if x > w], default=1 << 30)))
    keys = known.select("license", F.explode(F.coalesce(*(F.when(fits(w), _bands(F.col("g"), w, gram, bands)) for w in widths))).alias("k")).select("license", "k.*")
    keys = few(written(keys.distinct()))
    known = known.select("license", F.array_distinct("g").alias("grams"), F.ceil(F.size("words") * 1.5 - gram + 1).cast("int").alias("span"))

    source = docs.select(docs["doc_id"], docs["text"]).where("doc_id IS NOT NULL AND text IS NOT NULL")
    hashed = lambda rows: _hashed(rows.select("doc_id", words_of(F.col("text")).alias("words"), *(c for c in rows.columns if c not in ("doc_id", "text"))), gram)
    # windows whose minima are equal have that shingle in common, so a document without any shingle of a template needs no bands
    some = F.array(*(F.lit(r.x) for r in known.select(F.explode("grams").alias("x")).distinct().orderBy("x").collect()))  # the templates' shingles, as few as these
    sharing = hashed(source).select("doc_id", F.explode(F.when(F.arrays_overlap("g", some.cast("array<long>")), F.array("g"))).alias("g"))
    found = sharing.select("doc_id", F.explode(F.array(*(_bands(F.col("g"), w, gram, bands) for w in widths))).alias("of")).select("doc_id", F.explode("of").alias("k")).select("doc_id", "k.*")
    pairs = written(found.join(keys, ["width", "band", "least"]).select("doc_id", "license").distinct())

    # a document's templates are as many as there are templates at most
    asked = few(pairs.groupBy("doc_id").agg(F.collect_list("license").alias("licenses")))
    again = hashed(source.join(asked, "doc_id")).select("doc_id", "g", F.explode("licenses").alias("license"))
    again = again.join(F.broadcast(known), "license").select("doc_id", "g", F.struct("license", "grams", "span").alias("t"))  # the templates are few, as a parameter
    places = F.filter(_positions(F.size("g"), 1), lambda i: F.array_contains("t.grams", F.get("g", i)))
    counts = F.transform(places, lambda i: F.struct(F.size(F.array_intersect(F.slice("g", i + 1, F.col("t.span")), F.col("t.grams"))).alias("n"), (-i).alias("before")))
    best = again.select("doc_id", "t.license", F.size("t.grams").alias("n_shingles"), F.array_max(counts).alias("b")).where(F.col("b.n") >= F.lit(contained) * F.col("n_shingles"))
    best = best.groupBy("doc_id", "license").agg(F.max("b").alias("b"), F.first("n_shingles").alias("n_shingles"))
    return best.select("doc_id", "license", F.col("b.n").alias("n_found"), "n_shingles", (-F.col("b.before")).alias("start"))
