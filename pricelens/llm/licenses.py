"""License scans with MinHash bands over overlapping text windows, in DataFrame functions only.

A template of m five-word shingles is looked for in windows of 2w shingles that start every w, where w is the power of two from m
up: every run of m shingles lies in a window. Window and template then have a Jaccard similarity of at least .8 m / (2w + .2 m),
more than .18. Each of BANDS bands is one MinHash; all miss with a probability below (1 - .18) ** BANDS, .0018.

A band can only match where the window holds the template's own minimal shingle; so the few shingles that are minimal in some
template give the windows to hash, and others, which can't match, are passed over. Matches of bands are candidates,
and a candidate counts if at least CONTAINMENT of the template's shingles stand in the window.

Null, empty and very short texts have no shingles and give no rows; a template of fewer words than a shingle is skipped.
Repeated rows give repeated results by doc_id: one row for each doc_id and license. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 5
BANDS = 32
CONTAINMENT = 0.8
#: Public license notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Released under the BSD License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    # the full texts, by a passage near their beginning
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works."),
    ("LGPL-2.1", "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it."),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("Apache-2.0", "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("MPL-2.0", "\"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def shingles(text: Column) -> Column:
    """Hashes of the runs of WORDS words (letters and digits, lower case), in order."""
    words = F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")
    n = F.size(words) - WORDS
    each = lambda w, i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)])
    # the array of words is bound once, as the only element of an outer array
    bound = F.transform(F.array(words), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: each(w, i)))
    return F.when(n >= 0, F.get(bound, F.lit(0))).otherwise(F.array().cast("array<bigint>"))


def _minhash(h: Column, band: int) -> Column:
    return F.array_min(F.transform(h, lambda x: F.xxhash64(x, F.lit(band))))


def _bands(df: DataFrame, h: str) -> DataFrame:
    """df once for each band, with band and low, the least hash."""
    all_bands = F.array(*[F.struct(F.lit(b).alias("band"), _minhash(F.col(h), b).alias("low")) for b in range(BANDS)])
    return df.select("*", F.explode(all_bands).alias("b")).select("*", "b.band", "b.low").drop("b")


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(template, license, own: shingle hashes, width: half a window)."""
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    t = spark.createDataFrame(rows, "template int, license string, text string")
    t = t.select("template", "license", F.array_distinct(shingles(F.col("text"))).alias("own")).where("size(own) > 0")
    return t.withColumn("width", F.pow(2, F.ceil(F.log2(F.size("own")))).cast("int"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, license, containment, first_word) of every license found in a document, at its best match."""
    spark = docs.sparkSession
    table = template_table(spark, templates)
    kept = table.collect()  # the templates, a fixed list
    banded = _bands(spark.createDataFrame(kept, table.schema), "own")
    by_band = banded.select("low", "band", F.explode("own").alias("x")).where(F.xxhash64("x", "band") == F.col("low"))
    minimal = {r.x for r in by_band.select("x").distinct().collect()}
    widths = sorted({r.width for r in kept})
    found = docs.select(F.col("doc_id").cast("long"), shingles(F.col("text")).alias("h"))
    at = F.filter(F.transform("h", lambda x, i: F.when(x.isin(sorted(minimal)), i).otherwise(F.lit(-1))), lambda i: i >= 0)
    found = found.withColumn("at", at).where("size(at) > 0")
    # starts of the windows that hold such a shingle, by width
    def at_width(w: int) -> Column:
        both = F.flatten(F.transform("at", lambda p: F.array(F.floor(p / w) * w, F.greatest(F.floor(p / w) - 1, F.lit(0)) * w)))
        return F.transform(F.array_distinct(both), lambda s: F.struct(F.lit(w).alias("width"), s.cast("int").alias("start")))

    windows = F.flatten(F.array(*map(at_width, widths)))
    found = found.select("doc_id", "h", F.explode(windows).alias("v")).select(
        "doc_id", "v.width", "v.start", F.slice("h", F.col("v.start") + 1, F.col("v.width") * 2).alias("part")
    )
    hit = _bands(found, "part").join(F.broadcast(banded.withColumnRenamed("width", "w")), ["band", "low"]).where("width = w")
    share = F.size(F.array_intersect("part", "own")) / F.size("own")
    first = F.col("start") + F.array_min(F.transform(F.array_intersect("part", "own"), lambda x: F.array_position("part", x))) - 1
    checked = hit.select("doc_id", "license", share.alias("containment"), first.cast("long").alias("first_word")).where(F.col("containment") >= CONTAINMENT)
    best = F.max(F.struct(F.col("containment"), (-F.col("first_word")).alias("at")))
    return checked.groupBy("doc_id", "license").agg(best.alias("m")).select("doc_id", "license", "m.containment", (-F.col("m.at")).alias("first_word"))
