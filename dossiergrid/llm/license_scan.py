"""License scans: MinHash bands retrieve templates for overlapping text windows, exact shingle containment verifies them.

Windows are twice as long as a template's size class and overlap by half, so every occurrence lies whole in one.
Containment of a template depends on its own shingles only, so a window keeps those that some template of its class has (a semi-join
on the hash of each shingle), which also makes it as similar to the template as it can be. How similar a window that contains a
template is at least follows from the window's number of shingles, and that number tells how many bands it needs to share one with the
template but for a probability of ``MISS``. What a band retrieves is verified by counting. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossiergrid.hot_keys import join_dealt
from dossiergrid.llm.decontamination import BROADCAST_ROWS, WORD
from dossiergrid.llm.license_texts import FULL_TEXTS
from dossiergrid.scratch import materialize, spread

WIDTH = 5
CONTAINMENT = 0.8
#: A window that contains a template shares none of its bands with at most this probability.
MISS = 1e-6
#: Minima in a band. A window is at least a sixteenth to a quarter as similar as it can be: bands of two would need many times the minima.
ROWS = 1

#: Well-known notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation"
    ),
    "mit": "Released under the MIT License",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction"
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "agpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation"
    ),
    "lgpl-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation"
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "unlicense": "This is free and unencumbered software released into the public domain",
    "cc0-1.0": "has waived all copyright and related or neighboring rights to",
    "cc0-1.0-dedication": (
        "dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"
    ),
    "epl-1.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "v1.0"
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"
    ),
    "cc-by-4.0-short": "Licensed under CC BY 4.0",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-nc-nd-4.0": "Licensed under CC BY-NC-ND 4.0",
    "cc-by-sa-4.0-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-4.0-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nd-4.0-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "cc-by-nc-sa-4.0-work": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"
    ),
    "cc-by-nc-nd-4.0-work": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"
    ),
    "mit-licensed": "licensed under the MIT License",
    "apache-2.0-project": "licensed under the Apache License 2.0",
}


def collision_probability(similarity: float, bands: int, rows: int = ROWS) -> float:
    """That two sets of this similarity share all minima of at least one band."""
    return 1 - (1 - similarity**rows) ** bands


def bands_needed(similarity, rows: int = ROWS, miss: float = MISS):
    """The least number of bands (a column) by which sets of this similarity (a column) share one, but for a probability of ``miss``."""
    alike = F.least(F.pow(similarity, F.lit(float(rows))), F.lit(1.0))
    return F.when(alike >= 1, F.lit(1)).otherwise(F.ceil(F.log(F.lit(miss)) / F.log(1 - alike))).cast("int")


def _bands(shingles, bands, rows: int = ROWS):
    """(band, key) of the first ``bands`` bands of a set of hashes: the hash of the minima of ``rows`` hash functions."""
    least = lambda k: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, k)))
    minima = lambda j: F.transform(F.sequence(j * rows, (j + 1) * rows - 1), least)
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda j: F.struct(j.alias("band"), F.xxhash64(minima(j)).alias("key")))


def _meet(rows: DataFrame, table: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``rows`` joined with a ``table`` of ``n`` rows: broadcast if these are few, else hot keys are dealt to pieces."""
    return rows.join(F.broadcast(table), keys) if n <= BROADCAST_ROWS else join_dealt(rows, table, keys, F.col("row_id"), rows.count())


def _words(text):
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _shingles(words, width: int):
    """Hashes of all runs of ``width`` words, by place; none if there are fewer words."""
    if width == 1:
        hashed = F.transform(words, lambda x: F.xxhash64(x))
    else:
        hashed = F.transform(words, lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, width)]))
    return F.slice(hashed, F.lit(1), F.greatest(F.lit(0), F.size(words) - (width - 1)))


def _tagged(words, width: int):
    """The shingles with their width and place."""
    return F.transform(_shingles(words, width), lambda h, i: F.struct(F.lit(width).alias("width"), i.alias("pos"), h.alias("h")))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """A small local table of (template_id, text)."""
    import json

    rows = json.dumps([{"template_id": k, "text": v} for k, v in templates.items()])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<template_id:string,text:string>>")))


def license_matches(docs: DataFrame, templates: DataFrame, width: int = WIDTH, containment: float = CONTAINMENT, id_col="doc_id", text_col="text"):
    """(rows, matches): a row per document (row_id, doc_id, n_words), and every window that contains a
    template: row_id, template_id, first_word, containment.

    Templates of fewer words than ``width`` are one shingle of their own length; those
    without words never match. Words are lower-cased.
    """
    words = templates.select("template_id", _words(F.col("text")).alias("w")).where(F.size("w") > 0)
    words = words.withColumn("size", F.size("w")).withColumn("width", F.least(F.lit(width), F.size("w")))
    widths = sorted(r["width"] for r in words.select("width").distinct().collect())  # at most ``width`` values
    cut = F.array(*[_tagged(F.col("w"), n) for n in widths]) if widths else F.array().cast("array<array<struct<width:int,pos:int,h:bigint>>>")
    shingles = words.select("template_id", "size", "width", F.explode(F.flatten(cut)).alias("s")).where("s.width = width")
    # A size class is the power of two that holds the template; its windows advance by it.
    span = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(2), F.col("size").cast("int"))))).cast("int")
    shingles = materialize(shingles.select("template_id", span.alias("span"), F.col("s.width").alias("width"), F.col("s.h").alias("h")).distinct(), "license-shingles")
    n_shingles = shingles.count()
    own = shingles.groupBy("template_id", "span", "width").agg(F.count(F.lit(1)).alias("n"), F.collect_list("h").alias("set"))
    # At least ``must`` of a template's n shingles are met, so at most ``spare`` are missing.
    must = F.ceil(F.col("n") * containment - 1e-9)
    own = own.withColumn("must", must).withColumn("spare", F.col("n") - must)
    # One row per size class and width: at most 32 times ``width`` of them.
    classes = own.groupBy("span", "width").agg(F.min("must").alias("must"), F.max("spare").alias("spare"))
    similarity = lambda size: F.col("must") / (size + F.col("spare"))
    signed = own.select("template_id", "span", "width", "set").join(F.broadcast(classes), ["span", "width"])
    signed = signed.select("template_id", "span", "width", F.inline(_bands(F.col("set"), bands_needed(similarity(2 * F.col("span"))))))
    signed = materialize(signed, "license-bands")
    n_bands = signed.count()
    counted = own.select("template_id", "n")

    rid = F.monotonically_increasing_id()
    text = docs.select(rid.alias("row_id"), docs[id_col].alias("doc_id"), _words(docs[text_col]).alias("w"))
    # The last place of a row carries its identifier and length, so that the texts are read once.
    end = F.array(F.struct(F.lit(0).alias("width"), F.size("w").alias("pos"), F.lit(0).cast("long").alias("h")))
    tagged = [_tagged(F.col("w"), n) for n in widths]
    places = text.select("row_id", "doc_id", F.inline(F.concat(end, *tagged)))
    known = shingles.groupBy("width", "h").agg(F.collect_set("span").alias("spans"))
    known = known.union(docs.sparkSession.range(1).select(F.lit(0), F.lit(0).cast("long"), F.array().cast("array<int>")))
    hits = _meet(places, known, ["width", "h"], n_shingles)
    hits = materialize(hits.select("row_id", F.when(F.col("width") == 0, F.col("doc_id")).alias("doc_id"), "width", "h", "pos", "spans"), "license-hits")
    rows = hits.where("width = 0").select("row_id", "doc_id", F.col("pos").cast("long").alias("n_words"))

    # A place is in the window that starts in its block, and in the one before; before the first there is none.
    found = hits.where("width > 0").select("row_id", "width", "h", "pos", F.explode("spans").alias("span"))
    block = F.floor(F.col("pos") / F.col("span"))
    found = found.select("row_id", "span", "width", "h", "pos", F.explode(F.array(block, block - 1)).alias("win")).where("win >= 0")
    # A window has at most twice its span of places.
    met = F.collect_list(F.struct("h", "pos")).alias("met")
    windows = found.groupBy("row_id", "span", "win", "width", "h").agg(F.min("pos").alias("pos")).groupBy("row_id", "span", "win", "width").agg(met)
    windows = windows.join(F.broadcast(classes), ["span", "width"]).where(F.size("met") >= F.col("must"))
    windows = materialize(windows, "license-windows")
    keys = _bands(F.col("met.h"), bands_needed(similarity(F.size("met"))))
    banded = windows.select("row_id", "span", "win", "width", F.inline(keys))
    candidates = _meet(banded, signed, ["span", "width", "band", "key"], n_bands).select("row_id", "span", "win", "width", "template_id").distinct()
    candidates = candidates.join(windows, ["row_id", "span", "win", "width"])
    # Only templates that a window was retrieved for are held against it, shingle by shingle.
    places = candidates.select("row_id", "span", "win", "template_id", F.inline("met"))
    met = _meet(places, shingles.select("template_id", "h"), ["template_id", "h"], n_shingles).groupBy("row_id", "span", "win", "template_id")
    met = met.agg(F.count(F.lit(1)).alias("met"), F.min("pos").alias("first_word"))
    met = _meet(met, counted, ["template_id"], n_shingles)
    met = met.withColumn("containment", F.col("met") / F.col("n")).where(F.col("containment") >= containment)
    # The same place seen through two overlapping windows counts once.
    return rows, met.groupBy("row_id", "template_id", "first_word").agg(F.max("containment").alias("containment"))


def license_scan(docs: DataFrame, templates: DataFrame | None = None, **options) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_matches``, ``licenses`` (template ids, sorted,
    comma-joined), ``best`` (largest containment, 0 without a match), ``licensed``.

    Null and empty texts have no words and no license. Rows are documents of their own
    even where identifiers repeat or are null. Other columns are ignored.
    """
    templates = template_table(docs.sparkSession, TEMPLATES | FULL_TEXTS) if templates is None else templates
    rows, matches = license_matches(docs, templates, **options)
    found = matches.groupBy("row_id").agg(
        F.count(F.lit(1)).alias("n_matches"),
        F.array_join(F.array_sort(F.collect_set("template_id")), ",").alias("licenses"),
        F.max("containment").alias("best"),
    )
    return rows.join(found, "row_id", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"),
        F.coalesce("licenses", F.lit("")).alias("licenses"),
        F.coalesce("best", F.lit(0.0)).alias("best"),
        F.col("n_matches").isNotNull().alias("licensed"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
