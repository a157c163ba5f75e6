import itertools
import random

import pytest
from pyspark.sql import functions as F

from dossiergrid.llm import license_scan as op
from tests.llm.helpers import ALNUM_WORD, docs, words


def split(t):
    return [x.lower() for x in ALNUM_WORD.findall(t or "")]


def brute(text, templates, width=5, containment=0.8):
    """Templates contained in one of the overlapping windows of their size class."""
    w, found = split(text), set()
    for name, t in templates.items():
        n = min(width, len(split(t)))
        if not n:
            continue
        own = {tuple(split(t)[i : i + n]) for i in range(len(split(t)) - n + 1)}
        span = 2
        while span < len(split(t)):
            span *= 2
        for b in range(0, max(1, len(w)), span):
            part = {tuple(w[i : i + n]) for i in range(b, min(b + 2 * span, len(w) - n + 1))}
            if len(own & part) >= containment * len(own):
                found.add(name)
    return ",".join(sorted(found))


def test_against_brute_force(spark):
    rng = random.Random(8)
    templates = op.TEMPLATES | {"short": "All rights reserved", "one": "copyleft", "none": "..."}
    rows = [(1, None), (2, ""), (3, "All Rights RESERVED."), (4, "copyleft"), (4, "copyleft"), (None, op.TEMPLATES["mit"])]
    for i in range(60):
        w = words(rng, rng.randrange(0, 90))
        for _ in range(rng.randrange(3)):
            t = rng.choice(list(templates.values())).split()
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = rng.choice(["of", "x"])
            at = rng.randrange(len(w) + 1)
            w[at:at] = t
        rows.append((100 + i, rng.choice([" ", "\n"]).join(w)))
    rows.append((300, " ".join(words(rng, 30_000)) + " " + op.TEMPLATES["gpl-header"]))
    got = op.license_scan(docs(spark, rows), op.template_table(spark, templates)).collect()
    want = sorted(((i, len(split(t)), brute(t, templates)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.licenses) for r in got), key=repr) == want
    assert all(r.licensed == bool(r.licenses) and (r.best >= 0.8) == r.licensed for r in got)
    assert sum(r.licensed for r in got) > 20


def test_no_template_and_no_document(spark):
    assert op.license_scan(docs(spark, [])).count() == 0
    got = op.license_scan(docs(spark, [(1, "a b")]), op.template_table(spark, {"none": "--"})).collect()
    assert [(r.doc_id, r.n_words, r.licenses, r.best) for r in got] == [(1, 2, "", 0.0)]


def test_band_settings(spark):
    """The scan's own bands: as many as a probability asks for, and no more."""
    for rows in (1, 2):
        got = spark.range(1, 41).select((F.col("id") / 40).alias("s")).select("s", op.bands_needed(F.col("s"), rows).alias("b")).collect()
        for r in got:
            assert 1 - op.collision_probability(r.s, r.b, rows) <= op.MISS * 1.0001
            assert r.b == 1 or 1 - op.collision_probability(r.s, r.b - 1, rows) > op.MISS * 0.9999


def test_bands_collide_as_often_as_sets_are_similar(spark):
    """Shared bands, over many pairs of sets of one similarity, against the probability that the settings rest on."""
    pairs = spark.range(400).select(F.sequence(F.lit(0), F.lit(29)).alias("a"), F.sequence(F.lit(20), F.lit(39)).alias("b"), "id")
    salted = [F.transform(c, lambda x: F.xxhash64(x, F.col("id"))) for c in ("a", "b")]
    for rows in (1, 2):
        a, b = (op._bands(c, F.lit(8), rows) for c in salted)
        shared = pairs.select(F.size(F.array_intersect(a, b)).alias("n")).agg(F.avg("n") / 8, F.avg((F.col("n") > 0).cast("int"))).first()
        assert shared[0] == pytest.approx(0.25**rows, abs=0.03) and shared[1] == pytest.approx(op.collision_probability(0.25, 8, rows), abs=0.08)


def test_many_templates_without_a_broadcast(spark, monkeypatch):
    """Beyond the size that is broadcast, the same matches come by dealt joins."""
    rows = [(i, f"x y {t} z") for i, t in enumerate(op.TEMPLATES.values())] + [(900, None)]
    want = op.license_scan(docs(spark, rows)).collect()
    monkeypatch.setattr(op, "BROADCAST_ROWS", 10)
    assert sorted(op.license_scan(docs(spark, rows)).collect(), key=str) == sorted(want, key=str)


def test_neighbours_at_many_offsets(spark):
    """A template counts whatever stands next to it: short ones were lost among the shingles of longer ones."""
    texts = ["Released under the MIT License. " + op.TEMPLATES["mit-permission"]]
    for k, (a, b) in enumerate(itertools.product(op.TEMPLATES.values(), repeat=2)):
        texts += ["x " * at + a + " " + b for at in range(k % 7, 33, 7)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.licenses for r in op.license_scan(docs(spark, rows)).collect()}
    assert got == {i: brute(t, op.TEMPLATES) for i, t in rows}


def test_usual_licenses(spark):
    """Notices as they stand in files, with what is usually around them."""
    notices = {
        "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "agpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License",
        "isc": "Copyright (c) 2020 A B. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy",
        "cc0-1.0": "To the extent possible under law, A B has waived all copyright and related or neighboring rights to this work.",
        "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is at",
        "cc-by-nd-4.0": "(c) A B, licensed under CC BY-ND 4.0.",
        "mit-licensed": "This project is licensed under the MIT License - see LICENSE",
        "apache-2.0-project": "It is licensed under the Apache License 2.0 and free",
    }
    got = {r.doc_id: r.licenses.split(",") for r in op.license_scan(docs(spark, [*enumerate(notices.values()), (99, "under the terms of the contract")])).collect()}
    assert all(name in got[k] for k, name in enumerate(notices)) and got[99] == [""]


def test_recall_of_whole_texts_in_plain_text(spark):
    """Whole license texts with some words changed, at any place of other text: what containment over the
    whole document finds is the measure, and at least nine in ten of it must be retrieved (all of it is)."""
    rng = random.Random(12)
    rows, want = [], []
    for k, (name, t) in enumerate([*op.FULL_TEXTS.items()] * 4):
        own = t.split()
        for _ in range(rng.randrange(len(own) // 60 + 1)):
            own[rng.randrange(len(own))] = "changed"
        w = words(rng, rng.randrange(400))
        at = rng.randrange(len(w) + 1)
        w[at:at] = own
        rows.append((k, " ".join(w)))
        have = {tuple(split(rows[-1][1])[i : i + 5]) for i in range(len(split(rows[-1][1])))}
        for other, u in op.FULL_TEXTS.items():
            s = {tuple(split(u)[i : i + 5]) for i in range(len(split(u)) - 4)}
            want += [(k, other)] if len(s & have) >= 0.8 * len(s) else []
    found = op.license_scan(docs(spark, rows), op.template_table(spark, op.FULL_TEXTS)).collect()
    got = {(r.doc_id, x) for r in found for x in r.licenses.split(",") if x}
    assert got <= set(want) and len(got & set(want)) >= 0.9 * len(set(want)) > 40
    assert got == set(want)
