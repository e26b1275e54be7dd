from orderlytics.llm import license_scan

SCHEMA = "doc_id long, path string, text string, licence string, score int"
FILES = [
    (1, "LICENSE", "Apache License\nLicensed under the Apache License, Version 2.0."),
    (2, "a/b/x.py", "import x\n# Licensed under CC BY-NC 4.0.\ncode code"),
    (3, "a/b/y.py", "no notice here\n\nat all"),
    (4, "a/COPYING.txt", "hello\nThis work is licensed under the GNU General Public License, version 3."),
    (5, "a/b/c/d.txt", None),
    (6, "z/q.txt", ""),
    (7, "top.txt", "the mit and the license of the free world, said the person with a copy"),
    (8, None, "Released under the MIT License."),
    (9, None, "nothing"),
    (10, "a/b/LICENCE", "not a licence text at all"),
    (None, "a/b/y.py", "words " * 30_000 + "\nreleased under the mit license"),
    (3, "a/b/y.py", "no notice here\n\nat all"),
    (11, "ab/e", "x"),
]


def test_own_and_inherited(spark):
    out = license_scan.scan(spark.createDataFrame([(*f, "x", 1) for f in FILES], SCHEMA)).collect()
    got = sorted(((r["doc_id"] or 0, r["licence"], r["origin"], r["licence_dir"]) for r in out), key=str)
    assert got == sorted([
        (1, "Apache-2.0", "own", None), (2, "CC-BY-NC-4.0", "own", None), (3, "GPL-3.0", "inherited", "a"),
        (3, "GPL-3.0", "inherited", "a"), (4, "GPL-3.0", "own", None), (5, "GPL-3.0", "inherited", "a"),
        (6, "Apache-2.0", "inherited", ""), (7, "Apache-2.0", "inherited", ""), (8, "MIT", "own", None),
        (9, None, None, None), (10, "GPL-3.0", "inherited", "a"), (0, "MIT", "own", None),
        (11, "Apache-2.0", "inherited", "")], key=str)
    line = {r["doc_id"]: r["line"] for r in out}
    assert (line[1], line[2], line[4], line[None]) == (1, 1, 1, 1)


def test_empty(spark):
    assert license_scan.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_cosine_by_brute_force(spark):
    import math
    import re
    rows = [(f[0], f[1], f[2]) for f in FILES if f[0] not in (None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    lines = {i: [re.findall("[a-z0-9]+", x.lower()) for x in (t or "").split("\n")] for i, _, t in rows}
    every = [set(w) for ls in lines.values() for w in ls if w]
    known = {w for _, t in license_scan.TEMPLATES for w in re.findall("[a-z0-9]+", t.lower())}

    def vector(words):
        return {w: words.count(w) * math.log((1 + len(every)) / (1 + (sum(w in e for e in every) if w in known else 0))) for w in set(words)}

    def cosine(a, b):
        return sum(v * b.get(w, 0) for w, v in a.items()) / max(1e-12, math.hypot(*a.values()) * math.hypot(*b.values()))

    templates = [vector(re.findall("[a-z0-9]+", t.lower())) for _, t in license_scan.TEMPLATES]
    for r in license_scan.own_licences(df, ["doc_id"]).collect():
        best = max([cosine(vector(w), t) for w in lines[r["doc_id"]] if w for t in templates], default=0)
        assert abs(r["score"] - best) < 1e-9


def test_notice_among_other_words_or_wrapped(spark):
    texts = [
        ("Apache-2.0", "Copyright 2020 Foo Inc. Licensed under the Apache License, Version 2.0."),
        ("MIT", "Copyright (c) 2021 Jane Doe. Released under the MIT License."),
        ("Apache-2.0", "some words before\n# Licensed under the Apache\n# License, Version 2.0 and more words after it"),
        ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'),
        ("MIT", "MIT License"), ("MIT", "MIT License\n\nCopyright (c) 2020 Somebody Else"),
        ("Apache-2.0", "Apache License\n   Version 2.0, January 2004"),
        ("GPL-3.0", "// SPDX-License-Identifier: GPL-3.0-only\nint main"), ("MIT", "# SPDX-License-Identifier: MIT"),
        (None, "SPDX-License-Identifier: Zlib"), (None, "the mit and the license of the free world"),
        ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                    "Public License as published by\nthe Free Software Foundation, either version 3 of the License, or"),
        ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy"),
        (None, ""), (None, None),
    ]
    rows = [(i, None, t, "x", 1) for i, (_, t) in enumerate(texts)]
    rows += [(100 + i, None, f"{a} other{i} text{i}\nand you for not copyright", "x", 1) for i in range(300) for a in ("the of this", "in any")]
    out = {r["doc_id"]: r["licence"] for r in license_scan.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [out[i] for i in range(len(texts))] == [n for n, _ in texts]
    assert all(v is None for i, v in out.items() if i >= 100)
