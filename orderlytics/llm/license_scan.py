"""Licences of files: TF-IDF cosine to templates, then the directories' licences.

Every line of a file is compared with every template, as sparse vectors of word
counts weighted by how few lines of all files hold a word. The best line that is
similar enough names the file's own licence. So does the best run of words as long
as a template, across lines, when it is nearer: the words around a notice do not
dilute it, and it may be wrapped. Titles and identifiers of few words count only
when they stand there word by word. A file without a licence takes that of the
nearest directory above it that holds a licence file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlytics.llm import scratch
from orderlytics.llm.textscan import Scanner, find

#: The notices by which licences ask to be named.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    *((f"{short}-{number}", f"it under the terms of the GNU {title} as published by the Free Software Foundation, "
       f"either version {number.removesuffix('.0')} of the License") for short, title, number in (
        ("GPL", "General Public License", "2.0"), ("GPL", "General Public License", "3.0"),
        ("LGPL", "Lesser General Public License", "2.1"), ("LGPL", "Lesser General Public License", "3.0"),
        ("AGPL", "Affero General Public License", "3.0"))),
    *((f"CC-BY-{short}-4.0", f"Licensed under the Creative Commons {title} 4.0 International License") for short, title in (
        ("SA", "Attribution-ShareAlike"), ("ND", "Attribution-NoDerivatives"), ("NC", "Attribution-NonCommercial"),
        ("NC-SA", "Attribution-NonCommercial-ShareAlike"), ("NC-ND", "Attribution-NonCommercial-NoDerivatives"))),
)
#: Titles and identifiers: these words in this order. The longest counts.
PHRASES = (
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License Version 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("GPL-2.0", "GNU General Public License Version 2"),
    ("GPL-3.0", "GNU General Public License Version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3"),
    *((n, f"SPDX-License-Identifier: {n}") for n in (
        "MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0",
        "AGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-ND-4.0", "CC-BY-NC-4.0",
        "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "ISC", "Unlicense")),
)
#: Least cosine of a line to a template.
LEAST = 0.7
#: Least cosine of a run of words to the template as long.
NEAR = 0.85
#: Share of a run's words that the template must have for the cosine to be computed.
SHARED = 0.6
#: Runs compared at once.
RUNS = 4096
#: Names of licence files.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)(\.\w+)?$"


def _lines(words) -> np.ndarray:
    """The line (counted through the block) of every word."""
    starts = words.start + np.repeat(words.at[:-1], np.diff(words.first))
    line = np.cumsum(words.data == 10)[starts] if len(words.data) else np.zeros(0, np.int64)
    return line + np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))  # a text begins a line


def _unique(line: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, word, count) of the distinct words of each line."""
    order = np.lexsort((word, line))
    line, word = line[order], word[order]
    new = np.ones(len(line), dtype=bool)
    new[1:] = (line[1:] != line[:-1]) | (word[1:] != word[:-1])
    at = np.flatnonzero(new)
    return line[at], word[at], np.diff(np.append(at, len(line)))


def _template_words(templates) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words, and how often each template has them."""
    w = [next(Scanner(lower=True, punctuation=True).blocks(pa.array([t]))).hash for _, t in templates]
    words = np.unique(np.concatenate(w))
    return words, np.array([np.bincount(np.searchsorted(words, x), minlength=len(words)) for x in w], float)


def _weights(files: DataFrame, words: np.ndarray) -> np.ndarray:
    """log((1 + lines) / (1 + lines with the word)) of every template word; of any
    other word, that of one in no line. Lines without words do not count."""
    def count(batches):
        scanner, seen, lines = Scanner(lower=True, punctuation=True), np.zeros(len(words) + 1, np.int64), 0
        for batch in batches:
            for w in scanner.blocks(batch.column("text")):
                line, word = _lines(w), find(words, w.hash)
                known = word < len(words)
                seen += np.bincount(_unique(line[known], word[known])[1], minlength=len(words) + 1)
                lines += len(np.unique(line))
        seen[-1] = lines
        yield pa.record_batch([pa.array(np.arange(len(words) + 1)), pa.array(seen)], ["word", "lines"])

    rows = (files.select("text").mapInArrow(count, "word long, lines long").groupBy("word")
            .agg(F.sum("lines").alias("lines")).collect())  # one row per template word
    lines = np.zeros(len(words) + 1)
    for r in rows:
        lines[r["word"]] = r["lines"]
    return np.append(np.log((1 + lines[-1]) / (1 + lines[:-1])), np.log(1 + lines[-1]))


def _matches(words, known: np.ndarray, weight: np.ndarray, vectors: np.ndarray, sizes: np.ndarray,
             phrases: list[np.ndarray], near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, template or templates + phrase, cosine) of the runs of words that are as
    long as a template and ``near`` enough, or equal to a phrase. Every word that no
    template has counts as another."""
    at, of = find(known, words.hash), np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for t, m in enumerate(sizes.tolist()):
        if len(at) < m:
            continue
        has = np.concatenate(([0], np.cumsum(np.append(vectors[t] > 0, False)[at])))
        starts = np.flatnonzero((has[m:] - has[:-m] >= SHARED * m) & (of[:len(of) - m + 1] == of[m - 1:]))
        for some in np.array_split(starts, -(-len(starts) // RUNS)) if len(starts) else []:
            run = at[some[:, None] + np.arange(m)]
            bag = np.bincount((run + np.arange(len(some))[:, None] * (len(known) + 1)).ravel(),
                              minlength=len(some) * (len(known) + 1)).reshape(len(some), -1)
            value = bag[:, :-1] * weight[:-1]
            cosine = value @ vectors[t] / np.maximum(np.sqrt((value ** 2).sum(1) + bag[:, -1] * weight[-1] ** 2), 1e-12)
            good = cosine >= near
            found.append((of[some[good]], np.full(good.sum(), t), cosine[good]))
    for f, phrase in enumerate(phrases):
        m = len(phrase)
        starts = np.flatnonzero(words.hash[:max(0, len(at) - m + 1)] == phrase[0])
        starts = starts[of[starts] == of[starts + m - 1]]
        for j in range(1, m):
            starts = starts[words.hash[starts + j] == phrase[j]]
        found.append((of[starts], np.full(len(starts), len(sizes) + f), np.ones(len(starts))))
    return tuple(map(np.concatenate, zip(*found)))


def own_licences(files: DataFrame, keep: list[str], templates=TEMPLATES, least: float = LEAST,
                 phrases=PHRASES, near: float = NEAR) -> DataFrame:
    """``keep`` columns of ``files``, licence (NULL: none), score (cosine of the best
    line; 0 without words), line (of the best, from 0) and match (cosine of the best
    run of words that is ``near`` to a template or equal to a phrase; 0: none). The
    nearer of line and run names the licence. Of equal lines the first counts, of equal
    templates the longest run, then the first in their order."""
    words, counts = _template_words(templates)
    weight = _weights(files, words)
    vectors = counts * weight[:-1]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    names = np.array([n for n, _ in templates])
    titles = [next(Scanner(lower=True, punctuation=True).blocks(pa.array([t]))).hash for _, t in phrases]
    sizes = counts.sum(1).astype(np.int64)
    every, length = np.array([*names, *(n for n, _ in phrases)]), np.array([*sizes, *map(len, titles)])
    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep)

    def scan(batches):
        scanner = Scanner(lower=True, punctuation=True)
        for batch in batches:
            licence, score, place, match = [], [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for w in scanner.blocks(batch.column("text")):
                texts = len(w.first) - 1
                line, word, n = _unique(_lines(w), w.hash)
                at = find(words, word)
                value = n * weight[at]
                lines, of = np.unique(line, return_inverse=True)
                size = np.sqrt(np.bincount(of, value ** 2, len(lines)))
                known = at < len(words)
                cosine = np.zeros((len(lines), len(names)))
                for t in range(len(names)):
                    cosine[:, t] = np.bincount(of[known], value[known] * vectors[t, at[known]], len(lines))
                cosine /= np.maximum(size, 1e-12)[:, None]
                best, which = cosine.max(1, initial=0), cosine.argmax(1) if len(lines) else np.zeros(0, int)
                # texts own ranges of lines: those from their first word's to their last
                first = np.cumsum(np.concatenate(([0], [0 if not len(w.data) else x for x in np.add.reduceat(
                    np.append(w.data == 10, False).astype(np.int64), w.at[:-1]) * (np.diff(w.at) > 0)] if texts else [])))[:-1]
                first = first + np.arange(texts)
                owner = np.searchsorted(first, lines, "right") - 1
                order = np.lexsort((lines, -best, owner))
                head = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
                s, l, g = np.zeros(texts), np.zeros(texts, np.int64), np.full(texts, None, object)
                s[owner[head]], l[owner[head]] = best[head], lines[head] - first[owner[head]]
                good = head[best[head] >= least]
                g[owner[good]] = names[which[good]]
                text, run, value = _matches(w, words, weight, vectors, sizes, titles, near)
                value = np.minimum(np.round(value, 9), 1.0)
                order = np.lexsort((run, -length[run], -value, text))
                head = order[np.flatnonzero(np.diff(text[order], prepend=-1))]
                nearest = np.zeros(texts)
                nearest[text[head]] = value[head]
                head = head[(value[head] > s[text[head]] + 1e-9) | np.equal(g[text[head]], None)]
                g[text[head]] = every[run[head]]
                match.append(nearest)
                licence += g.tolist()
                score.append(s)
                place.append(l)
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(licence, pa.string()),
                                   pa.array(np.concatenate(score)), pa.array(np.concatenate(place)), pa.array(np.concatenate(match))],
                                  names=[*keep, "licence", "score", "line", "match"])

    return files.select(*dict.fromkeys([*keep, "text"])).mapInArrow(scan, f"{kinds}, licence string, score double, line long, match double")


def scan(files: DataFrame, path: str | Column = "path", id_col: str = "doc_id", text_col: str = "text",
         templates=TEMPLATES, least: float = LEAST, phrases=PHRASES, near: float = NEAR) -> DataFrame:
    """One row per row of ``files``: doc_id, path, licence, origin ("own", "inherited"
    or NULL), score and line (of the file's own best line), match (of its best run of
    words), licence_dir (whose licence was inherited).

    A file named like a licence file gives its own licence to its directory; of
    several in one directory the first name counts, then the highest score. Paths are
    parted by "/"; the root is "". NULL and empty texts have no licence of their own,
    NULL paths inherit none. Repeated rows each get theirs."""
    path = F.col(path) if isinstance(path, str) else path
    files = files.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.col(text_col).alias("text"))
    own = own_licences(files, ["doc_id", "path"], templates, least, phrases, near)
    own = scratch.table(own.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
                        .withColumn("name", F.regexp_extract("path", "[^/]*$", 0)))
    given = scratch.table(own.where(F.col("licence").isNotNull() & F.col("name").rlike(LICENCE_FILE))
                          .groupBy(F.col("dir").alias("above"))
                          .agg(F.min(F.struct("name", -F.greatest("score", "match"), "licence")).alias("g"))
                          .select("above", F.col("g.licence").alias("given")))
    # each directory, not each file, looks for the directories above it
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    nearest = (own.where("dir IS NOT NULL").select("dir").distinct()
               .select("dir", F.posexplode(F.array_distinct(above)).alias("depth", "above"))
               .join(scratch.bounded(given), "above").groupBy("dir")
               .agg(F.max(F.struct("depth", "above", "given")).alias("n")))
    nearest = scratch.table(nearest.select("dir", F.col("n.above").alias("licence_dir"), F.col("n.given").alias("given")))
    joined = own.join(scratch.bounded(nearest), "dir", "left")
    mine = F.col("licence").isNotNull()
    return joined.select(
        "doc_id", "path", F.coalesce("licence", "given").alias("licence"),
        F.when(mine, "own").when(F.col("given").isNotNull(), "inherited").alias("origin"), "score", "line", "match",
        F.when(~mine, F.col("licence_dir")).alias("licence_dir"))
