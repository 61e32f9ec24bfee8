"""License scans: sparse TF-IDF cosine to templates, then inheritance by path."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, staged
from .words import slices

#: Short notices by which a text names its license.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License. See the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Licensed under the 3-Clause BSD License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0, dedicated to the public domain."],
}
#: Least cosine of a header line, and of the whole text of a licence file.
HEADER, FILE = 0.75, 0.6
_TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_FILE_NAME = r"(?iu)^(un)?licen[cs]e|^copying|^notice"


#: Most of (1 + log c)^2 / c, by which a term that a window holds c times outweighs c single ones.
_MOST = 1.5


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


@cache
def full_texts() -> dict[str, list[str]]:
    """Whole licences, by which licence files are known."""
    return {p.stem: [p.read_text()] for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


class Matcher:
    """Cosine of texts to the templates, weighed by log frequency and inverse document frequency.

    `df` holds the documents that have each term of the templates, of `n`. A term
    outside the templates weighs as one that no document had.
    """

    def __init__(self, df: dict[str, int], n: int, templates=None, least: float = HEADER):
        self.idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items()}
        self.other = math.log(1 + n) + 1
        self.by_term: dict[str, list[tuple[int, float]]] = {}
        self.names, strong = [], set()
        self.sizes, self.telling, self.least = [], [], least
        templates = templates or TEMPLATES
        held = Counter(t for texts in templates.values() for t in {t for x in texts for t in terms(x)})
        for name, texts in templates.items():
            for t in texts:
                own = terms(t)
                v = self.vector(own)
                self.sizes.append(len(own))
                # the terms that the fewest licences have: a part of a line must hold one
                self.telling.append({x for x in own if held[x] == min(map(held.get, own))})
                norm = math.sqrt(sum(x * x for x in v.values()))
                for term, x in v.items():
                    self.by_term.setdefault(term, []).append((len(self.names), x / norm))
                self.names.append(name)
                # terms without which the cosine stays under `least`: the weak rest falls short of it
                weak = 0.0
                for term, x in sorted(v.items(), key=lambda kv: (kv[1], kv[0])):
                    weak += (x / norm) ** 2
                    if weak >= least * least:
                        strong.add(term)
        self.hint = re.compile("|".join(map(re.escape, sorted(strong, key=len, reverse=True))))

    def vector(self, words: list[str]) -> dict[str, float]:
        return {t: (1 + math.log(c)) * self.idf.get(t, self.other) for t, c in Counter(words).items()}

    def best(self, text: str) -> tuple[str | None, float]:
        """The license of the nearest template and its cosine; equal ones by name."""
        return self._nearest(terms(text))

    def _nearest(self, words: list[str]) -> tuple[str | None, float]:
        v = self.vector(words)
        dots: dict[int, float] = {}
        for t, x in v.items():
            for k, y in self.by_term.get(t, ()):
                dots[k] = dots.get(k, 0.0) + x * y
        if not dots:
            return None, 0.0
        k = min(dots, key=lambda k: (-dots[k], self.names[k], k))
        return self.names[k], dots[k] / math.sqrt(sum(x * x for x in v.values()))

    def _windows(self, words: list[str], least: float):
        """(first word, words) of the runs of a template's length that could reach `least` and hold a telling term of it.

        The bound on single words leaves out no run that reaches `least`: a
        repeated word weighs `_MOST` of its single weights at the most, and the
        last of the factors below at the least.
        """
        have = set(words)
        able = {k for k, t in enumerate(self.telling) if not t.isdisjoint(have)}
        if not able or least >= 1:
            return
        weight = np.array([self.idf.get(t, self.other) ** 2 for t in words])
        total = np.concatenate([[0.0], np.cumsum(weight)])
        at: dict[str, list[int]] = {}
        for i, t in enumerate(words):
            at.setdefault(t, []).append(i)
        inside: dict[int, list[int]] = {}
        for t, places in at.items():
            for k, _ in self.by_term.get(t, ()):
                if k in able:
                    inside.setdefault(k, []).extend(places)
        seen = set()
        for k, places in inside.items():
            size = min(self.sizes[k], len(words))
            telling = np.zeros(len(words) + 1, np.int64)
            for t in self.telling[k]:
                telling[[i + 1 for i in at.get(t, ())]] = 1
            telling = np.cumsum(telling)
            ratio = least * least / (1 - least * least) / _MOST * min(1.0, (1 + math.log(size)) ** 2 / size)
            own = np.zeros(len(words) + 1)
            own[np.array(places) + 1] = weight[places]
            own = np.cumsum(own)
            got = own[size:] - own[:-size]
            other = total[size:] - total[:-size] - got
            for i in np.flatnonzero((got >= ratio * other - 1e-9) & (telling[size:] > telling[:-size])).tolist():
                if (i, size) not in seen:
                    seen.add((i, size))
                    yield i, words[i : i + size]

    def header(self, text: str, least: float = HEADER) -> tuple[str | None, float, int | None]:
        """The best line or notice of a text that reaches `least`, and the line it begins in; the first of equal ones.

        A notice is a run of words of a template's length, wherever lines break
        and whatever stands before and after it.
        """
        out = (None, 0.0, None)
        low = text.lower()
        if not self.hint.search(low):
            return out
        words, line_of, lines = [], [], low.split("\n")
        for i, (line, folded) in enumerate(zip(text.split("\n"), lines, strict=False)):
            own = _TERM.findall(folded)
            words += own
            line_of += [i] * len(own)
            if self.hint.search(folded):
                name, cos = self.best(line)
                if name and cos >= least and cos > out[1]:
                    out = (name, cos, i)
        if out[1] < 1 - 1e-9:
            for i, run in self._windows(words, least):
                name, cos = self._nearest(run)
                if name and cos >= least and cos > out[1] + 1e-9 and any(n == name and t & set(run) for n, t in zip(self.names, self.telling, strict=True)):
                    out = (name, cos, line_of[i])
        return out


def document_frequencies(docs: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """Documents that have each term of the (bounded) vocabulary, over all documents."""

    def run(batches):
        for batch in batches:
            seen: Counter = Counter()
            for t in batch.column("text"):
                t = t.as_py()
                if t:
                    seen.update(vocabulary.intersection(_TERM.findall(t.lower())))
            seen[""] = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    got = {r["term"]: r["n"] for r in docs.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return {t: got.get(t, 0) for t in vocabulary}, got.get("", 0)


def scan_licenses(docs: DataFrame, path, id_col: str = "doc_id", text_col: str = "text", templates=None, header: float = HEADER, whole: float = FILE) -> DataFrame:
    """License of each document: (doc_id, path, license, cosine, origin, declared_in).

    `path` is a column (or its name) of `/`-separated paths, or a table (doc_id,
    path) of the places where documents stand: a document then has a row for each
    of its places, and one with a null path if it has none; texts don't move. A licence file is one
    named LICENSE, COPYING or NOTICE, or one whose whole text reaches `whole`
    against a template or a whole licence (`full_texts`, unless templates are
    given); every other document is searched for a header, its line or wrapped or
    embedded notice of the highest cosine, `header` at least. A document with neither inherits from
    the licence file in its own folder, else in the nearest folder above; of
    several in one folder the one of the highest cosine counts, then the smaller
    path. origin is `file`, `header`, `inherited` or null.

    Null texts have no license of their own; null paths inherit none; rows that
    repeat an id are judged each by its own text and path; an empty table gives an
    empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    places = path if isinstance(path, DataFrame) else None
    path = F.lit(None) if places is not None else F.col(path) if isinstance(path, str) else path
    d = docs.select(F.col(id_col).alias("doc_id"), path.cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    vocabulary = {t for texts in (templates or TEMPLATES).values() for x in texts for t in terms(x)}
    full = {} if templates else full_texts()
    long = {t for texts in full.values() for x in texts for t in terms(x)}
    bound_batches(spark)
    df_all, n = document_frequencies(d.select("text"), vocabulary | long)
    df = {t: df_all[t] for t in vocabulary}
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = Matcher(df, n, templates, min(header, whole))
        files = Matcher(df_all, n, full, whole) if full else None
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for t in part.column("text").to_pylist():
                    t = t or ""
                    hit = (None, 0.0)
                    if m.hint.search(t.lower()):
                        words = terms(t)
                        hit = m._nearest(words)
                        if files:
                            hit = max(hit, files._nearest(words), key=lambda x: x[1])
                    if hit[0] and hit[1] >= whole:
                        out.append((hit[0], hit[1], "file"))
                        continue
                    name, cos, _ = m.header(t, header)
                    out.append((name, cos if name else None, "header" if name else None))
                name, cos, origin = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("path"), pa.array(name, pa.string()), pa.array(cos, pa.float64()), pa.array(origin, pa.string())], ["doc_id", "path", "license", "cosine", "origin"])

    found = d.mapInArrow(run, f"doc_id {kind}, path string, license string, cosine double, origin string")
    if places is not None:
        places = places.select("doc_id", F.col("path").cast("string").alias("path")).where("doc_id is not null and path is not null").distinct()
        found = found.drop("path").join(places, "doc_id", "left").select("doc_id", "path", "license", "cosine", "origin")
    is_file = F.element_at(F.split("path", "/"), -1).rlike(_FILE_NAME)
    found = found.withColumn("origin", F.when(F.col("origin").isNotNull() & is_file, "file").otherwise(F.col("origin")))
    own = staged(found.withColumn("folder", F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)), "licenses")
    # the licence of each folder, then of each folder with documents that lack one
    of = own.where("origin = 'file' and path is not null").groupBy("folder").agg(F.min(F.struct((-F.col("cosine")).alias("k"), "path", "license")).alias("f")).select(F.col("folder").alias("above"), "f.license", "f.path")
    open_ = own.where("origin is null and path is not null").select("folder").distinct()
    depth = F.size(F.split("folder", "/"))
    up = open_.select("folder", F.explode(F.sequence(F.lit(0), depth - 1)).alias("k")).select("folder", "k", F.when(F.col("k") == 0, "").otherwise(F.concat(F.array_join(F.slice(F.split("folder", "/"), F.lit(1), F.col("k")), "/"), F.lit("/"))).alias("above"))
    near = staged(up.join(of, "above").groupBy("folder").agg(F.max(F.struct("k", "license", "path")).alias("n")).select("folder", F.col("n.license").alias("given"), F.col("n.path").alias("from")), "inherited")
    # rows that can't inherit don't join: those without a path would all meet in one task
    lacks = F.col("origin").isNull() & F.col("path").isNotNull()
    out = own.where(lacks).join(near, "folder", "left").unionByName(own.where(~lacks), allowMissingColumns=True)
    take = F.col("given").isNotNull()
    return out.select("doc_id", "path", F.when(take, F.col("given")).otherwise(F.col("license")).alias("license"), "cosine", F.when(take, "inherited").otherwise(F.col("origin")).alias("origin"), F.when(take, F.col("from")).when(F.col("origin").isNotNull(), F.col("path")).alias("declared_in"))
