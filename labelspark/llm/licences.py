"""Licence scan: sparse TF-IDF cosine of segments to licence templates, then
inheritance from the nearest ancestor directory by joins on paths.

A segment is a run of a file's words, across line breaks, as long as a template
or a little longer.  Terms are words and word pairs; the templates' terms are
weighed by the share of files that hold them (a table as large as the
templates), every other term by a fixed weight, so the verdict on a line does
not depend on the size of the table.  A file
with a segment close to a template has that licence of its own.  Licence files
(by name, or because a passage of licence text makes up a good part of them) give their
licence to their directory; a file without a licence of its own takes that of
the nearest directory above it that has one.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.llm.shared import keep

#: Wording of well-known licence notices.
TEMPLATES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved."],
}
#: Names that licences go by in short notices.
TITLES = {
    "AGPL-3.0": ["AGPLv3", "AGPL 3.0"], "Apache-2.0": ["Apache License 2.0", "Apache 2.0 License"], "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"], "EPL-2.0": ["Eclipse Public License 2.0", "EPL 2.0"], "GPL-2.0": ["GPLv2", "GPL 2.0"],
    "GPL-3.0": ["GPLv3", "GPL 3.0"], "ISC": ["ISC License"], "LGPL-3.0": ["LGPLv3", "LGPL 3.0"], "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "MPL 2.0"], "Unlicense": ["Unlicense"],
}
_NOTICES = ("Licensed under the {}.", "Released under the {}.", "Distributed under the terms of the {}.")


def all_templates() -> dict[str, list[str]]:
    """TEMPLATES, the short notices of each title, and the tags that name a licence
    by its identifier (of the GNU licences also with what follows the version)."""
    out = {name: list(texts) for name, texts in TEMPLATES.items()}
    for name, titles in TITLES.items():
        out.setdefault(name, []).extend(n.format(t) for t in titles for n in _NOTICES)
    for name, texts in out.items():
        if name != "proprietary":
            tags = [name, f"{name}-only", f"{name}-or-later"] if "GPL" in name else [name]
            texts += [f"SPDX-License-Identifier: {t}" for t in tags if f"SPDX-License-Identifier: {t}" not in texts]
    return {name: list(dict.fromkeys(texts)) for name, texts in out.items()}


MIN_COSINE, MIN_SHARE = 0.7, 0.25
#: Words of licence text that make a file a licence file whatever its name.
MIN_WORDS = 20
#: Words that turn a notice round, in it or up to three words before it.
NEGATIONS = frozenset(["not", "never", "nor", "no", "neither", "isn", "aren", "wasn", "cannot"])
#: Share of files that stands for all rarer terms and for terms outside the templates.
RAREST = 1e-3
_TERM = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
_NAMED = r"(?i)(^|/)(licen[cs]e|copying|copyright|notice)([.\-_][^/]*)?$"


def lowered(text: str | None) -> str:
    """A text in lower case, with the spelling that the templates have."""
    return (text or "").lower().replace("licence", "license").replace("licenced", "licensed")


def segment_terms(words: list[str]) -> Counter:
    return Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:]))


def longest(n: int) -> int:
    """Words of the longest segment that is compared with a template of n words."""
    return n + max(2, n // 4)


class Matcher:
    """Unit TF-IDF vectors of the templates, as postings by term."""

    def __init__(self, templates: dict[str, list[str]], df: dict[str, int] | None = None, n: int = 0):
        worded = [(name, _TERM.findall(lowered(t))) for name in sorted(templates) for t in templates[name]]
        parts = [(name, segment_terms(words)) for name, words in worded]
        self.vocabulary = {t for _, terms in parts for t in terms}
        self.df, self.n, self.names = df or {}, n, [name for name, _ in parts]
        self.lengths = [len(words) for _, words in worded]
        self.outside = 1 - math.log(RAREST)
        self.weight = {t: self.idf(t) for t in self.vocabulary}
        self.vectors: list[dict[str, float]] = []
        for _, terms in parts:
            weights = {t: f * self.idf(t) for t, f in terms.items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            self.vectors.append({t: w / norm for t, w in weights.items()})
        self._by_cue: dict[float, dict[str, list[int]]] = {}

    def idf(self, term: str) -> float:
        if term not in self.vocabulary:
            return self.outside
        return 1 - math.log(max(self.df.get(term, 0) / self.n, RAREST)) if self.n else 1.0

    def _cues_of(self, k: int, min_cosine: float) -> set[str]:
        v, mine = self.vectors[k], set()
        for word in sorted((t for t in v if " " not in t), key=lambda t: (-v[t], t)):
            if sum(w * w for t, w in v.items() if mine.isdisjoint(t.split())) < min_cosine**2:
                break
            mine.add(word)
        return mine

    def cues(self, min_cosine: float) -> list[str]:
        """Words of which a segment needs one to reach ``min_cosine``: per
        template the heaviest words, until the terms without any of them have
        less than ``min_cosine`` squared of its unit mass (by Cauchy-Schwarz
        no segment made of those alone comes closer)."""
        return sorted(set().union(*(self._cues_of(k, min_cosine) for k in range(len(self.vectors)))))

    def by_cue(self, min_cosine: float) -> dict[str, list[int]]:
        """The templates that each cue belongs to."""
        if min_cosine not in self._by_cue:
            found = defaultdict(list)
            for k in range(len(self.vectors)):
                for word in self._cues_of(k, min_cosine):
                    found[word].append(k)
            self._by_cue[min_cosine] = dict(found)
        return self._by_cue[min_cosine]

    def close(self, words: list[str], min_cosine: float):
        """Segments of at least ``min_cosine``: (cosine, licence, start, end)."""
        of, at = self.by_cue(min_cosine), defaultdict(list)
        for i, w in enumerate(words):
            for k in of.get(w, ()):
                at[k].append(i)
        for k, cues in at.items():
            v, n = self.vectors[k], min(self.lengths[k], len(words))
            most, squares, done = longest(self.lengths[k]), {t: w * w for t, w in v.items()}, 0
            for i in cues:
                lo, hi = max(0, i - most + 1), min(len(words), i + most)
                near = set(words[lo:hi])
                near.update(f"{a} {b}" for a, b in zip(words[lo:hi], words[lo + 1 : hi]))
                # what no segment around the cue can exceed
                if sum(squares[t] for t in near & squares.keys()) < min_cosine**2 * (1 - 1e-9):
                    continue
                for start in range(max(lo, done), min(i, len(words) - n) + 1):
                    for cosine, end in self._from(words, start, n, most, v):
                        if cosine >= min_cosine and not self._negated(words, start, end, v):
                            yield cosine, self.names[k], start, end
                done = max(done, min(i, len(words) - n) + 1)

    @staticmethod
    def _negated(words: list[str], start: int, end: int, v: dict[str, float]) -> bool:
        return any(w in NEGATIONS and w not in v for w in words[max(0, start - 3) : end])

    def _from(self, words: list[str], start: int, n: int, most: int, v: dict[str, float]):
        """Cosines to ``v`` of the segments of n to ``most`` words from ``start``, and their ends."""
        counts: Counter = Counter()
        dot = square = 0.0
        for j in range(start, min(len(words), start + most)):
            for t in (words[j], f"{words[j - 1]} {words[j]}") if j > start else (words[j],):
                w = self.weight.get(t, self.outside)
                dot += v.get(t, 0.0) * w
                square += w * w * (2 * counts[t] + 1)
                counts[t] += 1
            if j - start + 1 >= n:
                yield round(dot / math.sqrt(square), 12), j + 1

    def best(self, words: list[str], min_cosine: float = MIN_COSINE) -> tuple[float, str] | None:
        """Highest cosine of a segment, and the licence; ties by name."""
        found = min(self.close(words, min_cosine), key=lambda x: (-x[0], x[1]), default=None)
        return found and found[:2]


def _frequencies(docs: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """How many texts hold each term, and the number of texts."""
    pairs = {tuple(t.split()) for t in vocabulary if " " in t}

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                words = _TERM.findall(lowered(t))
                counts.update(vocabulary.intersection(words))
                counts.update(" ".join(p) for p in pairs.intersection(zip(words, words[1:])))
                counts[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    total = docs.mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r["term"]: r["n"] for r in total.collect()}  # one row per template term
    return counts, counts.pop("", 0)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, file_id: str, path: Column, text: str = "text", templates: dict[str, list[str]] | None = None,
         min_cosine: float = MIN_COSINE, min_share: float = MIN_SHARE) -> DataFrame:
    """Licence of every row of ``files``.

    Columns: the id, ``path``, ``own`` (licence of the closest template, null
    below ``min_cosine``), ``cosine`` (of the closest segment, 0 below that),
    ``licence`` (own, or inherited, or null) and ``inherited_from`` (the
    directory; null if the licence is its own or there is none).  A notice that
    a negation turns round does not count.  Licence files are those named so, and
    those with at least MIN_WORDS words of licence text that are ``min_share`` of
    the text; texts of any length are read whole.  A directory with several licence files takes that of the least path (then id).  Null
    paths count as the root's files, null and empty texts have no segment, rows
    that are repeated are scanned each, other columns are not read, an empty
    table gives none.
    """
    templates = all_templates() if templates is None else templates
    rows = files.select(F.col(file_id).alias("id"), F.coalesce(path, F.lit("")).alias("path"), F.col(text).alias("text"))
    matcher = Matcher(templates)
    matcher = Matcher(templates, *_frequencies(rows.select("text"), matcher.vocabulary))
    cues = matcher.cues(min_cosine)

    def judged(text: str | None) -> tuple[float, str | None, float]:
        low, top, inside = lowered(text), (0.0, None), set()
        if not any(c in low for c in cues):
            return 0.0, None, 0.0
        words = _TERM.findall(low)
        for cosine, name, start, end in matcher.close(words, min_cosine):
            inside.update(range(start, end))
            if cosine > top[0] or (cosine == top[0] and name < top[1]):
                top = cosine, name
        return *top, len(inside) / len(words) if len(inside) >= MIN_WORDS else 0.0

    def run(batches):
        for batch in batches:
            cosine, own, share = zip(*[judged(t) for t in batch.column("text").to_pylist()]) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("path"), pa.array(own, pa.string()), pa.array(cosine, pa.float64()), pa.array(share, pa.float64())],
                names=["id", "path", "own", "cosine", "share"])

    scanned = keep(rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, path string, own string, cosine double, share double"))
    scanned = scanned.withColumn("dir", parent(F.col("path")))
    given = (scanned.where(F.col("own").isNotNull() & (F.col("path").rlike(_NAMED) | (F.col("share") >= min_share)))
             .groupBy("dir").agg(F.min_by("own", F.struct("path", "id")).alias("given")))
    # every directory once: its ancestors, itself included, deepest match wins
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("above")))
    dirs = scanned.groupBy("dir").agg(F.lit(1).alias("one")).select("dir", F.explode(up).alias("u")).select("dir", "u.depth", "u.above")
    near = (dirs.join(given.withColumnRenamed("dir", "above"), "above").groupBy("dir")
            .agg(F.max_by(F.struct("given", "above"), "depth").alias("near")))
    out = scanned.join(near, "dir", "left")
    return out.select(F.col("id").alias(file_id), "path", "own", "cosine", F.coalesce("own", "near.given").alias("licence"),
                      F.when(F.col("own").isNull(), F.col("near.above")).alias("inherited_from"))
