"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then nearest-ancestor inheritance.

A file's passages are its lines, sentences and paragraphs that hold a cue of licensing; each is compared with all templates.  Inverse
document frequencies come from all passages of all files; only terms of the templates need one (a vocabulary that the templates
bound, so it is sent to all tasks), any other term counts as unseen.  A file whose best cosine reaches ``least`` has a licence
of its own.  Directories get the licence of their licence files; all others inherit from the nearest ancestor that has one, by
joins on paths over distinct directories, not files.  A file that says it is under a licence that no template knows inherits none:
its licence is unknown, so that a stricter one is never replaced by a looser one.

Defined results: null and empty texts have no licence of their own; very long texts are read whole, line by line, so that a notice
counts wherever it stands; of equal cosines the first template counts; a null path inherits nothing; of several licence files in a
directory the highest cosine wins, then the smallest path, then the smallest licence; rows that repeat get the same result; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import cut, looked_up, whole_texts

LEAST = 0.6
#: Verdicts that a task remembers, by the digest of the passages.
REMEMBERED = 10_000
_CUE = r"(?i)licen[cs]|copyright|redistribut|warrant|spdx|public domain|permission"
_CUES, _TERM, _LINE, _PARAGRAPH = re.compile(_CUE), re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*"), re.compile(r"[^\n\r]+"), re.compile(r"\r?\n[^\S\n]*\r?\n")
_SENTENCE = re.compile(r"(?<=[.;!?])\s+")
_STATEMENT = re.compile(r"(?i)\b(?:licen[cs]ed|released|distributed|available) under\b|spdx-license-identifier")

#: Licences with the notices and headers that name them (fixed values, public texts).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "MPL-2.0": (
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "CC0-1.0": (
        "SPDX-License-Identifier: CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work, CC0 1.0 Universal.",
    ),
    **{
        f"CC-{short}-4.0": (
            f"SPDX-License-Identifier: CC-{short}-4.0",
            f"Licensed under CC {short} 4.0.",
            f"This work is licensed under a Creative Commons {long} 4.0 International License.",
        )
        for short, long in (
            ("BY", "Attribution"),
            ("BY-SA", "Attribution-ShareAlike"),
            ("BY-NC", "Attribution-NonCommercial"),
            ("BY-ND", "Attribution-NoDerivatives"),
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
            ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
    },
    "ISC": (
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}


def terms(passage: str) -> Counter:
    return Counter(_TERM.findall(passage.lower()))


def passages(text: str) -> list[str]:
    """The lines, the sentences of a line of several, and the paragraphs of several lines, that hold a cue."""
    if not _CUES.search(text):
        return []
    lines = [x for x in _LINE.findall(text) if _CUES.search(x)]
    sentences = [x for line in lines if len(parts := _SENTENCE.split(line.strip())) > 1 for x in parts if _CUES.search(x)]
    return lines + sentences + [x for x in _PARAGRAPH.split(text) if "\n" in x.strip() and _CUES.search(x)]


def states_one(found: list[str]) -> bool:
    """Whether any passage says that something is under a licence, whichever."""
    return any(_STATEMENT.search(x) for x in found)


class Weights:
    """The templates as unit vectors for given frequencies of their terms in n passages."""

    def __init__(self, templates: dict[str, tuple[str, ...]], n: int, frequency: dict[str, int]) -> None:
        self.n, self.frequency = n, frequency
        self.templates = [(name, self.unit(terms(form))) for name, forms in templates.items() for form in forms]

    def idf(self, term: str) -> float:
        return math.log((1 + self.n) / (1 + self.frequency.get(term, 0))) + 1

    def unit(self, counts: Counter) -> dict[str, float]:
        vector = {t: c * self.idf(t) for t, c in counts.items()}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        return {t: x / norm for t, x in vector.items()} if norm else {}

    def best(self, found: list[str]) -> tuple[float, str]:
        """The highest cosine of any passage to any template, and its licence; of equal ones the first template."""
        top = (0.0, "")
        for passage in found:
            vector = self.unit(terms(passage))
            for name, template in self.templates:
                cosine = sum(x * vector.get(t, 0.0) for t, x in template.items())
                if cosine > top[0] + 1e-12:
                    top = (cosine, name)
        return top


def _frequency_rows(vocabulary: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for raw in whole_texts(batch):
                for passage in passages(raw.decode("utf-8")):
                    counts[""] += 1
                    counts.update(vocabulary & terms(passage).keys())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    return run


def cued_rows(files: DataFrame) -> Column:
    """Whether a row has a word that any statement of a licence has; null texts have none."""
    return F.coalesce(F.col("text").rlike(_CUE), F.lit(False))


def own_licenses(files: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, least: float = LEAST) -> DataFrame:
    """stated, license and score of the rows of ``files`` (text and other columns) that have a cue, and the other columns.

    ``stated`` tells whether a row says that it is under a licence.  The licence is null if no template reaches ``least``: it is
    unknown.
    """
    templates = templates or TEMPLATES
    cued = files.where(cued_rows(files))
    vocabulary = frozenset(t for forms in templates.values() for form in forms for t in terms(form))
    sums = cued.select("text").mapInArrow(_frequency_rows(vocabulary), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    frequency = {r.term: r.n for r in sums}
    weights = Weights(templates, frequency.pop("", 0), frequency)
    rest = [c for c in files.columns if c != "text"]

    def verdict(found: list[str]) -> tuple[float, str | None] | None:
        score, name = weights.best(found)
        return (score, name) if score >= least else (score, None) if states_one(found) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, tuple[float, str | None] | None] = {}  # by a digest, so that its size does not go with the passages'
        for batch in batches:
            found = []
            for raw in whole_texts(batch):
                parts = passages(raw.decode("utf-8"))
                key = hashlib.blake2b("\n\n".join(parts).encode(), digest_size=16).digest()
                if key not in memory:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[key] = verdict(parts)
                found.append(memory[key])
            stated = pa.array([x is not None for x in found], pa.bool_())
            columns = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            made = [pa.array([x and x[1] for x in found], pa.string()), pa.array([x and x[0] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, stated, *made], names=[*rest, "stated", "license", "score"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in files.dtypes if c != "text")
    return cued.select(*rest, "text").mapInArrow(run, f"{kinds}, stated boolean, license string, score double")


def directory(path: Column) -> Column:
    """The directory of a path, without the last slash; the root is empty."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def license_scan(files: DataFrame, is_license: Column, templates: dict[str, tuple[str, ...]] | None = None, least: float = LEAST, keep: tuple[str, ...] = ()) -> DataFrame:
    """path, license, score, how ('own', 'inherited' or 'unknown') and source_path of every row of ``files`` (path, text).

    ``is_license`` is a condition on path and text that says which files speak for their directory.  The columns of ``keep`` come
    first, as they are.  What a row states is its own, whatever other rows have its path, and stays with its row; a path decides
    only which directories a row inherits from.
    """
    kept = [f"kept_{k}" for k in range(len(keep))]
    rows = files.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)], F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("speaks", F.coalesce(is_license, F.lit(False)))
    own = cut(own_licenses(rows, templates, least), "licenses")
    order = F.struct((-F.col("score")).alias("s"), "path", "license")
    spoken = own.where("stated AND speaks AND path IS NOT NULL AND license IS NOT NULL")
    spoken = spoken.groupBy(directory(F.col("path")).alias("ancestor")).agg(F.min(order).alias("l"))

    dirs = rows.where("path IS NOT NULL").groupBy(directory(F.col("path")).alias("dir")).agg(F.count("*").alias("files"))
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    ancestors = F.array_distinct(F.concat(F.array(F.lit("")), ancestors))
    near = dirs.select("dir", "files", F.posexplode(ancestors).alias("depth", "ancestor")).join(spoken, "ancestor", "left")
    near = near.groupBy("dir").agg(F.max_by("l", F.when(F.col("l").isNotNull(), F.col("depth"))).alias("l"), F.first("files").alias("files"))

    mine = own.where("stated").select(
        *kept, "path", "license", "score", F.when(F.col("license").isNotNull(), "own").otherwise("unknown").alias("how"), F.col("path").alias("source_path")
    )
    others = rows.where(~cued_rows(rows)).select(*kept, "path").unionByName(own.where("NOT stated").select(*kept, "path"))
    placed = looked_up(others.where("path IS NOT NULL").withColumn("at", directory(F.col("path"))), near, [("at", "dir")], "files", files.count())
    found = F.col("l").isNotNull()
    inherited = placed.select(*kept, "path", F.col("l.license").alias("license"), (-F.col("l.s")).alias("score"), F.when(found, "inherited").alias("how"), F.col("l.path").alias("source_path"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("license", "string"), ("score", "double"), ("how", "string"), ("source_path", "string"))]
    nowhere = others.where("path IS NULL").select(*kept, "path", *none)
    return mine.unionByName(inherited).unionByName(nowhere).withColumnsRenamed(dict(zip(kept, keep, strict=True)))
