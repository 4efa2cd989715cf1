"""License scanning: MinHash bands over overlapping text windows retrieve templates, and
exact containment of the template's shingles verifies them.

A template of s shingles (five words; a shorter one is a shingle itself) is looked for in
windows of 2B shingles that start every B, where B is the power of two at or above s, so
some window holds it whole, wherever it stands.  A window and a template meet if they
agree in one of ``BANDS`` minima.  With the template whole in its window their similarity
is at least 1/4 and they miss each other with probability below 0.75 ** BANDS (1e-4);
with three quarters of it, below 0.82 ** BANDS (2e-3).

Texts without a single shingle of a template hold none, so minima are taken only of texts
that have one; what that costs depends on the size classes of the templates, not on how
many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import bloom
from heddle.llm.bytewords import ALNUM, grams, mix, salted, slices, words
from heddle.llm.shared import written

SHINGLE, BANDS, CONTAINED = 5, 32, 0.75
#: Bits of the filter for each template shingle: a text of thousands of words rarely passes by chance.
SHINGLE_BITS = 64

# Short notices that say which license applies.  Whole license texts lie beside
# this module, in ``license_texts``, as their publishers word them.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0"],
    "Apache-2.0-header": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version"
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
}
TEXTS = Path(__file__).parent / "license_texts"


def all_templates() -> dict[str, list[str]]:
    """The notices of each license, and its whole text as the last template of its name with
    ``-text`` behind."""
    return NOTICES | {f"{p.stem}-text": [p.read_text("utf-8")] for p in sorted(TEXTS.glob("*.txt"))}


def templates(spark: SparkSession) -> DataFrame:
    """license, template (number within the license), text."""
    return spark.createDataFrame([(name, i, t) for name, texts in all_templates().items() for i, t in enumerate(texts)], "license string, template int, text string")


def _class(n: int) -> int:
    return max(0, int(n - 1).bit_length())


def _template_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = words(batch.column("text"), ALNUM)
        out = []
        for d in range(batch.num_rows):
            a, b = int(found.first[d]), int(found.first[d + 1])
            if a == b:
                continue
            # the shingle length goes with a template shorter than a shingle
            k = min(SHINGLE, b - a)
            s = np.unique(grams(found.hashes[a:b], k))
            c = _class(b - a - k + 1)
            keys = [int(band_key(salted(s, j).min(keepdims=True), c, k, j)[0]) for j in range(BANDS)]
            out.append({"license": batch.column("license")[d].as_py(), "template": batch.column("template")[d].as_py(), "size_class": c, "k": k, "shingles": s.view(np.int64).tolist(), "keys": np.array(keys, np.uint64).view(np.int64).tolist()})
        yield pa.RecordBatch.from_pylist(out, _BANDED)


_BANDED = pa.schema([("license", pa.string()), ("template", pa.int32()), ("size_class", pa.int32()), ("k", pa.int32()), ("shingles", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])


def band_key(least: np.ndarray, size_class: int, k: int, band: int) -> np.ndarray:
    return mix(least + np.uint64((size_class * 16 + k) * 64 + band))


_HIT = pa.struct([("size_class", pa.int32()), ("k", pa.int32()), ("word", pa.int64()), ("shingles", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])


def shingle_key(shingles: np.ndarray, k: int) -> np.ndarray:
    return mix(shingles + np.uint64(k))


def _window_hits(classes: list[tuple[int, int]], sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, shingles = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                found = words(part.column("text"), ALNUM)
                hits: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for k in sorted({k for _, k in classes}):
                    _probe(found, k, [c for c, n in classes if n == k], bands, shingles, hits)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("version"), pa.array(hits, pa.list_(_HIT))], ["doc_id", "version", "hits"])

    return run


def _probe(found, k: int, classes: list[int], filled: np.ndarray, known: np.ndarray, hits: list[list[dict]]) -> None:
    count = np.maximum(np.diff(found.first) - k + 1, 0)  # shingles of each text
    if not count.sum():
        return
    everywhere = grams(found.hashes, k)
    # texts that have a shingle of a template; a shingle across two texts makes one too many
    likely = np.flatnonzero(bloom.holds(known, shingle_key(everywhere, k)))
    seen = np.zeros(len(count), bool)
    seen[np.searchsorted(found.first, likely, "right") - 1] = True
    count = np.where(seen, count, 0)
    if not count.sum():
        return
    first = np.cumsum(count) - count
    # the shingles of those texts on end, without those across texts
    s = everywhere[np.repeat(found.first[:-1] - first, count) + np.arange(int(count.sum()))]
    # blocks of each class: begin, whether the next block is of the same text
    blocks = {}
    for c in classes:
        n = -(-count // (1 << c))
        doc = np.repeat(np.arange(len(count)), n)
        begin = first[doc] + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * (1 << c)
        blocks[c] = (doc, begin)
    keys: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {c: [] for c in classes}
    for j in range(BANDS):
        h = salted(s, j)
        for c in classes:
            doc, begin = blocks[c]
            least = np.minimum.reduceat(h, begin)
            pair = least.copy()
            joined = np.flatnonzero(doc[:-1] == doc[1:])
            pair[joined] = np.minimum(least[joined], least[joined + 1])
            key = band_key(pair, c, k, j)
            at = np.flatnonzero(bloom.holds(filled, key))
            if len(at):
                keys[c].append((at, key[at]))
    for c in classes:
        if not keys[c]:
            continue
        doc, begin = blocks[c]
        at = np.concatenate([a for a, _ in keys[c]])
        key = np.concatenate([x for _, x in keys[c]])
        for i in np.unique(at).tolist():
            d = int(doc[i])
            stop = min(int(begin[i]) + (2 << c), int(first[d] + count[d]))
            hits[d].append({"size_class": c, "k": k, "word": int(begin[i] - first[d]), "shingles": np.unique(s[begin[i] : stop]).view(np.int64).tolist(), "keys": key[at == i].view(np.int64).tolist()})


def _shingle_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k, s = np.asarray(batch.column("k"), np.int64).astype(np.uint64), np.asarray(batch.column("s"), np.int64).view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(mix(s + k).view(np.int64))], ["key"])


def scan(docs: DataFrame, known: DataFrame, *, contained: float = CONTAINED, bits: int = bloom.BITS) -> DataFrame:
    """Find the templates ``known`` (license, template, text) in ``docs`` (doc_id, text).

    Returns one row for each document and license found: doc_id, license, containment (the
    best share of a template's shingles in one window), n_windows (with at least
    ``contained``), first_word (where the first such window begins).  Null and empty texts
    hold nothing; repeated rows are found once; templates without words match nothing.  A very
    long text is one row with all its windows that meet a template."""
    banded = written(known.select("license", "template", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_template_bands, "license string, template int, size_class int, k int, shingles array<bigint>, keys array<bigint>"), "bands")
    # size classes are logarithmic in the longest template
    classes = sorted((r[0], r[1]) for r in banded.select("size_class", "k").distinct().collect())
    keyed = banded.select("license", "template", F.col("shingles").alias("wanted"), F.explode("keys").alias("key"))
    shingled = banded.select("k", F.explode("shingles").alias("s")).distinct().mapInArrow(_shingle_keys, "key long")
    sent = docs.sparkSession.sparkContext.broadcast((bloom.build(keyed.select("key"), "key", bits), bloom.build(shingled, "key", bits, SHINGLE_BITS)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    hit = "array<struct<size_class:int,k:int,word:bigint,shingles:array<bigint>,keys:array<bigint>>>"
    read = docs.select("doc_id", F.xxhash64("text").alias("version"), F.coalesce("text", F.lit("")).alias("text"))
    marked = written(read.mapInArrow(_window_hits(classes, sent), f"doc_id {kind}, version long, hits {hit}").filter(F.size("hits") > 0), "windows")
    windows = marked.select("doc_id", "version", F.explode("hits").alias("h")).select("doc_id", "version", "h.word", "h.shingles", F.explode("h.keys").alias("key"))
    met = windows.join(keyed, "key")
    share = F.size(F.array_intersect("shingles", "wanted")) / F.size("wanted")
    verified = met.select("doc_id", "version", "license", "template", "word", share.alias("share")).filter(F.col("share") >= contained)
    return verified.groupBy("doc_id", "license").agg(
        F.round(F.max("share"), 6).alias("containment"), F.count_distinct("version", "template", "word").alias("n_windows"), F.min("word").alias("first_word")
    )
