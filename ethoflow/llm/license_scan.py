"""License scans by diagonal voting.

A template is a list of words: a whole license, the notice that files carry, or
a phrase.  Every rolling word k-gram of every text is hashed in its task and
joined by Spark with the places of the same gram in the templates.  A hit at
word p of a text and word q of a template votes for the diagonal p - q, where
the template would begin; votes are summed before the shuffle.  Diagonals of one
template that lie next to each other, as inserted or deleted words leave them,
become one candidate span, and the candidate is verified on the words of the
text: the template's words inside equal grams must make up a share of at least
``least`` of it.

Texts are normalised at byte level, as in ``decontaminate``: A-Z in lower case,
words of ASCII letters, digits and all other bytes from 0x80.  Texts are not
shuffled with their grams: a text meets its candidates again by its id and
content hashes, behind a blocked Bloom filter of those that have any.

Edge cases: null and empty texts have no words and no spans; a null id is an id
like any other; repeated rows come back as often as they came, each with the
spans of its own text; rows that share an id but not a text stay apart; spans of
one text that overlap are all returned; templates without words, or with fewer
words than their gram, take no part; no templates, or an empty table, give rows
without spans and no rows; further columns, of any name, do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ethoflow.llm._arrays import mixed
from ethoflow.llm._common import Scratch, small_batches
from ethoflow.llm.decontaminate import normalise
from ethoflow.llm.url_filter import built_filter

#: Grams of the templates that are broadcast; with more, the join is a shuffle.
BROADCAST_GRAMS = 1 << 20
#: Words whose grams are hashed at a time.
PIECE = 1 << 17

SPANS = "array<struct<template:int,first_word:long,last_word:long,start:long,end:long,similarity:double>>"


class Template(NamedTuple):
    """Words to look for, and how: gram length, steps between neighbouring diagonals, least share of words in equal grams."""

    label: str
    text: str
    gram: int = 5
    step: int = 4
    least: float = 0.8


def phrase(label: str, text: str) -> Template:
    """A template that counts only where all its words stand consecutively."""
    return Template(label, text, 2, 0, 1.0)


def notice(label: str, text: str) -> Template:
    """A short notice: grams of two words, one word may be put in or left out."""
    return Template(label, text, 2, 1, 0.8)


#: The phrases of the base labels.
PHRASES = (phrase("mit", "mit license"), phrase("apache", "apache license"), phrase("gpl", "general public license"))

#: Notices and license texts as their publishers word them.
TEXTS = (
    notice("mit", "released under the MIT license"),
    notice("apache", "licensed under the Apache License, Version 2.0"),
    notice("gpl", "licensed under the GNU General Public License, version 3"),
    phrase("cc-by-nc", "CC BY-NC"),
    phrase("cc-by-sa", "CC BY-SA"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    Template(
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You '
        "may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    Template(
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
)

TEMPLATES = PHRASES + TEXTS

_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(joined: bytes, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words of a text whose words are parted by one space."""
    raw = np.frombuffer(joined, dtype=np.uint8)
    begins = np.concatenate(([0], np.flatnonzero(raw == 0x20) + 1)) if len(raw) else np.zeros(0, dtype=np.int64)
    ends = np.concatenate((begins[1:] - 1, [len(raw)]))
    n = len(begins) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        # A polynomial over bytes: differences of prefix sums, brought to a common power by the base's inverse.
        power, back, total = _powers(_BASE, len(raw)), _powers(pow(_BASE, -1, 1 << 64), len(raw)), np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        first, last = begins[:n], ends[size - 1 :]
        return mixed((total[last] - total[first]) * back[first]).view(np.int64)


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    parts = [gram_hashes(b" ".join(words[i : i + PIECE + size - 1]), size) for i in range(0, max(1, len(words) - size + 1), PIECE)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _grams(sizes: Sequence[int]):
    """Rows (id, hashes of the text, n_words, size, grams); the one gram of size 0 stands for the row itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            rows, counts, kinds, grams = [], [], [], []
            for i in range(batch.num_rows):
                words = normalise(texts[i].as_py()).split()
                rows += [i] * (1 + len(sizes))
                counts += [len(words)] * (1 + len(sizes))
                kinds += [0, *sizes]
                grams += [np.zeros(1, dtype=np.int64), *(_hashes(words, k) for k in sizes)]
            if not rows:
                continue
            offsets = np.concatenate(([0], np.cumsum([len(g) for g in grams]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(grams)))
            own = [batch.column(n).take(pa.array(rows)) for n in ("doc_id", "h1", "h2", "bytes")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int64()), pa.array(kinds, pa.int32()), lists], names=["doc_id", "h1", "h2", "bytes", "n_words", "size", "grams"])

    return run


def positions(templates: Sequence[Template]) -> list[tuple[int, int, int, int]]:
    """(size, gram, template, place) of every gram of the templates."""
    out = [(0, 0, -1, 0)]
    for t, template in enumerate(templates):
        words = normalise(template.text).split()
        out += [(template.gram, int(h), t, q) for q, h in enumerate(_hashes(words, template.gram))] if len(words) >= template.gram else []
    return out


class _Matcher:
    """Verifies candidates on the words of a text."""

    def __init__(self, templates: Sequence[Template]) -> None:
        self.templates = templates
        self.words = [normalise(t.text).split() for t in templates]
        self.places: list[dict[bytes, list[int]]] = []
        for t, words in zip(templates, self.words):
            at: dict[bytes, list[int]] = {}
            for q in range(len(words) - t.gram + 1):
                at.setdefault(b" ".join(words[q : q + t.gram]), []).append(q)
            self.places.append(at)

    def spans(self, text: str | None, candidates: list[tuple[int, int, int]]) -> list[tuple]:
        """(template, first word, last word, start, end, similarity) of the candidates (template, lowest and highest diagonal) that hold."""
        plain = normalise(text)
        words, found = plain.split(), []
        for t, low, high in candidates:
            k, n = self.templates[t].gram, len(self.words[t])
            covered, first, last = set(), None, 0
            for p in range(max(0, low), min(len(words) - k, high + n - k) + 1):
                hits = [q for q in self.places[t].get(b" ".join(words[p : p + k]), ()) if low <= p - q <= high]
                if hits:
                    covered.update(q + i for q in hits for i in range(k))
                    first, last = p if first is None else first, p + k - 1
            similarity = len(covered) / n
            if similarity >= self.templates[t].least:
                found.append((t, first, last, similarity))
        if not found:
            return []
        inside = np.concatenate(([False], np.frombuffer(plain, dtype=np.uint8) != 0x20, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
        source = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        chars = np.concatenate(([0], np.cumsum((source & 0xC0) != 0x80)))
        return [(t, a, b, int(chars[edges[a, 0]]), int(chars[edges[b, 1]]), s) for t, a, b, s in sorted(found)]


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.withColumns({"h1": F.xxhash64("text"), "h2": F.hash("text"), "bytes": F.octet_length("text")})


_KEY = ["doc_id", "h1", "h2", "bytes"]


def candidates(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, h1, h2, bytes, n_words, copies, found): one a different text and id, with the spans that enough votes speak for."""
    spark = docs.sparkSession
    small_batches(spark)
    places = positions(templates)
    listed = spark.createDataFrame(places, "size int, gram long, template int, place int")
    sizes = sorted({p[0] for p in places if p[0]})
    grams = _identified(docs, id_col, text_col).mapInArrow(_grams(sizes), "doc_id long, h1 long, h2 int, bytes int, n_words long, size int, grams array<long>")
    grams = grams.select(*_KEY, "n_words", "size", F.posexplode("grams").alias("at", "gram"))
    hits = grams.join(F.broadcast(listed) if len(places) <= BROADCAST_GRAMS else listed, ["size", "gram"])
    votes = hits.groupBy(*_KEY, "n_words", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.count("*").alias("votes"))
    # Neighbouring diagonals of a template become one candidate.
    rules = [(t, x.step, x.gram, len(normalise(x.text).split()) * x.least) for t, x in enumerate(templates)]
    rules = spark.createDataFrame([(-1, 0, 1, 0.0), *rules], "template int, step int, size int, least double")
    line = Window.partitionBy(*_KEY, "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > F.col("step")).cast("int"), F.lit(0))
    runs = votes.join(F.broadcast(rules), "template").withColumn("apart", apart).withColumn("run", F.sum("apart").over(line))
    merged = runs.groupBy(*_KEY, "n_words", "template", "run").agg(
        F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("votes").alias("votes"), F.first("size").alias("size"), F.first("least").alias("least")
    )
    # A vote covers as many words as its gram has, so fewer votes cannot reach the share.
    enough = merged.where(F.col("votes") * F.col("size") >= F.col("least") - 1e-6)
    spans = F.collect_list(F.when(F.col("template") >= 0, F.struct("template", "low", "high")))
    return enough.groupBy(*_KEY, "n_words").agg(F.max(F.when(F.col("template") < 0, F.col("votes"))).alias("copies"), F.array_sort(spans).alias("found"))


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, spans) for every document.

    spans: (number of the template, first and last word, start and end
    character in the original text, share of the template's words).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    found = scratch.keep(candidates(docs, templates, id_col, text_col), "candidates")
    some = found.where(F.size("found") > 0)
    none = found.where(F.size("found") == 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    sent = spark.sparkContext.broadcast(built_filter(some.select("h1")))

    @F.pandas_udf("boolean")
    def may_hold(hashes):
        import pandas as pd

        return pd.Series(sent.value.may_hold(hashes.to_numpy()))

    rows = _identified(docs, id_col, text_col).where(may_hold("h1"))
    met = rows.alias("d").join(some.alias("s"), (F.col("d.doc_id").eqNullSafe(F.col("s.doc_id"))) & (F.col("d.h1") == F.col("s.h1")) & (F.col("d.h2") == F.col("s.h2")) & (F.col("d.bytes") == F.col("s.bytes")))
    met = met.select("d.doc_id", "s.n_words", "d.text", "s.found")
    names = ("template", "first_word", "last_word", "start", "end", "similarity")
    kind = pa.list_(pa.struct([(names[0], pa.int32()), *((n, pa.int64()) for n in names[1:5]), (names[5], pa.float64())]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Matcher(templates)
        for batch in batches:
            out = [
                [dict(zip(names, s)) for s in matcher.spans(text, [(c["template"], c["low"], c["high"]) for c in held])]
                for text, held in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(out, kind)], names=["doc_id", "n_words", "spans"])

    verified = met.mapInArrow(verify, f"doc_id long, n_words long, spans {SPANS}")
    return verified.unionAll(none.select("doc_id", "n_words", F.array().cast(SPANS).alias("spans")))


def labelled(scanned: DataFrame, templates: Sequence[Template] = TEMPLATES, base: int = len(PHRASES)) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score); the first ``base`` templates are the base's phrases."""
    names = F.array(*(F.lit(t.label) for t in templates)) if templates else F.array().cast("array<string>")
    of_base = F.filter("spans", lambda s: s["template"] < base)

    def joined(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.element_at(names, s["template"] + 1)))), ",")

    places = F.transform("of_base", lambda s: s["first_word"])
    return scanned.withColumn("of_base", of_base).select(
        "doc_id", "n_words", F.size("of_base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        joined("of_base").alias("base_labels"), joined("spans").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["similarity"])), F.lit(0.0)).alias("score"),
    )
