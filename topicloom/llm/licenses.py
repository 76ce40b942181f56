"""Licence scans by diagonal voting.

Every k-gram hash of a text's words that a licence template holds is joined in Spark to its places in the templates. A hit
at text place p and template place t votes for the diagonal p - t; votes are counted by text, template and diagonal, and
diagonals a few words apart (an inserted or dropped word) are merged. Merged parts that follow each other in the text as in
the template, over at most twice the template's words, are added up (a longer insertion or gap). A span whose votes cover
half of what is needed is verified: its words are aligned with the template's, in order, and the share of the template's
words that are found decides; of spans of one place the best covered counts. A template of fewer than K words is one gram and is found whole only.
The base labels are a plain search for three phrases and always stay.

Texts are addressed by 128 hash bits of their content, so copies vote for one set of places, and a very frequent text is
one group of at most (template words x its own diagonals). The template table is fixed and small and is broadcast.

Defined cases: a null or empty text has no words and no label (empty strings, null places, score 0); equal rows get equal
results; empty tables give empty results; columns other than the id and the text are not read. ``score`` is the best
share of a template that was found, and 1 where a base phrase stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words of a gram, and the least words of a template.
K, LEAST = 4, 3

#: Phrases and their base labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Licence notices, each with the label it gives.
TEMPLATES = [
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("mit-notice", "This software is released under the MIT License"),
    ("mit-notice", "Licensed under the MIT License"),
    ("mit-notice", "Released under the MIT License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved"),
    ("reserved", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
]

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def word_table(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text: n + 1) after ASCII letters are lower-cased."""
    low = common.LOWER[body]
    starts, ends, first = common.words(low, offsets, _WORD)
    return common.word_hashes(low, starts, ends), first


def _words_of(text: str) -> np.ndarray:
    return word_table(*common.buffers(pa.array([text])))[0]


def _phrase_hits(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, phrase at each), ascending; a phrase doesn't reach from one text into the next."""
    text_end = first[np.searchsorted(first, np.arange(len(hashes)), side="right")] if len(hashes) else np.zeros(0, np.int64)
    places, kinds = [], []
    for kind, phrase in enumerate(PHRASES):
        want = _words_of(phrase)
        n = len(hashes) - len(want) + 1
        if n <= 0:
            continue
        hit = np.ones(n, bool)
        for j, h in enumerate(want):
            hit &= hashes[j : j + n] == h
        at = np.flatnonzero(hit)
        at = at[at + len(want) <= text_end[at]]
        places.append(at)
        kinds.append(np.full(len(at), kind))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, kind = np.concatenate(places), np.concatenate(kinds)
    order = np.argsort(at, kind="stable")
    return at[order], kind[order]


def templates(extra: list[tuple[str, str]] = ()) -> list[tuple[int, int, int, str, int, int]]:
    """(gram hash, template, place, label, words of the template, words of the gram); fewer than LEAST words are refused."""
    out = []
    for number, (label, text) in enumerate([*TEMPLATES, *extra]):
        words = _words_of(text)
        if len(words) < LEAST:
            raise ValueError(f"a template needs at least {LEAST} words: {text!r}")
        width = min(K, len(words))
        out += [(int(h), number, place, label, len(words), width) for place, h in enumerate(common.shingle_hashes(words, width).view(np.int64))]
    return out


def chains(parts: list[dict], size: int, width: int) -> list[tuple[float, int, int]]:
    """(coverage, first word, last word) of the best chains of ``parts``, best first; no part is in two of them.

    parts: first_word, last_word, ats (template places of its grams). In a chain, both ends of the parts ascend in the
    text and in the template, and the text from the first to the last word is at most 2 * size words (or one part).
    """
    rows = sorted((p["first_word"], p["last_word"], min(p["ats"]), max(p["ats"]), frozenset(t + k for t in p["ats"] for k in range(width))) for p in parts)
    found = []
    for i, start in enumerate(rows):
        best = {i: (start[4], (i,))}
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if b[0] >= start[0] + 2 * size:
                break
            if b[1] >= start[0] + 2 * size:
                continue
            before = [best[k] for k in best if all(x < y for x, y in zip(rows[k][:4], b[:4], strict=True))]
            if before:
                words, way = max(before, key=lambda x: len(x[0] | b[4]))
                best[j] = (words | b[4], (*way, j))
        words, way = max(best.values(), key=lambda x: (len(x[0]), -len(x[1])))
        found.append((len(words) / size, way))
        if len(way) > 1:
            found.append((len(start[4]) / size, (i,)))
    out, used = [], set()
    for coverage, way in sorted(found, key=lambda x: -x[0]):
        if used.isdisjoint(way):
            used.update(way)
            out.append((coverage, rows[way[0]][0], rows[way[-1]][1]))
    return out


def _sliced(batch: pa.RecordBatch, column: int):
    body, offsets = common.buffers(batch.column(column))
    for i, j in common.slices(offsets, 1 << 20):
        yield i, j, *word_table(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def aligned(template: np.ndarray, words: np.ndarray) -> int:
    """How many words of ``template`` stand in ``words`` in the same order: the longest common subsequence."""
    best = np.zeros(len(words) + 1, np.int64)
    for t in template:
        step = np.maximum(best[1:], best[:-1] + (words == t))
        best[1:] = np.maximum.accumulate(step)
    return int(best[-1])


def _better(one: tuple, other: tuple) -> bool:
    """Whether a span tells more of most of another's words: notices of one family are alike, the best covered one counts."""
    (label, a, b, coverage), (theirs, c, d, least) = one, other
    return label != theirs and coverage > least and 2 * (min(b, d) - max(a, c) + 1) > d - c + 1


def needed(size: int, share: float) -> float:
    """The share of a template's words that a span must hold: of a short one nearly all, as notices differ by few words."""
    return max(share, 1 - size / 50)


def spans(docs: DataFrame, text: str = "text", share: float = 0.6, apart: int = 3, extra: list[tuple[str, str]] = ()) -> DataFrame:
    """Verified spans of each different text: k1, k2 (its address), label, first_word, last_word, coverage."""
    keyed = docs.select(*_address(text), F.col(text).alias("text"))

    known = templates(extra)
    wanted = {width: np.unique([t[0] for t in known if t[5] == width]) for width in {t[5] for t in known}}

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hits; the first one of a text brings the hashes of all its words."""
        common.release()
        for batch in batches:
            for i, j, hashes, first in _sliced(batch, 2):
                owner = np.repeat(np.arange(i, j), np.diff(first))
                told: set[int] = set()
                for width, codes in wanted.items():
                    rolled = common.shingle_hashes(hashes, width).view(np.int64)
                    at = np.flatnonzero(codes[np.minimum(np.searchsorted(codes, rolled), len(codes) - 1)] == rolled)
                    at = at[owner[at] == owner[at + width - 1]]  # a gram doesn't reach into the next text
                    rows = owner[at]
                    lead = np.zeros(len(rows), bool)
                    lead[np.unique(rows, return_index=True)[1]] = True
                    words = [hashes[first[r - i] : first[r - i + 1]].view(np.int64) if led and r not in told else None for r, led in zip(rows.tolist(), lead.tolist(), strict=True)]
                    told.update(rows.tolist())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array((at - first[rows - i]).astype(np.int32)), pa.array(rolled[at]), pa.array(words, pa.list_(pa.int64()))], names=["k1", "k2", "place", "gram", "words"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                out += [(r["k1"], r["k2"], r["template"], a, b) for c, a, b in chains(r["parts"], r["size"], r["width"]) if 2 * c >= needed(r["size"], share)]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            columns = zip(*out, strict=True) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["k1", "k2", "template", "first_word", "last_word"])

    notices = [(label, _words_of(notice).view(np.int64)) for label, notice in [*TEMPLATES, *extra]]

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, out = batch.column(3), []
            values, at = words.values.to_numpy(zero_copy_only=False), words.offsets.to_numpy()
            for row, (k1, k2, likely) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                own, found = values[at[row] : at[row + 1]], []
                for s in likely:
                    label, notice = notices[s["template"]]
                    coverage = aligned(notice, own[s["first_word"] : s["last_word"] + 1]) / len(notice)
                    if coverage >= needed(len(notice), share):
                        found.append((label, s["first_word"], s["last_word"], coverage))
                out += [(k1, k2, *f) for f in found if not any(_better(g, f) for g in found)]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64()]
            columns = zip(*out, strict=True) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["k1", "k2", "label", "first_word", "last_word", "coverage"])

    rolled = common.written(keyed.mapInArrow(grams, "k1 long, k2 long, place int, gram long, words array<long>"), "hits")
    places = docs.sparkSession.createDataFrame(known, "gram long, template int, at int, label string, size int, width int").drop("label")
    one = ["k1", "k2", "template", "size", "width"]
    votes = rolled.select("k1", "k2", "place", "gram").join(F.broadcast(places), "gram").groupBy(*one, (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"))
    own = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(own) <= apart, 0).otherwise(1)
    merged = votes.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    joined = merged.groupBy(*one, "span").agg(
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"),
        F.min(F.col("diagonal") + F.array_min("ats")).alias("first_word"),
        F.max(F.col("diagonal") + F.array_max("ats") + F.col("width") - 1).alias("last_word"),
    )
    parts = joined.groupBy(*one).agg(F.collect_list(F.struct("first_word", "last_word", "ats")).alias("parts"))
    likely = parts.mapInArrow(chained, "k1 long, k2 long, template int, first_word int, last_word int")
    words = rolled.filter("words is not null").select("k1", "k2", "words").dropDuplicates(["k1", "k2"])  # copies have the same words
    by_text = likely.groupBy("k1", "k2").agg(F.collect_list(F.struct("template", "first_word", "last_word")).alias("likely"))
    found = by_text.join(words, ["k1", "k2"]).select("k1", "k2", "likely", "words")
    return found.mapInArrow(verified, "k1 long, k2 long, label string, first_word int, last_word int, coverage double")


def _address(text: str) -> list:
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit(1), whole, F.length(whole)).alias("k2")]


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    names = ["doc_id", "k1", "k2", "n_words", "n_base", "first_word", "last_word", "base"]
    label = list(PHRASES.values())

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in batches:
            for i, j, hashes, first in _sliced(batch, 3):
                at, kind = _phrase_hits(hashes, first)
                lo, hi = np.searchsorted(at, first[:-1]), np.searchsorted(at, first[1:])
                some = hi > lo
                one = np.where(some, at[np.minimum(lo, max(0, len(at) - 1))] - first[:-1] if len(at) else 0, 0)
                two = np.where(some, at[np.maximum(hi - 1, 0)] - first[:-1] if len(at) else 0, 0)
                found = [sorted({label[k] for k in kind[a:b]}) if b > a else [] for a, b in zip(lo, hi, strict=True)]
                rows = [c.slice(i, j - i) for c in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(np.diff(first)), pa.array(hi - lo), pa.array(one, pa.int64(), mask=~some), pa.array(two, pa.int64(), mask=~some), pa.array(found, pa.list_(pa.string()))], names=names)

    plain = docs.select(F.col(doc_id).alias("doc_id"), *_address(text), F.col(text).alias("text"))
    kind_ = docs.schema[doc_id].dataType.simpleString()
    based = plain.mapInArrow(base, f"doc_id {kind_}, k1 long, k2 long, n_words long, n_base long, first_word long, last_word long, base array<string>")
    own = spans(docs, text, **options).groupBy("k1", "k2").agg(F.collect_set("label").alias("own"), F.max("coverage").alias("best"))
    both = based.join(own, ["k1", "k2"], "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("own", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.col("best"), F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
