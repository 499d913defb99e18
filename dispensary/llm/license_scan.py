"""License scans by diagonal voting.

Every document's rolling word k-grams (k = 2) are joined with the places of the same k-grams in license templates.
A match votes for a diagonal, its place in the document less its place in the template.  Votes are counted by
diagonal, and neighbouring diagonals (a few words were added or dropped) are merged.  Votes only say where to look: a phrase
that a text repeats votes again and again.  So a span is verified by aligning document and template: its matches are the longest
sequence of k-grams that stand in the same order in both, each place of the template counted once.
k-grams are exact word numbers in the templates' vocabulary, not hashes that could collide; words outside that
vocabulary can't match and end a k-gram.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dispensary.llm._annotate import annotated
from dispensary.llm._spark import documents
from dispensary.llm._text import ALNUM, STEP_BYTES, words

#: Phrases that count wherever their words stand consecutively, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Passages of public license texts, and their labels.
TEMPLATES = {
    "agpl-header": ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    "apache-header": ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    "apache-warranty": ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    "boost-permission": ("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    "bsd-conditions": ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "bsd-source": ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    "bsd-binary": ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    "bsd-names": ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "bsd-warranty": ("bsd", "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    "cc-by-notice": ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-nc-notice": ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    "cc-by-nc-nd-notice": ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution NonCommercial NoDerivatives 4.0 International License"),
    "cc-by-nc-sa-notice": ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution NonCommercial ShareAlike 4.0 International License"),
    "cc-by-nd-notice": ("cc-by-nd", "This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License"),
    "cc-by-sa-notice": ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    "cc0-notice": ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    "epl-header": ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License which accompanies this distribution"),
    "gpl-header": ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    "gpl-notice": ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    "gpl-warranty": ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    "isc-permission": ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    "isc-warranty": ("isc", "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    "lgpl-header": ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version"),
    "mit-permission": ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    "mit-notice": ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    "mit-warranty": ("mit", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"),
    "mpl-header": ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    "unlicense": ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    "zlib-permission": ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
}

FOUND = "n_words long, grams array<struct<gram:long,at:int>>"
_GRAM = pa.struct([("gram", pa.int64()), ("at", pa.int32())])


def _split(text: str) -> list[bytes]:
    data = np.frombuffer(text.encode(), np.uint8)
    w = words(data, np.array([0, len(data)]), ALNUM, lower=True)
    return [w.word(i) for i in range(len(w.starts))]


class _Vocabulary:
    """Exact numbers (from 1) of the templates' words."""

    def __init__(self, listed: list[bytes]):
        self.size = len(listed)
        data = np.frombuffer(b" ".join(listed), np.uint8)
        w = words(data, np.array([0, len(data)]), ALNUM, lower=False)
        hashes = w.hashes()
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[hashes >> np.uint64(48)] = True
        self.lengths = w.ends - w.starts
        self.letters = np.zeros((len(listed), max(map(len, listed))), np.uint8)
        for i, x in enumerate(listed):
            self.letters[i, : len(x)] = np.frombuffer(x, np.uint8)

    def numbers(self, w) -> np.ndarray:
        out = np.zeros(len(w.starts), np.int64)
        hashes = w.hashes()
        at = np.flatnonzero(self.maybe[hashes >> np.uint64(48)])
        place = np.minimum(np.searchsorted(self.sorted, hashes[at]), self.size - 1)
        same = self.sorted[place] == hashes[at]
        at, which = at[same], self.order[place[same]]
        length = w.ends[at] - w.starts[at]
        same = length == self.lengths[which]
        at, which, length = at[same], which[same], length[same]
        equal = np.ones(len(at), bool)
        for j in range(int(length.max(initial=0))):
            has = np.flatnonzero(length > j)
            equal[has] &= w.data[w.starts[at[has]] + j] == self.letters[which[has], j]
        out[at[equal]] = which[equal] + 1
        return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("template", pa.string()), ("coverage", pa.float64()), ("label", pa.string())]))


def alignments(at: np.ndarray, place: np.ndarray, least: int, density: float, neighbours: int, gap: int) -> list[tuple[int, int, int]]:
    """(first, last, matches) of the spans that align with a template, given the matches' places in document and template.

    Of spans that overlap the one with more matches is taken, then the shorter, then the earlier one.  The work follows the number of matches
    times those within `gap` of each."""
    order = np.lexsort((place, at))
    at, place = at[order].astype(np.int64), place[order].astype(np.int64)
    begin = np.searchsorted(at, at - gap)
    upto = np.searchsorted(at, at)  # earlier places of the document
    count, start = np.ones(len(at), np.int64), at.copy()
    for i, (a, b) in enumerate(zip(begin.tolist(), upto.tolist(), strict=True)):
        step = place[i] - place[a:b]
        fits = np.flatnonzero((step > 0) & (np.abs(at[i] - at[a:b] - step) <= neighbours)) + a
        if len(fits):
            best = fits[np.lexsort((-start[fits], -count[fits]))[0]]
            count[i], start[i] = count[best] + 1, start[best]
    good = np.flatnonzero((count >= least) & (count >= density * (at - start + 1)))
    out: list[tuple[int, int, int]] = []
    for i in good[np.lexsort((at[good], at[good] - start[good], -count[good]))].tolist():
        if not any(a <= at[i] + 1 and start[i] <= b + 1 for a, b, _ in out):  # the words of two k-grams
            out.append((int(start[i]), int(at[i]), int(count[i])))
    return out


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, tuple[str, str]] | None = None, coverage: float = 0.6, density: float = 0.5, neighbours: int = 4, gap: int = 24, id_col: str = "doc_id", text_col: str = "text", step_bytes: int = STEP_BYTES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for every document.

    Words are maximal runs of digits, letters a-z and non-ASCII characters after lower-casing A-Z.  n_base counts
    the places of all phrases; first_word and last_word are the smallest and largest start of one (words from 0;
    null without any).  A template's span is an alignment with it: both places rise from
    match to match, by `gap` k-grams of the document at most and on diagonals not more than `neighbours` apart.  It is
    reported if its matches reach `coverage` of the template's k-grams and `density` of the span, and if no other reported span that overlaps it
    has a greater coverage.  Labels are distinct, sorted and joined by commas; score is 1 with a phrase, else the best
    coverage of a reported span, else 0.  Null and empty texts have no words and no labels; a very long text is
    scanned whole, and its votes are bounded by its length.  Spans of equal coverage that overlap are all reported.  Repeated rows and
    ids give a row each; an empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    split = {k: _split(k) for k in phrases} | {k: _split(t) for k, (_, t) in templates.items()}
    if any(len(x) < 2 for x in split.values()):
        raise ValueError("phrases and templates need two words at least")
    listed = sorted({w for x in split.values() for w in x})
    number = {w: i for i, w in enumerate(listed, start=1)}
    base = len(listed) + 1

    def make():
        vocabulary = _Vocabulary(listed)

        def f(data, offsets):
            w = words(data, offsets, ALNUM, lower=True)
            n, codes, left = w.counts(), vocabulary.numbers(w), w.left()
            at = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0) & (left[:-1] > 1))
            doc = np.searchsorted(w.first, at, side="right") - 1
            # each document also sends one k-gram that only the row standing for "no template" has
            gram = np.concatenate((np.full(len(n), -1), codes[at] * base + codes[at + 1] if len(at) else at))
            where = np.concatenate((np.zeros(len(n), np.int64), at - w.first[:-1][doc]))
            doc = np.concatenate((np.arange(len(n)), doc))
            by = np.argsort(doc, kind="stable")
            grams = pa.StructArray.from_arrays([pa.array(gram[by]), pa.array(where[by].astype(np.int32))], fields=list(_GRAM))
            return {"n_words": n, "grams": pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[by], np.arange(len(n) + 1)).astype(np.int32)), grams)}

        return f

    places = [(-1, "", "", 0, 1, False)]
    for k, x in split.items():
        label = phrases[k] if k in phrases else templates[k][0]
        places += [(number[a] * base + number[b], k, label, i, len(x) - 1, k in phrases) for i, (a, b) in enumerate(zip(x, x[1:], strict=False))]
    spark = docs.sparkSession
    # as long as the templates, whatever the documents
    table = F.broadcast(spark.createDataFrame(places, "gram long, template string, label string, place int, grams int, is_phrase boolean"))

    docs = documents(docs, id_col, text_col)
    scanned = annotated(docs, "text", "found", FOUND, make, step_bytes).withColumn("row", F.monotonically_increasing_id()).select("row", "id", "found.n_words", F.explode("found.grams").alias("g"))
    votes = scanned.select("row", "id", "n_words", "g.gram", "g.at").join(table, "gram")
    # one shuffle; a document's votes are bounded by its length
    votes = votes.select("row", "id", "n_words", "template", "label", "is_phrase", "grams", "at", (F.col("at") - F.col("place")).alias("diagonal")).repartition("row")
    diagonals = votes.groupBy("row", "id", "n_words", "template", "label", "is_phrase", "grams", "diagonal").agg(F.collect_list("at").alias("at"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("is_phrase"), 0).otherwise(neighbours), F.lit(True))
    merged = diagonals.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(order))
    keys = ("row", "id", "n_words", "template", "label", "is_phrase", "grams")
    # a run holds as many matches as its document has votes at most
    runs = merged.groupBy("row", "id", "n_words", "template", "label", "is_phrase", "grams", "run").agg(F.sum(F.size("at")).alias("votes"), F.min("diagonal").cast("long").alias("diagonal"), F.collect_list(F.struct("diagonal", "at")).alias("hits"))
    may_align = ~F.col("is_phrase") & (F.col("template") != "") & (F.col("votes") >= coverage * F.col("grams") - 1e-9)
    runs = runs.select("row", "id", "n_words", "template", "label", "is_phrase", "grams", "votes", "diagonal", F.when(may_align, F.col("hits")).alias("hits"))
    spans = "array<struct<start:int,stop:int,template:string,coverage:double,label:string>>"

    def align(batches):
        for b in batches:
            found = []
            for hits, template, label, grams in zip(b.column("hits"), b.column("template").to_pylist(), b.column("label").to_pylist(), b.column("grams").to_pylist(), strict=True):
                chains = []
                if hits.is_valid:
                    lists = hits.values.field("at")
                    at, diagonal = np.asarray(lists.flatten()), np.asarray(hits.values.field("diagonal"))
                    place = at - np.repeat(diagonal, np.diff(np.asarray(lists.offsets)))
                    need = math.ceil(coverage * grams - 1e-9)
                    if len(np.unique(place)) >= need:
                        chains = alignments(at, place, need, density, neighbours, gap)
                found.append([{"start": x, "stop": y + 2, "template": template, "coverage": n / grams, "label": label} for x, y, n in chains])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "id", "n_words", "label", "is_phrase", "grams", "votes", "diagonal")), pa.array(found, _SPANS)], names=["row", "id", "n_words", "label", "is_phrase", "grams", "votes", "diagonal", "spans"])

    runs = runs.mapInArrow(align, f"row long, id long, n_words long, label string, is_phrase boolean, grams int, votes long, diagonal long, spans {spans}")
    is_base = F.col("is_phrase") & (F.col("votes") == F.col("grams"))
    found = runs.groupBy("row", "id", "n_words").agg(
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(is_base, F.col("diagonal"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(is_base, F.col("label")))).alias("base"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"),  # as long as the document at most
    )
    beaten = lambda s: F.exists("all", lambda o: (o["coverage"] > s["coverage"]) & (o["start"] < s["stop"]) & (s["start"] < o["stop"]))
    found = found.withColumn("best", F.filter("all", lambda s: ~beaten(s)))
    return found.select(
        "id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.transform("best", lambda s: s["label"]))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("best", lambda s: s["coverage"])), F.lit(0.0))).alias("score"),
        F.transform("best", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["template"].alias("template"), s["coverage"].alias("coverage"))).alias("spans"),
    )
