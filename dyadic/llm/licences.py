"""Licence scan with a generalised suffix automaton of licence tokens.

Files stream through the automaton; matching statistics give, at each token and for each template, the longest suffix
that the template holds. Maximal matches of ``min_match`` words or more are chained per template when they follow each
other in file and template with small gaps. A chain is a candidate if it covers enough of its template and holds the
words that tell the template from its relatives (``ShareAlike``, ``Lesser``, a version). Of candidates that overlap,
the one that covers most words is the span of the region. Short key phrases are sequences of the same automaton and
count wherever their words stand consecutively. No shuffle.

Words are maximal runs of ASCII letters, digits and non-ASCII characters, ASCII letters in lower case; texts are
read whole. Nulls and empty texts have no words, places or spans. Repeated rows are each judged alike. Templates
or phrases without words are ignored; a template whose needed words are not its own is never found. Candidates equal
in covered words and coverage go by smaller start, then label. Kept columns may have any names; they lie in ``row``.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadic.llm.automaton import SuffixAutomaton
from dyadic.llm.words import ALNUM_LOWER, map_texts

# Key phrases and their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Names in the customary notices of two families of licences.
GNU = [("gpl", "General", ["2", "3"]), ("lgpl", "Lesser General", ["2.1", "3"]), ("agpl", "Affero General", ["3"])]
CREATIVE_COMMONS = [
    ("cc-by", "Attribution"),
    ("cc-by-sa", "Attribution-ShareAlike"),
    ("cc-by-nd", "Attribution-NoDerivatives"),
    ("cc-by-nc", "Attribution-NonCommercial"),
    ("cc-by-nc-sa", "Attribution-NonCommercial-ShareAlike"),
    ("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivatives"),
]

# The customary notices of other licences, and the words that a span must hold.
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the Software), to deal in the Software without restriction")
MIT_RIGHTS = (
    ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so")
MIT_TERMS = (
    ", subject to the following conditions: The above copyright notice and this permission notice shall be included in "
    "all copies or substantial portions of the Software.")
BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met")
BSD_TERMS = (
    ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.")
BSD_NAMES = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.")
ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted")
OTHERS = [
    ("mit", MIT_GRANT, ""),
    ("mit-0", MIT_GRANT + MIT_RIGHTS, "furnished"),
    ("mit", MIT_GRANT + MIT_RIGHTS + MIT_TERMS, "notice"),
    ("mit", "released under the MIT License", "mit"),
    ("mit", "licensed under the MIT License", "mit"),
    ("apache-2", "Licensed under the Apache License, Version 2.0", "apache 2"),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the "
                 "License. You may obtain a copy of the License at", "apache 2"),
    ("bsd", BSD_GRANT, ""),
    ("bsd-2", BSD_GRANT + BSD_TERMS, "reproduce"),
    ("bsd-3", BSD_GRANT + BSD_TERMS + BSD_NAMES, "reproduce neither"),
    ("isc", ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies", "provided"),
    ("0bsd", ISC_GRANT, "fee"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2"),
    ("epl-1", "made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution", "eclipse v1"),
    ("epl-2", "made available under the terms of the Eclipse Public License 2.0 which is available at", "eclipse 2"),
    ("bsl-1", "Distributed under the Boost Software License, Version 1.0.", "boost"),
    ("cddl-1", "The contents of this file are subject to the terms of the Common Development and Distribution License", "development"),
    ("cc0-1", "licensed under CC0 1.0 Universal", "cc0"),
    ("cc0-1", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held "
             "liable for any damages arising from the use of this software.", "authors"),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered"),
]


def notices() -> list[tuple[str, str, str]]:
    """(label, text, needed words) of the customary notices, those of families from their names."""
    out = list(OTHERS)
    for label, name, versions in GNU:
        licensed = f"licensed under the GNU {name} Public License"
        free = (f"free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License "
                "as published by the Free Software Foundation")
        out += [(label, licensed, name), (label, free, name)]
        for v in versions:
            out.append((f"{label}-{v}", f"{licensed} version {v}", f"{name} version {v}"))
            out.append((f"{label}-{v}", f"{free}, either version {v} of the License", f"{name} version {v}"))
    for label, name in CREATIVE_COMMONS:
        parted = name.replace("NonC", "Non-C").replace("ShareA", "Share-A").replace("NoD", "No-D")
        for title in dict.fromkeys((name, parted)):
            out.append((label, f"licensed under a Creative Commons {title} 4.0 International License", title))
        short = label.upper().replace("CC-", "CC ")
        out.append((label, f"licensed under {short} 4.0", short))
    return out


TEMPLATES = notices()

MIN_MATCH, MAX_GAP, MIN_COVERAGE = 4, 8, 0.6
SEPARATOR = b"\xff"

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("places", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("label", T.StringType())]))),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
        T.StructField("label", T.StringType()), T.StructField("coverage", T.DoubleType())]))),
])
_PLACES = pa.list_(pa.struct([("start", pa.int32()), ("label", pa.string())]))
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("coverage", pa.float64())]))


class LicenceIndex:
    """Phrases (label, text) and templates (label, text) or (label, text, needed words) in one automaton."""

    def __init__(self, phrases, templates, min_match: int, max_gap: int, min_coverage: float):
        words = lambda t: t.encode().translate(ALNUM_LOWER).split()
        phrases = [(label, w) for label, text in phrases if (w := words(text))]
        templates = [(label, w, words(needed[0]) if needed else []) for label, text, *needed in templates if (w := words(text))]
        self.min_match, self.max_gap, self.min_coverage = min_match, max_gap, min_coverage
        sequences = [ws for _, ws in phrases] + [ws for _, ws, _ in templates]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for ws in sequences for w in ws), 1)}
        self.vocabulary[SEPARATOR] = 0
        ids = [[self.vocabulary[w] for w in ws] for ws in sequences]
        self.automaton = a = SuffixAutomaton(ids)
        self.shortest = min([min_match, *(len(ws) for _, ws in phrases)])
        order = sorted(range(1, len(a.length)), key=a.length.__getitem__)
        ends: dict[int, tuple[int, list[str]]] = {}
        for (label, _), tokens in zip(phrases, ids, strict=False):
            state = [s for s, _ in a.stream(tokens)][-1]
            ends.setdefault(state, (len(tokens), []))[1].append(label)
        self.ends, self.nearest = ends, [-1] * len(a.length)
        for v in order:
            self.nearest[v] = v if v in ends else self.nearest[a.link[v]]
        self.labels = [label for label, _, _ in templates]
        self.sizes = [len(ws) for _, ws, _ in templates]
        #: of each template, the places of each word that its spans must hold
        self.needed = [[[i for i, w in enumerate(ws) if w == x] for x in needed] for _, ws, needed in templates]
        where: list[dict[int, list[int]]] = [{} for _ in a.length]
        for k, tokens in enumerate(ids[len(phrases):]):
            for end, (state, _) in enumerate(a.stream(tokens), 1):
                while a.length[state] >= min_match:
                    where[state].setdefault(k, []).append(end)
                    state = a.link[state]
        #: of each state, each template with a long enough suffix of it: the suffix's length (0: the whole match) and its ends
        self.held: list[list[tuple[int, int, list[int]]]] = [[] for _ in a.length]
        for v in order:
            if a.length[v] >= min_match:
                up = a.link[v]
                self.held[v] = [(k, 0, at) for k, at in where[v].items()] + [
                    (k, n or a.length[up], at) for k, n, at in self.held[up] if k not in where[v]]

    def scan(self, tokens: list[int], base: int, places: list, matches: list) -> None:
        """Add phrase places and each template's maximal matches (start, end, template, its ends there) of a run of
        known tokens that starts at word ``base``."""
        live: dict[int, tuple[int, list[int]]] = {}
        for i, (state, n) in enumerate(self.automaton.stream([*tokens, -1]), 1):
            u = self.nearest[state]
            while u >= 0:
                size, labels = self.ends[u]
                if size <= n:
                    places.extend((base + i - size, label) for label in labels)
                u = self.nearest[self.automaton.link[u]]
            now = {k: (size or n, at) for k, size, at in self.held[state]} if n >= self.min_match else {}
            for k, (size, at) in live.items():
                if k not in now or now[k][0] <= size:
                    matches.append((base + i - 1 - size, base + i - 1, k, at))
            live = {k: x for k, x in now.items() if x[0] >= self.min_match}

    def chained(self, matches: list[tuple[int, int, int, list[int]]]) -> list[tuple[int, int, str, float]]:
        """Spans of templates from maximal matches in order of their ends, in one pass; overlapping ones settled."""
        open_chains: dict[int, tuple[int, int, int, list[tuple[int, int]]]] = {}  # start, end, words covered, pieces of the template
        found: list[tuple[int, float, int, int, str]] = []

        def close(k: int) -> None:
            start, end, covered, pieces = open_chains.pop(k)
            holds = all(any(a <= i < b for i in places for a, b in pieces) for places in self.needed[k])
            if covered >= self.min_coverage * self.sizes[k] and holds:
                found.append((-covered, -covered / self.sizes[k], start, end, self.labels[k]))

        for start, end, k, ends in matches:
            size = end - start
            if k in open_chains:
                first, last, covered, pieces = open_chains[k]
                begin, upto = pieces[-1]  # a match that begins no later in the template starts it anew
                overlap = lambda at: max(0, last - start, upto - (at - size))  # noqa: B023, E731
                near = [at for at in ends if at > upto and begin < at - size <= upto + self.max_gap and overlap(at) < size]
                if near and start - last <= self.max_gap:
                    open_chains[k] = (first, end, covered + size - overlap(near[0]), [*pieces, (near[0] - size, near[0])])
                    continue
                close(k)
            open_chains[k] = (start, end, size, [(ends[0] - size, ends[0])])
        for k in list(open_chains):
            close(k)
        chosen: list[tuple[int, int, str, float]] = []
        for _, coverage, start, end, label in sorted(found):
            i = bisect_left(chosen, (start,))
            if (i == 0 or chosen[i - 1][1] <= start) and (i == len(chosen) or chosen[i][0] >= end):
                chosen.insert(i, (start, end, label, -coverage))
        return chosen


def scan_texts(texts: list[bytes | None], index: LicenceIndex) -> list[pa.Array]:
    words = (b" " + SEPARATOR + b" ").join((t or b"").translate(ALNUM_LOWER) for t in texts).split()
    ids = np.fromiter(map(index.vocabulary.get, words, repeat(-1)), dtype=np.int32, count=len(words))
    begins = np.concatenate(([0], np.flatnonzero(ids == 0) + 1))
    counts = np.diff(np.concatenate((begins, [len(ids) + 1]))) - 1
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
    starts, ends = edges[0::2], edges[1::2]
    long = ends - starts >= index.shortest
    owners = np.searchsorted(begins, starts[long], side="right") - 1
    hits: dict[int, tuple[list, list]] = {}
    for a, b, k in zip(starts[long].tolist(), ends[long].tolist(), owners.tolist(), strict=True):
        places, matches = [], []
        index.scan(ids[a:b].tolist(), a - int(begins[k]), places, matches)
        if places or matches:
            own = hits.setdefault(k, ([], []))
            own[0].extend(places)
            own[1].extend(matches)
    places, spans = [[]] * len(texts), [[]] * len(texts)
    for k, (p, m) in hits.items():
        places[k] = [{"start": s, "label": x} for s, x in sorted(p)]
        spans[k] = [{"start": s, "end": e, "label": x, "coverage": c} for s, e, x, c in index.chained(m)]
    return [pa.array(counts, pa.int64()), pa.array(places, _PLACES), pa.array(spans, _SPANS)]


def scan_licences(
    docs: DataFrame, keep: list[str], phrases=PHRASES, templates=TEMPLATES, min_match: int = MIN_MATCH,
    max_gap: int = MAX_GAP, min_coverage: float = MIN_COVERAGE, text: str = "text",
) -> DataFrame:
    """Columns ``row`` (the kept ones) and ``found``: n_words, phrase places, template spans with their coverage.

    Phrases are (label, text); templates also name the words that a span must hold. Both are the caller's lists of a few
    thousand words at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(LicenceIndex(phrases, templates, min_match, max_gap, min_coverage))
    return map_texts(docs, keep, FOUND, lambda texts: scan_texts(texts, shared.value), text)


def licence_labels(*lists):
    """Distinct labels of struct lists, sorted and comma-joined."""
    labels = F.array_distinct(F.concat(*[F.transform(x, lambda s: s["label"]) for x in lists]))
    return F.array_join(F.array_sort(labels), ",")
