"""Operators against plain versions, with nulls, empty and long texts, repeated rows, clashing names and empty tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from plain import classes, mixture, phrase_places, strong_spans, without_repeats
from pyspark.sql import functions as F

from dyadic.llm import decontamination, licences, line_dedup, mixing, neighbours, ngram_join, quality, revisits, secrets, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = DOCS + ", row string, found string, d long, n long, class string, tag long, block int, pass string"


def prose(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(400)) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [" ".join(prose(rng, rng.choice([3, 30, 120, 400]))) for _ in range(40)]
    base = prose(rng, 200)
    passage = prose(rng, 70)
    for k in range(24):  # near copies of one text, some too far to link
        words = list(base)
        for _ in range(k):
            words[rng.randrange(200)] = f"new{rng.random()}"
        texts.append(" ".join(words))
    texts += [" ".join(prose(rng, 60) + passage + prose(rng, 60)) for _ in range(6)]
    texts += [texts[0], texts[0] + " ", "", None, "one two", "ONE two", " ", " ".join(["again"] * 300), "naïve\tcafé x \U0001f600 " * 40]
    texts.append(" ".join(prose(rng, 30_000)) + " " + " ".join(base))
    return list(enumerate(texts))


def frame(spark, corpus, schema=CLASHING):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "r", "f", 1, 2, "c", 3, 4, "p") for i, t in corpus]
    return spark.createDataFrame([r[: 5 if schema == DOCS else 13] for r in rows], schema).repartition(3)


def empty(spark):
    return spark.createDataFrame([], CLASHING)


def test_jaccard_classes(spark, corpus):
    found = ngram_join.jaccard_classes(frame(spark, corpus), ["doc_id"]).collect()
    assert {r.row.doc_id: (r.n, r["class"]) for r in found} == classes(corpus)
    assert ngram_join.one_of_each_class(empty(spark)).count() == 0


def test_jaccard_classes_in_blocks(spark, corpus, monkeypatch):
    """Components of several blocks, and n-grams so frequent that they are salted."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 5)
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    docs = frame(spark, corpus)
    docs = docs.union(docs.where("doc_id in (40, 41)")).union(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    found = ngram_join.jaccard_classes(docs, ["doc_id"]).collect()
    assert {r.row.doc_id: (r.n, r["class"]) for r in found if r.row.doc_id is not None} == classes(corpus)
    assert len(found) == len(corpus) + 3
    stay = sorted(r.doc_id for r in ngram_join.one_of_each_class(docs).select("doc_id").collect())
    want = classes(corpus)
    assert stay == sorted(i for i, (n, c) in want.items() if n == 0 or c == i)


def test_copies_send_their_ngrams_once(spark):
    """Copies in one task give one set of rows, and still all of them belong to one class."""
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(i, text) for i in range(50)] + [(60, None), (61, ""), (62, text + " more")], "doc_id long, text string").coalesce(1)
    rows = ngram_join._bucket_rows(docs, "text", 5, 75, np.zeros(ngram_join.SKETCH, dtype=np.int8))
    assert rows.groupBy("d").count().count() == 2 and rows.count() == rows.distinct().count()
    got = {r.row.doc_id: r["class"] for r in ngram_join.jaccard_classes(docs, ["doc_id"]).collect()}
    assert got == {**dict.fromkeys([*range(50), 62], 0), 60: 60, 61: 61}


def test_unlike_texts_under_one_id_are_two_classes(spark):
    first, second = (" ".join(f"{c}{k}" for k in range(40)) for c in "xy")
    docs = spark.createDataFrame([(1, first), (1, second), (2, second + " more"), (3, first + " more"), (None, second)], "doc_id long, text string")
    stay = ngram_join.one_of_each_class(docs).collect()
    assert sorted((r.doc_id, r.text) for r in stay) == [(1, first), (1, second)]


def test_substring_dedup(spark, corpus):
    docs = frame(spark, corpus)
    found = substring_dedup.repeated_words(docs.union(docs.where("doc_id = 45")), ["doc_id", "d"]).collect()
    assert {r.row.doc_id: (r.n_words, r.n_removed, r.digest) for r in found} == without_repeats(corpus)
    assert len(found) == len(corpus) + 1
    assert substring_dedup.repeated_words(empty(spark), ["doc_id"]).count() == 0


def test_line_dedup(spark):
    page = "a\nb\nc\nd"
    rows = [(1, page), (2, "x\n" + page + "\ny"), (3, "a\nb"), (4, None), (5, ""), (5, ""), (None, page), (6, "q\n" * 6)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "r", "f", 1, 2, "c", 3, 4, "p") for i, t in rows], CLASHING)
    found = {(r.row.doc_id): (r.n_lines, r.n_removed, r.kept) for r in line_dedup.dedup_lines(docs).collect()}
    assert found[None] == (4, 0, page)  # null ids come first
    assert found[1] == (4, 4, "") and found[2] == (6, 4, "x\ny") and found[3] == (2, 0, "a\nb")
    assert found[4] == (0, 0, None) and found[5] == (1, 0, "")
    assert found[6] == (7, 5, "q\n")
    assert line_dedup.replace_text(line_dedup.dedup_lines(docs), docs.columns).columns == docs.columns
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), "en", "big" if i % 10 else f"small{i % 20}", 0, "r", "f", 1, 2, "c", 3, 4, "p") for i in range(600)]
    rows += [(700, None, "en", None, 0, "r", "f", 1, 2, "c", 3, 4, "p"), (701, "a b c", "en", None, 0, "r", "f", 1, 2, "c", 3, 4, "p")]
    docs = spark.createDataFrame(rows, CLASHING)
    got = mixing.mix_sources(docs, entropy=None, max_repeat=3.0).collect()
    tokens, used, ids = {}, {}, set()
    for r in rows:
        tokens[r[3]] = tokens.get(r[3], 0) + len((r[1] or "").split())
    for r in got:
        used[r.row.source] = used.get(r.row.source, 0) + r.tokens
        ids.add(r.row.doc_id)
    repeats = {s: used[s] / tokens[s] for s in tokens}
    assert ids == {r[0] for r in rows}  # every document once at least
    assert max(repeats.values()) <= 3.01 and max(repeats.values()) > 2.7 and min(repeats.values()) > 0.99
    weights = {r.row.source: r.weight for r in got}
    assert sum(weights.values()) == pytest.approx(1)
    # half the tokens as budget: a prefix of the blocks, never more than the budget
    half = mixing.mix_sources(docs, entropy=None, max_repeat=None, budget_share=0.5).collect()
    assert 0.4 * sum(tokens.values()) < sum(r.tokens for r in half) <= 0.5 * sum(tokens.values()) + 2
    assert mixing.mix_sources(empty(spark)).count() == 0


def test_exponent_meets_the_entropy(spark):
    shares = [0.6, 0.2, 0.1, 0.06, 0.04]
    totals = spark.createDataFrame([(str(k), int(s * 1e6), s) for k, s in enumerate(shares)], "source string, tokens long, share double")
    a = mixing.exponent(totals, 0.95, None, None)
    w = np.array(shares) ** a
    w /= w.sum()
    assert -(w * np.log(w)).sum() == pytest.approx(0.95 * np.log(5), abs=1e-4)


def test_exponent_above_one_and_targets_out_of_reach(spark):
    def found(shares, *targets):
        rows = [(str(k), int(s * 1e6), s) for k, s in enumerate(shares)]
        return mixing.temperature(spark.createDataFrame(rows, "source string, tokens long, share double"), *targets)

    shares = np.array([0.3, 0.27, 0.23, 0.2])
    a, held = found(shares.tolist(), 0.95, 4.0, None)
    w = shares ** a / (shares ** a).sum()
    assert a > 1 and held == "entropy" and -(w * np.log(w)).sum() == pytest.approx(0.95 * np.log(4), abs=1e-4)
    a, held = found(shares.tolist(), 0.5, 2.0, None)  # the limit of repeats comes first
    assert held == "unmet" and (0.3 / 0.2) ** (a - 1) == pytest.approx(2, abs=1e-4)
    assert found([0.25] * 4, 0.95, 4.0, None)[1] == "unmet" and found([1.0], 0.95, 4.0, None) == (0.0, "none")
    assert found([0.9, 0.1], 1.0, 2.0, None)[1] == "repetition" and found([0.5, 0.5], 0.95, 1.0, 2.0) == (1.0, "unmet")


@pytest.mark.parametrize("entropy", [0.7, 0.98])
def test_mixing_equals_a_plain_mixer(spark, entropy):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)) if i % 50 else None, "abc"[min(rng.randrange(6), 2)]) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, entropy=entropy, max_repeat=4.0).select("row.doc_id", "pass", "place", "exponent").collect()
    a, wanted = mixture(rows, entropy, 4.0)
    assert got[0].exponent == pytest.approx(a, abs=2e-6)
    assert sorted((r.doc_id, r["pass"], r.place) for r in got) == wanted


def test_secrets(spark):
    key, run = "AKIA" + "Z9" * 8, "0123456789abcdef" * 2
    texts = [
        f"password = hunter22 and {key} then {run}!", "token=token: abcdefgh", "api_key:'abc'", None, "", f"é{run}\U0001f600 Secret: \"abcdef\"",
        "login: jane7 ... pass: xyz123 at https://db.example.org/x", "pass: xyz123 alone", "login: jane7 alone", "pass: xyz123 " + "." * 900 + " login: jane7",
        "token=abcdefg", "AKIA" + "Q" * 15, ("token=abcdef1 " * 300),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    got = {r.row.doc_id: (r.base, r.spans) for r in secrets.scan_secrets(docs, ["doc_id", "base"]).select(
        "row", secrets.named(F.col("base")).alias("base"), secrets.named(F.col("spans")).alias("spans")).collect()}
    assert {i: b for i, (b, _) in got.items()} == {i: strong_spans(t) for i, t in enumerate(texts)}
    assert [x.split(":")[0] for x in got[6][1].split(",")] == ["identifier", "weak", "endpoint"]
    assert not got[7][1] and not got[8][1] and not got[9][1]
    assert secrets.scan_secrets(docs.limit(0), ["doc_id"]).count() == 0


def test_licences(spark, corpus):
    texts = [t for _, t in corpus[-10:]] + ["Under the MIT-license, cc by nc. CC BY NC!", "apache license version 2 apache license version 2", licences.TEMPLATES[0][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row.doc_id: r.found for r in licences.scan_licences(docs, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        n, places = phrase_places(t, licences.PHRASES)
        assert got[i].n_words == n and [(p.start, p.label) for p in got[i].places] == places
    assert [s.label for s in got[len(texts) - 1].spans] == ["mit"] and got[len(texts) - 1].spans[0].coverage == 1
    assert licences.scan_licences(docs.limit(0), ["doc_id"]).count() == 0


LABELS = [
    ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3"]),
    ("under the terms; licensed under the GNU Lesser General Public License", ["lgpl"]),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
     "published by the Free Software Foundation; either version 2.1 of the License, or later", ["lgpl-2.1"]),
    ("free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
     "Free Software Foundation, either version 3 of the License", ["agpl-3"]),
    ("Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["cc-by-sa"]),
    ("Licensed under a Creative Commons Attribution 4.0 International License.", ["cc-by"]),
    ("Licensed under a Creative Commons Attribution-Non-Commercial-No-Derivatives 3.0 Unported", ["cc-by-nc-nd"]),
    ("Licensed under CC BY-NC-SA 4.0 and then licensed under CC BY-ND 4.0", ["cc-by-nc-sa", "cc-by-nd"]),
    (licences.BSD_GRANT + licences.BSD_TERMS, ["bsd-2"]),
    (licences.BSD_GRANT + licences.BSD_TERMS + licences.BSD_NAMES, ["bsd-3"]),
    (licences.MIT_GRANT + licences.MIT_RIGHTS, ["mit-0"]),
    (licences.MIT_GRANT + licences.MIT_RIGHTS + licences.MIT_TERMS, ["mit"]),
    (licences.ISC_GRANT, ["0bsd"]),
    ("Distributed under the Boost Software License, Version 1.0.", ["bsl-1"]),
    ("made available under the terms of the Eclipse Public License 2.0 which is available at", ["epl-2"]),
    ("the public is licensed to use the work and the software without restriction", []),
]


def test_licences_of_one_family_are_told_apart(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(LABELS)] * 2, "doc_id long, text string, found string")
    for r in licences.scan_licences(docs, ["doc_id", "found"]).collect():
        assert [s.label for s in r.found.spans] == LABELS[r.row.doc_id][1], LABELS[r.row.doc_id][0]


def test_licence_matches_equal_plain_ones():
    """Every maximal match of each template, against a comparison of all places."""
    rng = random.Random(4)
    for _ in range(40):
        words = lambda n: [rng.choice("abc") for _ in range(n)]
        templates, text = [words(rng.randrange(4, 14)) for _ in range(4)], words(60)
        index = licences.LicenceIndex([], [(str(k), " ".join(t)) for k, t in enumerate(templates)], 3, 2, 0.6)
        found, wanted = [], set()
        index.scan([index.vocabulary.get(w.encode(), -1) for w in text], 0, [], found)
        for k, t in enumerate(templates):
            longest = [max(n for n in range(min(i, len(t)) + 1) if any(text[i - n:i] == t[p:p + n] for p in range(len(t) - n + 1))) for i in range(len(text) + 1)] + [0]
            for i in range(1, len(text) + 1):
                if longest[i] >= 3 and longest[i + 1] <= longest[i]:
                    n = longest[i]
                    wanted.add((i - n, i, k, tuple(p + n for p in range(len(t) - n + 1) if t[p:p + n] == text[i - n:i])))
        assert {(a, b, k, tuple(sorted(at))) for a, b, k, at in found} == wanted and len(found) == len(wanted)


def test_a_repeated_phrase_chains_at_its_later_place():
    text = "one two three four five one two three four six seven eight nine"
    index = licences.LicenceIndex([], [("x", text)], 4, 2, 1.0)
    assert licences.scan_texts([text.replace("six", "odd six").encode(), None, b"", (text + " ").encode() * 5000], index)[2].to_pylist()[:3] == [
        [{"start": 0, "end": 14, "label": "x", "coverage": 1.0}], [], []]


def test_decontamination(spark):
    item = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame(
        [(1, item, 0), (2, "x " * 500 + item, 0), (3, "clean text", 0), (4, None, 0), (5, "", 0), (6, "tiny item", 0)], "doc_id long, text string, found int")
    items = spark.createDataFrame([(1, item), (2, None), (3, "..."), (None, "Tiny item")], "item_id long, text string")
    left = {r.doc_id: r.text for r in decontamination.decontaminate(docs, items).collect()}
    assert set(left) == {2, 3, 4, 5} and left[3] == "clean text" and left[4] is None and left[2].split() == ["x"] * 500
    few = decontamination.find_contamination(docs, items, ["doc_id"], automaton_words=3).collect()  # several automata
    assert {r.row.doc_id: sum(s.end - s.start for s in r.found.spans) for r in few} == {1: 20, 2: 20, 3: 0, 4: 0, 5: 0, 6: 2}
    assert decontamination.decontaminate(docs.limit(0), items.limit(0)).count() == 0


def test_decontamination_holds_one_automaton(spark):
    """Only the last of several automata is in the plan that is returned; the others are applied and gone."""
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five six seven"), (3, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two"), (2, "five six"), (3, "eight nine")], "item_id long, text string")
    found = decontamination.find_contamination(docs, items, ["doc_id"], automaton_words=1)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {r.row.doc_id: r.found["items"] for r in found.collect()} == {1: ["1"], 2: ["2"], 3: []}


def test_quality(spark):
    rng = random.Random(1)
    good = ["\n".join(" ".join(prose(rng, 12)) + "." for _ in range(5)) for _ in range(120)]
    bad = ["\n".join(" ".join(w.upper() + "!!" for w in prose(rng, 12)) for _ in range(5)) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(good + bad)] + [(900, None, "x"), (901, "", "x"), (902, "ok " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(180)] + [(5, 0), (None, 1), (7, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.row.doc_id: r.found.score for r in quality.score_quality(docs, model, ["doc_id", "found"]).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    assert np.mean([(got[i] >= 0.7) == (i < 120) for i in range(180)]) > 0.97
    assert quality.train(docs, labels.limit(0)).constant == 1.0
    assert quality.train(docs, labels.where("quality = 1")).constant == 1.0


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    x, counts = rng.normal(size=(6, 3)), np.array([4, 2])
    model = quality.ChainModel(rng.normal(size=3), 0.2, rng.normal(size=(2, 2)))
    own = x @ model.weights + model.bias
    p = model.marginals(x, counts)
    for begin, n in ((0, 4), (4, 2)):
        weight = {}
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            weight[tuple(y)] = np.exp(sum(own[begin + k] * y[k] for k in range(n)) + sum(model.turns[a, b] for a, b in zip(y, y[1:], strict=False)))
        total = sum(weight.values())
        for k in range(n):
            assert p[begin + k] == pytest.approx(sum(w for y, w in weight.items() if y[k]) / total)


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    vectors = [list(map(float, v)) for v in rng.normal(size=(900, 16)).astype(np.float32)]
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + [(1000 + i, vectors[50], 0) for i in range(30)]
    rows += [(2000, None, 0), (2050, [0.0] * 16, 0), (2100, [float("nan")] * 16, 0), (2150, [None] + [1.0] * 15, 0), (None, vectors[1], 0), (2200, [1.0, 2.0], 0), (3, vectors[3], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = neighbours.nearest_neighbours(table, F.col("vec_id") % 50 == 0, shard_size=300).collect()
    ids = np.array([r[0] for r in rows[:930]])
    unit = np.array([r[1] for r in rows[:930]])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    right = total = 0
    for q in range(0, 1030, 50):
        if q in ids:
            s = unit @ unit[np.flatnonzero(ids == q)[0]]
            best = [i for i in np.lexsort((ids, -s.round(12))) if ids[i] != q][:5]
            mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
            assert len(mine) == 5 and q not in mine
            right, total = right + len(set(mine) & set(ids[best].tolist())), total + 5
    assert right / total >= 0.95
    assert sorted(r.vec_id for r in got if r.query_id == 50) == [1000, 1001, 1002, 1003, 1004]
    assert not {r.query_id for r in got} & {2000, 2050, 2100, 2150, 2200}
    assert neighbours.nearest_neighbours(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_count_ids_not_rows(spark):
    """Repeated rows of a common vector, and an id with many vectors, leave room for the other ids."""
    one, other = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(0, one)] + [(1, one)] * 40 + [(i, one) for i in range(2, 9) for _ in range(2)]
    rows += [(100, other)] + [(101, [0.001 * k, 1.0, 0.0]) for k in range(1, 31)] + [(i, [0.1, 1.0, 0.01 * (i - 100)]) for i in range(102, 107)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, i) for i in range(1, 6)] + [(100, i) for i in range(101, 106)]


def test_revisits(spark):
    h = lambda **k: [(n.replace("_", "-"), v) for n, v in k.items()]
    rows = [
        (1, "http://A.org/x/", 10, "response", h(ETag='"a"', Content_Type="t", Cache_Control="1"), "d1"),
        (2, "https://www.a.org:443/x?utm_source=q#f", 20, "response", h(ETag='"b"'), "d2"),
        (3, "http://a.org/x", 15, "revisit", h(etag='W/"a"', cache_control="2", Content_Length="0"), None),
        (4, "http://a.org/x", 30, "revisit", h(ETag='"a"'), None), (5, "http://a.org/x", 10, "revisit", h(ETag='"a"'), None),
        (6, "http://a.org/x", 25, "revisit", [], None), (7, None, 25, "revisit", h(ETag='"a"'), None), (8, "http://a.org/x", None, "revisit", None, None),
        (3, "http://a.org/x", 15, "revisit", h(etag='W/"a"', cache_control="2", Content_Length="0"), None),
    ]
    records = spark.createDataFrame(rows, "record_id long, url string, at long, type string, headers array<struct<name:string,value:string>>, digest string")
    got = revisits.resolve_revisits(records, blocks=3).collect()
    assert len(got) == 7 and {(r.record_id, r.status, r.target) for r in got} == {
        (3, "resolved", 1), (4, "mismatch", 2), (5, "no_response", None), (6, "no_validator", 2), (7, "no_response", None), (8, "no_response", None)}
    three = next(r for r in got if r.record_id == 3)
    assert three.digest == "d1" and [tuple(x) for x in three.headers] == [("Content-Type", "t"), ("etag", 'W/"a"'), ("cache-control", "2")]
    assert revisits.resolve_revisits(records.limit(0)).count() == 0
