"""Divergence, ranked search and byte pairs against plain versions, with all odd cases of their docstrings."""

from __future__ import annotations

import base64
import hashlib
import os
import random

import public_tokenizers
import pytest
import tiktoken
from plain import divergence, ranked
from pyspark.sql import functions as F

import __spark_entry__ as entry
from dyadic.llm import byte_pairs
from dyadic.llm import divergence as audit
from dyadic.llm import lexical_search as search

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, row string, found string, term string, id long, n long, h long, ids string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "r", "f", "t", 1, 2, 3, "i") for r in rows], DOCS).repartition(parts)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [w for n in range(1, 9) for w in ("".join(rng.choice("abé") for _ in range(n)) for _ in range(9))]
    words += ["prefix" + "x" * n for n in range(40)] + ["Prefix", "x1y", "don't", "日本", "a_b"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 20, 80]))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None]))
            for i in range(150)]
    rows += [(200 + i, "alone again", "en", "only") for i in range(4)] + [(300, None, "xx", "q"), (301, "", "xx", "r"), (302, " 12 ", None, None)]
    rows += [(400, "same text here twice", "de", "s"), (400, "same text here twice", "de", "s"), (None, "alone text", "de", None)]
    rows.append((500, " ".join(rng.choice(words) for _ in range(60_000)) + " " + "long" * 50_000, "fr", "a"))
    return rows


@pytest.mark.parametrize(("least", "ladder"), [(1, (3, 6, 9, 14, 24)), (5, (1, 2)), (30, (4,)), (1000, (3, 6))])
def test_divergence(spark, corpus, least, ladder):
    found = audit.source_divergence(frame(spark, corpus), least, ladder=ladder).collect()
    assert sorted(map(tuple, found)) == divergence([r[1:] for r in corpus], least)


def test_divergence_in_small_blocks_and_by_shuffles(spark, corpus, monkeypatch):
    monkeypatch.setattr(audit, "CELLS", 1)
    monkeypatch.setattr(audit, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(audit, "PIECE", 500)
    found = audit.source_divergence(frame(spark, corpus), 3).collect()
    assert sorted(map(tuple, found)) == divergence([r[1:] for r in corpus], 3)


def test_levels_discard_prefixes(spark, corpus):
    """What a level keeps is a subset of the extensions of the level before, and rare terms are never grouped whole."""
    rows = audit.term_rows(frame(spark, corpus), "text", "lang", "source", (3, 6)).cache()
    docs = {}
    for _, text, lang, _ in corpus:
        for prefix in {w[:3] for w in audit.split_terms([(text or "").encode()], audit.LETTERS, True)[0].to_pylist()}:
            docs[lang or "", prefix] = docs.get((lang or "", prefix), 0) + 1
    counted = rows.groupBy("lang", F.substring("term", 1, 3).alias("p")).agg(F.sum("fresh0").alias("n")).collect()
    assert {(r.lang, bytes(r.p)): r.n for r in counted} == docs
    kept = audit.kept_terms(rows, 20, (3, 6)).collect()
    assert kept and all(docs[r["lang"], bytes(r.term)[:3]] >= 20 for r in kept)


def test_divergence_of_nothing(spark):
    assert audit.source_divergence(frame(spark, []).limit(0)).count() == 0


def test_ranked_search(spark, corpus):
    items = [(1, "alone again x1y"), (2, None), (3, ""), (4, "Prefix prefix PREFIX é"), (4, "Prefix prefix PREFIX é"), (None, "same text"), (6, "zzz unknown")]
    items += [(10 + k, r[1]) for k, r in enumerate(corpus[:20])]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id int, text string, item string, score int")
    docs = [(r[0], r[1]) for r in corpus]
    key = lambda rows: sorted(map(str, map(tuple, rows)))
    for size in (1 << 20, 200):  # one pass, several passes
        assert key(search.rank_documents(frame(spark, corpus), table, item_bytes=size).collect()) == key(ranked(docs, items))


def test_search_scores_a_class_once(spark):
    """Copies and texts that differ outside the vocabulary are one class, which keeps its smallest ids."""
    rows = [(i, f"apple pear other{i}", "en", "s") for i in range(500)] + [(1000, "apple pear pear", "en", "s")]
    block = next(search.item_blocks(spark.createDataFrame([(1, "apple pear")], "item_id int, text string"), "item_id", "text", 100))
    shared = spark.sparkContext.broadcast(block.vocabulary)
    classes = search.bag_classes(search.bags(frame(spark, rows), shared, "doc_id", "text"), 501, 1503, 10).collect()
    assert sorted(r.ids for r in classes) == [list(range(10)), [1000]]


def test_search_in_small_steps(spark, corpus, monkeypatch):
    monkeypatch.setattr(search, "CELLS", 1)
    monkeypatch.setattr(search, "POSTINGS", 1)
    items = [(k, r[1]) for k, r in enumerate(corpus[:6])]
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = [r[:2] for r in corpus[:150]]
    assert sorted(map(tuple, search.rank_documents(frame(spark, corpus[:150]), table, top=3).collect())) == ranked(docs, items, 3)


def test_search_of_nothing(spark, corpus):
    items = spark.createDataFrame([(1, "apple")], "item_id int, text string")
    assert search.rank_documents(frame(spark, []).limit(0), items).count() == 0
    assert search.rank_documents(frame(spark, corpus), items.limit(0)).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    ranks = byte_pairs.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
    return ranks, theirs


@pytest.mark.parametrize("stretch", [3, 7, 1 << 16])
def test_text_tree(tokenizer, monkeypatch, stretch):
    """Leaves cut anywhere, windows that grow over whole runs, characters on which Unicode versions differ."""
    monkeypatch.setattr(byte_pairs, "STRETCH", stretch)
    ranks, theirs = tokenizer
    tree, back = byte_pairs.TextTree(ranks, public_tokenizers.PATTERN, byte_pairs.class_differences()), byte_pairs.Decoder(ranks)
    rng = random.Random(stretch)
    alphabets = ["ab", "a", " ", "\n ", "aA '’s1 \n", "'sdmtrevl ", "日本 漢字1!", " 　\xa0xé1!'", "<|endoftext|> ", "".join(map(chr, range(0x550, 0x590)))]
    for letters in alphabets:
        for n in (1, 2, 3, 9, 40, 700):
            for _ in range(8):
                text = "".join(rng.choice(letters) for _ in range(n))
                _, ids = tree.encode([text.encode()])
                assert ids.tolist() == theirs.encode_ordinary(text)
                assert back.decode(ids) == text.encode()


def test_join_is_associative(tokenizer):
    pairs = byte_pairs.BytePairs(tokenizer[0])
    rng = random.Random(9)
    for _ in range(300):
        a, b, c = ("".join(rng.choice("aether n") for _ in range(rng.randrange(9))).encode() for _ in range(3))
        x, y, z = map(pairs.merge, (a, b, c))
        assert pairs.join(pairs.join(x, y), z) == pairs.join(x, pairs.join(y, z)) == pairs.merge(a + b + c)


def test_decoder_refuses_unknown_ids(tokenizer):
    with pytest.raises(ValueError, match="vocabulary"):
        byte_pairs.Decoder(tokenizer[0]).decode(byte_pairs.np.array([50_256]))


def test_encode_and_decode_tables(spark, corpus, tokenizer, monkeypatch):
    monkeypatch.setattr(byte_pairs, "DECODED", 1000)
    ranks, theirs = tokenizer
    rows = [*corpus, (600, "x" * 300_000, None, None), (600, "<|endoftext|>", None, None), (601, " " * 70_000 + "\U0001f600", None, None)]
    keep = ["doc_id", "row", "found", "ids"]
    encoded = byte_pairs.encode_texts(frame(spark, rows), keep, ranks, public_tokenizers.PATTERN)
    found = byte_pairs.decode_ids(encoded.select("row.doc_id", F.col("row.row").alias("row"), F.col("found.ids").alias("ids")), ["doc_id", "row", "ids"], ranks)
    key = lambda pairs: sorted(pairs, key=str)
    assert key((r.row.doc_id, list(r.row.ids), bytes(r.found.data)) for r in found.collect()) == key(
        (i, theirs.encode_ordinary(t or ""), (t or "").encode()) for i, t, _, _ in rows)
    assert byte_pairs.decode_ids(byte_pairs.encode_texts(frame(spark, []).limit(0), ["doc_id"], ranks, public_tokenizers.PATTERN).select(
        "row.doc_id", "found.ids"), ["doc_id"], ranks).count() == 0
    nulls = byte_pairs.decode_ids(spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>"), ["k"], ranks)
    assert {r.row.k: r.found.data for r in nulls.collect()} == {1: None, 2: bytearray()}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
def test_queries_equal_plain_versions(spark, tokenizer):
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    run = lambda name: entry.queries()[name](spark, FOLDER)
    assert sorted(map(tuple, run("op11_divergence").select("lang", "source", "part", "item", "value", "rank").collect())) == divergence([d[1:] for d in docs])
    assert sorted(map(tuple, run("op12_search").select("item_id", "rank", "doc_id", "score").collect())) == ranked([d[:2] for d in docs], items)
    sha = lambda data: hashlib.sha256(data).hexdigest()
    want = []
    for i, text, _, _ in docs:
        ids = tokenizer[1].encode_ordinary(text or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    assert sorted(map(tuple, run("op13_byte_pairs").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == sorted(want)
