"""Substring dedup over a compacted de Bruijn graph of token k-mers.

Edges of the graph are k-mers of words; of each window of ``window`` words only the k-mer with the smallest hash is kept,
so a window is found wherever it stands by the same k-mer at the same offset (about one k-mer in twenty is kept). Spark
joins keep the k-mers that occur in several documents. Two neighbouring k-mers of a document belong to one path if the
span from one to the other occurs as often as each of them, that is, if the graph does not branch between them. Such
paths are compacted: every window inside a path occurs in exactly the documents of the path, whose smallest id is known
from any of its k-mers, so the windows inside need no look of their own.

What remains are windows across branches and path ends. Their word sequences are hashed from the source text at the
paths' coordinates and their smallest document is found by one aggregation. Words covered by repeats are removed.

Hashes have 64 bits; a window inside a path is backed by the hashes of several k-mers and spans. Very common k-mers
are aggregated with partial sums and joined by equi-joins that Spark may split.

Defined cases: null texts have no words; texts shorter than a window lose nothing. Documents with null ids come after
all others and lose nothing to each other. Rows with equal ids lose nothing to each other; rows equal in id and text
get equal results. Words are whole and unchanged; texts are read whole. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadic.llm.words import SPACED, WORD_BASE, Words, map_texts, mix, pieces, range_hash, range_sums
from dyadic.session import cut_lineage

LAST = 2**63 - 1
SPAN = T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())])


def chosen_kmers(texts: list[bytes | None], window: int) -> tuple[np.ndarray, ...]:
    """Owner, place, k-mer hash, hash of the span up to the next k-mer's end (odd; even: no next), distance to the next k-mer,
    and how far before the place the first and last windows begin that are found by the k-mer."""
    k = window // 3
    words = Words(texts, SPACED)
    sums = range_sums(words.hashes(), WORD_BASE)
    n = len(words)
    counts = words.counts
    per_text = np.maximum(0, counts - window + 1)
    owner = np.repeat(np.arange(len(counts)), per_text)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text) + words.first[:-1][owner]
    if not len(start):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none, none, none
    places = np.arange(n - k + 1)
    hashes = range_hash(sums, places, places + k)
    # leftmost smallest of window - k + 1 neighbours, by doubling
    best, width, reach = places, 1, window - k + 1
    while width < reach:
        step = min(width, reach - width)
        a, b = best[:-step], best[step:]
        best = np.where(hashes[b] < hashes[a], b, a)
        width += step
    found = best[start]
    new = np.concatenate(([True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])))
    first = start[new]
    last = start[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(start) - 1]))]
    place, owner = found[new], owner[new]
    follows = np.concatenate((owner[1:] == owner[:-1], [False]))
    after = np.concatenate((place[1:], [0]))
    gap = np.where(follows, after - place, 0)
    # even values that differ: where a text ends there is no span to look up, and no key that all texts share
    span = mix(hashes[place] + place.astype(np.uint64)) & ~np.uint64(1)
    span[follows] = range_hash(sums, place[follows], after[follows] + k) | np.uint64(1)
    own = place - words.first[:-1][owner]
    return owner, own, hashes[place].view(np.int64), span.view(np.int64), gap, place - first, place - last


def _identity(docs: DataFrame, id: str, text: str, keep: list[str]) -> DataFrame:
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(LAST)).alias("doc"),
        F.xxhash64(F.col(f"`{text}`")).alias("tag"), F.col(f"`{text}`").cast("binary").alias("text"))


def _kmer_rows(base: DataFrame, window: int) -> DataFrame:
    """Rows (doc, tag, kmer, span, at): ``at`` packs place, gap and window range, to keep the shuffled rows small."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                owner, place, kmer, span, gap, first, last = chosen_kmers(piece.column("text").to_pylist(), window)
                at = (place << 24) | (gap << 16) | (first << 8) | last
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc").take(take), piece.column("tag").take(take), pa.array(kmer), pa.array(span), pa.array(at)],
                    ["doc", "tag", "kmer", "span", "at"])

    return base.select("doc", "tag", "text").mapInArrow(run, "doc long, tag long, kmer long, span long, at long")


def _paths(base: DataFrame, window: int) -> DataFrame:
    """Rows (doc, tag, low, start, end, first, last) of shared k-mers with the ends of their compacted paths."""
    rows = _kmer_rows(base, window)
    shared = rows.groupBy("kmer").agg(F.count("*").alias("times"), F.min("doc").alias("low"), F.max("doc").alias("high"))
    # written, so that the join below deals both sides anew and Spark can split a very common k-mer
    shared = cut_lineage(shared.where("low < high").drop("high"))
    found = cut_lineage(rows.join(shared, "kmer").drop("kmer"))
    spans = cut_lineage(found.where("span & 1 = 1").groupBy("span").agg(F.count("*").alias("together")))
    # dealt once, packed: neither the rows' distinctness nor the windows below need another exchange
    joined = found.join(spans, "span", "left").select("doc", "tag", "times", "low", "at", "together")
    joined = joined.repartition("doc", "tag").distinct().select(
        "doc", "tag", "times", "low", F.expr("at >> 24").alias("place"), F.expr("(at >> 16) & 255").alias("gap"),
        F.expr("at >> 8 & 255").alias("first"), F.expr("at & 255").alias("last"), "together")
    inside = Window.partitionBy("doc", "tag").orderBy("place")
    before = lambda c: F.lag(c).over(inside)
    goes_on = (before("place") + before("gap") == F.col("place")) & (before("gap") > 0) & (before("together") == before("times")) & (before("times") == F.col("times"))
    marked = joined.withColumn("fresh", F.when(goes_on, 0).otherwise(1)).withColumn("path", F.sum("fresh").over(inside))
    path = Window.partitionBy("doc", "tag", "path")
    return marked.select(
        "doc", "tag", "low", (F.col("place") - F.col("first")).alias("first"), (F.col("place") - F.col("last")).alias("last"),
        F.min("place").over(path).alias("start"), (F.max("place").over(path) + window // 3).alias("end"))


def _ranges(kind: Column, low: Column, high: Column) -> Column:
    return F.when(kind & (low <= high), F.array(F.struct(low.cast("int").alias("from"), high.cast("int").alias("to")))).otherwise(
        F.array().cast("array<struct<from:int,to:int>>"))


def repeated_words(docs: DataFrame, keep: list[str], id: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """Columns ``row`` (the kept ones), n_words, n_removed, spans (removed word ranges), kept (the words left, joined by a
    space; null where nothing is removed) and digest (sha256 of the words left). ``window`` is 3 to 255 words."""
    if not 3 <= window <= 255:  # distances inside a window are packed into bytes
        raise ValueError("window must be between 3 and 255 words")
    base = _identity(docs, id, text, keep)
    paths = _paths(base, window)
    span_end = F.col("end") - window
    # windows of a k-mer that lie in its path are settled; those before and after it are looked up
    settled = _ranges((F.col("end") - F.col("start") >= window) & (F.col("low") < F.col("doc")), F.col("start"), F.col("end"))
    left = _ranges(F.lit(True), F.col("first"), F.least(F.col("last"), F.greatest(F.col("first"), F.col("start")) - 1))
    right = _ranges(F.lit(True), F.greatest(F.col("first"), F.col("start"), span_end + 1), F.col("last"))
    per_doc = paths.select("doc", "tag", settled.alias("settled"), F.concat(left, right).alias("open"))
    per_doc = per_doc.groupBy("doc", "tag").agg(
        F.array_distinct(F.flatten(F.collect_list("settled"))).alias("settled"), F.flatten(F.collect_list("open")).alias("open"))
    per_doc = per_doc.where("size(settled) > 0 or size(open) > 0")
    texts = base.select("doc", "tag", "text")
    some = cut_lineage(texts.join(per_doc, ["doc", "tag"]))
    opened = some.where("size(open) > 0").select("doc", "tag", "text", "open")
    windows = _window_rows(opened, window)
    lowest = cut_lineage(windows.groupBy("h").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("h", "low"))
    looked = windows.join(lowest, "h").where("low < doc").groupBy("doc", "tag").agg(F.collect_set("place").alias("places"))
    result = _removed(some.select("doc", "tag", "text", "settled").join(looked, ["doc", "tag"], "left"), window)
    plain = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("digest", T.StringType())])

    def count(texts):
        split = [(t or b"").translate(SPACED).split() for t in texts]
        return [pa.array([len(w) for w in split], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in split])]

    plain_rows = map_texts(base, ["row", "doc", "tag"], plain, count).select("row.*", "found.*")
    result = result.dropDuplicates(["doc", "tag"])
    return plain_rows.join(result, ["doc", "tag"], "left").select(
        "row", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.array().cast("array<struct<from:int,to:int>>")).alias("spans"), "kept",
        F.coalesce("kept_digest", "digest").alias("digest"))


def _window_rows(opened: DataFrame, window: int) -> DataFrame:
    """Rows (h, doc, tag, place) of the windows in the open ranges."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                words = Words(piece.column("text").to_pylist(), SPACED)
                sums = range_sums(words.hashes(), WORD_BASE)
                ranges = [np.unique(np.concatenate([np.arange(r["from"], r["to"] + 1) for r in x])) for x in piece.column("open").to_pylist()]
                sizes = np.array([len(r) for r in ranges])
                place = np.concatenate(ranges)
                owner = np.repeat(np.arange(len(ranges)), sizes)
                start = place + words.first[:-1][owner]
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range_hash(sums, start, start + window).view(np.int64)), piece.column("doc").take(take),
                     piece.column("tag").take(take), pa.array(place, pa.int32())], ["h", "doc", "tag", "place"])

    return opened.mapInArrow(run, "h long, doc long, tag long, place int")


def _removed(rows: DataFrame, window: int) -> DataFrame:
    """Removed word ranges and the words left of documents with settled ranges or places of repeated windows."""
    schema = T.StructType([
        T.StructField("doc", T.LongType()), T.StructField("tag", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(SPAN)), T.StructField("kept", T.StringType()), T.StructField("kept_digest", T.StringType())])
    span_type = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                out = []
                for text, settled, places in zip(*(piece.column(c).to_pylist() for c in ("text", "settled", "places")), strict=True):
                    words = (text or b"").translate(SPACED).split()
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    for r in settled:
                        change[r["from"]] += 1
                        change[r["to"]] -= 1
                    at = np.array(places or [], dtype=np.int64)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + window, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).tolist()
                    cuts = [0, *edges, len(words)]
                    kept = b" ".join(w for a, b in zip(cuts[0::2], cuts[1::2], strict=True) for w in words[a:b])
                    spans = [{"from": a, "to": b} for a, b in zip(edges[0::2], edges[1::2], strict=True)]
                    out.append((int(gone.sum()), spans, kept.decode(), hashlib.sha256(kept).hexdigest()))
                n, spans, kept, digest = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc"), piece.column("tag"), pa.array(n, pa.int64()), pa.array(spans, span_type), pa.array(kept), pa.array(digest)],
                    schema.names)

    return rows.mapInArrow(run, schema)
