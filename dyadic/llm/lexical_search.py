"""Ranked lexical search of whole documents by bags that are scored once.

Documents are restricted to the vocabulary of the items. What counts of a document are the frequencies of these terms
and its length measure m; documents that agree in both form a class (found by hash, told apart by the vectors
themselves), so copies and near copies are scored once and then expanded by ascending id.

Every document is a row: repeated rows are ranked each on its own, extra columns are not read. A null or empty text has
no terms and is not counted; documents without a positive score are not listed; a row whose id is null (or not a whole
number) is counted but cannot be named and is not listed. Repeated items are answered each; items without terms have no
answer. Empty tables give an empty result. Texts of any length are read whole. Equal scores go by ascending id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadic.llm.terms import LETTERS_DIGITS, split_terms
from dyadic.llm.words import lists, pieces
from dyadic.session import cut_lineage, spread_scan

#: Bytes of item text that are searched in one pass; more items make more passes.
ITEM_BYTES = 4 << 20
#: Scores (classes times items) that a task holds at once, and postings that it expands at once.
CELLS, POSTINGS = 1 << 20, 1 << 21
BASE, SPAN = 10, 90


class ItemTerms:
    """Distinct terms of some items, coded; for each term the items that hold it."""

    def __init__(self, items: list[Row]):
        terms, counts = split_terms([bytes(r.text) for r in items], LETTERS_DIGITS)
        coded = terms.dictionary_encode()
        self.ids = [r.id for r in items]
        self.vocabulary = coded.dictionary
        pairs = np.unique(coded.indices.to_numpy().astype(np.int64) * len(items) + np.repeat(np.arange(len(items)), counts))
        self.items = pairs % max(1, len(items))
        self.ends = np.searchsorted(pairs // max(1, len(items)), np.arange(len(self.vocabulary)), side="right")
        self.starts = np.concatenate(([0], self.ends[:-1])).astype(np.int64)


def item_blocks(items: DataFrame, item_id: str, text: str, limit: int) -> Iterator[ItemTerms]:
    """Items in groups of about ``limit`` bytes of text, fetched one group at a time."""
    rows = items.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + int(size) // limit
    for k in range(n):
        yield ItemTerms(rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect())


def bags(docs: DataFrame, vocabulary, doc_id: str, text: str) -> DataFrame:
    """Rows (id, n, terms, tfs): number of terms of a document, and frequencies of those in the vocabulary."""
    rows = docs.select(F.expr(f"try_cast(`{doc_id}` as bigint)").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                terms, counts = split_terms(piece.column("text").to_pylist(), LETTERS_DIGITS)
                codes = pc.index_in(terms, value_set=vocabulary.value)
                doc = np.repeat(np.arange(len(counts)), counts)[codes.is_valid().to_numpy(zero_copy_only=False)]
                size = max(1, len(vocabulary.value))
                held, tf = np.unique(doc * size + codes.drop_null().to_numpy(), return_counts=True)
                sizes = np.bincount(held // size, minlength=len(counts))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array(counts, pa.int64()), lists(sizes, pa.array(held % size, pa.int32())),
                     lists(sizes, pa.array(tf, pa.int64()))], schema.names)

    return spread_scan(rows).mapInArrow(run, schema)


def bag_classes(found: DataFrame, documents: int, terms: int, top: int) -> DataFrame:
    """One row (m, terms, tfs, ids) for each class of equal bags; ids are its ``top`` smallest ids.

    No item can list more members of a class than that. The rank is limited before the exchange too, so a class of
    very many documents brings ``top`` rows from each task.
    """
    m = (F.call_function("div", (F.lit(SPAN).cast("decimal(3,0)") * F.col("n").cast("decimal(17,0)") * F.lit(documents).cast("decimal(17,0)")),
                         F.lit(max(1, terms)).cast("decimal(19,0)")) + BASE).alias("m")
    rows = found.where("id is not null and size(terms) > 0").select(m, "terms", "tfs", "id").withColumn("h", F.xxhash64("m", "terms", "tfs"))
    same = ["h", "m", "terms", "tfs"]
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy(*same).orderBy("id"))).where(F.col("place") <= top)
    return first.groupBy(*same).agg(F.sort_array(F.collect_list("id")).alias("ids")).drop("h")


class Best:
    """The best documents of each item so far, by score and then by id."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.item, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.least = np.ones(items, dtype=np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        item, score, ids = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, item))
        item, score, ids = item[order], score[order], ids[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        stays = place < self.top
        last = place == self.top - 1
        self.least[item[last]] = score[last]
        self.item, self.score, self.id = item[stays], score[stays], ids[stays]


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions ``start .. start + size`` of all ranges, end to end."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def score_classes(classes: DataFrame, shared, item_type: T.DataType, top: int) -> DataFrame:
    """Rows (item, item_id, score, id): the best of each partition of classes, for every item."""
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", item_type),
                           T.StructField("score", T.LongType()), T.StructField("id", T.LongType())])

    def run(batches):
        items, weight = shared.value
        best = Best(len(items.ids), top)
        for batch in batches:
            column = lambda name, kind: (batch.column(name).offsets.to_numpy().astype(np.int64), batch.column(name).values.to_numpy().astype(kind))
            ends, terms = column("terms", np.int64)
            tfs = column("tfs", np.int64)[1]
            id_ends, ids = column("ids", np.int64)
            sizes = np.diff(ends)
            m = np.repeat(batch.column("m").to_numpy(), sizes)
            worth = weight[terms[ends[0]:]] * ((1_000_000_000 * tfs[ends[0]:]) // (1000 * tfs[ends[0]:] + 8 * m))
            width = items.ends - items.starts
            postings = np.concatenate(([0], np.cumsum(width[terms[ends[0]:]])))[ends - ends[0]]
            at = 0
            while at < len(sizes):
                to = max(at + 1, min(at + max(1, CELLS // len(items.ids)), int(np.searchsorted(postings, postings[at] + POSTINGS, side="right")) - 1))
                here = slice(int(ends[at] - ends[0]), int(ends[to] - ends[0]))
                own = terms[ends[0]:][here]
                held = width[own]
                row = np.repeat(np.repeat(np.arange(to - at), sizes[at:to]), held)
                score = np.zeros((to - at) * len(items.ids), dtype=np.int64)
                np.add.at(score, row * len(items.ids) + items.items[spans(items.starts[own], held)], np.repeat(worth[here], held))
                score = score.reshape(to - at, len(items.ids))
                row, item = np.nonzero(score >= best.least)
                members = np.diff(id_ends)[at + row]
                best.add(np.repeat(item, members), np.repeat(score[row, item], members), ids[spans(id_ends[at + row], members)])
                at = to
        named = [items.ids[k] for k in best.item.tolist()]
        yield pa.RecordBatch.from_pydict({"item": best.item, "item_id": pa.array(named, arrow_type(item_type)), "score": best.score, "id": best.id})

    return classes.mapInArrow(run, schema)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def rank_documents(docs: DataFrame, items: DataFrame, top: int = 10, doc_id: str = "doc_id", text: str = "text",
                   item_id: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item."""
    context = docs.sparkSession.sparkContext
    kind = items.schema[item_id].dataType
    out: DataFrame | None = None
    for block in item_blocks(items, item_id, item_text, item_bytes):
        found = cut_lineage(bags(docs, context.broadcast(block.vocabulary), doc_id, text))
        documents, terms = found.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(block.vocabulary), dtype=np.int64)  # as many rows as the block has terms
        for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[r["term"]] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
        scored = score_classes(bag_classes(found, documents, terms, top), context.broadcast((block, weight)), kind, top)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), "id"))
        best = scored.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", F.col("id").alias("doc_id"), "score")
        out = cut_lineage(best) if out is None else out.union(cut_lineage(best))
    return out
