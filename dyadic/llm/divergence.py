"""Audit of how the sources of a language diverge from each other and from the language, over the terms it uses widely.

Which terms a language keeps is found by iceberg prefix refinement. Prefixes of growing byte length are counted by the
documents that hold them; a prefix in too few documents is discarded with all that extends it, so only extensions of
surviving prefixes are ever grouped, and what is complete and survives is a kept term. Rare terms, which are most of a
vocabulary, never reach a shuffle as terms.

Documents are read once. A piece of a partition gives one row for each language and term: how often each source has
it, and for each prefix length in how many documents this term is the first (in byte order) with its prefix. Summed
over the terms of a prefix these numbers are its distinct documents, without a distinct aggregation.

A row is a document, also if it is repeated. Null texts, languages and sources count as empty ones; texts without
terms still make their group known; terms of any length are kept whole. Columns other than the three are not read.
An empty table gives an empty result. A language with one source has no pairs; one without kept terms has pairs of
value 0. Equal values are ordered by the bytes of the item.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadic.llm.terms import LETTERS, split_terms
from dyadic.llm.words import lists, pieces
from dyadic.session import cut_lineage, spread_scan

#: Byte lengths of the levels; the last level is the whole term.
LADDER = (3, 6, 9, 14, 24)
PIECE = 8 << 20
#: Survivors of a level are broadcast up to this many rows (some 25 MB), else joined by shuffles.
BROADCAST_ROWS = 300_000
#: Cells of one block of terms by sources, where they outnumber the sums that a block returns.
CELLS = 1 << 16
SCALE, SMOOTH = 1_000_000_000, 5


def term_rows(docs: DataFrame, text: str, lang: str, source: str, ladder: tuple[int, ...]) -> DataFrame:
    """Rows (lang, term, fresh0.., uses) for each piece of a partition; terms end with a zero byte.

    ``fresh<k>`` counts the documents where the term is the first with its prefix of level k; ``uses`` has the
    occurrences by source.
    """
    named = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(named(lang).alias("lang"), named(source).alias("source"), F.col(f"`{text}`").cast("binary").alias("text"))
    levels = len(ladder) + 1
    uses = T.ArrayType(T.StructType([T.StructField("source", T.StringType()), T.StructField("n", T.LongType())]))
    schema = T.StructType([
        T.StructField("lang", T.StringType()), T.StructField("term", T.BinaryType()),
        *[T.StructField(f"fresh{k}", T.LongType()) for k in range(levels)], T.StructField("uses", uses)])

    def work(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        terms, counts = split_terms(piece.column("text").to_pylist(), LETTERS, end_mark=True)
        if not len(terms):
            return None
        coded = terms.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        known = coded.dictionary.take(pa.array(order))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        held = np.unique(np.repeat(np.arange(len(counts)), counts) * len(order) + place[coded.indices.to_numpy()], return_counts=True)
        doc, term, n = held[0] // len(order), held[0] % len(order), held[1]
        lang, source = (piece.column(c).dictionary_encode() for c in ("lang", "source"))
        lang_of, source_of = (c.indices.to_numpy().astype(np.int64) for c in (lang, source))
        row, inverse = np.unique(lang_of[doc] * len(order) + term, return_inverse=True)
        follows = np.concatenate(([False], doc[1:] == doc[:-1]))
        before = np.concatenate(([0], term[:-1]))
        columns = []
        for size in (*ladder, None):
            cut = known if size is None else pc.binary_slice(known, 0, size)
            changed = pc.not_equal(cut[1:], cut[:-1]).to_numpy(zero_copy_only=False)
            prefix = np.concatenate(([0], np.cumsum(changed)))
            fresh = ~(follows & (prefix[term] == prefix[before]))
            columns.append(pa.array(np.bincount(inverse[fresh], minlength=len(row)), pa.int64()))
        used, at = np.unique(inverse * len(source.dictionary) + source_of[doc], return_inverse=True)
        total = np.zeros(len(used), dtype=np.int64)
        np.add.at(total, at, n)
        each = pa.StructArray.from_arrays([source.dictionary.take(pa.array(used % len(source.dictionary))), pa.array(total)], ["source", "n"])
        return pa.RecordBatch.from_arrays(
            [lang.dictionary.take(pa.array(row // len(order))), known.take(pa.array(row % len(order))).cast(pa.binary()), *columns,
             lists(np.bincount(used // len(source.dictionary), minlength=len(row)), each)], schema.names)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, limit=PIECE):
                if (found := work(piece)) is not None:
                    yield found

    return spread_scan(rows).mapInArrow(run, schema)


def small(table: DataFrame, rows: int) -> DataFrame:
    """A written table as a join side: broadcast while it is known to be small, else left to the optimizer."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def kept_terms(rows: DataFrame, least: int, ladder: tuple[int, ...]) -> DataFrame:
    """(lang, term) of the terms in at least ``least`` documents, found level by level."""
    kept: DataFrame | None = None
    alive, before = rows, None
    for k, size in enumerate((*ladder, None)):
        prefix = F.col("term") if size is None else F.substring("term", 1, size)
        counted = alive.where(F.col(f"fresh{k}") > 0).groupBy("lang", prefix.alias("prefix")).agg(F.sum(f"fresh{k}").alias("docs"))
        survivors = cut_lineage(counted.where(F.col("docs") >= least).select(
            "lang", "prefix", (F.substring("prefix", -1, 1) == F.lit(b"\x00")).alias("complete")))
        found = survivors.where("complete").select("lang", F.col("prefix").alias("term"))
        kept = found if kept is None else kept.union(found)
        before = survivors.where("not complete").select("lang", "prefix")
        n = before.count()
        if n == 0:
            break
        alive = rows.where(F.length("term") > size).withColumn("prefix", F.substring("term", 1, size)).join(
            small(before, n), ["lang", "prefix"], "left_semi").drop("prefix")
    return kept


def share(n: Column, total: Column, kept: Column) -> Column:
    """Smoothed share of a term in billionths, rounded down, plus one; exact for any count."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(19,0)")
    below = (total + kept * SMOOTH).cast("decimal(19,0)")
    return F.call_function("div", top, below) + 1


def source_counts(docs: DataFrame, least: int = 30, text: str = "text", lang: str = "lang", source: str = "source",
                  ladder: tuple[int, ...] = LADDER) -> tuple[DataFrame, DataFrame]:
    """Counts of kept terms (lang, source, term, n) where above zero, and the groups (lang, source, total, kept)."""
    rows = cut_lineage(term_rows(docs, text, lang, source, ladder))
    kept = cut_lineage(kept_terms(rows, least, ladder))
    uses = rows.select("lang", "term", "uses").join(small(kept, kept.count()), ["lang", "term"]).select("lang", "term", F.explode("uses").alias("use"))
    counts = cut_lineage(uses.groupBy("lang", "use.source", "term").agg(F.sum("use.n").alias("n")))
    named = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    groups = (
        docs.select(named(lang).alias("lang"), named(source).alias("source")).distinct()
        .join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        .join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left").na.fill(0, ["total", "kept"]))
    return counts, cut_lineage(groups)


def pair_sums(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): summed differences of shares for each two sources of a language with kept terms.

    Terms are dealt to blocks by hash, as many as keep a block of terms by sources bounded; a block gives one partial
    sum for each pair of sources.
    """
    shape = groups.groupBy("lang").agg(F.count("*").alias("sources"), (F.max("kept") * F.count("*")).alias("cells"))
    cells, sources = shape.agg(F.coalesce(F.max("cells"), F.lit(0)), F.coalesce(F.max("sources"), F.lit(0))).first()
    n = 1 + int(cells) // max(CELLS, 4 * sources * sources)
    shares = counts.join(groups, ["lang", "source"]).select(
        "lang", F.pmod(F.xxhash64("term"), F.lit(n)).cast("int").alias("block"), F.xxhash64("term", F.lit(1)).alias("h"), "term", "source",
        share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    everyone = groups.where("kept > 0").select(
        "lang", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), "source",
        share(F.lit(0).cast("long"), F.col("total"), F.col("kept")).alias("p"))

    def block(key, found: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        names = names.sort_values("source", ignore_index=True)
        of = {s: k for k, s in enumerate(names.source)}
        rows, _ = pd.factorize(found.term.map(bytes))
        table = np.repeat(names.p.to_numpy(np.int64)[None, :], rows.max() + 1 if len(rows) else 0, axis=0)
        table[rows, found.source.map(of).to_numpy(np.int64)] = found.p.to_numpy(np.int64)
        out = [(a, a + 1 + b, v) for a in range(len(names) - 1)
               for b, v in enumerate(np.abs(table[:, a + 1:] - table[:, a: a + 1]).sum(axis=0).tolist())]
        a, b, v = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [])
        return pd.DataFrame({"lang": [key[0]] * len(v), "a": names.source.to_numpy()[a], "b": names.source.to_numpy()[b], "value": np.array(v, dtype=np.int64)})

    parts = shares.groupBy("lang", "block").cogroup(everyone.groupBy("lang", "block")).applyInPandas(
        block, "lang string, a string, b string, value long")
    sums = cut_lineage(parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    return sums.selectExpr("lang", "a as source", "b as item", "value").union(sums.selectExpr("lang", "b as source", "a as item", "value"))


def source_divergence(docs: DataFrame, least: int = 30, top: int = 50, text: str = "text", lang: str = "lang", source: str = "source",
                      ladder: tuple[int, ...] = LADDER) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources by divergence (``pair``) and over-used terms (``term``)."""
    counts, groups = source_counts(docs, least, text, lang, source, ladder)
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").where("source <> item").join(
        pair_sums(counts, groups), ["lang", "source", "item"], "left").na.fill(0, ["value"])
    whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    spread = counts.withColumn("lang_n", F.sum("n").over(Window.partitionBy("lang", "term")))
    p = share(F.col("n"), F.col("total"), F.col("kept"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    name = F.expr("substring(term, 1, length(term) - 1)").cast("string")
    terms = spread.join(groups, ["lang", "source"]).join(whole, "lang").select("lang", "source", name.alias("item"), (p - q).alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(order).alias("rank")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank).where(F.col("rank") <= top)
    return pairs.union(terms)
