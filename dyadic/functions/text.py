"""String features: character histograms, hashed n-grams, vocabularies, id sequences, pooled tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadic.functions.vectors import let, norm

# Residue letters outside the standard alphabet, and the letter that stands in for them.
RARE_RESIDUES = "[UZOB]"
RARE_REPLACEMENT = "X"
STRETCH = 1 << 20  # characters whose grams are counted at once
DENSE = 1 << 22  # with fewer possible values, distinct ones are found by counting instead of sorting
PIECES = 64  # groups in which the partial counts of a key are added up first


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalize_sequence(text: Column | str) -> Column:
    stripped = F.regexp_replace(_col(text), r"^\s+|\s+$", "")
    return F.regexp_replace(F.upper(stripped), RARE_RESIDUES, RARE_REPLACEMENT)


def char_counts(text: Column | str) -> Column:
    """``array<struct<ch, n>>`` of a string's characters, found without exploding it into rows.

    The distinct characters of a text are few; the count of each is the length that disappears when the
    character is removed, a native string operation. Nothing is shuffled.
    """
    text = _col(text)
    distinct = F.array_remove(F.array_distinct(F.split(text, "")), "")
    return F.transform(
        distinct,
        lambda ch: F.struct(
            ch.alias("ch"),
            (F.length(text) - F.length(F.replace(text, ch, F.lit("")))).cast("double").alias("n"),
        ),
    )


def _bucket_total(counts: Column, bucket: Column, width: int) -> Column:
    return F.aggregate(
        F.filter(counts, lambda c: F.ascii(c["ch"]) % F.lit(width) == bucket),
        F.lit(0.0),
        lambda acc, c: acc + c["n"],
    )


def hash_vector(text: Column | str, width: int = 16) -> Column:
    """L2-normed histogram of code point modulo ``width`` as a dense array (empty text: zeros)."""
    return let(
        char_counts(text),
        lambda counts: let(
            F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: _bucket_total(counts, i, width)),
            lambda raw: let(
                norm(raw),
                lambda size: F.when(size > 0, F.transform(raw, lambda x: x / size)).otherwise(raw),
            ),
        ),
    )


def hash_map(text: Column | str, width: int = 768) -> Column:
    """Sparse twin of :func:`hash_vector`: ``map<int,double>`` with only the buckets in use."""

    def scaled(counts: Column, buckets: Column) -> Column:
        raw = F.transform(buckets, lambda b: _bucket_total(counts, b, width))
        return let(raw, lambda r: let(
            norm(r), lambda size: F.map_from_arrays(buckets, F.transform(r, lambda x: x / size))
        ))

    return let(
        char_counts(text),
        lambda counts: let(
            F.array_distinct(F.transform(counts, lambda c: (F.ascii(c["ch"]) % F.lit(width)).cast("int"))),
            lambda buckets: scaled(counts, buckets),
        ),
    )


def char_rows(frame: DataFrame, key: str, text: str) -> DataFrame:
    """One row ``(key, ch)`` per character of long texts, for aggregation by generated code.

    Counts are complete within a map task already, so a shuffle moves one row per text and distinct value.
    """
    return frame.select(key, F.explode(F.split(F.col(text), "")).alias("ch")).where(F.col("ch") != "")


def hash_features(frame: DataFrame, key: str, text: str, width: int = 16) -> DataFrame:
    """Sparse form ``(key, bucket, w)`` of :func:`hash_vector` for long texts."""
    hits = char_rows(frame, key, text).groupBy(key, (F.ascii("ch") % F.lit(width)).alias("bucket")).agg(
        F.count("*").cast("double").alias("n")
    )
    return unit_rows(hits, key, "n").withColumnRenamed("n", "w")


def unit_rows(hits: DataFrame, key: str, weight: str) -> DataFrame:
    """Rows (key, bucket, weight) scaled to length one for each key; a key has at most one row for each bucket."""
    packed = hits.groupBy(key).agg(F.collect_list(F.struct("bucket", weight)).alias("_hits"), F.sqrt(F.sum(F.col(weight) * F.col(weight))).alias("_norm"))
    return packed.select(key, "_norm", F.inline("_hits").alias("bucket", weight)).select(key, "bucket", (F.col(weight) / F.col("_norm")).alias(weight))


def _numbered(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, all below ``size``, and the place of each value among them."""
    if size > DENSE:
        return np.unique(values, return_inverse=True)
    found = np.flatnonzero(np.bincount(values, minlength=size))
    place = np.empty(size, dtype=np.int64)
    place[found] = np.arange(len(found))
    return found, place[values]


def _gram_buckets(text: str, n: int, buckets: int) -> np.ndarray:
    """Bucket of the gram at each place of a text of at least ``n`` characters; md5 runs once per distinct gram."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    found, char = _numbered(codes, 0x110000)
    chars = [chr(c) for c in found.tolist()]
    grams, at = chars, char
    for size in range(1, n):
        found, at = _numbered(at[:-1] * len(chars) + char[size:], len(grams) * len(chars))
        grams = [grams[g // len(chars)] + chars[g % len(chars)] for g in found.tolist()]
    digests = (hashlib.md5(g.encode("utf-8", "surrogateescape"), usedforsecurity=False).hexdigest() for g in grams)
    return np.array([int(d[:8], 16) % buckets for d in digests], dtype=np.int64)[at]


def _stretches(texts: list[bytes], n: int) -> Iterator[list[tuple[int, str]]]:
    """Lists of (row, stretch) with about ``STRETCH`` characters; each gram lies in exactly one stretch."""
    held, size = [], 0
    for row, raw in enumerate(texts):
        text = raw.decode("utf-8", "surrogateescape")
        for start in range(0, len(text) - n + 1, STRETCH):
            held.append((row, text[start : start + STRETCH + n - 1]))
            size += len(held[-1][1])
            if size >= STRETCH:
                yield held
                held, size = [], 0
    if held:
        yield held


def _count_grams(key: pa.Array, texts: list[bytes], n: int, buckets: int) -> tuple[pa.Array, pa.MapArray]:
    """The distinct keys of a batch and for each the counts of its buckets."""
    if pa.types.is_nested(key.type):
        keys, owner = key, np.arange(len(key))
    else:
        coded = key.dictionary_encode(null_encoding="encode")
        keys, owner = coded.dictionary, coded.indices.to_numpy()
    cells, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for held in _stretches(texts, n):
        rows, parts = zip(*held, strict=True)
        part = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        whole = part[: len(part) - n + 1] == part[n - 1 :]
        bucket = _gram_buckets("".join(parts), n, buckets)
        found, place = _numbered((part[: len(bucket)] * buckets + bucket)[whole], len(parts) * buckets)
        cells.append(owner[np.array(rows)][found // buckets] * buckets + found % buckets)
        counts.append(np.bincount(place, minlength=len(found)))
    found, place = _numbered(np.concatenate(cells), len(keys) * buckets)
    total = np.zeros(len(found), dtype=np.int64)
    np.add.at(total, place, np.concatenate(counts))
    offsets = np.searchsorted(found, np.arange(len(keys) + 1) * buckets).astype(np.int32)
    return keys, pa.MapArray.from_arrays(pa.array(offsets), pa.array((found % buckets).astype(np.int32)), pa.array(total))


def _added(frame: DataFrame, *by: str) -> DataFrame:
    """``(*by, _counts)``: the counts of all rows of a group added up bucket by bucket."""
    maps = frame.groupBy(*by).agg(F.collect_list("_counts").alias("_maps"))
    added = F.aggregate(
        F.slice("_maps", 2, F.size("_maps")),
        F.get("_maps", F.lit(0)),
        lambda total, more: F.map_zip_with(total, more, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))),
    )
    return maps.select(*by, added.alias("_counts"))


def ngram_features(frame: DataFrame, key: str, text: str, n: int = 2, buckets: int = 512,
                   normalize: bool = True) -> DataFrame:
    """Sparse hashed n-gram counts ``(key, bucket, w)``; short strings are padded with ``_`` to one gram.

    A task counts the grams of its texts in place, so a key is one row with a map of its buckets until the end: no row
    per gram is made or moved. Counts of a key with many rows are added up in pieces first.
    """
    padded = F.when(F.length(text) < n, F.rpad(F.col(text), n, "_")).otherwise(F.col(text))
    texts = frame.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), padded.cast("binary").alias("_text"))
    schema = T.StructType([texts.schema["_key"], T.StructField("_counts", T.MapType(T.IntegerType(), T.LongType()))])

    def run(batches):
        for batch in batches:
            found = _count_grams(batch.column(0), batch.column(1).to_pylist(), n, buckets)
            yield pa.RecordBatch.from_arrays(list(found), ["_key", "_counts"])

    # A key's rows of one task stay together, so a task that runs again sends them to the same place.
    counted = texts.mapInArrow(run, schema).withColumn("_piece", F.pmod(F.spark_partition_id(), F.lit(PIECES)))
    counts = _added(_added(counted, "_key", "_piece"), "_key")
    size = norm(F.transform(F.map_values("_counts"), lambda x: x.cast("double"))) if normalize else F.lit(1.0)
    hits = counts.select("_key", size.alias("_norm"), "_counts").select("_key", "_norm", F.explode("_counts").alias("bucket", "_n"))
    return hits.select(F.col("_key").alias(key), "bucket", (F.col("_n").cast("double") / F.col("_norm")).alias("w"))


def char_vocabulary(frame: DataFrame, text: str) -> DataFrame:
    """``(ch, id)`` of all characters in code-point order, ids from 1 (0 is the pad).

    The number of rows is bounded by the Unicode range, so the one ordered window over them is small
    whatever the size of the input.
    """
    chars = (
        frame.select(F.explode(F.array_distinct(F.split(F.col(text), ""))).alias("ch"))
        .where(F.col("ch") != "")
        .distinct()
    )
    return chars.select("ch", F.expr("row_number() over (order by ch)").cast("int").alias("id"))


def code_point_table(vocabulary: DataFrame) -> Column:
    """Constant array that maps a code point to its vocabulary id in one step (0 where unknown).

    Collecting is safe: a vocabulary cannot exceed the 1,114,112 code points of Unicode.
    """
    rows = vocabulary.select(F.ascii("ch").alias("cp"), "id").collect()
    table = [0] * (max((r.cp for r in rows), default=0) + 1)
    for row in rows:
        table[row.cp] = row.id
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")


def encode_chars(text: Column | str, table: Column, max_len: int | None) -> Column:
    """Vocabulary ids of the first ``max_len`` characters, zero-padded; ``None`` keeps the whole text unpadded."""
    text = _col(text)
    head = text if max_len is None else F.substring(text, 1, max_len)
    chars = F.when(F.length(head) > 0, F.split(head, "")).otherwise(F.array().cast("array<string>"))
    ids = F.transform(chars, lambda ch: F.coalesce(F.get(table, F.ascii(ch)), F.lit(0)))
    if max_len is None:
        return ids
    return F.concat(ids, F.array_repeat(F.lit(0), F.lit(max_len) - F.size(ids)))
