"""Line dedup by overlapping three-line windows.

Every run of ``window`` consecutive lines is hashed (128 bits). A window that occurs anywhere before is a repeat; the
lines that repeats cover are removed, so a passage goes as a whole while its first occurrence stays. Occurrences are
ordered by document id (null first), then by a digest of the text, then by line number.

Only hashes and positions are shuffled; the first occurrence of a window is an aggregate with partial sums, and the join
that brings it back to its repeats is an ordinary equi-join, which Spark splits where one window is very common.

Defined cases: a null text stays null; an empty text and texts of fewer lines than a window have no windows and stay;
blank lines are lines. Rows equal in id and text are one document and get the same result. Columns, their order and
unusual names of other columns stay. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadic.session import cut_lineage


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """Rows (_id, _digest, at, h1, h2), one for each window."""
    spot = lambda i: [F.get("_lines", i + k) for k in range(window)]
    hashes = F.transform(
        F.sequence(F.lit(0), F.size("_lines") - window),
        lambda i: F.struct(i.alias("at"), F.xxhash64(*spot(i)).alias("h1"), F.xxhash64(F.lit(window), *spot(i)).alias("h2")),
    )
    return docs.where(F.size("_lines") >= window).select("_id", "_digest", F.explode(hashes).alias("w")).select(
        "_id", "_digest", "w.*")


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """Positions of the windows that occur before: one row (_id, _digest, starts) per document with any."""
    windows = _windows(docs, window)
    place = F.struct("_id", "_digest", "at")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # written, so that the join deals both sides anew and Spark can split a very common window
    first = cut_lineage(first.where("first <> last").select("h1", "h2", "first"))
    later = windows.join(first, ["h1", "h2"]).where(place != F.col("first"))
    return later.groupBy("_id", "_digest").agg(F.sort_array(F.collect_set("at")).alias("starts"))


def kept_lines(lines: Column, starts: Column, window: int) -> Column:
    """Lines outside the windows that begin at the sorted ``starts``: the gaps between merged windows."""
    edges = F.concat(F.array(F.lit(-window)), starts, F.array(F.size(lines)))
    gap = lambda i: F.slice(
        lines, F.get(edges, i) + (window + 1), F.greatest(F.lit(0), F.get(edges, i + 1) - F.get(edges, i) - window))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(edges) - 2), gap))


def keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``row`` with all columns, the identity of the document and its lines."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("_text")).select(
        "row", "_id", F.xxhash64(F.lit(7), "_text").alias("_digest"), F.split("_text", "\n").alias("_lines"))


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 3) -> DataFrame:
    """Columns ``row`` (the document), ``n_lines``, ``n_removed`` and ``kept`` (the text without repeated lines)."""
    base = keyed(docs, id, text)
    starts = repeated_windows(base.select("_id", "_digest", "_lines"), window)
    starts = starts.select(F.col("_id").alias("_other"), F.col("_digest").alias("_other_digest"), "starts")
    same = F.col("_id").eqNullSafe(F.col("_other")) & (F.col("_digest") == F.col("_other_digest"))
    # the lines are split again after the join, so that texts travel once
    joined = base.drop("_lines").join(starts, same, "left").withColumn("_lines", F.split(F.col(f"row.`{text}`"), "\n"))
    kept = F.when(F.col("starts").isNull(), F.col("_lines")).otherwise(kept_lines(F.col("_lines"), F.col("starts"), window))
    n_lines = F.coalesce(F.size("_lines"), F.lit(0))
    n_lines = F.when(n_lines < 0, 0).otherwise(n_lines).cast("long")
    return joined.select("row", n_lines.alias("n_lines"), kept.alias("kept")).select(
        "row", "n_lines", F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("kept")).cast("long").alias("n_removed"),
        F.array_join("kept", "\n").alias("kept"))


def replace_text(result: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The documents of ``dedup_lines`` with their text replaced."""
    return result.select(*[F.col("kept").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in columns])
