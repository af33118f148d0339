"""Lookups that stay balanced when a few keys hold a large share of the rows.

``HotKeys`` names the keys above ``1 / SHARE`` of all rows. There can be at most ``SHARE`` of them, which is
what makes the list safe to collect and to broadcast. Fact rows of a hot key are spread over several salts and
the one lookup row of that key is repeated once per salt; every other key joins as usual.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARE = 10_000
MIN_ROWS = 1_000_000  # a key smaller than this fits one task on any cluster


@dataclass(frozen=True)
class HotKeys:
    key: str
    pieces: dict  # key value -> number of salts

    def _frame(self, like: DataFrame, key: str) -> DataFrame:
        schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("_pieces", T.IntegerType())])
        listed = like.sparkSession.createDataFrame(list(self.pieces.items()), schema)
        return F.broadcast(listed.withColumn(key, F.col(key).cast(like.schema[key].dataType)))

    def salt(self, facts: DataFrame, spread_by: list[str]) -> DataFrame:
        """Add ``_salt``: 0 for ordinary keys, a hash of ``spread_by`` modulo the piece count for hot ones."""
        if not self.pieces:
            return facts
        salt = F.pmod(F.xxhash64(*spread_by), F.coalesce(F.col("_pieces"), F.lit(1))).cast("int")
        return (
            facts.join(self._frame(facts, self.key), self.key, "left")
            .withColumn("_salt", salt)
            .drop("_pieces")
        )

    def repeat(self, table: DataFrame, key: str) -> DataFrame:
        """Repeat the lookup rows of hot keys, once for each ``_salt``."""
        if not self.pieces:
            return table
        last = F.coalesce(F.col("_pieces"), F.lit(1)) - 1
        return (
            table.join(self._frame(table, key), key, "left")
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
            .drop("_pieces")
        )


def no_hot_keys(key: str) -> HotKeys:
    return HotKeys(key, {})


def find_hot_keys(
    facts: DataFrame, keys: list[str], min_rows: int = MIN_ROWS, share: int = SHARE, at_most: int | None = None
) -> dict[str, HotKeys]:
    """Hot keys of several columns in one pass (``min_rows`` is lowered by tests).

    A table of at most ``min_rows`` rows has none; ``at_most`` is a known bound on its size that saves counting.
    """
    total = facts.count() if at_most is None or at_most > min_rows else at_most
    if total <= min_rows:
        return {k: no_hot_keys(k) for k in keys}
    sets = [[F.col(k)] for k in keys]
    counts = (
        facts.groupingSets(sets, *keys)
        .agg(F.count("*").alias("n"))
        .select(
            reduce(lambda acc, k: F.when(F.col(k).isNotNull(), F.lit(k)).otherwise(acc), keys, F.lit(None)).alias("col"),
            F.coalesce(*[F.col(k).cast("string") for k in keys]).alias("value"),
            "n",
        )
    )
    return _listed(counts, keys, total, min_rows, share)


def hot_keys_of_counts(counted: DataFrame, key: str, rows: str, total: int, min_rows: int = MIN_ROWS, share: int = SHARE) -> HotKeys:
    """Hot keys of a table of ``total`` rows from one row per key with its number of ``rows``."""
    if total <= min_rows:
        return no_hot_keys(key)
    counts = counted.select(F.lit(key).alias("col"), F.col(key).cast("string").alias("value"), F.col(rows).alias("n"))
    return _listed(counts, [key], total, min_rows, share)[key]


def _listed(counts: DataFrame, keys: list[str], total: int, min_rows: int, share: int) -> dict[str, HotKeys]:
    # Only rows of large keys reach the driver, at most ``share`` per column.
    rows = counts.where((F.col("n") > min_rows) & (F.col("n") * share > total)).collect()
    size = max(min_rows, total // share, 1)
    found: dict[str, dict] = {k: {} for k in keys}
    for row in rows:
        found[row["col"]][row["value"]] = -(-row["n"] // size)
    return {k: HotKeys(k, v) for k, v in found.items()}


def lookup(
    facts: DataFrame, table: DataFrame, key: str, hot: HotKeys | None = None,
    spread_by: list[str] | None = None, how: str = "left",
) -> DataFrame:
    """Join ``table`` (unique on ``key``) to ``facts``, hot keys spread over salts.

    Which side is broadcast, if any, is left to the optimizer's measured sizes.
    """
    if hot is None or not hot.pieces:
        return facts.join(table, key, how)
    nested = (T.MapType, T.ArrayType, T.StructType)
    spread = spread_by or [f.name for f in facts.schema if f.name != key and not isinstance(f.dataType, nested)]
    joined = hot.salt(facts, spread).join(hot.repeat(table, key), [key, "_salt"], how)
    return joined.drop("_salt")
