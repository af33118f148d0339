"""Rows packed into lists before they go to Arrow tasks: what a row costs on that way is paid once for thousands of them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = 64  # lists of a group


def packed(frame: DataFrame, keys: list[str], columns: list[str], spread_by: list[str]) -> DataFrame:
    """``(*keys, _rows)``: the rows of a group in up to ``PIECES`` lists by a hash of ``spread_by``, dealt by ``keys``.

    There is one exchange; grouping or co-grouping by ``keys`` afterwards needs no other.
    """
    piece = F.pmod(F.xxhash64(*spread_by), F.lit(PIECES)).alias("_piece")
    lists = frame.repartition(*keys).groupBy(*keys, piece).agg(F.collect_list(F.struct(*columns)).alias("_rows"))
    return lists.select(*keys, "_rows")


def unpacked(table: pa.Table) -> pa.Table:
    """The rows of all lists in one table."""
    return pa.Table.from_batches([pa.RecordBatch.from_struct_array(table.column("_rows").combine_chunks().flatten())])
