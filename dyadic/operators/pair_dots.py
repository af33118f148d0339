"""Dot products of the vectors of given pairs, without a vector on any pair.

Both sides are dealt into blocks by a hash of the key, so a pair knows its cell without a lookup. Vectors go to the cells
in which their block has pairs, once for each; a pair is exchanged once, comes with its own columns and leaves with one
number more. Blocks are as large as a task can hold, since a vector is copied for every block of the other side, and a
cell with more than ``CELL_PAIRS`` pairs is dealt into pieces, whatever an entity's share of all pairs is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dyadic.operators.packing import packed, unpacked
from dyadic.session import cut_lineage

#: Entities below which a block is not split to give cores work, pairs multiplied at once, numbers of a block, pairs of a task.
BLOCK, CHUNK, NUMBERS, CELL_PAIRS = 1024, 1 << 14, 1 << 22, 1 << 21


def block_counts(rows: dict[str, int], width: int, smallest: int, tasks: int) -> dict[str, int]:
    """Blocks of both sides: as few as a task's memory allows, then more of the larger side until there are ``tasks`` cells."""
    most = max(smallest, NUMBERS // max(width, 1))
    blocks = {s: max(1, -(-n // most)) for s, n in rows.items()}
    large = max(rows, key=rows.get)
    other = next(s for s in rows if s != large)
    blocks[large] = max(blocks[large], min(-(-rows[large] // smallest), -(-tasks // blocks[other])))
    return blocks


def _rows(vectors: pa.Table, side: str) -> tuple[pa.Table, pa.Array, np.ndarray]:
    own = vectors.filter(pc.equal(vectors.column("_side"), side))
    given = own.filter(pc.is_valid(own.column("_vec")))
    keys = given.column("_key").combine_chunks()
    return own, keys, given.column("_vec").combine_chunks().flatten().to_numpy().reshape(len(keys), -1)


def _dots(pairs: pa.Table, vectors: pa.Table, names: list[str], carried: dict[str, list[str]]) -> pa.Table:
    (all_left, left, x), (all_right, right, y) = _rows(vectors, "a"), _rows(vectors, "b")
    i, j = pc.index_in(pairs.column("a"), value_set=left), pc.index_in(pairs.column("b"), value_set=right)
    known = pc.and_(pc.is_valid(i), pc.is_valid(j)).to_numpy()
    at, to = (c.fill_null(0).to_numpy() for c in (i, j))
    out = np.zeros(len(at))
    places = np.flatnonzero(known)
    for k in range(0, len(places), CHUNK):
        here = places[k: k + CHUNK]
        out[here] = np.einsum("ij,ij->i", x[at[here]], y[to[here]])
    found = pairs.select(names).append_column("dot", pa.array(out, pa.float64(), mask=~known))
    for side, own, keys, place in (("a", all_left, left, i), ("b", all_right, right, j)):
        if carried[side] and len(own) > len(keys):  # entities without a vector have columns as well
            place = pc.index_in(pairs.column(side), value_set=own.column("_key").combine_chunks())
        elif carried[side]:
            own = own.filter(pc.is_valid(own.column("_vec")))
        for name in carried[side]:
            found = found.append_column(name, own.column(name).combine_chunks().take(place))
    return found


def pair_dots(pairs: DataFrame, left: DataFrame, right: DataFrame, block: int | None = None, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """``pairs`` with ``dot`` of the vectors (key, vec) of a and b; NULL where a side has none. Keys are unique.

    Further columns of ``left`` and ``right`` come along with their pairs.
    """
    spark, tables = pairs.sparkSession, {"a": left, "b": right}
    sizes = {s: t.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first() for s, t in tables.items()}
    if block is None:
        blocks = block_counts({s: r.n for s, r in sizes.items()}, max(r.width or 1 for r in sizes.values()), BLOCK, 2 * spark.sparkContext.defaultParallelism)
    else:
        blocks = {s: -(-r.n // block) or 1 for s, r in sizes.items()}
    place = lambda key, s: F.pmod(F.xxhash64(key), F.lit(blocks[s])).cast("int")
    placed = pairs.withColumn("_da", place("a", "a")).withColumn("_db", place("b", "b"))
    used = cut_lineage(placed.groupBy("_da", "_db").agg(F.ceil(F.count("*") / cell_pairs).cast("int").alias("_n")))
    keys = ["_da", "_db"]
    if (used.agg(F.max("_n")).first()[0] or 1) > 1:
        placed = placed.join(used, keys).withColumn("_dp", F.pmod(F.xxhash64("a", "b"), "_n").cast("int")).drop("_n")
        keys = [*keys, "_dp"]
    # cells are few: a block holds as many vectors as a task can
    used = F.broadcast(used.select("_da", "_db", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_dp")).select(*keys))
    carried = {s: [f for f in t.schema.fields if f.name not in ("key", "vec")] for s, t in tables.items()}
    facing = None
    for s, table in tables.items():
        extra = [F.col(f.name) if s == own else F.lit(None).cast(f.dataType).alias(f.name) for own, fields in carried.items() for f in fields]
        own = table.select(F.lit(s).alias("_side"), F.col("key").alias("_key"), F.col("vec").cast("array<double>").alias("_vec"),
                           place("key", s).alias(f"_d{s}"), *extra).join(used, f"_d{s}")
        facing = own if facing is None else facing.unionByName(own)
    names, carried_names = pairs.columns, {s: [f.name for f in fields] for s, fields in carried.items()}
    schema = T.StructType([*pairs.schema.fields, T.StructField("dot", T.DoubleType()),
                           *[T.StructField(f.name, f.dataType) for fields in carried.values() for f in fields]])

    def run(own: pa.Table, met: pa.Table) -> pa.Table:
        return _dots(unpacked(own), unpacked(met), names, carried_names) if len(own) else empty.empty_table()

    empty = to_arrow_schema(schema)
    lists = packed(placed, keys, names, ["a", "b"])
    vectors = packed(facing, keys, [c for c in facing.columns if c not in keys], ["_key"])
    return lists.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(run, schema)
