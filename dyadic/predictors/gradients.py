"""Full-batch gradient steps over all training pairs, with the pairs dealt once.

Entities of a side are numbered within blocks, and pairs are dealt into cells: all pairs of one left block and one right
block, in several pieces where they are many. Cells are packed and stored as a table that is bucketed by the cell. A step
sends every block of vectors to the cells it has pairs in and adds up the partial gradients; the pairs themselves are
read where they lie and are not exchanged again. A task holds one cell and two blocks of vectors, however often an
entity occurs. A step sends a vector to every block of the other side, so blocks are as large as a task can hold and
there are few. Nothing that grows with the data is broadcast by force or collected.

Where all pairs and vectors fit one task there is one cell, and all steps are taken in its task (``DealtPairs.in_the_cell``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadic.operators.packing import packed, unpacked
from dyadic.operators.pair_dots import NUMBERS, block_counts, pair_dots
from dyadic.operators.pairs import PairData
from dyadic.operators.skew import lookup
from dyadic.session import checkpoint_folder, cut_lineage

#: Entities below which a block is not split to give cores work, fewest and most pairs of a cell, pairs that a task multiplies at once.
BLOCK, FEW_PAIRS, CELL_PAIRS, CHUNK = 4096, 1 << 16, 1 << 23, 1 << 15
#: Pairs up to which one task takes all steps: exchanges of a step would take longer than its sums.
ONE_TASK = 1 << 20

Slope = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def squared_slope(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and loss of the squared error."""
    return 2.0 * (score - y), (score - y) * (score - y)


def with_dots(cells: DataFrame, vectors: DataFrame) -> DataFrame:
    """Add ``dot`` of the vectors (side, key, vec) to (a, b) cells."""
    return pair_dots(cells, *[vectors.where(F.col("side") == side).select("key", "vec") for side in ("a", "b")])


def loss_curve(vectors: DataFrame, n: int) -> list[float]:
    """Mean loss of every epoch."""
    rows = (
        vectors.where("side = 'a'").select(F.posexplode("losses").alias("epoch", "loss"))
        .groupBy("epoch").agg(F.sum("loss").alias("loss")).orderBy("epoch").collect()
    )
    return [row.loss / max(n, 1) for row in rows]


def _numbered(entities: DataFrame, side: str, blocks: int) -> DataFrame:
    place = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    return entities.select(F.lit(side).alias("side"), "key", place.alias("block")).withColumn(
        "no", F.row_number().over(W.partitionBy("block").orderBy("key")) - 1)


def _packed(lists: pa.Table) -> pa.Table:
    table = unpacked(lists)
    blob = lambda c, kind: [table.column(c).to_numpy().astype(kind).tobytes()]
    return pa.table({"cell": lists.column("cell")[:1].combine_chunks(), "a": pa.array(blob("a_no", np.int32), pa.binary()),
                     "b": pa.array(blob("b_no", np.int32), pa.binary()), "y": pa.array(blob("y", np.float64), pa.binary())})


def _vectors(vectors: pa.Table, width: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Vectors of both sides by number, and their blocks."""
    side = np.where(pc.equal(vectors.column("side"), "a").to_numpy(), "a", "b")
    block, no = vectors.column("block").to_numpy(), vectors.column("no").to_numpy()
    values = vectors.column("vec").combine_chunks().flatten().to_numpy().reshape(len(side), -1)
    tables = {}
    for s in ("a", "b"):
        own = side == s
        tables[s] = np.zeros((no[own].max() + 1 if own.any() else 0, width))
        tables[s][no[own]] = values[own]
    return tables, {s: block[side == s] for s in ("a", "b")}


def _pairs(pairs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = (np.frombuffer(pairs.column(c)[0].as_py(), dtype=np.int32) for c in ("a", "b"))
    return a, b, np.frombuffer(pairs.column("y")[0].as_py(), dtype=np.float64)


def summed_slopes(tables: dict[str, np.ndarray], pairs: tuple[np.ndarray, np.ndarray, np.ndarray], slope: Slope) -> tuple[dict[str, np.ndarray], float]:
    """Gradients of both tables over the pairs (numbers of a, numbers of b, y), and the loss."""
    sums, total, (a, b, y) = {s: np.zeros_like(t) for s, t in tables.items()}, 0.0, pairs
    for at in range(0, len(y), CHUNK):
        i, j = a[at: at + CHUNK], b[at: at + CHUNK]
        left, right = tables["a"][i], tables["b"][j]
        steep, loss = slope(np.einsum("ij,ij->i", left, right), y[at: at + CHUNK])
        total += float(loss.sum())
        for s, at_rows, other in (("a", i, right), ("b", j, left)):
            low, high = int(at_rows.min()), int(at_rows.max()) + 1
            place, pulls = at_rows - low, np.ascontiguousarray(other.T) * steep
            for d, pull in enumerate(pulls):
                sums[s][low:high, d] += np.bincount(place, weights=pull, minlength=high - low)
    return sums, total


def _cell_gradients(pairs: pa.Table, vectors: pa.Table, slope: Slope, width: int) -> pa.Table:
    """Partial gradients (side, block, no, grad, loss) of one cell."""
    tables, block = _vectors(vectors, width)
    a, b, y = _pairs(pairs)
    sums, total = summed_slopes(tables, (a, b, y), slope)
    touched = {"a": np.unique(a), "b": np.unique(b)}
    rows = np.concatenate([sums[s][touched[s]] for s in ("a", "b")])
    loss = np.zeros(len(rows))
    loss[:1] = total  # the loss of a cell rides on its first left entity
    return pa.table({
        "side": pa.array(["a"] * len(touched["a"]) + ["b"] * len(touched["b"]), pa.string()),
        "block": pa.array(np.repeat([block[s][0] for s in ("a", "b")], [len(touched["a"]), len(touched["b"])]), pa.int32()),
        "no": pa.array(np.concatenate([touched["a"], touched["b"]]), pa.int32()),
        "grad": pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(rows.ravel())),
        "loss": pa.array(loss)})


def as_rows(tables: dict[str, np.ndarray], pairs: tuple[np.ndarray, np.ndarray, np.ndarray], history: list[float]) -> pa.Table:
    """(side, block, no, vec, losses) of the only blocks of both sides; the losses stand on the first left entity that has pairs."""
    rows, n = np.vstack([tables["a"], tables["b"]]), {s: len(t) for s, t in tables.items()}
    losses = np.zeros((len(rows), len(history)))
    losses[pairs[0].min()] = history
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
    return pa.table({
        "side": pa.array(["a"] * n["a"] + ["b"] * n["b"], pa.string()), "block": pa.array(np.zeros(len(rows), np.int32)),
        "no": pa.array(np.concatenate([np.arange(n["a"]), np.arange(n["b"])]), pa.int32()), "vec": lists(rows), "losses": lists(losses)})


def descended(vectors: pa.Table, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], slope: Slope, width: int, rate: float, steps: int) -> pa.Table:
    """Vectors after so many steps over all pairs."""
    tables, _ = _vectors(vectors, width)
    history = []
    for _ in range(steps):
        sums, total = summed_slopes(tables, pairs, slope)
        history.append(total)
        for s in ("a", "b"):
            tables[s] -= rate * sums[s]
    return as_rows(tables, pairs, history)


@dataclass
class DealtPairs:
    """Training pairs in cells. ``nodes``: (side, key, block, no); ``cells``: (cell, a_block, b_block)."""

    nodes: DataFrame
    cells: DataFrame
    name: str
    largest_block: int

    @classmethod
    def deal(cls, data: PairData, train: DataFrame, block: int | None = None, cell_pairs: int | None = None, width: int = 16) -> DealtPairs:
        """``block`` and ``cell_pairs`` are by default what gives every core a cell, within bounds, for vectors of ``width`` numbers."""
        spark = train.sparkSession
        cores = spark.sparkContext.defaultParallelism
        rows = {s: e.count() for s, e in (("a", data.left), ("b", data.right))}
        if block is None and cell_pairs is None and data.size <= ONE_TASK and max(rows.values()) * width <= NUMBERS:
            block, cell_pairs = max(1, *rows.values()), ONE_TASK
        if cell_pairs is None:
            cell_pairs = min(CELL_PAIRS, max(FEW_PAIRS, 2 * data.size // cores))
        blocks = block_counts(rows, width, BLOCK, cores) if block is None else {s: -(-n // block) or 1 for s, n in rows.items()}
        nodes = cut_lineage(_numbered(data.left, "a", blocks["a"]).unionByName(_numbered(data.right, "b", blocks["b"])))
        placed = train.select("a", "b", "y")
        for s, other in (("a", "b"), ("b", "a")):
            numbers = nodes.where(F.col("side") == s).select(F.col("key").alias(s), F.col("block").alias(f"{s}_block"), F.col("no").alias(f"{s}_no"))
            placed = lookup(placed, numbers, s, data.hot[s], [other], how="inner")
        placed = cut_lineage(placed.select("a_block", "b_block", "a_no", "b_no", "y"))
        counts = placed.groupBy("a_block", "b_block").agg(F.ceil(F.count("*") / cell_pairs).cast("long").alias("pieces"))
        # cells are numbered by their blocks and piece; a piece number needs at most the digits of all pairs
        number = (F.col("a_block").cast("long") * blocks["b"] + F.col("b_block")) * (1 + data.size // cell_pairs)
        counts = cut_lineage(counts.withColumn("first", number))
        cells = counts.select(F.explode(F.sequence("first", F.col("first") + F.col("pieces") - 1)).alias("cell"), "a_block", "b_block")
        dealt = placed.join(counts, ["a_block", "b_block"]).select(
            (F.col("first") + F.pmod(F.xxhash64("a_no", "b_no"), F.col("pieces"))).alias("cell"), "a_no", "b_no", "y")
        blobs = packed(dealt, ["cell"], ["a_no", "b_no", "y"], ["a_no", "b_no"]).groupBy("cell").applyInArrow(_packed, "cell long, a binary, b binary, y binary")
        name = f"dyadic_cells_{uuid.uuid4().hex}"
        buckets = max(1, min(cells.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
        blobs.write.bucketBy(buckets, "cell").option("path", f"{checkpoint_folder(spark)}/{name}").saveAsTable(name)
        return cls(nodes, cells, name, max(-(-n // blocks[s]) for s, n in rows.items()))

    def gradients(self, vectors: DataFrame, width: int, slope: Slope) -> DataFrame:
        """(side, block, no, grad, loss): summed gradients for vectors (side, block, no, vec); losses stand on side a."""
        facing = None
        for s in ("a", "b"):
            own = F.broadcast(self.cells.select("cell", F.col(f"{s}_block").alias("block")))  # few: blocks are as large as a task allows
            part = vectors.where(F.col("side") == s).select("side", "block", "no", "vec").join(own, "block")
            facing = part if facing is None else facing.unionByName(part)
        run = lambda pairs, met: _cell_gradients(pairs, unpacked(met), slope, width)
        pairs = vectors.sparkSession.table(self.name)
        facing = packed(facing, ["cell"], ["side", "block", "no", "vec"], ["side", "no"])
        parts = pairs.groupBy("cell").cogroup(facing.groupBy("cell")).applyInArrow(
            run, "side string, block int, no int, grad array<double>, loss double")
        sums = parts.groupBy("side", "block", "no").agg(
            *[F.sum(F.get("grad", F.lit(i))).alias(f"_{i}") for i in range(width)], F.sum("loss").alias("loss"))
        return sums.select("side", "block", "no", F.array(*[F.col(f"_{i}") for i in range(width)]).alias("grad"), "loss")

    @cached_property
    def in_one_task(self) -> bool:
        return self.cells.count() == 1

    def in_the_cell(self, entities: DataFrame, run: Callable[[pa.Table, tuple[np.ndarray, np.ndarray, np.ndarray]], pa.Table]) -> DataFrame:
        """(side, block, no, vec, losses): what ``run`` makes in one task of all entities (side, no, ...) and all pairs."""
        whole = lambda pairs, met: run(unpacked(met), _pairs(pairs))
        columns = [c for c in entities.columns if c != "key"]
        facing = packed(entities.withColumn("cell", self.cells.select("cell").scalar()), ["cell"], columns, ["side", "no"])
        pairs = entities.sparkSession.table(self.name)
        return pairs.groupBy("cell").cogroup(facing.groupBy("cell")).applyInArrow(
            whole, "side string, block int, no int, vec array<double>, losses array<double>")

    def forget(self) -> None:
        """Drop the table's name; its files stay in the shared folder, which its owner clears."""
        self.nodes.sparkSession.sql(f"drop table if exists {self.name}")
