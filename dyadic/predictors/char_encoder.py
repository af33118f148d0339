"""Trainable character embeddings, pooled per entity, with per-entity biases.

Mean pooling over characters equals the entity's character frequencies times the embedding table, so tokens are
reduced to frequencies once. Per epoch the pairs meet the pooled vectors in Spark, the gradient of the tables is summed
per partition, and only the tables (vocabulary times width, bounded by the character set) visit the driver. Where all pairs
and the frequencies of all characters fit one task, all epochs run there.
Biases ride along as two extra vector components: (v, bias, 1) on side a against (v, 1, bias) on side b.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadic.functions.hashing import gaussian_matrix
from dyadic.functions.numeric import sigmoid
from dyadic.functions.text import char_counts, char_vocabulary, code_point_table
from dyadic.functions.vectors import let, total
from dyadic.operators.pair_dots import NUMBERS
from dyadic.operators.pairs import PairData
from dyadic.predictors.base import Prediction, target_cells
from dyadic.predictors.gradients import DealtPairs, Slope, as_rows, loss_curve, squared_slope, summed_slopes, with_dots
from dyadic.session import cut_lineage, forget

INITIAL_SCALE, SCORE_BOUND = 0.05, 50.0
SIDES = ("a", "b")
ENTRIES = 1 << 17  # character frequencies that a task multiplies at once


def char_frequencies(entities: DataFrame, max_len: int | None = None) -> tuple[DataFrame, int]:
    """``(key, ids, freqs)``: vocabulary ids and relative frequencies of the characters.

    Frequencies are of the whole text, or of its first ``max_len`` characters where a configuration asks for that.
    """
    texts = entities.select("key", F.coalesce("content", F.lit("")).alias("content"))
    vocabulary = cut_lineage(char_vocabulary(texts, "content"))
    size, table = vocabulary.count(), code_point_table(vocabulary)
    counts = char_counts("content" if max_len is None else F.substring("content", 1, max_len))

    def relative(found: Column) -> Column:
        return let(
            F.greatest(total(F.transform(found, lambda c: c["n"])), F.lit(1.0)),
            lambda length: F.struct(
                F.transform(found, lambda c: F.get(table, F.ascii(c["ch"]))).alias("ids"),
                F.transform(found, lambda c: c["n"] / length).alias("freqs"),
            ),
        )

    packed = texts.select("key", let(counts, relative).alias("p"))
    return packed.select("key", "p.ids", "p.freqs"), size


def _entries(rows: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Compressed sparse rows: for runs of entities the row, character and frequency of every entry."""
    ids, freqs = rows.column("ids"), rows.column("freqs")
    ends = ids.offsets.to_numpy().astype(np.int64)
    chars, values = ids.values.to_numpy(), freqs.values.to_numpy()
    base = int(freqs.offsets[0].as_py()) - int(ends[0]) if len(ends) else 0
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + ENTRIES, side="right")) - 1)
        low, high = int(ends[at]), int(ends[to])
        yield slice(at, to), np.repeat(np.arange(to - at), np.diff(ends[at: to + 1])), chars[low:high], values[low + base: high + base]
        at = to


def _of_side(batch: pa.RecordBatch, side: str) -> pa.RecordBatch:
    return batch.filter(pc.equal(batch.column("side"), side))


def _matrix(rows: pa.Array, width: int) -> np.ndarray:
    return rows.flatten().to_numpy().reshape(len(rows), -1)[:, :width]


def pooled_vectors(state: DataFrame, tables: dict[str, np.ndarray]) -> DataFrame:
    """``(side, key, block, no, vec)`` with the bias components appended."""
    width = tables["a"].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for side in SIDES:
                part = _of_side(batch, side)
                vectors = np.ones((len(part), width + 2))
                vectors[:, :width] = 0.0
                vectors[:, width if side == "a" else width + 1] = part.column("bias").to_numpy()
                for here, row, char, freq in _entries(part):
                    np.add.at(vectors[here, :width], row, freq[:, None] * tables[side][char])
                offsets = np.arange(len(part) + 1, dtype=np.int32) * (width + 2)
                yield pa.RecordBatch.from_arrays(
                    [*map(part.column, ["side", "key", "block", "no"]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))],
                    ["side", "key", "block", "no", "vec"])

    return state.select("side", "key", "block", "no", "ids", "freqs", "bias").mapInArrow(
        run, "side string, key string, block int, no int, vec array<double>")


def table_gradients(state: DataFrame, tables: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Sum over entities of frequency times vector gradient, per side."""
    width = tables["a"].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {side: np.zeros_like(table) for side, table in tables.items()}
        for batch in batches:
            moved = batch.filter(pc.is_valid(batch.column("grad")))
            for side in SIDES:
                part = _of_side(moved, side)
                grads = _matrix(part.column("grad"), width) if len(part) else None
                for here, row, char, freq in _entries(part):
                    np.add.at(sums[side], char, freq[:, None] * grads[here][row])
        for side, matrix in sums.items():
            used = np.flatnonzero(matrix.any(axis=1))
            yield pa.RecordBatch.from_pydict({"side": [side] * len(used), "row": pa.array(used, pa.int32()), "values": matrix[used].tolist()},
                                             schema=pa.schema([("side", pa.string()), ("row", pa.int32()), ("values", pa.list_(pa.float64()))]))

    parts = state.select("side", "ids", "freqs", "grad").mapInArrow(
        run, "side string, row int, values array<double>"
    )
    sums = parts.groupBy("side", "row").agg(
        F.array(*[F.sum(F.get("values", F.lit(i))) for i in range(width)]).alias("values")
    )
    found = {side: np.zeros_like(table) for side, table in tables.items()}
    for row in sums.collect():
        found[row.side][row.row] = row["values"]
    return found


def trained(state: pa.Table, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], tables: dict[str, np.ndarray], slope: Slope,
            lr: float, l2: float, epochs: int) -> pa.Table:
    """Vectors with their bias components after so many epochs over all pairs, and the summed losses."""
    width, n, history = tables["a"].shape[1], len(pairs[2]), []
    tables, freqs, vectors, own = dict(tables), {}, {}, {"a": width, "b": width + 1}
    for side in SIDES:
        part = state.filter(pc.equal(state.column("side"), side)).combine_chunks()
        no = part.column("no").to_numpy()
        freqs[side] = np.zeros((no.max() + 1, len(tables[side])))
        for batch in part.to_batches():
            at = batch.column("no").to_numpy()
            for here, row, char, freq in _entries(batch):
                freqs[side][at[here][row], char] = freq
        vectors[side] = np.ones((len(freqs[side]), width + 2))
        vectors[side][:, own[side]] = 0.0
    for epoch in range(epochs + 1):
        for side in SIDES:
            vectors[side][:, :width] = freqs[side] @ tables[side]
        if epoch == epochs:
            return as_rows(vectors, pairs, history)
        sums, total = summed_slopes(vectors, pairs, slope)
        history.append(total)
        for side in SIDES:
            bias = vectors[side][:, own[side]]
            vectors[side][:, own[side]] = bias - lr * (sums[side][:, own[side]] / n + l2 * bias)
            tables[side] = tables[side] - lr * (freqs[side].T @ (sums[side][:, :width] / n) + l2 * tables[side])


def cross_entropy_slope(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-np.clip(score, -SCORE_BOUND, SCORE_BOUND)))
    safe = np.clip(p, 1e-8, 1.0 - 1e-8)
    return p - y, -(y * np.log(safe) + (1.0 - y) * np.log(1.0 - safe))


def predict(data: PairData, targets: DataFrame | None = None, config: dict | None = None) -> Prediction:
    config = config or {}
    width, epochs = max(8, int(config.get("embedding_dim", 64))), max(1, int(config.get("epochs", 30)))
    lr, l2 = max(1e-6, float(config.get("lr", 0.05))), max(0.0, float(config.get("l2", 1e-5)))
    seed = int(config.get("seed", 42))
    given = {"a": config.get("max_drug_len"), "b": config.get("max_target_len")}
    lengths = {side: None if n is None else max(8, int(n)) for side, n in given.items()}
    cells = target_cells(data, targets)
    train = data.train.select("a", "b", "y")
    facts = train.agg(
        F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"),
        F.every(F.col("y").isin(0.0, 1.0)).alias("binary"),
    ).first()
    if not facts.n:
        return Prediction(cells.withColumn("y_hat", F.lit(0.0)))
    shift, scale = (0.0, 1.0) if facts.binary else (facts.mean, facts.std + 1e-8)
    train = cut_lineage(train.withColumn("y", (F.col("y") - shift) / scale))
    slope = cross_entropy_slope if facts.binary else squared_slope

    state, tables = None, {}
    for side, entities in zip(SIDES, (data.left, data.right)):
        frequencies, size = char_frequencies(entities, lengths[side])
        tables[side] = np.array(gaussian_matrix(seed, f"chars-{side}", size + 1, width)) * INITIAL_SCALE
        part = frequencies.select(F.lit(side).alias("side"), "key", "ids", "freqs", F.lit(0.0).alias("bias"))
        state = part if state is None else state.unionByName(part)
    dealt = DealtPairs.deal(data, train, width=width + 2)
    state = cut_lineage(state.join(dealt.nodes, ["side", "key"]))

    entries = max(int(dealt.largest_block) * len(t) for t in tables.values())
    if dealt.in_one_task and entries <= NUMBERS:
        run = lambda entities, pairs: trained(entities, pairs, tables, slope, lr, l2, epochs)
        found = dealt.in_the_cell(state.select("side", "no", "ids", "freqs"), run)
        found = cut_lineage(state.select("side", "key", "block", "no").join(found, ["side", "block", "no"]))
        history, vectors = loss_curve(found, facts.n), found.select("side", "key", "vec")
    else:
        history = []
        for _ in range(epochs):
            last, vectors = state, cut_lineage(pooled_vectors(state, tables))
            grads = dealt.gradients(vectors, width + 2, slope).withColumn(
                "grad", F.transform("grad", lambda g: g / F.lit(float(facts.n)))
            )
            at = F.when(F.col("side") == "a", width).otherwise(width + 1)
            bias_slope = F.coalesce(F.get("grad", at), F.lit(0.0)) + F.lit(l2) * F.col("bias")
            state = cut_lineage(
                state.select("side", "key", "block", "no", "ids", "freqs", "bias").join(grads, ["side", "block", "no"], "left")
                .withColumn("bias", F.col("bias") - F.lit(lr) * bias_slope)
            )
            for done in (last, vectors):
                forget(done)
            history.append(state.agg(F.sum("loss")).first()[0] / facts.n)
            slopes = table_gradients(state, tables)
            tables = {s: tables[s] - lr * (slopes[s] + l2 * tables[s]) for s in SIDES}
        vectors = cut_lineage(pooled_vectors(state, tables))
    dealt.forget()
    score = sigmoid(F.col("dot")) if facts.binary else F.col("dot") * F.lit(scale) + F.lit(shift)
    scored = with_dots(cells, vectors)
    return Prediction(scored.select("a", "b", score.alias("y_hat")), history)
