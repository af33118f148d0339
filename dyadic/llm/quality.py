"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are counts of character classes and word statistics of the line itself and of
the lines before and after it; transitions tie neighbouring labels. Lines of a labelled document carry its label in
training. The score of a document is the mean of the lines' forward-backward marginals, weighted by line length.

Training: labelled documents chosen by digest order, at most ``train_docs`` of them, among those with at most
``train_lines`` lines; their features (about 15 numbers a line) are collected and the weights fitted by gradient
ascent. The bound is independent of the table. Scoring is row-local: no shuffle, whole texts, long ones included.

Defined cases: a null text is an empty one; an empty text is one empty line. A document whose labels contradict each
other is not used. If the labels hold one class only, every score is that class, and without labels it is 1. Repeated
rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadic.llm.words import map_texts, mix, range_hash, range_sums

TRAIN_DOCS, TRAIN_LINES, STEPS = 4000, 256, 250
LETTER, UPPER, DIGIT, SPACE, STOP, SYMBOL, WIDE = range(7)

_CLASS = np.full(256, SYMBOL, dtype=np.uint8)
_CLASS[0x61:0x7B] = LETTER
_CLASS[0x41:0x5B] = UPPER
_CLASS[0x30:0x3A] = DIGIT
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = SPACE
_CLASS[[ord(c) for c in ".,;:'\"()?-"]] = STOP
_CLASS[0x80:] = WIDE
LINE_FEATURES = 14


def line_features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x LINE_FEATURES), bytes of each line and lines of each text."""
    data = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = (ends - starts).astype(np.float64)
    text_ends = np.cumsum([len(t or b"") + 1 for t in texts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(ends, text_ends))))
    kind = _CLASS[data]
    newline = data == 10
    blank = (kind == SPACE) | newline
    first = ~blank & np.concatenate(([True], blank[:-1]))
    word_at = np.flatnonzero(first)
    word_end = np.flatnonzero(~blank & np.concatenate((blank[1:], [True]))) + 1

    def per_line(marks: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(marks)
        return np.diff(np.searchsorted(at, np.concatenate((starts, [len(data)])))).astype(np.float64)

    share = lambda n, of: n / np.maximum(of, 1)
    words = per_line(first)
    letters, upper, digits, stops, symbols, wide = (per_line(kind == k) - (k == SYMBOL) for k in (LETTER, UPPER, DIGIT, STOP, SYMBOL, WIDE))
    # words: ends in a symbol, all symbols, equal to one of the two words before in the line
    tails = np.zeros(len(data), dtype=bool)
    tails[word_at[kind[word_end - 1] == SYMBOL]] = True
    alone = np.zeros(len(data), dtype=bool)
    alone[word_at[(word_end - word_at == 1) & (kind[word_at] == SYMBOL)]] = True
    line_of = np.searchsorted(ends, word_at)
    hashes = _ranges(data, word_at, word_end)
    again = np.zeros(len(word_at), dtype=bool)
    for back in (1, 2):
        again[back:] |= (hashes[back:] == hashes[:-back]) & (line_of[back:] == line_of[:-back])
    repeats = np.zeros(len(data), dtype=bool)
    repeats[word_at[again]] = True
    lines = _ranges(data, starts, ends)
    same = np.zeros(len(starts))
    same[1:] = (lines[1:] == lines[:-1]) & (size[1:] > 0)
    same[np.concatenate(([0], np.cumsum(counts)[:-1]))] = 0
    x = np.stack([
        share(letters + wide, size), share(upper, size), share(digits, size), share(stops, size), share(symbols, size),
        share(per_line(tails), words), share(per_line(alone), words), share(per_line(repeats), words),
        np.minimum(share(letters + upper + wide, words) / 8, 3), np.log1p(size) / 6, np.log1p(words) / 5, same,
        (size == 0).astype(np.float64), share(wide, size),
    ], 1)
    return x, size, counts


def _ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """Hashes of byte ranges in ascending order."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + block, side="right")))
        high = int(ends[to - 1])
        sums = range_sums(mix(data[low:high].astype(np.uint64) + np.uint64(1)), 0x9E3779B97F4A7C15)
        out[at:to] = range_hash(sums, starts[at:to] - low, ends[at:to] - low)
        at = to
    return out


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Features of each line, the line before and the line after, with marks for the first and last line."""
    n = len(x)
    first, last = np.zeros((n, 1)), np.zeros((n, 1))
    ends = np.cumsum(counts)
    first[ends - counts], last[ends - 1] = 1, 1
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    return np.concatenate((x, before * (1 - first), after * (1 - last), first, last), 1)


@dataclass
class ChainModel:
    """``constant`` is the score of all documents if nothing could be learnt."""

    weights: np.ndarray
    bias: float
    turns: np.ndarray  # scores of (label before, label)
    constant: float | None = None

    def marginals(self, x: np.ndarray, counts: np.ndarray, pairs: bool = False):
        """Probability of good for each line; with ``pairs`` also the expected number of each transition."""
        own = x @ self.weights + self.bias
        order = np.argsort(-counts, kind="stable")
        begins = (np.cumsum(counts) - counts)[order]
        sizes = counts[order]
        longest = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts with a line t
        up = np.exp(self.turns - self.turns.max())
        good = _sigmoid(own)
        potential = np.stack((1 - good, good), 1)
        ahead, back = np.empty_like(potential), np.ones_like(potential)
        for t in range(longest):
            at = begins[: active[t]] + t
            a = potential[at] if t == 0 else potential[at] * (ahead[at - 1] @ up)
            ahead[at] = a / a.sum(1, keepdims=True)
        expected = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            at = begins[: active[t + 1]] + t
            b = (potential[at + 1] * back[at + 1]) @ up.T
            if pairs:
                joint = ahead[at][:, :, None] * up * (potential[at + 1] * back[at + 1])[:, None, :]
                expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            back[at] = b / b.sum(1, keepdims=True)
        p = ahead * back
        p = p[:, 1] / np.maximum(p.sum(1), 1e-300)
        return (p, expected) if pairs else p

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x, size, counts = line_features(texts)
        p = self.marginals(with_neighbours(x, counts), counts)
        begins = np.cumsum(counts) - counts
        return np.clip(np.add.reduceat(p * (size + 1), begins) / np.add.reduceat(size + 1, begins), 0, 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int = STEPS, penalty: float = 1e-3) -> ChainModel:
    """Maximise the penalised likelihood of the chains by Adam."""
    y = np.repeat(labels, counts).astype(np.float64)
    observed = np.zeros((2, 2))
    for c in (0, 1):
        observed[c, c] = (counts[labels == c] - 1).sum()
    n, width = len(x), x.shape[1]
    theta, m, v = np.zeros(width + 5), np.zeros(width + 5), np.zeros(width + 5)
    for step in range(1, steps + 1):
        model = ChainModel(theta[:width], theta[width], theta[width + 1:].reshape(2, 2))
        p, expected = model.marginals(x, counts, pairs=True)
        gradient = np.concatenate((x.T @ (y - p), [(y - p).sum()], (observed - expected).ravel())) / n - penalty * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return ChainModel(theta[:width], float(theta[width]), theta[width + 1:].reshape(2, 2))


def held_out(id: str) -> Column:
    return F.crc32(F.col(f"`{id}`").cast("string").cast("binary")) % 4 == 2


def train(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
    train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES,
) -> ChainModel:
    """Fit the field on a bounded sample of the labelled documents that are not held out."""
    known = labels.select(F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.where(~F.coalesce(held_out("id"), F.lit(False))).groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("high"))
    known = known.where("label = high").select("id", "label", F.md5(F.col("id").cast("string")).alias("order"))
    sample = F.broadcast(known.orderBy("order").limit(train_docs))  # at most ``train_docs`` rows
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.join(sample, "id").where(F.length("text") - F.length(F.replace("text", F.lit("\n"))) < train_lines)
    found = T.StructType([T.StructField("x", T.BinaryType())])

    def work(texts):
        x, _, counts = line_features(texts)
        cuts = np.cumsum(counts)
        return [pa.array([x[b - c: b].tobytes() for b, c in zip(cuts, counts, strict=True)], pa.binary())]

    got = map_texts(rows, ["order", "label"], found, work).groupBy("row.order", "row.label").agg(F.min("found.x").alias("x")).collect()
    got = sorted((r["order"], r["label"], bytes(r["x"])) for r in got)
    y = np.array([g[1] for g in got], dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return ChainModel(np.zeros(0), 0.0, np.zeros((2, 2)), float(y[0]) if len(y) else 1.0)
    parts = [np.frombuffer(g[2]).reshape(-1, LINE_FEATURES) for g in got]
    counts = np.array([len(p) for p in parts])
    return fit(with_neighbours(np.concatenate(parts), counts), counts, y)


def score_quality(docs: DataFrame, model: ChainModel, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``row`` (the kept ones) and ``found.score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some fifty numbers
    found = T.StructType([T.StructField("score", T.DoubleType())])
    return map_texts(docs, keep, found, lambda texts: [pa.array(shared.value.scores(texts), pa.float64())], text)
