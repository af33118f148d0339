"""Whole texts as word arrays inside Arrow tasks: splitting, 64-bit word hashes, hashes of word ranges.

A task handles its rows in pieces of a few megabytes of text, so memory follows the piece (or the one longest
text), not the partition. Bytes are split, never code points: every separator of the contracts is one ASCII byte,
and UTF-8 uses no ASCII byte inside other characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE_BYTES = 2 << 20
HASH_BLOCK = 1 << 18
UPPER = bytes(range(0x41, 0x5B))
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"

#: Byte maps: every separator becomes a space.
SPACED = bytes.maketrans(WHITE, b" " * 6)
SPACED_LOWER = bytes.maketrans(WHITE + UPPER, b" " * 6 + UPPER.lower())
_other = bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))
ALNUM_LOWER = bytes.maketrans(_other + UPPER, b" " * len(_other) + UPPER.lower())

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**64, 256, dtype=np.uint64)
_ONE = np.uint64(1)


def odd_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and their inverses."""
    inverse = pow(base, -1, 2**64)
    out = []
    for b in (base, inverse):
        steps = np.full(n, b, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


BYTE_BASE, WORD_BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``odd_powers``, kept between pieces and grown in steps."""
    if base not in _powers or len(_powers[base][0]) < n:
        _powers[base] = odd_powers(base, 1 << max(16, int(n - 1).bit_length()))
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of several texts, end to end. ``first[i]:first[i + 1]`` are the words of text ``i``."""

    def __init__(self, texts: list[bytes | None], table: bytes):
        joined = b" " + b" ".join(t or b"" for t in texts).translate(table) + b" "
        self.bytes = joined
        letters = np.frombuffer(joined, dtype=np.uint8) != 32
        edges = np.flatnonzero(letters[1:] != letters[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        begins = np.cumsum([1] + [len(t or b"") + 1 for t in texts])
        self.first = np.searchsorted(self.starts, begins)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word, from sums of random byte values times powers."""
        out = np.empty(len(self), dtype=np.uint64)
        data = np.frombuffer(self.bytes, dtype=np.uint8)
        at = 0
        while at < len(self):
            low = int(self.starts[at])
            to = max(at + 1, int(np.searchsorted(self.ends, low + HASH_BLOCK, side="right")))
            high = int(self.ends[to - 1])
            up, down = powers(BYTE_BASE, high - low)
            sums = np.zeros(high - low + 1, dtype=np.uint64)
            np.cumsum(_BYTE[data[low:high]] * up[: high - low], out=sums[1:])
            s, e = self.starts[at:to] - low, self.ends[at:to] - low
            out[at:to] = (sums[e] - sums[s]) * down[s]
            at = to
        return mix(out)


def range_sums(hashes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums for ``range_hash``."""
    up, down = powers(base, max(1, len(hashes)) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return sums, down


def range_hash(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the word ranges ``start:end``; equal word sequences have equal hashes wherever they stand."""
    total, down = sums
    return mix((total[end] - total[start]) * down[start])


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(sizes):
        return
    slot = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Consecutive runs of ``values`` as lists of the given lengths."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def map_texts(docs: DataFrame, keep: list[str], found: T.StructType, work: Callable, text: str = "text") -> DataFrame:
    """Run ``work(texts) -> arrays`` over pieces of ``docs``; returns columns ``row`` (the kept ones) and ``found``.

    ``texts`` is a list of UTF-8 bytes or None. Both outputs are structs, so names of the caller's columns cannot
    clash with the names of the results.
    """
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
                         F.col(f"`{text}`").cast("binary").alias("text"))
    schema = T.StructType([source.schema["row"], T.StructField("found", found)])
    names = found.names

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                arrays = work(piece.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("row"), pa.StructArray.from_arrays(arrays, names)], ["row", "found"])

    return source.mapInArrow(run, schema)
