"""Seeded, engine-independent randomness.

Every random choice (fold membership, sampling, masking, initial factors) is a function of
``md5(seed|key)``. The value belongs to the row and not to the partition that happens to hold it, so a
recomputed task or a different cluster size yields the same answer, and any SQL engine with md5 can check it.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = 4294967296.0  # 2**32, the range of eight hex digits


def seeded_digest(seed: int, *keys: Column | str) -> Column:
    """md5 of ``seed|key1|key2...`` as 32 hex digits; its order is a random permutation of the keys."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def digest_number(digest: Column, start: int, width: int) -> Column:
    """``width`` hex digits of a digest, from the 1-based position ``start``, as a bigint."""
    return F.conv(F.substring(digest, start, width), 16, 10).cast("bigint")


def uniform(digest: Column, start: int = 1) -> Column:
    """Uniform in [0, 1) from eight hex digits."""
    return digest_number(digest, start, 8) / F.lit(_SPAN)


def gaussian(digest: Column) -> Column:
    """Standard normal by Box-Muller from the first sixteen hex digits."""
    radius = F.sqrt(F.lit(-2.0) * F.log((digest_number(digest, 1, 8) + F.lit(1)) / F.lit(_SPAN)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(digest, 9))


def gaussian_vector(seed: int, key: Column | str, width: int, scale: float, tag: str) -> Column:
    """Array of ``width`` independent normals for one key, multiplied by ``scale``."""
    key = F.col(key) if isinstance(key, str) else key
    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: gaussian(seeded_digest(seed, F.lit(tag), key, i)) * F.lit(scale),
    )


def gaussian_matrix(seed: int, tag: str, rows: int, cols: int) -> list[list[float]]:
    """Small constant matrix on the driver; entry (i, j) equals element j of :func:`gaussian_vector` of key i."""

    def entry(i: int, j: int) -> float:
        digest = hashlib.md5(f"{seed}|{tag}|{i}|{j}".encode()).hexdigest()
        low, high = int(digest[:8], 16), int(digest[8:16], 16)
        return math.sqrt(-2.0 * math.log((low + 1) / _SPAN)) * math.cos(2.0 * math.pi * (high / _SPAN))

    return [[entry(i, j) for j in range(cols)] for i in range(rows)]
