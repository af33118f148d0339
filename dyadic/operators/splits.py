"""Exact-size train/test splits as row-local predicates.

The permutation of pairs (or of the entities of one side) is the order of their seeded digests. Once the digest
at the cut is known, the fold of a row follows from its own key: no sort, no join with a held-out set, no
shuffle of the pair table, and no trouble with an entity that holds a third of all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadic.functions.hashing import seeded_digest
from dyadic.functions.numeric import is_finite
from dyadic.operators.ordering import permutation_cutoffs, round_half_even

# Strategy names and the columns they permute.
STRATEGIES = {"random": ["a", "b"], "cold_drug": ["a"], "cold_target": ["b"]}


def held_out_count(n: int, ratio: float) -> int:
    return max(1, round_half_even(n * ratio))


def split_pairs(pairs: DataFrame, strategy: str = "random", test_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Known pairs with a ``fold`` column; the last part of the permutation is the test fold."""
    if not 0.0 < float(test_ratio) < 1.0:
        raise ValueError(f"test_ratio must lie strictly between 0 and 1, got {test_ratio}")
    name = str(strategy).strip().lower()
    if name not in STRATEGIES:
        raise ValueError(f"unknown split strategy {strategy!r}; choose one of {sorted(STRATEGIES)}")
    keys = STRATEGIES[name]
    known = pairs.where(is_finite("y"))
    subjects = known.select(*keys) if len(keys) == 2 else known.select(*keys).distinct()
    n, cut = permutation_cutoffs(subjects, keys, seed, lambda n: [n - held_out_count(n, test_ratio)])
    if not cut:  # nothing known, or everything is held out
        return known.withColumn("fold", F.lit("test"))
    return known.withColumn(
        "fold", F.when(seeded_digest(seed, *keys) <= F.lit(cut[0]), "train").otherwise("test")
    )


def sample_exact(rows: DataFrame, keys: list[str], cap: int, seed: int) -> DataFrame:
    """Exactly ``min(cap, n)`` rows without replacement (``keys`` identify a row)."""
    _, cut = permutation_cutoffs(rows, keys, seed, lambda n: [min(cap, n)] if n > cap else [])
    return rows.where(seeded_digest(seed, *keys) <= F.lit(cut[0])) if cut else rows


def assign_environments(rows: DataFrame, key: str, n_envs: int, seed: int, out: str = "env") -> DataFrame:
    """Equal-sized random environments over the distinct keys, the first ones one larger when uneven.

    Dealing a shuffled list round-robin and cutting it into consecutive slices give the same distribution of
    equal-sized groups; slices need only ``n_envs - 1`` digests.
    """

    def slice_ends(n: int) -> list[int]:
        size, extra = divmod(n, n_envs)
        ends = [size * (i + 1) + min(extra, i + 1) for i in range(n_envs - 1)]
        return sorted({e for e in ends if 0 < e < n})

    _, cuts = permutation_cutoffs(rows.select(key).distinct(), [key], seed, slice_ends)
    digest = seeded_digest(seed, key)
    env = F.lit(0)
    for cut in cuts:
        env = env + F.when(digest > F.lit(cut), 1).otherwise(0)
    return rows.withColumn(out, env)
