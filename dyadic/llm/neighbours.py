"""Approximate nearest neighbours with robust-pruned directed graphs, one per shard.

Vectors are dealt to shards of about ``shard_size`` by a hash. A shard's graph grows in batches: a greedy beam search
from the medoid proposes neighbours of each new vector, robust pruning keeps an edge only if no kept neighbour is nearer
to it by the factor ``alpha``, and reverse edges are added and pruned alike. Queries go to every shard in groups, search
it with a beam, and the best of all shards are merged. Scores are recomputed in double precision on the original vectors.

Memory of a task: one shard and one group of queries. Equal vectors become one point that keeps its ``k + 1`` smallest
ids, which is all that ``k`` neighbours can need; so a vector shared by very many rows is one point.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
without id. Vectors of different widths are never compared. Of rows with the same id and the same vector one counts; an
id never is its own neighbour. If a query id has several vectors, the one with the smallest digest is searched. Ties go
to the smaller id. Empty tables and queries without candidates give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadic.session import cut_lineage

DEGREE, BEAM, ALPHA, SHARD_SIZE, GROUP_SIZE = 32, 64, 1.2, 8192, 4096
BATCH = 512


def beam_search(x: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best points of each query, nearest first, and their inner products; -1 fills short rows."""
    n, rows = len(queries), np.arange(len(queries))
    ids = np.full((n, beam), -1, dtype=np.int64)
    near = np.full((n, beam), -np.inf, dtype=np.float32)
    open_ = np.zeros((n, beam), dtype=bool)
    seen = np.zeros((n, len(x) + 1), dtype=bool)  # the last column stands for -1
    ids[:, 0], near[:, 0], open_[:, 0] = start, queries @ x[start], True
    seen[:, start] = seen[:, -1] = True
    active = rows
    while len(active):
        best = np.where(open_[active], near[active], -np.inf).argmax(1)
        at = ids[active, best]
        open_[active, best] = False
        new = edges[at]
        fresh = ~seen[active[:, None], new]
        seen[active[:, None], new] = True
        score = np.where(fresh, np.einsum("ird,id->ir", x[new], queries[active]), -np.inf).astype(np.float32)
        every = np.concatenate((near[active], score), 1)
        top = np.argpartition(-every, beam - 1, 1)[:, :beam]
        pick = np.arange(len(active))[:, None]
        near[active] = every[pick, top]
        ids[active] = np.concatenate((ids[active], np.where(fresh, new, -1)), 1)[pick, top]
        open_[active] = np.concatenate((open_[active], fresh), 1)[pick, top]
        active = active[open_[active].any(1)]
    order = np.argsort(-near, 1, kind="stable")
    return ids[rows[:, None], order], near[rows[:, None], order]


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse neighbours of each point among its candidates (-1 fills): nearest first, dropping what a kept one shadows."""
    bad = (candidates < 0) | (candidates == points[:, None])
    ordered = np.sort(np.where(bad, -1, candidates), 1)
    ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
    far = np.where(ordered < 0, np.inf, 2 - 2 * np.einsum("icd,id->ic", x[ordered], x[points]))
    rank = np.argsort(far, 1, kind="stable")
    pick = np.arange(len(points))
    ids, far = np.take_along_axis(ordered, rank, 1), np.take_along_axis(far, rank, 1)
    vectors = x[ids]
    between = 2 - 2 * np.einsum("icd,ied->ice", vectors, vectors, optimize=True)
    alive = ids >= 0
    kept = np.full((len(points), degree), -1, dtype=np.int64)
    for k in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        first = alive.argmax(1)
        kept[some, k] = ids[pick[some], first[some]]
        alive &= alpha * alpha * between[pick, first] > far
        alive[pick, first] = False
    return kept


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Edges (row of ids per point, -1 fills) and the start point of the graph of unit vectors ``x``."""
    n = len(x)
    edges = np.full((n, degree), -1, dtype=np.int64)
    start = int((x @ x.mean(0)).argmax())
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate(([start], order[order != start]))
    done = 1
    while done < n:
        batch = order[done: done + min(done, BATCH)]
        done += len(batch)
        proposed, _ = beam_search(x, edges, start, x[batch], beam)
        # vectors of one batch cannot find each other in the graph, so they propose themselves too
        own = x[batch] @ x[batch].T
        mates = batch[np.argsort(-own, 1)[:, : min(9, len(batch))]]
        edges[batch] = robust_prune(x, batch, np.concatenate((proposed, mates), 1), degree, alpha)
        _link_back(x, edges, batch, degree, alpha)
    return edges, start


def _link_back(x: np.ndarray, edges: np.ndarray, batch: np.ndarray, degree: int, alpha: float) -> None:
    """Add the reverse of the batch's edges, ``degree`` at a time for each point, and prune what grows too long."""
    to, of = edges[batch].ravel(), np.repeat(batch, degree)
    ok = to >= 0
    order = np.argsort(to[ok], kind="stable")
    to, of = to[ok][order], of[ok][order]
    place = np.arange(len(to)) - np.searchsorted(to, to)
    for round_ in range(0, int(place.max(initial=-1)) + 1, degree):
        now = (place >= round_) & (place < round_ + degree)
        points, row = np.unique(to[now], return_inverse=True)
        more = np.full((len(points), degree), -1, dtype=np.int64)
        more[row, place[now] - round_] = of[now]
        both = np.concatenate((edges[points], more), 1)
        for a in range(0, len(points), BATCH):
            edges[points[a: a + BATCH]] = robust_prune(x, points[a: a + BATCH], both[a: a + BATCH], degree, alpha)


def _unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    full = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    return full, (full / np.linalg.norm(full, axis=1)[:, None]).astype(np.float32)


def usable(vector: Column) -> Column:
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda v: v != 0)


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", degree: int = DEGREE,
    beam: int = BEAM, alpha: float = ALPHA, shard_size: int = SHARD_SIZE, group_size: int = GROUP_SIZE,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for the rows of ``vectors`` that ``is_query`` (on column ``id``) picks."""
    rows = vectors.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), is_query.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("h", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    smallest = Window.partitionBy("h", "h2").orderBy("id")
    # repeated rows go first, so that the limit counts ids; it is applied before the shuffle too, so a very common vector sends few rows
    names = rows.select("id", "h", "h2").distinct().withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
    names = names.groupBy("h", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    points = cut_lineage(rows.groupBy("h", "h2").agg(F.first("v").alias("v")).join(names, ["h", "h2"]))
    first = Window.partitionBy("id").orderBy("h", "h2")
    queries = rows.where("q").withColumn("n", F.row_number().over(first)).where("n = 1").select("id", "v", "h")
    queries = cut_lineage(queries)
    shards = max(1, math.ceil(points.count() / shard_size))
    groups = max(1, math.ceil(queries.count() / group_size))
    points = points.withColumn("shard", F.pmod("h2", F.lit(shards)).cast("int")).withColumn("width", F.size("v"))
    graph_type = "shard int, width int, start int, edges binary, ids array<array<long>>, vectors binary"

    def build(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["h", "h2"])
        full, unit = _unit(list(frame.v))
        edges, start = build_graph(unit, degree, beam, alpha)
        return pd.DataFrame({"shard": [key[0]], "width": [key[1]], "start": [start], "edges": [edges.astype(np.int32).tobytes()],
                             "ids": [[list(i) for i in frame.ids]], "vectors": [full.tobytes()]})

    graphs = cut_lineage(points.groupBy("shard", "width").applyInPandas(build, graph_type))
    graphs = graphs.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = queries.select(
        "id", "v", F.size("v").alias("width"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def search(graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(graph) and len(asked):
            g = graph.iloc[0]
            full = np.frombuffer(g.vectors).reshape(-1, int(g.width))
            norms = np.linalg.norm(full, axis=1)
            unit = (full / norms[:, None]).astype(np.float32)
            edges = np.frombuffer(g.edges, dtype=np.int32).reshape(len(full), degree).astype(np.int64)
            wanted, asked_unit = _unit(list(asked.v))
            names = asked.id.to_numpy()
            for a in range(0, len(names), BATCH):
                found, _ = beam_search(unit, edges, int(g.start), asked_unit[a: a + BATCH], beam)
                for name, q, near in zip(names[a: a + BATCH], wanted[a: a + BATCH], found, strict=True):
                    near = near[near >= 0]
                    scores = (full[near] @ q) / (norms[near] * np.linalg.norm(q))
                    pairs = sorted((-s, int(i)) for s, p in zip(scores, near, strict=True) for i in g.ids[p] if i != name)
                    nearest = {}  # an id with several vectors counts once, by its nearest
                    for s, i in pairs:
                        nearest.setdefault(i, -s)
                    out += [(name, i, s) for i, s in list(nearest.items())[: k + 1]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    keys = ["shard", "width", "group"]
    found = graphs.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
