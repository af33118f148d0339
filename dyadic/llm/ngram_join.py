"""N-gram Jaccard join with trees of count vectors.

A document is its set of distinct word n-grams. Hashing the n-grams into groups makes it a point of group counts, and
the sum over groups of the smaller count bounds the overlap of two documents. Boxes of points are bounded the same way
(by the minima of their upper corners), so a tree of boxes is searched before points, and points before sets.

A tree over all documents cannot prune enough alone (random documents of one size lie close together in every few
coordinates), so documents are routed to many trees:

1. A sketch of n-gram counts of fixed size ranks n-grams from rare to frequent. Documents that link share an n-gram in
   the rarest quarter of their sets (for 75 per cent), whatever the ranking; so buckets of these n-grams hold every link.
2. In each bucket the points whose bound allows a link are connected (a forest, never all pairs). N-grams that the
   sketch shows to be very frequent are salted and connect their documents through leaders.
3. The components of that graph are handed to tasks in blocks of bounded size. A task builds a tree over the points of
   a block, verifies surviving pairs of different classes on the sets themselves and joins classes. Components of several
   blocks are cut twice by different hashes; then every document outside the main class meets all blocks.

Equal sets are one point throughout. Texts are read three times and never shuffled; every step passes hashes.

Defined cases: null and empty texts and texts without words have empty sets and link with nothing. With fewer words
than ``size`` the whole sequence is the only n-gram. Rows equal in id and text are alike. Null ids take part; a class
is named by its smallest id, null if it has none. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadic.llm.components import components
from dyadic.llm.words import SPACED_LOWER, WORD_BASE, Words, mix, pieces, range_hash, range_sums
from dyadic.session import cut_lineage

SKETCH_BITS = 21
SKETCH = 1 << SKETCH_BITS
BITMAP_BUCKETS = 2048  # of 32768 bits: 8 MB
LEAST_GROUPS = 32
FREQUENT = 512  # estimated documents from which an n-gram is salted
SALTS = 64
BLOCK_DOCS, BLOCK_TOKENS, LEAF = 512, 400_000, 32


def ngram_sets(texts: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of the texts end to end, sorted inside each, and their number per text."""
    words = Words(texts, SPACED_LOWER)
    counts = words.counts
    sums = range_sums(words.hashes(), WORD_BASE)
    per_text = np.where(counts == 0, 0, np.maximum(1, counts - size + 1))
    owner = np.repeat(np.arange(len(counts)), per_text)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text) + words.first[:-1][owner]
    end = np.minimum(start + size, words.first[1:][owner])
    # the number of words is part of the hash, so a short sequence never equals a part of a longer one
    grams = mix(range_hash(sums, start, end) + (end - start).astype(np.uint64))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.bincount(owner[new], minlength=len(counts))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, dtype=values.dtype), np.cumsum(values, dtype=values.dtype)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def digests(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64-bit digest of each set; 0 for empty ones."""
    out = mix(_sums(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), counts) + counts.astype(np.uint64))
    return np.where(counts == 0, 0, out).astype(np.uint64).view(np.int64)


def group_number(n: np.ndarray) -> np.ndarray:
    """Groups of a set of ``n`` n-grams: a power of two near a quarter of it, so that a count vector tells sets of any size
    apart. Sets that may link differ by one step at most."""
    return 1 << np.maximum(LEAST_GROUPS.bit_length() - 1, np.floor(np.log2(np.maximum(n, 1))).astype(np.int64) - 2)


def count_vectors(grams: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Group counts of each set. The groups are the low bits of the hashes, so halves of a vector add up to fewer groups."""
    width = group_number(counts)
    begins = np.cumsum(width) - width
    owner = np.repeat(np.arange(len(counts)), counts)
    slot = begins[owner] + (grams & (width[owner] - 1).astype(np.uint64)).astype(np.int64)
    flat = np.bincount(slot, minlength=int(width.sum())).astype(np.int32)
    return np.split(flat, begins[1:]) if len(counts) else []


def coded(vector: np.ndarray) -> bytes:
    """One byte a count where all fit, else four; the first byte tells which."""
    return b"\1" + vector.astype(np.uint8).tobytes() if vector.max(initial=0) < 256 else b"\4" + vector.tobytes()


def decoded(vector: bytes) -> np.ndarray:
    return np.frombuffer(vector, dtype=np.uint8 if vector[0] == 1 else np.int32, offset=1).astype(np.int32)


def may_link(bound: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return bound * (100 + percent) >= percent * (a + b)


def links(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


class Classes:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def of(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.of(i), self.of(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


class PointTree:
    """Boxes of points sorted by size and then by their largest groups; ``order[leaf]`` are the points of a leaf."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, leaf: int = LEAF):
        self.vectors, self.sizes = vectors, sizes
        slab = leaf * max(1, math.isqrt(max(1, len(sizes) // leaf)))
        by_size = np.argsort(sizes, kind="stable")
        tile = np.empty(len(sizes), dtype=np.int64)
        tile[by_size] = np.arange(len(sizes)) // slab
        order = np.lexsort((sizes, vectors[:, 0] if len(vectors) else sizes, tile))
        self.leaves = [order[i: i + leaf] for i in range(0, len(order), leaf)]
        self.high = np.array([vectors[x].max(0) for x in self.leaves]).reshape(len(self.leaves), -1)
        self.least = np.array([sizes[x].min() for x in self.leaves], dtype=np.int64)

    def near_leaves(self, vector_or_box: np.ndarray, size: int, percent: int) -> np.ndarray:
        bound = np.minimum(self.high, vector_or_box).sum(1)
        return np.flatnonzero(may_link(bound, self.least, size, percent))

    def near_points(self, i: int, leaf: int, percent: int) -> np.ndarray:
        at = self.leaves[leaf]
        bound = np.minimum(self.vectors[at], self.vectors[i]).sum(1)
        return at[may_link(bound, self.sizes[at], self.sizes[i], percent)]


class Forest:
    """Trees of the points of one block, one for each number of groups, with the points of the next number folded in."""

    def __init__(self, vectors: list[np.ndarray], percent: int, sizes: np.ndarray):
        self.percent, self.sizes, self.vectors = percent, sizes, vectors
        self.width = np.array([len(v) for v in vectors])
        self.trees: dict[int, tuple[np.ndarray, np.ndarray, PointTree]] = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero((self.width == w) | (self.width == 2 * w))
            rows = np.array([self.folded(i, w) for i in at.tolist()])
            place = np.full(len(vectors), -1)
            place[at] = np.arange(len(at))
            self.trees[w] = (at, place, PointTree(rows, sizes[at]))

    def folded(self, i: int, width: int) -> np.ndarray:
        return self.vectors[i].reshape(-1, width).sum(0)

    def near(self, i: int, both_ways: bool = False) -> list[int]:
        """Points that may link with ``i``; without ``both_ways`` those of fewer groups, which find ``i``, are left out."""
        found: list[int] = []
        own = int(self.width[i])
        for w in (own, own // 2) if both_ways else (own,):
            if w in self.trees:
                at, place, tree = self.trees[w]
                k = int(place[i])
                for leaf in tree.near_leaves(tree.vectors[k], int(self.sizes[i]), self.percent).tolist():
                    found += at[tree.near_points(k, leaf, self.percent)].tolist()
        return found


def join_block(sets: list[np.ndarray], labels: list[int], percent: int, asked: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join the classes of a block; pairs inside one class are not verified. ``asked``: only these search."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    forest = Forest(count_vectors(np.concatenate(sets), sizes), percent, sizes)
    classes, seen, found = Classes(len(sets)), {}, []
    for i, label in enumerate(labels):
        classes.join(seen.setdefault(label, i), i)
    for i in range(len(sets)) if asked is None else asked:
        for j in forest.near(i, asked is not None):
            if classes.of(i) != classes.of(j):
                a, b = sets[i], sets[j]
                at = np.searchsorted(a, b)
                common = int((a[np.minimum(at, len(a) - 1)] == b).sum())
                if links(common, len(a), len(b), percent):
                    classes.join(i, j)
                    found.append((i, j))
    return found


def _points(docs: DataFrame, keep: list[str], text: str, size: int) -> tuple[DataFrame, np.ndarray]:
    """Table (row, tag, d, n, vector) and the sketch, from one scan."""
    source = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.xxhash64(F.col(f"`{text}`")).alias("tag"),
        F.col(f"`{text}`").cast("binary").alias("text"))
    point = T.StructType([T.StructField("tag", T.LongType()), T.StructField("d", T.LongType()), T.StructField("n", T.LongType()), T.StructField("vector", T.BinaryType())])
    schema = T.StructType([T.StructField("row", source.schema["row"].dataType), T.StructField("point", point), T.StructField("sketch", T.BinaryType())])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        sketch = np.zeros(SKETCH, dtype=np.uint32)
        row_type = None
        for batch in batches:
            row_type = batch.column("row").type
            for piece in pieces(batch):
                grams, counts = ngram_sets(piece.column("text").to_pylist(), size)
                sketch += np.bincount((grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
                vectors = pa.array([coded(v) for v in count_vectors(grams, counts)], pa.binary())
                found = pa.StructArray.from_arrays([piece.column("tag"), pa.array(digests(grams, counts)), pa.array(counts, pa.int64()), vectors], point.names)
                yield pa.RecordBatch.from_arrays([piece.column("row"), found, pa.nulls(len(counts), pa.binary())], schema.names)
        if row_type is not None:
            nothing = pa.struct(list(zip(point.names, kinds, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, row_type), pa.nulls(1, nothing), pa.array([zlib.compress(sketch.tobytes(), 1)], pa.binary())], schema.names)

    written = cut_lineage(source.mapInArrow(run, schema))

    def partial(frames):  # sums the sketches of a partition one by one
        total = np.zeros(SKETCH, dtype=np.uint64)
        for frame in frames:
            for s in frame.sketch:
                total += np.frombuffer(zlib.decompress(s), dtype=np.uint32)
        yield pd.DataFrame({"sketch": [zlib.compress(total.tobytes(), 1)]})

    sketches = written.where("sketch is not null").select("sketch").repartition(8).mapInPandas(partial, "sketch binary")
    total = np.zeros(SKETCH, dtype=np.uint64)
    for r in sketches.collect():  # eight arrays of fixed size
        total += np.frombuffer(zlib.decompress(bytes(r.sketch)), dtype=np.uint64)
    return written.where("point is not null").select("row", "point.*"), total


def frequency_ranks(sketch: np.ndarray) -> np.ndarray:
    """Rank of each sketch slot: 0 for what cannot be told from a rare n-gram, then the logarithm of the excess."""
    middle = float(np.median(sketch))
    excess = sketch.astype(np.float64) - middle
    return np.where(excess > 3 * math.sqrt(middle + 1), 1 + np.floor(np.log2(np.maximum(excess, 1))), 0).astype(np.int8)


def _first_seen(d: np.ndarray, done: set[int]) -> np.ndarray:
    """Which of the digests ``d`` are not in ``done`` yet nor earlier in ``d``; they are added to it."""
    return np.array([x not in done and not done.add(x) for x in d.tolist()], dtype=bool)


def _bucket_rows(docs: DataFrame, text: str, size: int, percent: int, ranks: np.ndarray) -> DataFrame:
    """Rows (key, d): the rarest n-grams of each document; the lowest bit of a key tells a frequent n-gram.

    Equal sets of one task count once, so groups of copies send few rows to the tasks of their n-grams.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # fixed size
    frequent = 1 + int(math.log2(FREQUENT))

    def run(batches):
        done: set[int] = set()
        for batch in batches:
            for piece in pieces(batch):
                grams, counts = ngram_sets(piece.column("text").to_pylist(), size)
                d = digests(grams, counts)
                new = _first_seen(d, done) & (counts > 0)
                grams, d, counts = grams[np.repeat(new, counts)], d[new], counts[new]
                rank = shared.value[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                owner = np.repeat(np.arange(len(counts)), counts)
                order = np.lexsort((grams, rank, owner))
                place = np.arange(len(grams)) - np.repeat(np.cumsum(counts) - counts, counts)
                prefix = counts - (counts * percent + 99) // 100 + 1
                take = order[place < prefix[owner]]
                key = (grams[take] & ~np.uint64(1)) | (rank[take] >= frequent).astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(d[owner[take]])], ["key", "d"])

    return docs.select(F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(run, "key long, d long")


def _sets_of(docs: DataFrame, text: str, size: int, wanted: DataFrame) -> DataFrame:
    """Rows (d, grams) of the documents in ``wanted`` and of few others: a bitmap of fixed size tells most others apart
    where texts are read, so that texts are not shuffled. Equal sets of one task count once."""
    spot = F.col("d").bitwiseAND(F.lit(BITMAP_BUCKETS * 32768 - 1))  # digests are hashes: their low bits will do
    bits = wanted.select(F.floor(spot / 32768).cast("int").alias("k"), (spot % 32768).alias("at")).groupBy("k").agg(F.bitmap_construct_agg("at").alias("bits"))
    bitmap = np.zeros((BITMAP_BUCKETS, 4096), dtype=np.uint8)
    for r in bits.collect():  # at most BITMAP_BUCKETS rows
        bitmap[r.k] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(bitmap.tobytes(), 1))

    def run(batches):
        held = np.frombuffer(zlib.decompress(shared.value), dtype=np.uint8)
        done: set[int] = set()  # copies in one task give one set
        for batch in batches:
            for piece in pieces(batch):
                grams, counts = ngram_sets(piece.column("text").to_pylist(), size)
                d = digests(grams, counts)
                ends = np.cumsum(counts)
                at = d & (BITMAP_BUCKETS * 32768 - 1)
                mark = (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1
                take = np.flatnonzero((mark == 1) & (counts > 0))
                take = take[_first_seen(d[take], done)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d[take]), pa.array([grams[ends[i] - counts[i]: ends[i]].tobytes() for i in take.tolist()], pa.binary())], ["d", "grams"])

    return docs.select(F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(run, "d long, grams binary")


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


def _shared_buckets(rows: DataFrame) -> DataFrame:
    """Rows (bucket, d) of buckets with several documents; buckets with the same documents count once in a partition.

    A frequent n-gram is salted, so no task gets all its documents; the salts' parts meet again through its key.
    """
    place = F.when(F.expr("key & 1") == 1, F.xxhash64("key", F.pmod("d", F.lit(SALTS)))).otherwise(F.col("key"))
    dealt = rows.repartition(place).sortWithinPartitions("key", "d")

    def run(batches):
        seen: set[int] = set()
        held = None
        for batch in _with_end(batches):
            if batch is not None:
                now = (batch.column("key").to_numpy(), batch.column("d").to_numpy())
                held = now if held is None else tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            if held is None or not len(held[0]):
                continue
            keys, ds = held
            end = len(keys) if batch is None else int(_runs(keys)[-1])
            if batch is not None and end and len(keys) < 50_000:
                continue
            held = (keys[end:], ds[end:])
            keys, ds = keys[:end], ds[:end]
            if not end:
                continue
            new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (ds[1:] != ds[:-1])))
            keys, ds = keys[new], ds[new]
            begins = _runs(keys)
            sizes = np.diff(np.concatenate((begins, [len(keys)])))
            frequent = (keys[begins] & 1) == 1
            names = np.where(frequent, keys[begins], 2 * (np.add.reduceat(mix(ds.view(np.uint64)), begins).view(np.int64) // 2))
            use = np.zeros(len(begins), dtype=bool)
            for i in np.flatnonzero((sizes > 1) | frequent).tolist():
                if frequent[i]:
                    use[i] = True
                elif (name := int(names[i])) not in seen:
                    seen.add(name)
                    use[i] = True
            mark = np.repeat(use, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, sizes)[mark]), pa.array(ds[mark])], ["bucket", "d"])

    return dealt.mapInArrow(run, "bucket long, d long")


def _with_end(batches):
    yield from batches
    yield None


def _possible_links(rows: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect, in each bucket, the points whose count vectors allow a link.

    A task joins the classes of all its buckets and returns one edge per document, to the first of its class.
    """
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "d")

    def run(batches):
        classes: dict[int, int] = {}

        def of(d: int) -> int:
            while classes.setdefault(d, d) != d:
                classes[d] = d = classes[classes[d]]
            return d

        def connect(bucket: list) -> None:
            points = {d: (n, v) for d, n, v in bucket}
            ds = list(points)
            if len(ds) > 1:
                sizes = np.array([points[d][0] for d in ds], dtype=np.int64)
                forest = Forest([decoded(points[d][1]) for d in ds], percent, sizes)
                for i, d in enumerate(ds):
                    for j in forest.near(i):
                        a, b = of(d), of(ds[j])
                        if a != b:
                            classes[max(a, b)] = min(a, b)

        at, bucket = None, []
        for batch in batches:
            for name, d, n, v in zip(*(batch.column(c).to_pylist() for c in ("bucket", "d", "n", "vector")), strict=True):
                if name != at:
                    connect(bucket)
                    at, bucket = name, []
                bucket.append((d, n, v))
        connect(bucket)
        pairs = [(of(d), d) for d in list(classes) if of(d) != d]
        for k in range(0, len(pairs), 50_000):
            part = pairs[k: k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _join_groups(rows: DataFrame, percent: int) -> DataFrame:
    """Links inside groups (g): rows (g, c, d, label, asked, grams) of one group meet in a task."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in frame.sort_values(["c", "d", "asked"], ascending=[True, True, False]).groupby("c", sort=False):
            part = part.drop_duplicates("d")
            if len(part) < 2:
                continue
            sets = [np.frombuffer(g, dtype=np.uint64) for g in part.grams]
            asked = None if part.asked.all() else np.flatnonzero(part.asked.to_numpy()).tolist()
            ds = part.d.to_numpy()
            out += [(int(ds[i]), int(ds[j])) for i, j in join_block(sets, part.label.tolist(), percent, asked)]
        return pd.DataFrame(out, columns=["a", "b"])

    return rows.groupBy("g").applyInPandas(work, "a long, b long")


def _relabel(sets: DataFrame, edges: DataFrame) -> DataFrame:
    labels = components(edges)
    return sets.drop("label").join(labels.select(F.col("node").alias("d"), "label"), "d", "left").withColumn("label", F.coalesce("label", "d"))


def jaccard_classes(
    docs: DataFrame, keep: list[str], id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75,
) -> DataFrame:
    """Columns ``row`` (the kept ones), tag (xxhash64 of the text), n (set size), class (smallest id, then null), label.

    Classes are told apart by label (null without words): unlike texts under one id can give two classes one name.
    """
    points, sketch = _points(docs, [id, *[c for c in keep if c != id]], text, size)
    rows = _bucket_rows(docs, text, size, percent, frequency_ranks(sketch))
    buckets = cut_lineage(_shared_buckets(rows))
    vectors = points.where("n > 0").groupBy("d").agg(F.first("n").alias("n"), F.first("vector").alias("vector"))
    rare = buckets.where("bucket & 1 = 0")
    light = _possible_links(rare.join(vectors, "d").select("bucket", "d", "n", "vector"), percent)
    hot = buckets.where("bucket & 1 = 1")
    leaders = hot.groupBy("bucket").agg(F.min("d").alias("a"), F.max("d").alias("high")).where("a < high").select("bucket", "a")
    leaders = cut_lineage(leaders)  # joins with written tables can be split where a key is very common
    heavy = hot.join(leaders, "bucket").select("a", F.col("d").alias("b")).where("a <> b")
    coarse = components(light.union(heavy))
    wanted = vectors.join(coarse.select(F.col("node").alias("d"), F.col("label").alias("c")), "d").select("d", "c", "n")
    wanted = cut_lineage(wanted)
    parts = wanted.groupBy("c").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))
    parts = cut_lineage(parts.withColumn("blocks", F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("tokens") / BLOCK_TOKENS)).cast("int")))
    totals = parts.agg(F.sum(F.when(F.col("blocks") == 1, F.col("tokens"))).alias("small"), F.max("blocks").alias("most")).first()
    bundles = 1 + int((totals.small or 0) // BLOCK_TOKENS)
    placed = cut_lineage(wanted.join(parts.select("c", "blocks"), "c").select("d", "c", "blocks"))
    sets = _sets_of(docs, text, size, placed)
    sets = cut_lineage(sets.join(placed, "d").withColumn("label", F.col("d")))
    block = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "d"), F.col("blocks")).cast("int")
    group = lambda seed: F.when(F.col("blocks") == 1, F.concat(F.lit("s"), F.pmod(F.xxhash64("c"), F.lit(bundles)))).otherwise(
        F.concat_ws("/", F.col("c").cast("string"), block(seed).cast("string")))
    asked = F.lit(True).alias("asked")
    edges = cut_lineage(_join_groups(sets.select(group(1).alias("g"), "c", "d", "label", asked, "grams"), percent))
    if (totals.most or 0) > 1:
        large = sets.where("blocks > 1")
        again = _relabel(large, edges)
        more = cut_lineage(_join_groups(again.select(group(2).alias("g"), "c", "d", "label", asked, "grams"), percent))
        edges = edges.union(more)
        rest = cut_lineage(_relabel(large, edges))
        main = cut_lineage(rest.groupBy("c", "label").agg(F.count("*").alias("n")).groupBy("c").agg(F.max(F.struct("n", "label"))["label"].alias("main")))
        outside = rest.join(main, "c").where("label <> main").drop("main")
        # documents outside the main class meet every block of their component, in blocks of their own
        askers = outside.groupBy("c").agg(F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum(F.length("grams") / 8) / BLOCK_TOKENS)).cast("int").alias("askers"))
        askers = cut_lineage(askers)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "d"), F.col(n)).cast("int")
        queries = outside.join(askers, "c").select("c", "d", "label", "grams", every("blocks").alias("x"), dealt(4, "askers").alias("y"), F.lit(True).alias("asked"))
        held = rest.join(askers, "c").select("c", "d", "label", "grams", dealt(3, "blocks").alias("x"), every("askers").alias("y"), F.lit(False).alias("asked"))
        met = queries.union(held).withColumn("g", F.concat_ws("/", F.col("c").cast("string"), F.col("x").cast("string"), F.col("y").cast("string")))
        edges = edges.union(cut_lineage(_join_groups(met.select("g", "c", "d", "label", "asked", "grams"), percent)))
    labels = components(edges).select(F.col("node").alias("d"), "label")
    classed = points.join(labels, "d", "left").withColumn("label", F.coalesce("label", "d"))
    names = cut_lineage(classed.where("n > 0").groupBy("label").agg(F.min(f"row.`{id}`").alias("class")))
    classed = classed.join(names, "label", "left")
    name = F.when(F.col("n") > 0, F.col("class")).otherwise(F.col(f"row.`{id}`"))
    return classed.select("row", "tag", "n", name.alias("class"), F.when(F.col("n") > 0, F.col("label")).alias("label"))


def one_of_each_class(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id (null last), then the smallest digest.

    Documents without words stay. Of rows equal in id and text one stays.
    """
    classes = jaccard_classes(docs, [id], id, text, size, percent).select(F.col(f"row.`{id}`").alias("_id"), "tag", "n", "label")
    empty = classes.where("n = 0").select("_id", "tag")
    order = F.struct(F.col("_id").isNull(), "_id", "tag")
    first = classes.where("n > 0").groupBy("label").agg(F.min(order).alias("first"))
    kept = cut_lineage(first.select("first._id", "first.tag").union(empty).distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id}`").alias("_own"), F.xxhash64(F.col(f"`{text}`")).alias("_tag"))
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_tag") == F.col("tag"))
    stay = rows.join(kept, same, "left_semi").dropDuplicates(["_own", "_tag"])
    return stay.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
