"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Documents stream through the automaton token by token; the longest match at each token tells which words stand in
a window of test-item words. No shuffle: a document is judged where it is read.

Words are maximal runs of ASCII letters, digits and non-ASCII characters, ASCII letters in lower case.
A window is ``window`` consecutive words of one item; an item of fewer words is one window; an item without words
has none. Nulls and empty texts have no words and no hits. Repeated rows are judged alike, each on its own; items
that share an item_id count once; a null item_id is written ``null``. Empty tables give empty or clean results.
Texts are read whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadic.llm.automaton import SuffixAutomaton
from dyadic.llm.words import ALNUM_LOWER, pieces
from dyadic.session import cut_lineage

#: Most item words that one automaton holds (about 200 bytes each); more items make more automata, used in turn.
AUTOMATON_WORDS = 1_000_000
SEPARATOR = b"\xff"  # never part of UTF-8 text

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


class ItemIndex:
    """Automaton of the items' words with the items of every window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        words = [(i, (t or b"").translate(ALNUM_LOWER).split()) for i, t in items]
        words = [(i, w) for i, w in words if w]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, ws in words for w in ws), 1)}
        self.vocabulary[SEPARATOR] = 0
        sequences = [[self.vocabulary[w] for w in ws] for _, ws in words]
        self.automaton = a = SuffixAutomaton(sequences)
        self.shortest = min([window, *map(len, sequences)])
        self.at = a.ancestor(window)
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, tuple[int, set[str]]] = {}
        for (item, _), tokens in zip(words, sequences, strict=True):
            state = 0
            if len(tokens) < window:
                for state, _ in a.stream(tokens):
                    pass
                self.short.setdefault(state, (len(tokens), set()))[1].add(item)
            else:
                for state, n in a.stream(tokens):
                    if n >= window:
                        self.items.setdefault(self.at[state], set()).add(item)
        #: of each state, the nearest state on its links (itself included) at which a short item ends
        self.nearest = [-1] * len(a.length)
        for v in sorted(range(1, len(a.length)), key=a.length.__getitem__):
            self.nearest[v] = v if v in self.short else self.nearest[a.link[v]]

    def hits(self, tokens: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Covered ranges of a token list and the items whose windows occur in it."""
        covered: list[tuple[int, int]] = []
        items: set[str] = set()
        link = self.automaton.link
        seen: set[int] = set()
        for i, (state, n) in enumerate(self.automaton.stream(tokens), 1):
            longest = 0
            if n >= self.window:
                longest = n
                if (w := self.at[state]) not in seen:
                    seen.add(w)
                    items |= self.items[w]
            u = self.nearest[state]
            while u >= 0:
                size, ended = self.short[u]
                if size <= n:
                    longest = max(longest, size)
                    items |= ended
                u = self.nearest[link[u]]
            if longest:
                covered.append((i - longest, i))
        return covered, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of ranges as disjoint ascending ranges; ranges that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def judge(texts: list[bytes | None], index: ItemIndex) -> tuple[list[int], dict[int, tuple[list, set]]]:
    """Words of each text; for texts with hits, their covered ranges and items."""
    words = (b" " + SEPARATOR + b" ").join((t or b"").translate(ALNUM_LOWER) for t in texts).split()
    ids = np.fromiter(map(index.vocabulary.get, words, repeat(-1)), dtype=np.int32, count=len(words))
    breaks = np.flatnonzero(ids == 0)
    begins = np.concatenate(([0], breaks + 1))
    counts = np.diff(np.concatenate((begins, [len(ids) + 1]))) - 1
    known = np.concatenate(([0], (ids > 0).view(np.int8), [0]))
    edges = np.flatnonzero(np.diff(known))
    starts, ends = edges[0::2], edges[1::2]
    long = ends - starts >= index.shortest
    found: dict[int, tuple[list, set]] = {}
    owners = np.searchsorted(begins, starts[long], side="right") - 1
    for a, b, k in zip(starts[long].tolist(), ends[long].tolist(), owners.tolist(), strict=True):
        covered, items = index.hits(ids[a:b].tolist())
        if items:
            shift = a - int(begins[k])
            own = found.setdefault(k, ([], set()))
            own[0].extend((x + shift, y + shift) for x, y in covered)
            own[1].update(items)
    return counts.tolist(), found


def item_shards(items: DataFrame, item_id: str, text: str, limit: int) -> tuple[int, Iterator[list[tuple[str, bytes]]]]:
    """Number of groups, and items in groups of about ``limit`` words, each small enough for one automaton.

    Groups are fetched one at a time; only their number depends on the table.
    """
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"),
                        F.col(text).cast("binary").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + int(size) // (limit * 5)
    return n, ([(r.id, bytes(r.text)) for r in rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()] for k in range(n))


def find_contamination(
    docs: DataFrame, items: DataFrame, keep: list[str], window: int = 13, text: str = "text",
    item_id: str = "item_id", item_text: str = "text", automaton_words: int = AUTOMATON_WORDS,
) -> DataFrame:
    """Columns ``row`` (the kept columns of ``docs``) and ``found``: n_words, spans (word ranges), items (item ids)."""
    found = T.StructType([
        T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)),
        T.StructField("items", T.ArrayType(T.StringType())),
    ])
    state = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").cast("binary").alias("text"),
                        F.lit(None).cast(found).alias("found"))
    n, shards = item_shards(items, item_id, item_text, automaton_words)
    context = docs.sparkSession.sparkContext
    for k in range(n):
        shared = context.broadcast(ItemIndex(next(shards), window))
        state = state.mapInArrow(_pass(shared, k == 0, k == n - 1, state.schema), state.schema)
        if k < n - 1:  # what is found so far is written, so that one automaton at a time is held
            state = cut_lineage(state)
            shared.destroy()
    return state.select("row", "found")


def _pass(shared, first: bool, last: bool, schema):
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                counts, hits = judge(piece.column("text").to_pylist(), shared.value)
                if not first:
                    before = piece.column("found").to_pylist()
                    for k, old in enumerate(before):
                        if old["items"]:
                            spans, items = hits.get(k, ([], set()))
                            hits[k] = (spans + [(s["start"], s["end"]) for s in old["spans"]], items | set(old["items"]))
                n = len(counts)
                spans = [[]] * n
                items = [[]] * n
                for k, (ranges, ids) in hits.items():
                    spans[k] = [{"start": a, "end": b} for a, b in merged(ranges)]
                    items[k] = sorted(ids)
                found = pa.StructArray.from_arrays(
                    [pa.array(counts, pa.int64()), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))],
                    ["n_words", "spans", "items"])
                text = pa.nulls(n, pa.binary()) if last else piece.column("text")
                yield pa.RecordBatch.from_arrays([piece.column("row"), text, found], ["row", "text", "found"])

    return run


def covered_words(spans: str = "found.spans"):
    """Number of words in disjoint spans."""
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(n_hit, n_words, percent: int = 5):
    """The contract's rule: some hit, and hits cover at least ``percent`` of the words."""
    return (n_hit > 0) & (n_hit * 100 >= n_words * percent)


def without_spans(text: bytes, spans: list[dict]) -> bytes:
    """The text without the given word ranges; what separates words around a removed range stays."""
    lettered = np.frombuffer(b" " + text.translate(ALNUM_LOWER) + b" ", dtype=np.uint8) != 32
    edges = np.flatnonzero(lettered[1:] != lettered[:-1])
    starts, ends = edges[0::2], edges[1::2]
    kept, at = [], 0
    for s in spans:
        kept.append(text[at: int(starts[s["start"]])])
        at = int(ends[s["end"] - 1])
    return b"".join([*kept, text[at:]])


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 13, percent: int = 5, text: str = "text", **names,
) -> DataFrame:
    """``docs`` without the documents that windows cover to ``percent`` or more, and with lesser spans cut out.

    Columns and their order stay. Documents without hits are returned byte for byte.
    """
    judged = find_contamination(docs, items, docs.columns, window, text, **names)
    n_hit = covered_words()
    rest = judged.where(~contaminated(n_hit, F.col("found.n_words"), percent))

    @F.pandas_udf("string")
    def cut(texts, spans):
        return texts.combine(spans, lambda t, s: t if t is None or not len(s) else without_spans(t.encode(), s).decode())

    cleaned = F.when(F.size("found.spans") > 0, cut(F.col(f"row.`{text}`"), F.col("found.spans"))).otherwise(F.col(f"row.`{text}`"))
    return rest.select(*[cleaned.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
