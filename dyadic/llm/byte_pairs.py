"""Byte-level byte-pair encoding as a tree reduction, and its decoding.

A byte string is encoded by encoding its halves and joining the two results: the tokens around the seam are encoded
again in a window that grows until the tokens left and right of it are stable. Stable means: each outer pair of
neighbours encodes to itself. A sequence in which every pair of neighbours encodes to itself is the encoding of its
bytes (the first merge across a token boundary of the whole would also be the first one across it in that pair), so
the joined sequence is exact, not a guess.

Whole texts reduce in the same way. A stretch of text is an element (head, tokens, tail): everything between its first
and its last safe cut is tokens, the rest stays text until a neighbour joins. A safe cut is a place where the pattern
ends a match whatever stands on either side. Joining two elements encodes the tail of one with the head of the other,
which is associative, so memory follows a stretch (or the longest run without a safe cut) and the ids, not all matches.

Null and empty texts have no tokens; very long texts and very long runs without any cut are encoded whole; repeated
rows are encoded alike, each on its own; bytes that are not UTF-8 are read as the replacement character. Decoding null
gives null and an id outside the vocabulary is an error. Empty tables give empty results; other columns stay as they are.
"""

from __future__ import annotations

import base64
import heapq
import sys
from array import array
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadic.llm.words import lists, map_texts

#: Characters of one leaf of a text's tree.
STRETCH = 1 << 16
#: Entries of each memory of a task; a full one starts anew.
MEMORY = 1 << 19
#: Longest byte string whose tokens a task remembers inside the tree.
SHORT = 12
#: Ids that are decoded at once.
DECODED = 1 << 20
#: Ends of letter runs and digit runs, starts of digit runs, and starts of white space.
SAFE = r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{N}])(?=\p{N})|(?<=\S)(?=\s)"


def read_ranks(path: str) -> bytes:
    """The rank file as bytes, read by the driver; its size does not depend on the data."""
    with open(path, "rb") as file:
        return file.read()


def class_differences() -> dict[int, str]:
    """Characters that ``regex`` and the tokenizer library put into different classes, with a stand-in of the right one.

    The two follow different Unicode versions, so the newest letters and digits are none for the older one.
    """
    import tiktoken

    single = {bytes([k]): k for k in range(256)}
    every = "".join(map(chr, (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)))
    stand_in: dict[int, str] = {}
    for kind, sign in ((r"\p{L}", "x"), (r"\p{N}", "0")):
        theirs = set(tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={}).decode(
            tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)))
        ours = set(regex.findall(kind, every))
        stand_in |= {ord(c): "�" for c in ours - theirs if ord(c) not in stand_in} | {ord(c): sign for c in theirs - ours}
    return stand_in


class Forgetful(dict):
    """A memory of a pure function."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMORY:
            self.clear()
        self[key] = made = self.make(key)
        return made


class BytePairs:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.bytes = {k: t for t, k in self.ranks.items()}
        self.halves = Forgetful(self._split)
        self.windows = Forgetful(self.merge)
        self.pairs = Forgetful(lambda p: self.windows[self.bytes[p[0]] + self.bytes[p[1]]] == list(p))

    @cached_property
    def whole(self) -> set[bytes]:
        """The byte strings that merge to one token."""
        return {t for t, k in self.ranks.items() if self.merge(t) == [k]}

    def merge(self, data: bytes) -> list[int]:
        """Tokens of a byte string by merging the pair of lowest rank, the leftmost first, again and again."""
        n, ranks = len(data), self.ranks
        if n <= 2 * SHORT:  # a scan of all pairs is cheaper than a queue
            parts = [data[i: i + 1] for i in range(n)]
            while True:
                low, at = min(((r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None), default=(-1, 0))
                if low < 0:
                    return [ranks[p] for p in parts]
                parts[at: at + 2] = [parts[at] + parts[at + 1]]
        ends, before = list(range(1, n + 1)), list(range(-1, n))
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i: i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, start, end = heapq.heappop(queue)
            middle = ends[start]
            if middle < 0 or middle >= n or ends[middle] != end:  # one of the two parts has changed
                continue
            ends[start], ends[middle] = end, -1
            if end < n:
                before[end] = start
                if (r := ranks.get(data[start: ends[end]])) is not None:
                    heapq.heappush(queue, (r, start, ends[end]))
            if (left := before[start]) >= 0 and (r := ranks.get(data[left:end])) is not None:
                heapq.heappush(queue, (r, left, end))
        out, at = [], 0
        while at < n:
            out.append(ranks[data[at: ends[at]]])
            at = ends[at]
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of the joined bytes of two encoded neighbours."""
        if not left or not right or self.pairs[left[-1], right[0]]:
            return left + right
        a = b = 1
        while True:
            window = b"".join(map(self.bytes.__getitem__, left[-a:] + right[:b]))
            inner = self.windows[window] if len(window) <= 2 * SHORT else self.merge(window)
            stable_left = a >= len(left) or self.pairs[left[-a - 1], inner[0]]
            stable_right = b >= len(right) or self.pairs[inner[-1], right[b]]
            if stable_left and stable_right:
                return left[:-a] + inner + right[b:]
            a, b = (a if stable_left else 2 * a), (b if stable_right else 2 * b)

    def _split(self, data: bytes) -> list[int]:
        half = len(data) >> 1
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def tree(self, data: bytes) -> list[int]:
        """Tokens of a byte string by encoding its halves and joining them."""
        if data in self.whole:
            return [self.ranks[data]]
        return self.halves[data] if len(data) <= SHORT else self._split(data)

    def match(self, data: bytes) -> list[int]:
        """Tokens of one match of the pattern; a match that is itself in the vocabulary is one token."""
        own = self.ranks.get(data)
        return [own] if own is not None else self.tree(data)


class Matches(dict):
    """Code of each match; the tokens of all coded matches stand end to end."""

    def __init__(self, pairs: BytePairs):
        super().__init__()
        self.pairs = pairs
        self.tokens, self.starts = array("i"), array("q", [0])

    def __missing__(self, match: str) -> int:
        self.tokens.extend(self.pairs.match(match.encode()))
        self.starts.append(len(self.tokens))
        self[match] = code = len(self.starts) - 2
        return code

    def gather(self, codes: np.ndarray) -> np.ndarray:
        starts = np.frombuffer(self.starts, dtype=np.int64)
        return gather(np.frombuffer(self.tokens, dtype=np.int32), starts[codes], starts[codes + 1])


def gather(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``values[s:e]`` of all ranges, end to end."""
    sizes = ends - starts
    if not len(sizes):
        return values[:0]
    shift = starts - (np.cumsum(sizes) - sizes)
    return values[np.arange(sizes.sum()) + np.repeat(shift, sizes)]


class TextTree:
    """Encodes whole texts: splits into matches, codes them, and joins stretches of long texts."""

    def __init__(self, rank_file: bytes, pattern: str, stand_in: dict[int, str]):
        self.pairs = BytePairs(rank_file)
        self.pattern = regex.compile(pattern)
        self.first, self.last = regex.compile(SAFE), regex.compile(f"(?r){SAFE}")
        self.stand_in = stand_in
        self.odd = frozenset(map(chr, stand_in))
        self.known = Matches(self.pairs)

    def codes(self, text: str) -> np.ndarray:
        """Codes of all matches in a text."""
        if not text.isascii() and not self.odd.isdisjoint(text):
            found = [text[m.start(): m.end()] for m in self.pattern.finditer(text.translate(self.stand_in))]
        else:
            found = self.pattern.findall(text)
        return np.fromiter(map(self.known.__getitem__, found), dtype=np.int64, count=len(found))

    def leaf(self, text: str) -> tuple[str, np.ndarray | None, str]:
        """Head, codes between the first and the last safe cut, tail. Without a cut all is head, and the codes are None."""
        cut = self.first.search(text)
        if cut is None:
            return text, None, ""
        start, end = cut.start(), self.last.search(text).start()
        return text[:start], self.codes(text[start:end]), text[end:]

    def joined(self, left, right):
        (h1, c1, t1), (h2, c2, t2) = left, right
        if c1 is None and c2 is None:
            return self.leaf(h1 + h2)
        if c1 is None:
            h, c, t = self.leaf(h1 + h2)
            return (h1 + h2, c2, t2) if c is None else (h, np.concatenate((c, self.codes(t), c2)), t2)
        if c2 is None:
            h, c, t = self.leaf(t1 + h2)
            return (h1, c1, t1 + h2) if c is None else (h1, np.concatenate((c1, self.codes(h), c)), t)
        return h1, np.concatenate((c1, self.codes(t1 + h2), c2)), t2

    def text_codes(self, text: str) -> np.ndarray:
        if len(text) <= STRETCH:
            return self.codes(text)
        parts = [self.leaf(text[i: i + STRETCH]) for i in range(0, len(text), STRETCH)]
        while len(parts) > 1:
            parts = [reduce(self.joined, parts[i: i + 2]) for i in range(0, len(parts), 2)]
        head, codes, tail = parts[0]
        return self.codes(head) if codes is None else np.concatenate((self.codes(head), codes, self.codes(tail)))

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens of each text, and all tokens end to end."""
        if len(self.known) >= MEMORY:
            self.known = Matches(self.pairs)
        counts, tokens = [], []
        for text in texts:
            found = self.known.gather(self.text_codes(text.decode("utf-8", "replace"))) if text else np.zeros(0, np.int32)
            counts.append(len(found))
            tokens.append(found)
        return np.array(counts, dtype=np.int64), np.concatenate(tokens) if tokens else np.zeros(0, np.int32)


def encode_texts(docs: DataFrame, keep: list[str], rank_file: bytes, pattern: str, text: str = "text") -> DataFrame:
    """Columns ``row`` (the kept columns) and ``found``: ids, the token ids of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((rank_file, pattern, class_differences()))
    tree: list[TextTree] = []

    def work(texts):
        if not tree:
            tree.append(TextTree(*shared.value))
        counts, tokens = tree[0].encode(texts)
        return [lists(counts, pa.array(tokens, pa.int32()))]

    return map_texts(docs, keep, T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))]), work, text)


class Decoder:
    """Bytes of token ids: blocks of ids are decoded by one gather each, and neighbours concatenate."""

    def __init__(self, rank_file: bytes):
        known = BytePairs(rank_file).bytes
        words = [known.get(k, b"") for k in range(max(known) + 1)]
        self.missing = np.array([k not in known for k in range(len(words))])
        self.ends = np.cumsum([len(w) for w in words])
        self.starts = self.ends - [len(w) for w in words]
        self.data = np.frombuffer(b"".join(words), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) > DECODED:
            half = len(ids) >> 1
            return self.decode(ids[:half]) + self.decode(ids[half:])
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.ends) or self.missing[ids].any()):
            raise ValueError("an id is not in the vocabulary")
        return gather(self.data, self.starts[ids], self.ends[ids]).tobytes()


def decode_ids(rows: DataFrame, keep: list[str], rank_file: bytes, ids: str = "ids") -> DataFrame:
    """Columns ``row`` (the kept columns) and ``found``: data, the bytes of the ids."""
    shared = rows.sparkSession.sparkContext.broadcast(rank_file)
    source = rows.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{ids}`").cast("array<int>").alias("ids"))
    schema = T.StructType([source.schema["row"], T.StructField("found", T.StructType([T.StructField("data", T.BinaryType())]))])

    def run(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            column = batch.column("ids")
            sizes = np.diff(column.offsets.to_numpy())
            slot = (np.cumsum(sizes) - sizes) // DECODED if len(sizes) else sizes
            for cut in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(slot)) + 1):
                if not len(cut):
                    continue
                part = column.slice(int(cut[0]), len(cut))
                data = [None if x is None else decoder.decode(x.values.to_numpy(zero_copy_only=False)) for x in map(plain_list, part)]
                found = pa.StructArray.from_arrays([pa.array(data, pa.binary())], ["data"])
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(int(cut[0]), len(cut)), found], ["row", "found"])

    return source.mapInArrow(run, schema)


def plain_list(scalar):
    """A list scalar, or None if it is null."""
    return scalar if scalar.is_valid else None
