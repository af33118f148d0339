"""Terms of whole texts as Arrow arrays: maximal runs of bytes that a table does not map to zero."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from dyadic.llm.words import UPPER


def term_table(digits: bool) -> bytes:
    """ASCII letters in lower case, bytes of other characters, and digits if wanted; all else becomes zero."""
    other = bytes(b for b in range(0x80) if not (chr(b).isalpha() or digits and chr(b).isdigit()))
    return bytes.maketrans(other + UPPER, b"\x00" * len(other) + UPPER.lower())


LETTERS, LETTERS_DIGITS = term_table(False), term_table(True)


def split_terms(texts: list[bytes | None], table: bytes, end_mark: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All terms end to end, and the number of terms of each text. With ``end_mark`` each term ends with a zero byte."""
    joined = np.frombuffer(b"\x00" + b"\x00".join((t or b"").translate(table) for t in texts) + b"\x00", dtype=np.uint8)
    inside = joined != 0
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    begins = np.cumsum([1] + [len(t or b"") + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, begins))
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts + end_mark, out=offsets[1:])
    kept = inside.copy()
    if end_mark:
        kept[ends] = True
    data = joined[kept]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), counts
