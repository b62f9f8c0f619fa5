"""Vectorised text kernels shared by the training-data operators.

Arrow hands a batch of strings over as one UTF-8 buffer plus offsets; everything here works on that buffer
with numpy, so no Python object is made per word.  Words are maximal runs of bytes other than ASCII white
space.  A null text is an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_R = U64(0x9E3779B97F4A7C15 | 1)
_R_INV = U64(pow(int(_R), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes worked on at a time (whole documents; a longer document is a group of its own).
GROUP_BYTES = 1 << 18
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x + U64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def _power(n: int, inverse: bool = False) -> np.ndarray:
    key = "inv" if inverse else "fwd"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, GROUP_BYTES + 1)
        base = np.full(size, _R_INV if inverse else _R, dtype=U64)
        base[0] = 1
        with np.errstate(over="ignore"):
            table = np.cumprod(base, dtype=U64)
        if size > 4 * GROUP_BYTES:  # one huge text: not worth keeping
            return table
        _powers[key] = have = table
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n+1 offsets of its rows in them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    if column.type != kind:
        column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def groups(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about GROUP_BYTES bytes and fewer than 60,000 rows each."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + GROUP_BYTES, side="right")) - 1
        j = min(max(j, i + 1), n, i + 60_000)
        yield i, j
        i = j


def word_spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words and the row each belongs to; a word never crosses a row's end."""
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offs[:-1][offs[:-1] < len(raw)]
    first[at] = inside[at]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= first[1:] | ~inside[1:]
    ends = np.flatnonzero(last) + 1
    rows = np.searchsorted(offs, starts, side="right") - 1
    return starts, ends, rows


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes give equal hashes anywhere."""
    if not len(starts):
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        prefix = np.empty(len(raw) + 1, U64)
        prefix[0] = 0
        np.cumsum((raw.astype(U64) + U64(1)) * _power(len(raw)), out=prefix[1:])
        value = (prefix[ends] - prefix[starts]) * _power(len(raw), True)[starts]
    return mix64(value, seed)


def distinct_per_row(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, 48-bit hash) in order, and how often each occurs.  rows < 65,536."""
    both = (rows.astype(U64) << U64(48)) | (hashes >> U64(16))
    both.sort()
    new = np.ones(len(both), dtype=bool)
    new[1:] = both[1:] != both[:-1]
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(both)))
    one = both[at]
    return (one >> U64(48)).astype(np.int64), one & U64((1 << 48) - 1), counts


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length-1 of every span, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    lengths = lengths.astype(np.int64)
    return np.arange(total) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
