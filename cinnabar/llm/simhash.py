"""SimHash of 256 bits over the distinct words of a text, and the words that route it to shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from cinnabar.llm.common import give_back
from cinnabar.llm.frequency import SLOT_BITS
from cinnabar.llm.textkern import distinct_per_row, groups, mix64, span_hashes, utf8, word_spans

WORDS = 4
BITS = 64 * WORDS
#: Byte -> eight counters of one byte each.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.uint8).view(np.uint64).ravel()


def simhashes(column: pa.Array, orders: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, WORDS) codes, and for each order of all terms the first of a row's words.

    A bit is set where more than half of the row's distinct words have it; no words: 0.
    """
    raw, offs = utf8(column)
    orders = np.empty((0, 1), np.int32) if orders is None else orders
    out = np.zeros((len(offs) - 1, WORDS), np.uint64)
    keys = np.zeros((len(offs) - 1, len(orders)), np.int64)
    for i, j in groups(offs):
        part, at = raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        starts, ends, rows = word_spans(part, at)
        rows, words, _ = distinct_per_row(rows, span_hashes(part, starts, ends))
        if not len(rows):
            continue
        n = np.bincount(rows, minlength=j - i)
        first = np.cumsum(n) - n
        # runs of at most 255 words, so that a counter of one byte can't overflow
        pieces = -(-n // 255)
        owner = np.repeat(np.arange(j - i), pieces)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = first[owner] + piece * 255
        has = np.flatnonzero(n)
        piece_at = (np.cumsum(pieces) - pieces)[has]
        slots = (words >> np.uint64(48 - SLOT_BITS)).astype(np.int64)
        for k, order in enumerate(orders):
            keys[i + has, k] = np.minimum.reduceat(order[slots], first[has])
        for w in range(WORDS):
            lanes = _LANES[mix64(words, w + 1).view(np.uint8).reshape(-1, 8)]
            counts = np.add.reduceat(lanes, begin, axis=0).view(np.uint8)
            total = np.add.reduceat(counts, piece_at, axis=0, dtype=np.int32)
            out[i + has, w] = np.packbits(2 * total > n[has, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out, keys


def emit(orders: Callable[[], np.ndarray | None] = lambda: None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (key..., text) to (key..., c0..c3, k0..), for mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = orders()
        for b in batches:
            codes, keys = simhashes(b.column(b.num_columns - 1), own)
            names = b.schema.names[:-1]
            columns = [*[b.column(c) for c in names], *[pa.array(codes.view(np.int64)[:, w]) for w in range(WORDS)], *[pa.array(k) for k in np.ascontiguousarray(keys.T)]]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *[f"c{w}" for w in range(WORDS)], *[f"k{k}" for k in range(keys.shape[1])]])
        give_back()

    return run
