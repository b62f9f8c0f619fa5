"""Document frequencies over a whole corpus, in a table of fixed size.

A term is a word hashed to one of 2^bits numbers (SLOTS, unless asked for), so what reaches the driver and is broadcast doesn't grow with the corpus;
words that share a slot share its frequency.

Defined cases: a null or wordless text counts for nothing; an empty table gives 0 documents, and every term the idf of
an unseen one; repeated rows count as often as they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinnabar.llm.common import give_back
from cinnabar.llm.textkern import groups, mix64, span_hashes, utf8, word_spans

SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS


def term_counts(column: pa.Array, window: int | None, bits: int = SLOT_BITS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of texts: the first row, each text's words, and the (row, term, count) of the words past its whole windows."""
    raw, offs = utf8(column)
    for i, j in groups(offs):
        part, at = raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        starts, ends, rows = word_spans(part, at)
        words = np.bincount(rows, minlength=j - i)
        if window is not None:
            first = np.cumsum(words) - words
            rest = np.arange(len(rows)) - first[rows] >= (words // window * window)[rows]
            starts, ends, rows = starts[rest], ends[rest], rows[rest]
        both = (rows.astype(np.int64) << bits) | (span_hashes(part, starts, ends) >> np.uint64(64 - bits)).astype(np.int64)
        one, counts = np.unique(both, return_counts=True)
        yield i, words, one >> bits, one & ((1 << bits) - 1), counts


class Statistics:
    """Of the whole corpus: documents with a word, their mean length, and the idf of each term."""

    def __init__(self, n: int, words: int, df: np.ndarray) -> None:
        self.n, self.mean = n, words / max(1, n)
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)


def statistics(docs: DataFrame, text_col: str = "text", bits: int = SLOT_BITS) -> Statistics:
    """Only 2^bits numbers reach the driver, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(1 << bits, np.int64), 0, 0
        for b in batches:
            for _, words, _, terms, _ in term_counts(b.column(0), None, bits):
                np.add.at(df, terms, 1)
                n += int((words > 0).sum())
                total += int(words.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, [-2, -1]).astype(np.int32)), pa.array(np.append(df[seen], [n, total]))], names=["k", "n"])
        del df, seen
        give_back()

    got = docs.select(F.col(text_col)).mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    k, n = got.column("k").to_numpy(), got.column("n").to_numpy()
    at = dict(zip(k[k < 0].tolist(), n[k < 0].tolist(), strict=True))
    df = np.zeros(1 << bits)
    df[k[k >= 0]] = n[k >= 0]
    return Statistics(at.get(-2, 0), at.get(-1, 0), df)


def preference(stats: Statistics, seed: int, power: float) -> np.ndarray:
    """A random order of all terms, as ranks, in which a term of weight idf^power comes early in proportion to it.

    The first of a text's terms in this order is a weighted min-hash: two texts agree on it with a probability that is
    the weighted Jaccard likeness of their words, however large the corpus.
    """
    u = (mix64(np.arange(SLOTS, dtype=np.uint64), seed) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
    draw = -np.log(u) / np.maximum(stats.idf.astype(np.float64), 1e-6) ** power
    rank = np.empty(SLOTS, np.int32)
    rank[np.argsort(draw, kind="stable")] = np.arange(SLOTS, dtype=np.int32)
    return rank
