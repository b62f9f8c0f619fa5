"""Order MinHash fingerprints.

The k-mers of a text are all runs of K bytes of its UTF-8 form, each numbered by how often it occurred before, so a
repeat counts as another element.  Each of M hash functions picks the L smallest numbered k-mers, puts them back in
text order, and hashes the tuple of their k-mers.  Two texts agree in a position with a probability that falls with
their edit distance, order included: the same k-mers in another order give other tuples.

Defined cases
* A null or empty text has the empty signature.  A text of fewer than K bytes is one k-mer; of fewer than L k-mers all
  are picked.
* Texts are read whole; the signature depends on the text alone, so repeated rows agree.  Equal hash values are told
  apart by position.  Empty tables work; other columns pass through, one named omh is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinnabar.llm.textkern import U64, _power, groups, mix64, utf8

K, L, M = 7, 3, 16
SEED = 41
_FACTORS = mix64(np.arange(1, 257, dtype=U64), SEED) | U64(1)
#: k-mers hashed at a time.
BLOCK = 1 << 15


def kmer_hashes(raw: np.ndarray, k: int = K) -> np.ndarray:
    """The hash of every k-mer of a text, in order."""
    k = min(k, len(raw))
    with np.errstate(over="ignore"):
        prefix = np.empty(len(raw) + 1, U64)
        prefix[0] = 0
        np.cumsum((raw.astype(U64) + U64(1)) * _power(len(raw)), out=prefix[1:])
        return mix64((prefix[k:] - prefix[:-k]) * _power(len(raw), True)[: len(raw) - k + 1], k)


def occurrences(kmers: np.ndarray) -> np.ndarray:
    """How often each k-mer occurred before its place."""
    n = len(kmers)
    bits = U64(max(1, int(n).bit_length()))
    keys = ((kmers >> bits) << bits) | np.arange(n, dtype=U64)
    keys.sort()
    group = keys >> bits
    new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    out = np.empty(n, U64)
    out[(keys & ((U64(1) << bits) - U64(1))).astype(np.int64)] = np.arange(n) - np.repeat(new, np.diff(np.append(new, n)))
    return out


def _smallest(values: np.ndarray, l: int) -> np.ndarray:  # noqa: E741
    """The columns of the l smallest of each row (the earlier on ties), as many rows, by size."""
    n = values.shape[1]
    if n <= 4 * l:
        return np.argsort(values, axis=1, kind="stable")[:, :l]
    limit = U64(min(2**64 - 1, int(2**64 * (l + 9) / n)))
    row, col = np.nonzero(values < limit)
    have = np.bincount(row, minlength=len(values))
    if have.min() < l:
        return np.argsort(values, axis=1, kind="stable")[:, :l]
    order = np.lexsort((col, values[row, col], row))
    first = np.cumsum(have) - have
    return col[order[(first[:, None] + np.arange(l)[None]).ravel()]].reshape(-1, l)


def signature(raw: np.ndarray, k: int = K, l: int = L, m: int = M) -> np.ndarray:  # noqa: E741
    """The m tuple hashes of one text's bytes."""
    if not len(raw):
        return np.empty(0, np.int64)
    kmers = kmer_hashes(raw, k)
    with np.errstate(over="ignore"):
        base = mix64(kmers + occurrences(kmers) * U64(0xA24BAED4963EE407), SEED)
        factors = _FACTORS[:m, None]
        if len(base) <= BLOCK:
            picked = _smallest(base[None] * factors, l)
        else:
            best = [(_smallest(base[None, s : s + BLOCK] * factors, l) + s) for s in range(0, len(base), BLOCK)]
            among = np.concatenate(best, axis=1)
            values = base[among] * factors
            picked = np.take_along_axis(among, np.argsort(values, axis=1, kind="stable")[:, :l], axis=1)
        out = np.full(m, U64(l), U64)
        for j in np.sort(picked, axis=1).T:
            out = mix64(out * U64(0x9FB21C651E98DF25) ^ kmers[j], 1)
    return out.view(np.int64)


def order_minhash(docs: DataFrame, text_col: str = "text", k: int = K, l: int = L, m: int = M, keep: list[str] | None = None) -> DataFrame:  # noqa: E741
    """The columns `keep` of docs (all, unless given) with omh, an array of m tuple hashes."""
    names = [c for c in keep or docs.columns if c.lower() != "omh"]
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField("omh", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = utf8(b.column(text_col))
            each = [signature(raw[s:e], k, l, m) for i, j in groups(offs) for s, e in zip(offs[i:j], offs[i + 1 : j + 1], strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
            omh = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each) if each else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], omh], names=[*names, "omh"])

    return docs.select(*[docs[f"`{c}`"] for c in dict.fromkeys([*names, text_col])]).mapInArrow(run, schema)


def agreement(a: Column, b: Column) -> Column:
    """The share of equal positions of two signatures: an estimate of order-sensitive likeness; null if either is empty."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), same / F.size(a))
