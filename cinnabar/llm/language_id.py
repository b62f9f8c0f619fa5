"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point, whatever its script.  A letter trigram is
bound as rotate2(a) * rotate1(b) * c, a text is the bundle (sum) of its trigrams, a language's prototype the bundle of
its training texts.  A text is given the language of the prototype with the greatest cosine.

Prototypes are fitted on a bounded sample of labelled rows (`per_language` rows of each language at most in
expectation, chosen by a hash of the id); every text is then read whole.

Defined cases
* Texts are compared in Unicode's composed form (NFC) and without case.  Letters and marks make up words; anything else,
  digits, emoji and punctuation too, is a space, and runs of spaces are one space, as are a text's ends.
* A null text, and one without letters, has language "und" and similarity 0, and is rejected; so is a text whose
  similarity is under `least`, unless it has fewer than `few` trigrams, which are too few for a verdict: such a text is
  accepted, and keeps the label in the column `declared` if that is given and not null.
* Ties go to the language first in the alphabet.  Null labels aren't trained on; without any label every row is "und".
* Repeated rows are judged alike, empty tables work, other columns pass through; columns named language, similarity
  and accepted are replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinnabar.llm.common import give_back, whole_id
from cinnabar.llm.textkern import U64, groups, mix64, utf8

DIM = 1024
SEED = 20
#: Bits of a letter in a trigram's key.
LETTER_BITS = 21
#: Trigram vectors kept at a time by a worker (1 KB each).
KEPT = 40_000
#: Trigrams of a text that are summed at a time (5 KB each).
STEP = 1 << 12
RESULT = [("language", T.StringType()), ("similarity", T.DoubleType()), ("accepted", T.BooleanType())]


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """The vector of each letter, by its code point."""
    words = mix64((letters.astype(U64)[:, None] << U64(8)) + np.arange(DIM // 64, dtype=U64), SEED)
    return np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").view(np.int8) * np.int8(2) - np.int8(1)


def composed(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts in composed form; marks and conjoining letters have a byte of 0xCC or more."""
    if not (raw >= 0xCC).any():
        return raw, offs
    text = raw.tobytes()
    parts = [text[s:e] for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
    said = [p.decode("utf-8", "replace") for p in parts]
    parts = [p if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t).encode() for p, t in zip(parts, said, strict=True)]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


class Profiles:
    """Trigram vectors, made when first seen, and text bundles."""

    def __init__(self) -> None:
        self.kinds = np.full(0x110000, -1, np.int32)
        self._reset()

    def _reset(self) -> None:
        self.keys, self.at = np.empty(0, np.int64), np.empty(0, np.int64)
        self.vectors, self.n = np.empty((4096, DIM), np.int8), 0

    def letters(self, points: np.ndarray) -> np.ndarray:
        """0 or the lower-case letter of each code point."""
        out = self.kinds[points]
        new = np.unique(points[out < 0])
        if len(new):
            self.kinds[new] = [ord(chr(c).lower()[0]) if unicodedata.category(chr(c))[0] in "LM" else 0 for c in new.tolist()]
            out = self.kinds[points]
        return out

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """Where the vectors of distinct, sorted trigrams stand."""
        where = np.searchsorted(self.keys, ids)
        known = np.zeros(len(ids), bool)
        inside = where < len(self.keys)
        known[inside] = self.keys[where[inside]] == ids[inside]
        if not known.all():
            if self.n + len(ids) > KEPT:
                self._reset()
                known[:] = False
            new = ids[~known]
            while self.n + len(new) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.empty((min(len(self.vectors), KEPT - len(self.vectors)), DIM), np.int8)])
            mask = (1 << LETTER_BITS) - 1
            a, b, c = (letter_vectors((new >> (k * LETTER_BITS)) & mask) for k in (2, 1, 0))
            self.vectors[self.n : self.n + len(new)] = np.roll(a, 2, axis=1) * np.roll(b, 1, axis=1) * c
            put = np.searchsorted(self.keys, new)
            self.keys = np.insert(self.keys, put, new)
            self.at = np.insert(self.at, put, np.arange(self.n, self.n + len(new)))
            self.n += len(new)
            where = np.searchsorted(self.keys, ids)
        return self.at[where]

    def bundles(self, column: pa.Array) -> Iterator[tuple[np.ndarray, int]]:
        """The bundle of each text, in order, and its number of trigrams; zeros where it has none."""
        raw, offs = utf8(column)
        for i, j in groups(offs):
            part, at = composed(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            starts = (part & 0xC0) != 0x80
            where = np.concatenate([[0], np.cumsum(starts)])[at]
            kinds = self.letters(np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32))
            for s, e in zip(where[:-1], where[1:], strict=True):
                x = kinds[s:e]
                if not x.any():
                    yield np.zeros(DIM, np.float32), 0
                    continue
                x = np.concatenate([[0], x, [0]]).astype(np.int64)
                x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]
                grams = (((x[:-2] << LETTER_BITS) | x[1:-1]) << LETTER_BITS) | x[2:]
                ids, counts = np.unique(grams, return_counts=True)
                total = np.zeros(DIM, np.float32)
                for k in range(0, len(ids), STEP):
                    at_rows = self.rows(ids[k : k + STEP])
                    total += counts[k : k + STEP].astype(np.float32) @ self.vectors[at_rows].astype(np.float32)
                yield total, len(grams)


def fit_prototypes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 2000) -> dict[str, np.ndarray]:
    """The prototype of each language, of length 1.  Only sums of fixed size (1,024 numbers a language) reach the driver."""
    labelled = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("l is not null")
    share = {r["l"]: min(1.0, per_language / r["n"]) for r in labelled.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return {}
    part = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])[F.col("l")]
    chosen = labelled.where(F.pmod(F.xxhash64(F.coalesce(whole_id("i"), F.lit(0)), F.lit(SEED)), F.lit(1_000_000)) < part * 1_000_000)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hyper, total = Profiles(), {}
        for b in batches:
            for lang, (v, _) in zip(b.column("l").to_pylist(), hyper.bundles(b.column("t")), strict=True):
                size = np.linalg.norm(v)
                if size:
                    total[lang] = total.get(lang, 0) + np.rint(v / size * 4096).astype(np.int64)
        if total:
            yield pa.RecordBatch.from_pydict({"l": list(total), "v": [x.tolist() for x in total.values()]})
        del hyper
        give_back()

    each = chosen.select("t", "l").mapInArrow(sums, "l string, v array<long>").select("l", F.posexplode("v").alias("k", "x"))
    found: dict[str, np.ndarray] = {}
    for r in each.groupBy("l", "k").agg(F.sum("x").alias("x")).collect():
        found.setdefault(r["l"], np.zeros(DIM))[r["k"]] = r["x"]
    return {k: v / (np.linalg.norm(v) or 1.0) for k, v in sorted(found.items())}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", least: float = 0.1, keep: list[str] | None = None, few: int = 12, declared: str | None = None) -> DataFrame:
    """The columns `keep` of docs (all, unless given) with language, similarity and accepted."""
    names = [c for c in keep or docs.columns if c.lower() not in dict(RESULT)]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(n, t) for n, t in RESULT])
    langs = np.array([*prototypes, "und"], dtype=object)
    matrix = np.array([*prototypes.values()], np.float32).reshape(-1, DIM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hyper = Profiles()
        for b in batches:
            best, cos, some = np.full(b.num_rows, len(langs) - 1), np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for k, (v, some[k]) in enumerate(hyper.bundles(b.column(text_col))):
                size = np.linalg.norm(v)
                if size and len(matrix):
                    all_cos = matrix @ v / size
                    best[k] = int(np.argmax(all_cos))
                    cos[k] = float(all_cos[best[k]])
            found, short = langs[best], (some > 0) & (some < few)
            if declared is not None:
                said = np.array(b.column(declared).to_pylist(), object)
                found = np.where(short & (said != None), said, found)  # noqa: E711
            accepted = ((cos >= least) | short) & (best < len(langs) - 1)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(found, pa.string()), pa.array(np.round(cos, 6)), pa.array(accepted)], names=[*names, *dict(RESULT)])
        del hyper
        give_back()

    read = dict.fromkeys([*names, text_col, *([declared] if declared else [])])
    return docs.select(*[docs[f"`{c}`"] for c in read]).mapInArrow(run, schema)
