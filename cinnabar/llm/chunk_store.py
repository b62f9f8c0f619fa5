"""A content-addressed store of token-id streams.

Each text is turned into token ids and its id stream is cut where a rolling hash of the last WINDOW ids has MASK's bits
zero (about every 256 ids), and at MOST ids at the latest.  A cut depends on nearby ids only, so equal passages of
different documents give equal chunks.  A chunk is kept once, under the SHA-256 of its bytes (ids as little-endian
16-bit words, or 32-bit ones for larger vocabularies).  A document's recipe lists its chunks in order together with
the root of the Merkle tree over their digests.  The manifest is the Merkle tree over all recipes: its root changes with any
of them, so a lost or changed recipe shows.  verify() rebuilds every document from the store, checks digests, roots and
lengths, and the store's recipes against its manifest.

The store is one table: rows of kind "chunk" (key = digest, payload, n_ids) and of kind "recipe" (key = the document's
id and root, doc_id, parts, n_ids, root); chunk_store_with_manifest() adds one of kind "manifest" (n_ids = recipes, parts
= digests of its top branches, root).  One pass over the text makes both, one shuffle by key drops the repeats.

Defined cases
* A null or empty text has a recipe without parts; its root is the hash of nothing.
* Rows that repeat an id and its ids' stream have one recipe; different texts under one id have one each.  A null id
  stays null.  Empty tables give empty stores.  Only the two named columns are read, so others may have any names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinnabar.llm.common import discard, materialize, whole_id
from cinnabar.llm.textkern import U64, _power, groups, mix64, ragged, span_hashes, utf8

#: The pre-tokenizer pattern of byte-level BPE: one piece is a contraction, letters, digits, marks or white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
WINDOW, MASK, MOST = 16, (1 << 8) - 1, 2048
#: Pieces whose ids a worker remembers.
KNOWN = 400_000
#: A store as it is shuffled and kept, digests as bytes: the key of a chunk is its digest, that of a recipe its id, a colon and its root.
SCHEMA = "key binary, doc_id long, n_ids long, parts binary, payload binary"


class Encoder:
    """Byte-level BPE of whole batches: each distinct piece of a batch is looked up or encoded once."""

    def __init__(self, vocabulary: str) -> None:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bpe = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.uint16 if max(ranks.values()) < 1 << 16 else np.uint32
        self.kind = self._kinds()
        self.forget()

    @staticmethod
    def _kinds() -> np.ndarray:
        """0 space, 1 letter, 2 digit, 3 other, of every code point, as the pattern's classes have it."""
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.full(0x110000, 3, np.uint8)
        for value, cls in ((1, r"\p{L}"), (2, r"\p{N}"), (0, r"\s")):
            for m in regex.finditer(f"{cls}+", every):
                s, e = ord(every[m.start()]), ord(every[m.end() - 1])
                for lo, hi in ((s, min(e, 0xD7FF)), (max(s, 0xE000), e)):
                    if lo <= hi:
                        table[lo : hi + 1] = value
        return table

    def forget(self) -> None:
        self.hashes = np.empty(0, U64)
        self.at = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def pieces(self, text: bytes, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets of all pieces' starts in a group of texts (no contractions), and each text's count."""
        raw = np.frombuffer(text, np.uint8)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        kind = self.kind[np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)]
        begin = np.zeros(len(kind) + 1, bool)
        rows = np.searchsorted(lead, offs)
        begin[rows] = True
        begin = begin[:-1]
        edge = begin.copy()  # a change of class, or a new text
        edge[1:] |= kind[1:] != kind[:-1]
        space = kind == 0
        plain = raw[lead] == 32
        start = edge.copy()
        # the last space of a run goes with what follows it, if it is a plain one; else it is a piece of its own
        after = np.zeros(len(kind), bool)
        after[:-1] = space[:-1] & ~space[1:] & ~begin[1:]
        start[after] = True
        joined = np.flatnonzero(after & plain) + 1
        start[joined] = False
        at = np.flatnonzero(start)
        counts = np.diff(np.searchsorted(at, rows))
        return lead[at], counts

    def group(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a group of texts and how many each text has."""
        if not len(raw):
            return np.empty(0, self.dtype), np.zeros(len(offs) - 1, np.int64)
        text = raw.tobytes()
        if b"'" in text:  # contractions: the plain way
            each = [np.array(self.bpe.encode_ordinary(text[s:e].decode()), self.dtype) for s, e in zip(offs[:-1], offs[1:], strict=True)]
            return np.concatenate(each), np.array([len(x) for x in each])
        starts, counts = self.pieces(text, offs)
        ends = np.append(starts[1:], len(raw))
        hashes = span_hashes(raw, starts, ends)
        one, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        where = np.searchsorted(self.hashes, one)
        known = np.zeros(len(one), bool)
        inside = where < len(self.hashes)
        known[inside] = self.hashes[where[inside]] == one[inside]
        if not known.all():
            if len(self.hashes) > KNOWN:
                self.forget()
                known[:] = False
            new = np.flatnonzero(~known)
            s, e = starts[first[new]], ends[first[new]]
            each = [self.bpe._encode_single_piece(text[a:b]) for a, b in zip(s.tolist(), e.tolist(), strict=True)]
            size = np.array([len(x) for x in each])
            base = len(self.ids)
            self.ids = np.concatenate([self.ids, np.fromiter((t for x in each for t in x), np.uint32, size.sum())])
            hashes_all = np.concatenate([self.hashes, one[new]])
            order = np.argsort(hashes_all)
            self.hashes = hashes_all[order]
            self.at = np.concatenate([self.at, base + np.cumsum(size) - size])[order]
            self.size = np.concatenate([self.size, size])[order]
            where = np.searchsorted(self.hashes, one)
        at, size = self.at[where][back], self.size[where][back]
        ids = self.ids[ragged(at, size)].astype(self.dtype)
        upto = np.concatenate([[0], np.cumsum(size)])
        piece = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(upto[piece])


def cuts(ids: np.ndarray) -> np.ndarray:
    """Where the chunks of one id stream end."""
    n = len(ids)
    if n > WINDOW:
        with np.errstate(over="ignore"):
            prefix = np.empty(n + 1, U64)
            prefix[0] = 0
            np.cumsum(mix64(ids.astype(U64), 7) * _power(n), out=prefix[1:])
            rolled = mix64((prefix[WINDOW:] - prefix[:-WINDOW]) * _power(n, True)[: n - WINDOW + 1])
        ends = np.flatnonzero((rolled & U64(MASK)) == 0) + WINDOW
        ends = ends[ends < n]
    else:
        ends = np.empty(0, np.int64)
    ends = np.concatenate([[0], ends, [n]]).astype(np.int64)
    extra = (np.diff(ends) - 1) // MOST  # cuts inside chunks that are too long
    if extra.any():
        own = ragged(np.ones(len(extra), np.int64), extra)
        ends = np.sort(np.concatenate([ends, np.repeat(ends[:-1], extra) + own * MOST]))
    return ends[1:]


def merkle_root(digests: list[bytes]) -> bytes:
    """The root of the binary Merkle tree over the digests; an odd one moves up unpaired."""
    if not digests:
        return hashlib.sha256(b"").digest()
    level = [hashlib.sha256(b"\0" + d).digest() for d in digests]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def _bytes(docs: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """The store of a table of documents, of SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        sent: set[bytes] = set()  # chunks that this task has given out already
        for b in batches:
            raw, offs = utf8(b.column("t"))
            for i, j in groups(offs):
                ids, counts = bpe.group(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                wide = ids.dtype.itemsize
                data = memoryview(ids.tobytes())
                rows: list[tuple] = []
                begin = 0
                for doc, n in zip(b.column("d").slice(i, j - i).to_pylist(), counts.tolist(), strict=True):
                    parts, at = [], begin
                    for end in (cuts(ids[begin : begin + n]) + begin).tolist() if n else []:
                        piece = data[at * wide : end * wide]
                        digest = hashlib.sha256(piece).digest()
                        parts.append(digest)
                        if digest not in sent:
                            sent.add(digest)
                            rows.append((digest, None, end - at, None, piece.tobytes()))
                        at = end
                    rows.append((f"{doc}:".encode() + merkle_root(parts), doc, n, b"".join(parts), None))
                    begin += n
                if len(sent) > 500_000:
                    sent.clear()
                key, doc_id, size, part, payload = map(list, zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.binary()), pa.array(doc_id, pa.int64()), pa.array(size, pa.int64()), pa.array(part, pa.binary()), pa.array(payload, pa.binary())],
                    names=["key", "doc_id", "n_ids", "parts", "payload"],
                )

    made = docs.select(whole_id(id_col).alias("d"), F.col(text_col).alias("t")).mapInArrow(run, SCHEMA)
    return made.dropDuplicates(["key"])


def _readable(made: DataFrame) -> DataFrame:
    """The store with its digests in hex."""
    digest = lambda x: F.lower(F.hex(x))
    recipe = F.col("parts").isNotNull()
    each = F.transform(F.sequence(F.lit(1), F.octet_length("parts") - 31, F.lit(32)), lambda at: digest(F.substring(F.col("parts"), at, F.lit(32))))
    root = F.when(recipe, digest(F.substring("key", -32, 32)))
    return made.select(
        F.when(recipe, F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")), F.lit(":"), root)).otherwise(digest("key")).alias("key"),
        F.when(recipe, "recipe").otherwise("chunk").alias("kind"), "doc_id", "n_ids",
        F.when(F.octet_length("parts") > 0, each).when(recipe, F.array().cast("array<string>")).alias("parts"), root.alias("root"), "payload",
    )


def chunk_store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The store of a table of documents."""
    return _readable(_bytes(docs, id_col, text_col, vocabulary))


def reconstruct(store: DataFrame) -> DataFrame:
    """(doc_id, root, n_ids, ids, sound): every document's ids from the store; sound: all digests, the root and the length agree."""
    chunks = store.where("kind = 'chunk'").select(F.col("key").alias("part"), "payload", (F.sha2("payload", 256) == F.col("key")).alias("good"))
    recipes = store.where("kind = 'recipe'").select("key", "doc_id", "root", "n_ids", "parts")
    each = recipes.select("key", F.posexplode("parts").alias("at", "part")).join(chunks, "part", "left")
    whole = each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "payload", "good"))).alias("p"))
    joined = recipes.join(whole, "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sound = [], []
            for parts, p, root, n in zip(*(b.column(c).to_pylist() for c in ("parts", "p", "root", "n_ids")), strict=True):
                data = b"".join(x["payload"] or b"" for x in p or [])
                ids.append(data)
                good = len(p or []) == len(parts) and all(x["good"] for x in p or [])
                sound.append(good and merkle_root([bytes.fromhex(x) for x in parts]).hex() == root and len(data) in (2 * n, 4 * n))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("root"), b.column("n_ids"), pa.array(ids, pa.binary()), pa.array(sound)], names=["doc_id", "root", "n_ids", "ids", "sound"])

    return joined.mapInArrow(run, "doc_id long, root string, n_ids long, ids binary, sound boolean")


def manifest(store: DataFrame, digits: int = 6) -> DataFrame:
    """One row of kind "manifest": the root over all recipes.

    Recipes' digests are put in order and hashed together by their first `digits` hex digits, these by half as many, these
    into the root: no task holds more than a branch of the tree.
    """
    leaf = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "root", F.col("n_ids").cast("string")), 256)
    level = store.where("kind = 'recipe'").select(leaf.alias("x"), F.lit(1).cast("long").alias("n"), leaf.alias("at"))
    for size in (digits, digits // 2):
        branch = F.sha2(F.array_join(F.array_sort(F.collect_list("x")), ""), 256)
        level = level.groupBy(F.substring("at", 1, size).alias("at")).agg(branch.alias("x"), F.sum("n").alias("n"))
    tops = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda t: t["x"])
    whole = level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_ids"), tops.alias("parts")).withColumn("root", F.sha2(F.array_join("parts", ""), 256))
    return whole.select(
        F.lit("manifest").alias("key"), F.lit("manifest").alias("kind"), F.lit(None).cast("long").alias("doc_id"), "n_ids", "parts", "root", F.lit(None).cast("binary").alias("payload")
    )


def chunk_store_with_manifest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The store of a table of documents, and its manifest."""
    store = _readable(materialize(_bytes(docs, id_col, text_col, vocabulary), "store"))
    return store.unionByName(manifest(store))


def verify(store: DataFrame) -> DataFrame:
    """(documents, unsound, manifest_holds) of a store with its manifest."""
    sums = reconstruct(store).agg(F.count(F.lit(1)).alias("documents"), F.count_if(~F.col("sound")).alias("unsound"))
    said = store.where("kind = 'manifest'").agg(F.first("root").alias("said"), F.first("n_ids").alias("n"))
    now = manifest(store).select(F.col("root").alias("now"), F.col("n_ids").alias("m"))
    one = F.lit(1)
    joined = sums.withColumn("one", one).join(said.withColumn("one", one), "one").join(now.withColumn("one", one), "one")
    return joined.select("documents", "unsound", F.coalesce((F.col("said") == F.col("now")) & (F.col("n") == F.col("m")), F.lit(False)).alias("manifest_holds"))
