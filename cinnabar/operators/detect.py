"""Duplicate detectors over records (id, code_hash, code_content, function_name, file_path).

Detectors by similarity give pairs of representatives: records that a detector can't tell apart are one class, the smallest
id stands for it, and classes() tells who is in it.  So a group of copies costs one row for each of them, and no link
between different texts is lost.  Null and empty content is nobody's duplicate.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinnabar.functions import parsing as P
from cinnabar.functions import text as X
from cinnabar.operators import overlap
from cinnabar.sources.scratch import give_back, materialize, small_batches, spread

BITS = 64
BLOCKS = 24
#: Features whose bits are added up at a time, unless a single row has more.
WORDS = 1 << 18


def exact_duplicates(records: DataFrame) -> DataFrame:
    """(code_hash, n, first_id): every content that stands more than once."""
    known = records.where(F.col("code_hash").isNotNull())
    return known.groupBy("code_hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


def exact_pairs(records: DataFrame) -> DataFrame:
    """(id_a, id_b, similarity_score = 1): each further copy with the first one of its group."""
    groups = exact_duplicates(records)
    return records.join(groups, "code_hash").where("id > first_id").select(F.col("first_id").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("similarity_score"))


def classes(rows: DataFrame, *same: str) -> DataFrame:
    """(id, class_id, copies) of rows that agree in these columns."""
    rows = materialize(rows.select("id", *same), "classes")  # it is read twice
    each = rows.groupBy(*same).agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    on = [rows[c].eqNullSafe(each[c]) for c in same]
    return rows.join(each, on).select("id", "class_id", "copies")


def layered_sides(records: DataFrame) -> DataFrame:
    """(id, key, chars) of records with content: the blocking key, and the distinct characters in order as one text."""
    side = records.where(F.length("code_content") > 0)
    key = X.feature_key(F.col("code_content"), F.col("function_name"))
    chars = F.array_join(F.array_sort(X.characters(X.squeeze(F.col("code_content"), True))), "")
    return side.select("id", key.alias("key"), chars.alias("chars"))


def layered_pairs(records: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs of classes of one blocking key whose contents' characters are alike enough.

    Contents of a key with the same characters have a likeness of 1 and are one class (classes(layered_sides(r), "key",
    "chars")); texts of white space alone have no characters and are alike to none but each other.
    """
    node = layered_sides(records).where("chars <> ''").groupBy("key", "chars").agg(F.min("id").alias("id")).withColumn("c", X.characters(F.col("chars")))
    a, b = node.alias("a"), node.alias("b")
    size = lambda s: F.size(F.col(f"{s}.c"))
    # sets whose sizes are too far apart can't be alike enough: told before their characters are compared
    near = (size("a") >= threshold * size("b")) & (size("b") >= threshold * size("a"))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & near)
    score = X.token_likeness(F.col("a.c"), F.col("b.c"))
    return pairs.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.round(score, 6).alias("similarity_score")).where(F.col("similarity_score") >= threshold)


def simhash_int(features: list[str], weights: list[int] = (), size: int = BITS) -> int:
    """The SimHash of some features, of any size that is above 0; a weight that is missing is 1."""
    if size <= 0:
        raise ValueError("the size of a hash is above 0")
    votes = [0] * size
    for k, f in enumerate(features):
        h, w = int(hashlib.md5(f.encode()).hexdigest(), 16), weights[k] if k < len(weights) else 1
        for bit in range(size):
            votes[bit] += w if h >> bit & 1 else -w
    return sum((v > 0) << k for k, v in enumerate(votes))


def _simhashes(features: pa.Array, weights: pa.Array | None) -> pa.Array:
    """A signed 64-bit SimHash of each list; 0 for none.  Some rows are looked at at a time, a longer one by itself."""
    if isinstance(features, pa.ChunkedArray):
        features = features.combine_chunks()
    size = np.nan_to_num(pc.list_value_length(features).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    ends, out, begin = np.cumsum(size), np.zeros(len(size), np.int64), 0
    while begin < len(size):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - size[begin] + WORDS, side="right")))
        some = slice(begin, end)
        out[some] = _voted(features[some].flatten(), None if weights is None else weights[some].flatten(), size[some])
        begin = end
    give_back()
    return pa.array(out)


def _voted(flat: pa.Array, weights: pa.Array | None, size: np.ndarray) -> np.ndarray:
    """The SimHash of each of some lists, of these sizes; each distinct feature is hashed once."""
    flat = flat.dictionary_encode()
    words = [hashlib.md5(w.encode()).digest()[:7:-1] for w in flat.dictionary.to_pylist()]
    bits = np.unpackbits(np.frombuffer(b"".join(words), np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.int8)
    bits *= 2
    bits -= 1
    at, votes, has = flat.indices.to_numpy(), np.zeros((len(size), BITS), np.int64), np.flatnonzero(size)
    if len(has):
        part = bits[at] if weights is None else bits[at] * weights.to_numpy().astype(np.int32)[:, None]
        votes[has] = np.add.reduceat(part, (np.cumsum(size) - size)[has], axis=0, dtype=np.int64 if weights is not None else np.int32)
    return np.packbits(votes > 0, axis=1, bitorder="little").view(np.int64)[:, 0]


@F.arrow_udf(T.LongType())
def simhash_of(features: pa.Array) -> pa.Array:
    return _simhashes(features, None)


@F.arrow_udf(T.LongType())
def weighted_simhash(features: pa.Array, weights: pa.Array) -> pa.Array:
    return _simhashes(features, weights)


def simhash(features: DataFrame) -> DataFrame:
    """(id, simhash) of rows (id, feature, weight): a bit is set where the weighted votes for it are positive."""
    each = features.where("feature is not null").groupBy("id").agg(F.collect_list(F.struct("feature", F.coalesce("weight", F.lit(1)).alias("weight"))).alias("f"))
    return each.select("id", weighted_simhash(F.col("f.feature"), F.col("f.weight").cast("array<int>")).alias("simhash"))


def words(content: Column) -> Column:
    """The distinct lower-case words of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(content, F.lit(""))), r"[ \t\r\n]+"), lambda w: w != ""))


def word_simhashes(records: DataFrame) -> DataFrame:
    """(id, simhash, words) of every record by its distinct words, in one pass without a shuffle; 0 where there are none."""
    small_batches(records.sparkSession)
    found = records.select("id", words(F.col("code_content")).alias("w"))
    return found.select("id", simhash_of("w").alias("simhash"), F.size("w").alias("words"))


def known_codes(records: DataFrame) -> DataFrame:
    """(id, simhash) of the records that have words, written once."""
    return materialize(word_simhashes(records).where("words > 0").select("id", "simhash"), "codes")


def _bands(parts: int, agree: int) -> list[Column]:
    """For each choice of `agree` of the parts of a code, what it has there."""
    widths = [BITS // parts + (k < BITS % parts) for k in range(parts)]
    starts = [sum(widths[:k]) for k in range(parts)]
    out = []
    for n, choice in enumerate(combinations(range(parts), agree)):
        mask = sum(((1 << widths[k]) - 1) << starts[k] for k in choice)
        out.append(F.struct(F.lit(n).alias("band"), F.col("simhash").bitwiseAND(F.lit(mask - (1 << BITS if mask >> (BITS - 1) else 0)).cast("long")).alias("part")))
    return out


def spare_parts(nodes: int, radius: int, crowd: int = 16) -> int | None:
    """By how many parts codes within a radius must agree at least, so that chance puts no more than `crowd` nodes in a bucket.

    Of radius + e parts e are the same.  None where that takes more than 60 buckets a node.
    """
    for e in range(1, BITS - radius):
        if math.comb(radius + e, e) > 60:
            return None
        if nodes / 2.0 ** (BITS * e // (radius + e)) <= crowd:
            return e
    return None


def hamming_pairs(hashes: DataFrame, radius: int) -> DataFrame:
    """(id_a, id_b, distance, similarity_score) of all pairs of different codes within a Hamming radius, exactly.

    The smallest id of a code stands for it.  Codes are cut into radius + e parts, of which two that are near agree in e at
    least; e follows the number of codes, so that buckets stay small however many there are.  Where the radius is too
    wide for that, all codes are compared, in blocks.
    """
    nodes = materialize(hashes.groupBy("simhash").agg(F.min("id").alias("node")), "nodes")
    spare = spare_parts(nodes.count(), radius)
    if spare is None:
        return hamming_search(nodes.withColumnRenamed("node", "id"), hashes, radius).where("id_a < id_b")
    banded = nodes.select("node", "simhash", F.inline(F.array(*_bands(radius + spare, spare))))
    a, b = banded.alias("a"), banded.alias("b")
    near = X.hamming(F.col("a.simhash"), F.col("b.simhash")) <= radius
    met = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.node") < F.col("b.node")) & near)
    return _scored(met).distinct()


def _scored(met: DataFrame) -> DataFrame:
    one, two = F.col("a.simhash"), F.col("b.simhash")
    return met.select(F.col("a.node").alias("id_a"), F.col("b.node").alias("id_b"), X.hamming(one, two).alias("distance"), X.hash_likeness(one, two).alias("similarity_score"))


def hamming_search(queries: DataFrame, hashes: DataFrame, radius: int) -> DataFrame:
    """(id_a, id_b, distance, similarity_score): for each different code of some queries (id, simhash) all other codes within a
    radius, exactly, by comparing them in blocks."""
    node = lambda rows: rows.groupBy("simhash").agg(F.min("id").alias("node"))
    asked = node(queries).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))))
    a, b = asked.alias("a"), node(hashes).withColumn("part", F.pmod(F.xxhash64("node"), F.lit(BLOCKS))).alias("b")
    near = X.hamming(F.col("a.simhash"), F.col("b.simhash")) <= radius
    return _scored(a.join(b, (F.col("a.part") == F.col("b.part")) & (F.col("a.simhash") != F.col("b.simhash")) & near))


def simhash_detector(records: DataFrame, radius: int = 12) -> DataFrame:
    return hamming_pairs(known_codes(records), radius)


def similar_by_hash(records: DataFrame, source: str, threshold: float = 0.7) -> DataFrame:
    """Records whose SimHash of words is near enough to a source's, with their similarity_score, the likest first."""
    wanted = simhash_of(words(F.lit(source)))
    known = word_simhashes(records).where("words > 0").select("id", X.hash_likeness(F.col("simhash"), wanted).alias("similarity_score")).where(F.col("similarity_score") >= threshold)
    return known.orderBy(F.desc("similarity_score"), "id")


def similarity_result(matches: DataFrame) -> DataFrame:
    """(is_duplicate, similarity_score, matches): the mean of matches' scores, 0 if there are none."""
    return matches.agg((F.count(F.lit(1)) > 0).alias("is_duplicate"), F.coalesce(F.avg("similarity_score"), F.lit(0.0)).alias("similarity_score"), F.count(F.lit(1)).alias("matches"))


def find_similar(records: DataFrame, source: str) -> DataFrame:
    """Records with exactly this content."""
    return records.where(F.col("code_hash") == F.sha2(F.lit(source), 256))


def set_overlap_pairs(sets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs of sets (id, features: a list) that share more than a part of the larger one.

    Equal sets are one class, for which the smallest id stands.  Lists of one id are united; features are compared by 64-bit hashes.
    """
    hashes = F.array_distinct(F.transform(F.filter("features", lambda x: x.isNotNull()), lambda x: F.xxhash64(x)))
    f = sets.where("id is not null").select("id", hashes.alias("f"))
    if not f.groupBy("id").count().where("count > 1").isEmpty():
        f = f.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("f"))).alias("f"))
    return overlap.pairs(f, threshold)


def feature_overlap_pairs(features: DataFrame, threshold: float = 0.5) -> DataFrame:
    """set_overlap_pairs() of rows (id, feature)."""
    f = features.where("feature is not null").groupBy("id").agg(F.collect_set(F.xxhash64("feature")).alias("f"))
    return overlap.pairs(materialize(f, "features"), threshold)


@F.arrow_udf(T.LongType())
def structural_simhash(code: pa.Array) -> pa.Array:
    """The SimHash of the weighted features of each source's syntax tree."""

    def made(texts: list[str | None]) -> pa.Array:
        found = [P.structure(c)["features"] for c in texts]
        weights = [[3 if f.startswith("class:") else 2 if f.startswith("func:") else 1 for f in x] for x in found]
        return _simhashes(pa.array(found, pa.list_(pa.string())), pa.array(weights, pa.list_(pa.int32())))

    return P.each_once(code, made)


def structural_simhashes(records: DataFrame) -> DataFrame:
    """(id, simhash) of records with code and name by the weighted features of their syntax trees; 0 where there are none."""
    known = records.where((F.length("code_content") > 0) & (F.length("function_name") > 0)).select("id", "code_content")
    return spread(known, "code_content").select("id", structural_simhash("code_content").alias("simhash"))


def structural_pairs(records: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs of classes whose structure is alike enough, with their band."""
    radius = int((1 - threshold) * BITS + 1e-9)
    pairs = hamming_pairs(materialize(structural_simhashes(records), "codes"), radius)
    return pairs.withColumn("band", band(F.col("similarity_score")))


def file_pairs(files: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs of whole files (file_path, code_content) whose words are alike enough; the first path of equal files stands for them."""
    sets = files.where(F.length("code_content") > 0).select(F.col("file_path").alias("id"), words(F.col("code_content")).alias("features"))
    return set_overlap_pairs(sets, threshold)


DETECTORS: dict[str, Callable[..., DataFrame]] = {"exact_match": exact_pairs, "layered": layered_pairs, "simhash": simhash_detector, "structural": structural_pairs}


def detect(records: DataFrame, algorithm: str = "exact_match", **options) -> DataFrame:
    """Pairs by the named detector; an unknown name is an error."""
    if algorithm not in DETECTORS:
        raise ValueError(f"unknown algorithm {algorithm!r}; known: {', '.join(sorted(DETECTORS))}")
    return DETECTORS[algorithm](records, **options)


def involving(pairs: DataFrame, record: int) -> DataFrame:
    """The pairs that a record is in."""
    return pairs.where((F.col("id_a") == record) | (F.col("id_b") == record))


def combine(semantic: DataFrame, structural: DataFrame) -> DataFrame:
    """Semantic pairs, and the structural ones that weren't analysed."""
    rest = structural.join(semantic.select("id_a", "id_b"), ["id_a", "id_b"], "left_anti")
    return semantic.withColumn("method", F.lit("semantic")).unionByName(rest.withColumn("method", F.lit("structural_only")), allowMissingColumns=True)


def combined_totals(combined: DataFrame) -> DataFrame:
    """How many pairs of combine() are of each method, in one row with their total."""
    return combined.agg(F.count_if(F.col("method") == "semantic").alias("semantic"), F.count_if(F.col("method") == "structural_only").alias("structural_only"), F.count(F.lit(1)).alias("total"))


def duplicate_summary(groups: DataFrame, total: int | DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """Groups (n), further copies, their rate, how many semantic pairs (confidence) are of high and medium confidence, a verdict
    and a recommendation."""
    count = total.agg(F.count(F.lit(1)).alias("total")) if isinstance(total, DataFrame) else groups.sparkSession.range(1).select(F.lit(total).alias("total"))
    sums = groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    if semantic is None:
        semantic = groups.sparkSession.createDataFrame([], "confidence double")
    c = F.col("confidence")
    pairs = semantic.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(c > 0.8).alias("high_confidence"), F.count_if((c > 0.5) & (c <= 0.8)).alias("medium_confidence"))
    rate = F.when(F.col("total") > 0, F.col("duplicates") * 100.0 / F.col("total")).otherwise(0.0)
    within = lambda most: (rate < most) & (F.col("pairs") < most)
    verdict = F.when(within(5), "Excellent").when(within(10), "Good").when(within(20), "Fair").otherwise("Needs Improvement")
    advice = F.concat_ws(
        " ", F.when(F.col("groups") > 10, F.concat(F.col("groups").cast("string"), F.lit(" groups of structural duplicates: consolidate them."))),
        F.when(F.col("high_confidence") > 0, F.concat(F.col("high_confidence").cast("string"), F.lit(" semantically similar pairs: review them."))),
    )
    one = F.lit(1).alias("__k")
    joined = sums.select("*", one).join(count.select("*", one), "__k").join(pairs.select("*", one), "__k")
    return joined.select(
        "groups", "duplicates", "total", F.round(rate, 4).alias("rate"), X.percent(rate).alias("duplication_rate"), "high_confidence", "medium_confidence",
        verdict.alias("health"), F.when(advice == "", "Duplication is within acceptable limits.").otherwise(advice).alias("recommendation"),
    )


def band(score: Column) -> Column:
    return F.when(score >= 0.9, "high").when(score >= 0.7, "medium").otherwise("low")


def bands(pairs: DataFrame) -> DataFrame:
    """How many pairs are of high, medium and low confidence."""
    return pairs.groupBy(band(F.col("similarity_score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))
