"""Near-duplicate documents: SimHash, and navigable small-world graphs over Hamming distance.

1. Every text gets a 256-bit SimHash of its distinct words; equal codes are one node (its smallest id stands for it).
2. Nodes are routed to shards of about `shard_nodes`, in each of several tables, by a weighted min-hash of their words
   (weights idf^2 over the whole corpus): two texts meet in a table with the probability of their words' weighted
   Jaccard likeness, which is about TOGETHER or more within the radius however large the corpus.  Beyond 2^16 shards
   a key is made of two words, then three; the number of tables is the least by which a pair meets with 0.97.
3. A shard builds its graph, and every one of its nodes is a query to it, with a beam that widens until it holds all
   neighbours within the radius, or widening meets none but nodes of the query's own component, so that a group of
   copies isn't gone through once for each of its members.  Each found pair's distance is exact, so every edge is
   verified.  A shard of more than `graph_nodes` nodes holds several graphs, and all of its queries go to each.
4. The edges are united; the smallest id of a component stays.
5. The recall is audited: `audit` nodes, chosen by hash, are compared with all nodes exactly.  If fewer than `recall`
   of their true pairs are in one group, the search is repeated with beams twice as wide and twice the tables; beyond beams of 1,024
   or MOST_KEYS routing words a warning says so.

Defined cases
* A null id, and a null or wordless text, is no one's copy and stays.
* Rows that repeat an id and its text are one document: near_dedup keeps one of them.  Different texts under one id
  are all kept or removed together: removed if any of them is a copy of a document with a smaller id.
* Empty tables give empty tables.  Other columns pass through near_dedup, whatever their names.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinnabar.llm.common import discard, give_back, materialize, small_batches, whole_id
from cinnabar.llm.frequency import Statistics, preference, statistics
from cinnabar.llm.graph import roots
from cinnabar.llm.simhash import WORDS, emit
from cinnabar.llm.small_world import SmallWorld, components, exact_within

RADIUS = 52
#: Weight of a word in routing: idf to this power; and how likely near copies share the least word.
POWER, TOGETHER = 2, 0.75
#: Routing words beyond which no more tables are tried: each broadcasts an order of all terms (4 MB).
MOST_KEYS = 32
CODE = [f"c{w}" for w in range(WORDS)]


def routing(n: int, shard_nodes: int, share: float = 0.97) -> tuple[int, int, int]:
    """The number of shards, words in a key, and tables."""
    shards = max(1, math.ceil(n / shard_nodes))
    words = max(1, math.ceil(math.log2(shards) / 16))
    return shards, words, 1 if shards == 1 else math.ceil(math.log(1 - share) / math.log(1 - TOGETHER**words))


def codes(docs: DataFrame, stats: Statistics, keys: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, c0..c3, k0..): the id, SimHash and routing words of every document that has both an id and a word."""
    shared = docs.sparkSession.sparkContext.broadcast(np.stack([preference(stats, 100 + k, POWER) for k in range(keys)]))
    given = docs.select(whole_id(id_col).alias("d"), F.col(text_col).alias("t")).where("d is not null and t is not null")
    hashed = given.mapInArrow(emit(lambda: shared.value), "d long, " + ", ".join(f"{c} long" for c in [*CODE, *[f"k{k}" for k in range(keys)]]))
    return hashed.where(" or ".join(f"{c} <> 0" for c in CODE))


def _matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(table.column(c).to_numpy()).view(np.uint64) if isinstance(table, pa.Table) else table.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in CODE], axis=1)


def edges(nodes: DataFrame, shards: int, words: int, tables: int, radius: int, beam: int, graph_nodes: int) -> DataFrame:
    """(a, b), a > b: each node that has a neighbour, and the smallest node that it reaches within its shard."""
    key = lambda t: F.pmod(F.xxhash64(*[f"k{t * words + k}" for k in range(words)]), F.lit(shards))
    # few bytes but much work: by their number, as partitions sized by bytes would be too few
    tasks = max(1, tables * shards // 4)
    placed = nodes.select("d", *CODE, F.inline(F.array(*[F.struct(F.lit(t).alias("tab"), key(t).alias("shard")) for t in range(tables)])))
    placed = placed.repartition(tasks, "tab", "shard")

    def search(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("d")
        ids, all_codes = shard.column("d").to_numpy(), _matrix(shard)
        root = np.arange(len(ids))
        for start in range(0, len(ids), graph_nodes):
            world = SmallWorld(all_codes[start : start + graph_nodes])
            linked = lambda query, node: root[query] == root[node + start]  # noqa: B023, E731
            for query, node, _ in world.within(all_codes, radius, beam, linked):
                root = components(root, query, node + start)
        found = root != np.arange(len(ids))
        edge = pa.table({"a": ids[found], "b": ids[root[found]]})
        give_back()
        return edge

    return placed.groupBy("tab", "shard").applyInArrow(search, "a long, b long")


def audited(nodes: DataFrame, root: DataFrame, radius: int, sample: int) -> tuple[int, int]:
    """Of a bounded sample of nodes: their true pairs, and how many of these are in one group."""
    queries = nodes.orderBy(F.xxhash64(*CODE), "d").limit(sample).toArrow()
    if not queries.num_rows:
        return 0, 0
    ids, wanted = queries.column("d").to_numpy(), _matrix(queries)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, n = exact_within(_matrix(b), wanted, radius)
            yield pa.RecordBatch.from_pydict({"x": ids[q], "y": b.column("d").to_numpy()[n]})

    pairs = nodes.mapInArrow(scan, "x long, y long").where("x <> y")
    at = lambda c: root.select(F.col("a").alias(c), F.col("b").alias(f"r{c}"))
    same = F.coalesce("rx", "x") == F.coalesce("ry", "y")
    row = pairs.join(at("x"), "x", "left").join(at("y"), "y", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("k")).first()
    return row["n"], row["k"]


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shard_nodes: int = 1 << 11, graph_nodes: int = 1 << 16, beam: int = 16, audit: int = 512, recall: float = 0.9
) -> DataFrame:
    """(doc_id, kept_doc_id): every document that is a copy, exact or near, and the one of its group that stays."""
    small_batches(docs.sparkSession)
    stats = statistics(docs, text_col)
    shards, words, tables = routing(stats.n, shard_nodes)

    def coding(tables: int) -> tuple[DataFrame, DataFrame]:
        keys = [f"k{k}" for k in range(words * tables)]
        coded = materialize(codes(docs, stats, len(keys), id_col, text_col), "codes")
        return coded, materialize(coded.groupBy(*CODE).agg(F.min(F.struct("d", *keys)).alias("m")).select(*CODE, "m.*"), "nodes")

    coded, nodes = coding(tables)
    while True:
        found = edges(nodes, shards, words, tables, radius, beam, graph_nodes)
        root = roots(found.select(F.col("a"), F.col("b")), "edges")
        true, united = audited(nodes, root, radius, audit)
        if united >= recall * true:
            break
        if beam > 1024 or tables * words > MOST_KEYS:
            warnings.warn(f"the audit found {united} of {true} pairs with beams of {beam} and {tables} tables", stacklevel=2)
            break
        discard(root)
        discard(coded)
        discard(nodes)
        beam, tables = beam * 2, tables * 2 if shards > 1 else 1
        coded, nodes = coding(tables)
    # an id with several codes stands for several nodes: they are one document, hence linked by the id itself
    members = coded.join(nodes.select(*CODE, F.col("d").alias("b")), CODE).select(F.col("d").alias("a"), "b").distinct()
    to = root.select(F.col("a").alias("b"), F.col("b").alias("r"))
    kept = members.join(to, "b", "left").groupBy("a").agg(F.min(F.coalesce("r", "b")).alias("kept"))
    return kept.where("a <> kept").select(F.col("a").alias("doc_id"), F.col("kept").alias("kept_doc_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each group of copies."""
    gone = near_duplicates(docs, id_col, text_col, **options).select(F.col("doc_id").alias("__gone"))
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), whole_id(id_col).alias("__d"), F.xxhash64(F.col(text_col)).alias("__h"))
    left = row.join(gone, row["__d"] == gone["__gone"], "left_anti")
    again = F.row_number().over(Window.partitionBy("__d", "__h").orderBy(F.lit(0)))
    return left.withColumn("__k", again).where("__k = 1 or __d is null").select("__row.*")
