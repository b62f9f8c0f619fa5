"""URL filtering by a trie over reversed host labels and path segments.

An entry is a host, or a host and a path.  A host entry also covers its subdomains; an entry with a path covers that
exact host, below that path, segment by segment.  Of all entries on a URL's way through the trie the longest decides;
where the same entry is both allowed and blocked, block wins.

Entries are broadcast as a trie while there are at most `broadcast_limit` of them, of `broadcast_bytes` in all, as counted
first; a larger list is joined on the exploded prefixes of each URL instead, with the same rows.

Defined cases
* Scheme, user, port, query and fragment play no part; the host's case doesn't count, a final dot is dropped, empty path segments
  are skipped.  "//" and a scheme may be missing.  Percent-encoded and punycode text is compared as it stands.
* A null URL or one without a host matches nothing: depth 0, entry null, decision = default.
* Repeated URLs and entries are judged alike; empty tables and empty lists work.  Other columns pass through; columns
  named decision, entry and depth are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinnabar.llm.common import materialize

STEP = "\x1f"
RESULT = T.StructType([T.StructField("decision", T.StringType()), T.StructField("entry", T.StringType()), T.StructField("depth", T.IntegerType())])


def way(url: Column) -> Column:
    """The trie keys of a URL from the top: reversed labels, then "/segment" for each path segment; null without a host."""
    bare = F.regexp_replace(F.regexp_replace(F.btrim(url), "^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), "^//", "")
    authority = F.regexp_extract(bare, "^([^/?#]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", "")), r"\.+$", "")
    path = F.regexp_extract(bare, "^[^/?#]*([^?#]*)", 1)
    labels = F.reverse(F.split(host, r"\.", -1))
    segments = F.transform(F.filter(F.split(path, "/", -1), lambda s: s != ""), lambda s: F.concat(F.lit("/"), s))
    return F.when(host != "", F.concat(labels, segments))


def build_trie(entries: Iterable[tuple[list[str], str, str]]) -> dict:
    """entries: keys, action, the entry as written.  A node's "" holds (action, entry)."""
    root: dict = {}
    for keys, action, entry in sorted(entries, key=lambda x: (x[1] != "block", x[2])):
        node = root
        for k in keys:
            node = node.setdefault(k, {})
        node.setdefault("", (action, entry))
    return root


def longest(trie: dict, keys: list[str]) -> tuple[str | None, str | None, int]:
    best: tuple[str | None, str | None, int] = (None, None, 0)
    node = trie
    for depth, k in enumerate(keys, 1):
        node = node.get(k)
        if node is None:
            break
        if "" in node:
            best = (*node[""], depth)
    return best


def url_filter(pages: DataFrame, entries: DataFrame, url_col: str = "url", default: str = "allow", broadcast_limit: int = 1_000_000, broadcast_bytes: int = 1 << 26) -> DataFrame:
    """pages with decision, entry and depth.  entries: columns entry (host or host/path) and action (allow or block)."""
    spark = pages.sparkSession
    rules = entries.select(F.array_join(way(F.col("entry")), STEP).alias("k"), F.lower("action").alias("a"), F.col("entry").alias("e"))
    rules = rules.where(F.col("k").isNotNull() & F.col("a").isin("allow", "block"))
    names = [c for c in pages.columns if c.lower() not in RESULT.names]
    rows = pages.select(F.struct(*[pages[f"`{c}`"] for c in names]).alias("__row"), way(pages[f"`{url_col}`"]).alias("__way"))
    size = rules.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("k") + F.octet_length("e")), F.lit(0)).alias("bytes")).first()
    if size["n"] <= broadcast_limit and size["bytes"] <= broadcast_bytes:
        trie = spark.sparkContext.broadcast(build_trie((r.k.split(STEP), r.a, r.e) for r in rules.collect()))

        @F.pandas_udf(RESULT)
        def judge(ways: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            root = trie.value
            for batch in ways:
                yield pd.DataFrame([longest(root, w.split(STEP)) if w is not None else (None, None, 0) for w in batch], columns=RESULT.names)

        hit = rows.select("__row", judge(F.array_join("__way", STEP)).alias("__hit"))
    else:
        best = rules.groupBy("k").agg(F.min(F.struct(F.when(F.col("a") == "block", 0).otherwise(1).alias("o"), "e", "a")).alias("b"))
        ways = rows.select(F.array_join("__way", STEP).alias("w"), "__way").where("w is not null").distinct()
        step = F.explode(F.transform(F.sequence(F.lit(1), F.size("__way")), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice("__way", F.lit(1), n), STEP).alias("k"))))
        steps = ways.select("w", step.alias("s")).select("w", "s.*")
        found = steps.join(best, "k").groupBy("w").agg(F.max_by(F.struct(F.col("b.a").alias("decision"), F.col("b.e").alias("entry"), F.col("depth").cast("int").alias("depth")), "depth").alias("__hit"))
        hit = rows.withColumn("w", F.array_join("__way", STEP)).join(materialize(found, "urls"), "w", "left")
    return hit.select(
        *[F.col("__row")[c].alias(c) for c in names],
        F.coalesce(F.col("__hit.decision"), F.lit(default)).alias("decision"),
        F.col("__hit.entry").alias("entry"),
        F.coalesce(F.col("__hit.depth"), F.lit(0)).alias("depth"),
    )
