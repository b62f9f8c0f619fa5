"""Clusters by similarity of name and code within families of names, and their merge with clusters by category.

Functions are rows (name, code, category, file...).  Null code counts as empty.  Order within a family: name, then code.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinnabar.functions import text as X
from cinnabar.functions.parsing import sequence_ratio
from cinnabar.operators import detect
from cinnabar.sources.scratch import discard, materialize, spread

WEIGHTS = {"name": 0.2, "code": 0.4, "length": 0.1, "tokens": 0.3}
THRESHOLD, LEAST = 0.7, 3
#: Rows of a family that are compared with all others at a time.
BLOCK = 64


def likeness(name_a: Column, name_b: Column, code_a: Column, code_b: Column) -> Column:
    """The weighted likeness of two functions: names, code without comments, lengths, tokens."""
    w, plain = WEIGHTS, X.without_comments
    return (
        w["name"] * sequence_ratio(name_a, name_b) + w["code"] * sequence_ratio(plain(code_a), plain(code_b))
        + w["length"] * X.length_likeness(code_a, code_b) + w["tokens"] * X.token_likeness(X.code_tokens(code_a), X.code_tokens(code_b))
    )


def _bounded(one: str, two: str, least: float) -> float:
    """The matching-blocks ratio of two texts, or an upper bound of it that is under `least`."""
    m = SequenceMatcher(None, one, two)
    for bound in (m.real_quick_ratio(), m.quick_ratio()):
        if bound < least:
            return bound
    return m.ratio()


def _alike(a: pd.Series, b: pd.Series, threshold: float) -> bool:
    """Whether two functions (name, code, plain, tokens) are alike enough; cheap parts first."""
    longer = max(len(a["code"]), len(b["code"]), 1)
    rest = WEIGHTS["length"] * (1 - abs(len(a["code"]) - len(b["code"])) / longer)
    one, two = set(a["tokens"]), set(b["tokens"])
    rest += WEIGHTS["tokens"] * (len(one & two) / len(one | two) if one or two else 1.0)
    left = threshold - 1e-12 - rest
    if left > WEIGHTS["name"] + WEIGHTS["code"]:
        return False
    rest += WEIGHTS["name"] * SequenceMatcher(None, a["name"], b["name"]).ratio()
    need = (threshold - 1e-12 - rest) / WEIGHTS["code"]
    return need <= 1 and _bounded(a["plain"], b["plain"], need) >= need


def _leader(own: dict[int, int], led: dict[str, list], threshold: float) -> Callable[..., Column]:
    """The leader of each row: as found already, else the first of its family that is alike enough; null if none is."""

    def find(row: pd.Series, family: pd.Series, name: pd.Series, code: pd.Series, plain: pd.Series, tokens: pd.Series) -> pd.Series:
        out = []
        for k, f, *values in zip(row, family, name, code, plain, tokens, strict=True):
            r = dict(zip(("name", "code", "plain", "tokens"), values, strict=True))
            out.append(own[k] if k in own else next((x["__row"] for x in led.get(f, []) if _alike(x, r, threshold)), None))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(find, T.LongType())


def _led(functions: DataFrame, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """All rows (functions with __row and __code), and of each different name and code (name, __code) its family, first row, leader and copies.

    A copy of name and code is as alike to any leader as the first one, and to that one by 1: it has the same leader.
    """
    if threshold > 1:
        raise ValueError("a likeness is at most 1")
    rows = materialize(functions.withColumn("__row", F.monotonically_increasing_id()).withColumn("__code", F.coalesce("code", F.lit(""))), "functions")
    code = F.col("__code")
    each = rows.groupBy("name", "__code").agg(F.min("__row").alias("__row"), F.count(F.lit(1)).alias("__copies")).withColumn("family", X.pattern_family(F.col("name"), code))
    left = materialize(spread(each.withColumn("__plain", X.without_comments(code)).withColumn("__tokens", X.code_tokens(code)), "name", "__code"), "families")
    names = ["name", "__code", "family", "__row", "__copies", "__leader"]
    done = []
    order = Window.partitionBy("family").orderBy("name", "__code")
    while True:
        head = left.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= block)
        asked = head.select("family", "__k", "__row", "name", F.col("__code").alias("code"), F.col("__plain").alias("plain"), F.col("__tokens").alias("tokens")).toPandas()
        if asked.empty:
            break
        led: dict[str, list] = {}
        own: dict[int, int] = {}
        for _, r in asked.sort_values(["family", "__k"]).iterrows():
            mine = led.setdefault(r["family"], [])
            by = next((x["__row"] for x in mine if _alike(x, r, threshold)), None)
            own[r["__row"]] = by if by is not None else r["__row"]
            if by is None:
                mine.append(r)

        judged = materialize(left.withColumn("__leader", _leader(own, led, threshold)("__row", "family", "name", "__code", "__plain", "__tokens")), "leaders")
        done.append(judged.where("__leader is not null").select(*names))
        discard(left)
        left = judged.where("__leader is null").drop("__leader")
    each = done[0] if done else left.withColumn("__leader", F.col("__row")).select(*names)
    for d in done[1:]:
        each = each.unionByName(d)
    return rows, each


def _of_rows(rows: DataFrame, each: DataFrame, *found: str) -> DataFrame:
    """rows with what was found for their name and code."""
    known = each.select(F.col("name").alias("__name"), F.col("__code").alias("__text"), *found)
    return rows.join(known, rows["name"].eqNullSafe(F.col("__name")) & (rows["__code"] == F.col("__text"))).drop("__name", "__text")


def leaders(functions: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """functions with family, leader and row_id: in order, each function not taken yet leads, and takes the later ones alike enough.

    Each different name and code is looked at once.  Families run side by side; of each the first `block` functions left are
    looked at by the driver, which finds the leaders among them, and all others of the family are compared with these where
    they are.  So no task holds a family, however large, and the result is that of the greedy walk.  Leaders' texts reach the
    driver a block at a time.
    """
    rows, each = _led(functions, threshold, block)
    found = _of_rows(rows, each, "family", F.col("__leader").alias("leader"))
    return found.select(*functions.columns, "family", F.col("__row").alias("row_id"), "leader")


def similarity_members(functions: DataFrame, threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """Members of the clusters of at least `least`: functions with family and group_id.

    A family of exactly `least` is one cluster as it is.  A family's clusters are numbered in order of their leaders if
    there are several.
    """
    rows, each = _led(functions, threshold, BLOCK)
    whole = Window.partitionBy("family")
    families = each.groupBy("family").agg(F.sum("__copies").alias("__f")).where(F.col("__f") >= least)
    sized = each.join(families, "family").withColumn("leader", F.when(F.col("__f") == least, F.lit(-1)).otherwise(F.col("__leader")))
    # a leader is the first of its group by name and code
    first = sized.groupBy("family", "leader").agg(F.sum("__copies").alias("__n"), F.min(F.struct("name", "__code", "__row")).alias("__first")).where(F.col("__n") >= least)
    first = first.withColumn("__i", F.row_number().over(whole.orderBy("__first")) - 1).withColumn("__m", F.count(F.lit(1)).over(whole))
    base = F.concat(F.lit("similarity_"), "family")
    group_id = F.when(F.col("__m") > 1, F.concat_ws("_", base, F.col("__i").cast("string"))).otherwise(base)
    kept = sized.join(first.select("family", "leader", group_id.alias("group_id")), ["family", "leader"])
    return _of_rows(rows, kept, "family", "group_id").select(*functions.columns, "family", "group_id", F.col("__row").alias("row_id"))


def pair_means(members: DataFrame) -> DataFrame:
    """(group_id, pairs, avg_similarity) over all pairs of each cluster; functions of one name and code are compared once."""
    side = members.groupBy("group_id", "name", F.coalesce("code", F.lit("")).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    # the ratio isn't symmetric: the earlier by name and code comes first
    before = F.struct("a.name", "a.code") < F.struct("b.name", "b.code")
    a, b = side.alias("a"), side.alias("b")
    pairs = a.join(b, (F.col("a.group_id") == F.col("b.group_id")) & before)
    score = likeness(F.col("a.name"), F.col("b.name"), F.col("a.code"), F.col("b.code"))
    across = pairs.select(F.col("a.group_id").alias("group_id"), (F.col("a.n") * F.col("b.n")).alias("k"), score.alias("s"))
    within = side.where("n > 1").select("group_id", F.expr("n * (n - 1) div 2").alias("k"), F.lit(1.0).alias("s"))
    return across.unionByName(within).groupBy("group_id").agg(F.sum("k").alias("pairs"), (F.sum(F.col("k") * F.col("s")) / F.sum("k")).alias("avg_similarity"))


def similarity_clusters(functions: DataFrame, threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """(group_id, label, size, avg_similarity, confidence) of the clusters by similarity."""
    return member_clusters(materialize(similarity_members(functions, threshold, least), "members"))


def member_clusters(members: DataFrame) -> DataFrame:
    """similarity_clusters() of their members."""
    sized = members.groupBy("group_id", "family").agg(
        F.count(F.lit(1)).alias("size"), F.min("name").alias("lo"), F.max("name").alias("hi"), F.min(F.reverse("name")).alias("rlo"), F.max(F.reverse("name")).alias("rhi"),
    )
    label = X.cluster_label(F.col("lo"), F.col("hi"), F.col("rlo"), F.col("rhi"), F.col("family"))
    joined = sized.join(pair_means(members), "group_id", "left").withColumn("label", label)
    mean = F.coalesce("avg_similarity", F.lit(1.0))
    confidence = F.when(F.col("size") < 2, 0.5).otherwise(mean * 0.7 + F.least(F.lit(1.0), F.col("size") / 10) * 0.3)
    return joined.select("group_id", "label", "size", F.round(mean, 6).alias("avg_similarity"), F.round(confidence, 6).alias("confidence"))


def classified_members(functions: DataFrame) -> DataFrame:
    """Functions under the category that their code's structure suggests, with its confidence."""
    flags = X.structure_flags(F.coalesce("code", F.lit("")), named=True)
    return functions.withColumn("__s", flags).withColumn("category", F.col("__s.category")).withColumn("confidence", F.col("__s.confidence")).drop("__s").withColumn("group_id", F.concat(F.lit("category_"), "category"))


def classified_clusters(functions: DataFrame) -> DataFrame:
    """(group_id, label, size, confidence): clusters by the classifier's category; the mean confidence of their members."""
    members = classified_members(functions)
    return members.groupBy("group_id", F.col("category").alias("label")).agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("confidence"), 6).alias("confidence"))


def overlaps(category: DataFrame, similar: DataFrame) -> DataFrame:
    """(cat_id, sim_id, ratio): how much of a similarity cluster's names a category cluster has; members are (group_id, name)."""
    sims = similar.select(F.col("group_id").alias("sim_id"), "name").distinct()
    cats = category.select(F.col("group_id").alias("cat_id"), "name").distinct()
    size = sims.groupBy("sim_id").agg(F.count(F.lit(1)).alias("n"))
    both = cats.join(sims, "name").groupBy("cat_id", "sim_id").agg(F.count(F.lit(1)).alias("common"))
    return both.join(size, "sim_id").select("cat_id", "sim_id", (F.col("common") / F.col("n")).alias("ratio"))


def unassigned(members: DataFrame, assigned: DataFrame) -> DataFrame:
    """Members whose names no assigned member has."""
    return members.join(assigned.select("name").distinct(), "name", "left_anti")


def merge(category: DataFrame, similar: DataFrame, category_info: DataFrame, similar_info: DataFrame, functions: DataFrame, least: int = LEAST) -> DataFrame:
    """(group_id, label, confidence, size, ratios): category clusters refined by the similarity clusters that they overlap,
    what is left of similarity clusters, and the rest.

    category, similar: members (group_id, name...); the infos: group_id, label, confidence.  A similarity cluster is used up
    in order of its id: a name that an earlier one takes isn't left for the next.
    """
    each = overlaps(category, similar)
    rank = F.row_number().over(Window.partitionBy("cat_id").orderBy(F.desc("ratio"), "sim_id"))
    best = each.withColumn("k", rank).where("k <= 3")
    info = similar_info.select(F.col("group_id").alias("sim_id"), F.col("label").alias("sim_label"), F.col("confidence").alias("sim_confidence"))
    first = best.where("k = 1").join(info, "sim_id").select("cat_id", "sim_label", "sim_confidence", F.col("ratio").alias("top"))
    ratios = best.groupBy("cat_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.round("ratio", 6).alias("r")))), lambda x: x["r"]).alias("ratios"))
    base = category_info.select(F.col("group_id").alias("cat_id"), "label", "confidence").join(category.groupBy(F.col("group_id").alias("cat_id")).agg(F.count(F.lit(1)).alias("size")), "cat_id")
    joined = base.join(first, "cat_id", "left").join(ratios, "cat_id", "left")
    strong = F.coalesce(F.col("top") > 0.7, F.lit(False))
    refined = joined.select(
        F.when(F.col("top").isNotNull(), F.concat(F.lit("hybrid_"), "cat_id")).otherwise(F.col("cat_id")).alias("group_id"),
        F.when(strong, F.concat_ws(" - ", "label", "sim_label")).otherwise(F.col("label")).alias("label"),
        F.round(F.when(strong, (F.col("confidence") + F.col("sim_confidence")) / 2).otherwise(F.col("confidence")), 6).alias("confidence"), "size", "ratios",
    )
    # a name goes to the first similarity cluster that is large enough when it is reached; clusters of one family share no rows
    free = unassigned(similar.select("group_id", "name"), category)
    counted = free.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    more = counted.join(similar_info.select("group_id", "label", "confidence"), "group_id").select(F.concat(F.lit("hybrid_"), "group_id").alias("group_id"), "label", F.round(F.col("confidence") * 0.9, 6).alias("confidence"), "size", F.lit(None).cast("array<double>").alias("ratios"))
    used = category.select("name").union(free.join(counted.select("group_id"), "group_id", "left_semi").select("name"))
    rest = unassigned(functions.select("name"), used).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    misc = rest.select(F.lit("hybrid_miscellaneous").alias("group_id"), F.lit("Miscellaneous Functions").alias("label"), F.lit(0.5).alias("confidence"), "size", F.lit(None).cast("array<double>").alias("ratios"))
    return refined.unionByName(more).unionByName(misc)


def merged_clusters(functions: DataFrame) -> DataFrame:
    """Clusters by category and similarity, merged."""
    similar = materialize(similarity_members(functions), "similar")
    return merge(classified_members(functions).select("group_id", "name"), similar.select("group_id", "name"), classified_clusters(functions), member_clusters(similar), functions)


def cluster_duplicates(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(group_id, id_a, id_b, similarity_score) within clusters (group_id, id, name, code): each further function of a skeleton with its first.

    Functions of one skeleton have a likeness of 1; others of the group aren't compared.  Every function of a class of
    equal skeletons is linked to the first, which stands for all pairs of the class.
    """
    known = members.where((F.length("code") > 0) & (F.length("name") > 0)).withColumn("norm", X.skeleton(F.col("code")))
    first = known.groupBy("group_id", "norm").agg(F.min("id").alias("id_a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = known.join(first, ["group_id", "norm"]).where("id > id_a")
    return pairs.where(F.lit(1.0) >= threshold).select("group_id", "id_a", F.col("id").alias("id_b"), F.lit(1.0).alias("similarity_score"))


def group_detector(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Duplicates within the groups of records whose names share a prefix (the group-based detector)."""
    named = records.where((F.length("code_content") > 0) & (F.length("function_name") > 0))
    key = X.prefix_key(F.col("function_name"))
    return cluster_duplicates(named.select("id", key.alias("group_id"), F.col("function_name").alias("name"), F.col("code_content").alias("code")), threshold)


detect.DETECTORS["group_based"] = group_detector
