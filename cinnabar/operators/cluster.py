"""Clusters of functions (name, category, file, complexity), their quality, splits and proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinnabar.functions import text as X


def by_category(functions: DataFrame) -> DataFrame:
    """Members with the cluster of their category."""
    return functions.select("*", F.concat(F.lit("category_"), "category").alias("group_id"), F.concat(X.title(F.col("category")), F.lit(" Functions")).alias("label"), F.lit(0.9).alias("confidence"))


def by_prefix(functions: DataFrame) -> DataFrame:
    """Members with the cluster of their name's prefix; prefixes of one member share a pool."""
    key = X.prefix_key(F.col("name"))
    shared = F.count(F.lit(1)).over(Window.partitionBy("prefix")) > 1
    keyed = functions.withColumn("prefix", key).withColumn("shared", shared)
    return keyed.select(
        *functions.columns, F.when(F.col("shared"), F.concat(F.lit("semantic_"), "prefix")).otherwise("semantic_unclustered").alias("group_id"),
        F.when(F.col("shared"), F.concat(F.initcap("prefix"), F.lit(" Functions"))).otherwise("Unclustered Functions").alias("label"), F.when(F.col("shared"), 0.7).otherwise(0.5).alias("confidence"),
    )


def hybrid(functions: DataFrame, most: int = 5) -> DataFrame:
    """Clusters by category; those of more than `most` members are split by prefix."""
    prefix = X.prefix_key(F.col("name"))
    counted = functions.withColumn("prefix", prefix).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("category"))).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("category", "prefix")))
    sub = F.when(F.col("m") > 1, F.col("prefix")).otherwise("unclustered")
    split = F.col("n") > most
    return counted.select(
        *functions.columns, F.when(split, F.concat_ws("_", F.lit("category"), "category", sub)).otherwise(F.concat(F.lit("category_"), "category")).alias("group_id"),
        F.when(split, F.when(F.col("m") > 1, 0.7).otherwise(0.5)).otherwise(0.9).alias("confidence"),
    )


STRATEGIES = {"category": by_category, "prefix": by_prefix, "hybrid": hybrid}


def clusters(functions: DataFrame, strategy: str = "category") -> DataFrame:
    """Members with their clusters; an unknown strategy is by category."""
    return STRATEGIES.get(strategy, by_category)(functions)


def sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))


def quality(members: DataFrame) -> DataFrame:
    """Clusters, members, mean size, and the largest and smallest cluster (the first by id of equals)."""
    s = sizes(members)
    return s.agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("size").alias("members"), F.bround(F.avg("size"), 2).alias("avg_size"),
        F.min_by("group_id", F.struct(-F.col("size"), "group_id")).alias("largest"), F.min_by("group_id", F.struct("size", "group_id")).alias("smallest"),
    )


def split_suggestions(members: DataFrame, least: int = 4) -> DataFrame:
    """For clusters of `least` members and more in several files: the main file, and how many stand there and elsewhere."""
    per_file = members.groupBy("group_id", "file").agg(F.count(F.lit(1)).alias("n"))
    whole = per_file.groupBy("group_id").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("files"), F.min_by("file", F.struct(-F.col("n"), "file")).alias("main_file"), F.max("n").alias("in_main"))
    return whole.where((F.col("size") >= least) & (F.col("files") > 1)).select("group_id", "main_file", "in_main", (F.col("size") - F.col("in_main")).alias("elsewhere"))


def split_metrics(members: DataFrame) -> DataFrame:
    s = sizes(members)
    return s.agg(F.count(F.lit(1)).alias("groups"), F.max("size").alias("max_size"), F.round(F.avg("size"), 4).alias("avg_size"), F.count_if(F.col("size") > 20).alias("over_20"), F.count_if(F.col("size") <= 15).alias("up_to_15"))


def proposals(groups: DataFrame) -> DataFrame:
    """Refactoring proposals of groups (group_id, label, size), the weightiest first."""
    label, size = F.lower("label"), F.col("size")
    is_a = lambda *words: F.greatest(*[label.contains(w) for w in words], F.lit(False))
    setter, getter, business = is_a("set", "setter"), is_a("get", "getter"), is_a("business", "logic", "process")

    def one(when: Column, kind: str, impact: str, effort: str) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(impact).alias("impact"), F.lit(effort).alias("effort")))

    every = F.array(
        one(setter & (size > 10), "extract_class", "high", "medium"), one(setter & (size > 15), "unify_interface", "medium", "low"),
        one(getter & (size > 10), "centralize_access", "medium", "low"), one(business & (size > 8), "layer_logic", "high", "high"), one(size > 20, "layer_module", "high", "high"),
    )
    found = groups.where(size >= 5).select("group_id", "size", F.explode(F.array_compact(every)).alias("p")).select("group_id", "size", "p.*")
    return found.orderBy(X.ordinal(F.col("impact")).desc(), X.ordinal(F.col("effort")), "group_id", "kind")


def complexity_histogram(functions: DataFrame) -> DataFrame:
    c = F.col("complexity")
    band = F.when(c < 5, "low").when(c < 10, "medium").when(c < 20, "high").otherwise("very_high")
    return functions.where("complexity > 0").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def complexity_report(functions: DataFrame, threshold: int = 10) -> DataFrame:
    return functions.where(F.col("complexity") >= threshold).orderBy(F.desc("complexity"), "name", "file")


def file_statistics(functions: DataFrame) -> DataFrame:
    return functions.groupBy("file").agg(F.count(F.lit(1)).alias("units"), F.sum("complexity").alias("total"), F.round(F.avg("complexity"), 4).alias("mean"), F.max("complexity").alias("most"))


def large_groups(functions: DataFrame, threshold: int = 20) -> DataFrame:
    return functions.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > threshold)


def functions_of(units: DataFrame) -> DataFrame:
    """The functions among units, as clusters take them: name, code, file, category, line_number, complexity."""
    return units.where(F.col("type") == "function").select(
        "name", F.col("source_code").alias("code"), F.coalesce("file_path", F.lit("unknown")).alias("file"), F.lit("unknown").alias("category"),
        F.coalesce("start_line", F.lit(0)).alias("line_number"), F.coalesce("complexity_score", F.lit(0)).alias("complexity"),
    )


def should_split(size: Column, most: int = 20) -> Column:
    return size > most


def recommended_strategy(size: Column) -> Column:
    """None for any group: groups are split by rules and judges, not by size."""
    return F.lit(None).cast("string")


def split_by_size(members: DataFrame) -> DataFrame:
    """The groups as they are, for the same reason."""
    return members


def split_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Groups, their largest and mean size before and after a split, sizes over 20 and up to 15 after it, and the factor."""

    def one(members: DataFrame, name: str) -> DataFrame:
        s = sizes(members)
        extra = [F.count_if(F.col("size") > 20).alias("over_20"), F.count_if(F.col("size") <= 15).alias("up_to_15")] if name == "split" else []
        return s.agg(F.count(F.lit(1)).alias(f"{name}_groups"), F.coalesce(F.max("size"), F.lit(0)).alias(f"{name}_largest"), F.round(F.coalesce(F.avg("size"), F.lit(0.0)), 4).alias(f"{name}_average"), *extra).withColumn("__k", F.lit(1))

    factor = F.when(F.col("original_groups") > 0, F.round(F.col("split_groups") / F.col("original_groups"), 4)).otherwise(0.0)
    return one(before, "original").join(one(after, "split"), "__k").drop("__k").withColumn("factor", factor)


def exported(members: DataFrame) -> DataFrame:
    """(group_id, json) of each cluster: its id, size and members' names in order."""
    return members.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("name")).alias("functions")).select("group_id", F.to_json(F.struct("group_id", "size", "functions")).alias("json"))
