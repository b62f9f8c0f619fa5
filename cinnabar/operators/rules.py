"""Split rules: tagging records by the first rule that matches, rule statistics, and bisection of large groups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinnabar.operators import judge
from cinnabar.operators.judge import Factory
from cinnabar.sources.scratch import discard, materialize


def first_match(name: Column, patterns: list[str]) -> Column:
    """The first pattern, in the order given, that is found in a name whatever its case; null if none.  One that can't be read matches nothing."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when(name.rlike(f"(?i){p}"), F.lit(p)).otherwise(out) if is_valid(p) else out
    return out


def ordered(rules: DataFrame) -> list[str]:
    """The patterns of a rule table, the most successful and then the newest first."""
    return [r["pattern"] for r in rules.orderBy(F.desc("success_count"), F.desc("created_at"), "id").select("pattern").collect()]


def outcomes(log: DataFrame) -> DataFrame:
    """(pattern, success_count, failure_count) of a log (pattern, success)."""
    return log.groupBy("pattern").agg(F.count_if("success").alias("success_count"), F.count_if(~F.col("success")).alias("failure_count"))


def statistics(rules: DataFrame) -> DataFrame:
    tried = F.col("success_count") + F.col("failure_count")
    return rules.agg(F.count(F.lit(1)).alias("rules"), F.coalesce(F.sum("success_count"), F.lit(0)).alias("successes"), F.coalesce(F.sum("failure_count"), F.lit(0)).alias("failures"), F.round(F.coalesce(F.avg(F.col("success_count") / F.nullif(tried, F.lit(0))), F.lit(0.0)), 6).alias("avg_success"))


def effective(rules: DataFrame, least: float = 0.2, trials: int = 5) -> DataFrame:
    """Rules that were tried little, or succeed often enough."""
    tried = F.col("success_count") + F.col("failure_count")
    return rules.where((tried <= trials) | (F.col("success_count") / tried >= least))


#: Flags of a rule on code: lines have starts and ends, and a dot is any character.
FLAGS = "(?ms)"


def is_valid(pattern: str) -> bool:
    """Whether a pattern can be read at all, here and by the JVM."""
    from pyspark import SparkContext

    try:
        re.compile(pattern)
        context = SparkContext._active_spark_context
        if context is not None:
            context._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001
        return False
    return True


def _hits(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(FLAGS + pattern), F.lit(False)) if is_valid(pattern) else F.lit(False)


def validity(members: DataFrame, patterns: list[str], text_col: str = "code") -> DataFrame:
    """(group_id, ord, pattern, matched, size, valid): a pattern splits a group if it is found in some members and not in all.

    A pattern that can't be read splits nothing; null text isn't matched.
    """
    hits = [F.count_if(_hits(F.col(text_col), p)).alias(f"m{k}") for k, p in enumerate(patterns)]
    counted = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), *hits)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(p).alias("pattern"), F.col(f"m{k}").alias("matched")) for k, p in enumerate(patterns)])).alias("r")
    rows = counted.select("group_id", "size", each).select("group_id", "size", "r.*")
    return rows.withColumn("valid", (F.col("matched") > 0) & (F.col("matched") < F.col("size")))


def _halve(now: DataFrame, patterns: list[str], columns: list[str], text_col: str, most: int, factor: float) -> DataFrame:
    """Groups of more than `most` members halved by the first valid pattern."""
    if not patterns:
        return now
    size = now.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), *[F.count_if(_hits(F.col(text_col), p)).alias(f"m{k}") for k, p in enumerate(patterns)])
    choice = F.lit(None).cast("int")
    for k in reversed(range(len(patterns))):
        choice = F.when((F.col(f"m{k}") > 0) & (F.col(f"m{k}") < F.col("size")), F.lit(k)).otherwise(choice)
    chosen = size.where(F.col("size") > most).select("group_id", choice.alias("__rule")).where("__rule is not null")
    hit = F.lit(False)
    for k, p in enumerate(patterns):
        hit = F.when(F.col("__rule") == k, _hits(F.col(text_col), p)).otherwise(hit)
    joined = now.join(chosen, "group_id", "left")
    halved = F.col("__rule").isNotNull()
    new = {
        "group_id": F.when(halved, F.concat("group_id", F.when(hit, "_a").otherwise("_b"))).otherwise(F.col("group_id")),
        "confidence": F.when(halved, F.col("confidence") * factor).otherwise(F.col("confidence")),
        "split_count": F.col("split_count") + F.when(halved, 1).otherwise(0),
        "parent": F.when(halved, F.col("group_id")).otherwise(F.col("parent")),
    }
    return joined.select(*[c for c in columns if c not in new], *[v.alias(c) for c, v in new.items()])


def bisect(members: DataFrame, patterns: list[str], most: int = 100, depth: int = 3, text_col: str = "code") -> DataFrame:
    """Members (group_id, confidence, text...) with groups of more than `most` halved by the first valid rule, `depth` times.

    Adds split_count and parent: how often a member's group was halved, and what it was before the last time.
    """
    now = members.withColumn("split_count", F.lit(0)).withColumn("parent", F.lit(None).cast("string"))
    for _ in range(depth):
        now = _halve(now, patterns, members.columns, text_col, most, 0.9)
    return now


def bisect_with_judge(members: DataFrame, patterns: list[str], factory: Factory, most: int = 100, depth: int = 3, attempts: int = 3, samples: int = 5) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The same over members (group_id, name, code, confidence), and new rules (pattern, reasoning).

    A group that no rule splits is shown to the judge, `samples` functions at a time; an answer that splits it is a new rule
    for it and all groups after it, at a confidence of 0.85.  A group that still can't be split is an error.
    """
    new: list[tuple[str, str]] = []
    now = members.withColumn("split_count", F.lit(0)).withColumn("parent", F.lit(None).cast("string"))
    for level in range(depth):
        before = now = materialize(now, "groups")
        now = materialize(_halve(now, patterns + [p for p, _ in new], members.columns, "code", most, 0.9), "groups")
        discard(before)
        while True:
            large = now.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.max("split_count").alias("s")).where((F.col("n") > most) & (F.col("s") < depth))
            untouched = large.where(F.col("s") <= level).orderBy("group_id").first()
            if untouched is None:
                break
            group, rule = untouched["group_id"], None
            for k in range(attempts):
                try:
                    pattern, reasoning, _a, _b = judge.split_pattern(judge.sample(now, group, samples, k), factory)
                except Exception:  # noqa: BLE001, S112
                    continue
                if validity(now.where(F.col("group_id") == group), [pattern]).where("valid").count():
                    rule = (pattern, reasoning)
                    break
            if rule is None:
                raise judge.unsplittable(group, attempts)
            new.append(rule)
            one = F.col("group_id") == group
            halved = _halve(now.where(one), [rule[0]], members.columns, "code", most, 0.85)
            before, now = now, materialize(now.where(~one).unionByName(halved), "groups")
            discard(before)
    return now, new


def apply_statistics(rules: DataFrame, log: DataFrame) -> DataFrame:
    """rules with the outcomes of a log (pattern, success) added to their counts."""
    more = outcomes(log).select("pattern", F.col("success_count").alias("__s"), F.col("failure_count").alias("__f"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rules.join(more, "pattern", "left").withColumn("success_count", zero("success_count") + zero("__s")).withColumn("failure_count", zero("failure_count") + zero("__f")).select(*rules.columns)


def by_pattern(rules: DataFrame, pattern: str) -> DataFrame:
    return rules.where(F.col("pattern") == pattern).orderBy("id").limit(1)
