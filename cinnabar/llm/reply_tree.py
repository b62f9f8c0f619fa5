"""Chat formatting from reply trees.

Messages point at the message that they answer.  Self-joins that double the known stretch of every path each time
(so a chain of n messages takes log2 n joins) give the path from the root to every message; the paths of the leaves
are the branches, ranked within a conversation by their mean message score, and each chosen branch is written as one
conversation.

Defined cases
* A message whose parent is missing is a root; messages on, or hanging from, a cycle of replies are left out.
* Rows without a conversation or message id (or turn) are left out; exactly repeated rows count once; a null role is
  "unknown", a null text "".  Empty tables give empty tables.
* Ranking: mean score, then more messages, then the smaller path of message ids.
* Only the named columns are read, so others may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinnabar.llm.common import discard, materialize


def word_score(text: Column) -> Column:
    """Words of a text: runs of anything but spaces and line ends."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[ \n]", -1), lambda w: w != "")
    return F.size(words).cast("double")


def tree_from_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages (conv, node, parent, role, text, score) of a table of turns.

    Different rows of the same turn are alternative replies to the same message; the first of them, by role and
    text, is the one that the next turn answers.
    """
    base = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.where("conv is not null and turn is not null").distinct()
    by_turn = Window.partitionBy("conv").orderBy("turn")
    node = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")).cast("long")
    first = F.min("node").over(Window.partitionBy("conv", "turn"))
    numbered = base.withColumn("node", node).withColumn("first", first)
    before = F.max("first").over(by_turn.rangeBetween(Window.unboundedPreceding, -1))
    return numbered.withColumn("parent", before).select("conv", "node", "parent", "role", "text", word_score(F.col("text")).alias("score"))


def root_paths(messages: DataFrame) -> DataFrame:
    """(conv, node, path, total) of every message: node ids from the root, and the sum of their scores."""
    base = messages.where("conv is not null and node is not null").groupBy("conv", "node").agg(F.min("parent").alias("parent"), F.max("score").alias("score"))
    there = base.select("conv", F.col("node").alias("parent"), F.lit(True).alias("there"))
    state = base.join(there, ["conv", "parent"], "left").select(
        "conv", "node", F.when(F.col("there"), F.col("parent")).alias("ptr"), F.array("node").alias("path"),
        F.coalesce("score", F.lit(0.0)).alias("total"), F.lit(False).alias("lost"),
    )
    state = materialize(state, "paths")
    while state.where("ptr is not null").limit(1).count():
        s, t = state.alias("s"), state.alias("t")
        step = s.join(t, (F.col("s.conv") == F.col("t.conv")) & (F.col("s.ptr") == F.col("t.node")), "left")
        ptr, path = F.col("t.ptr"), F.when(F.col("t.path").isNotNull(), F.concat("t.path", "s.path")).otherwise(F.col("s.path"))
        step = step.select(
            F.col("s.conv").alias("conv"), F.col("s.node").alias("node"), ptr.alias("ptr"), path.alias("path"),
            (F.col("s.total") + F.coalesce("t.total", F.lit(0.0))).alias("total"),
            (F.col("s.lost") | F.coalesce("t.lost", F.lit(False))).alias("lost"),
        )
        circle = F.col("ptr").isNotNull() & F.array_contains("path", F.col("ptr"))
        step = step.withColumn("lost", F.col("lost") | circle)
        new = step.select("conv", "node", F.when(~F.col("lost"), F.col("ptr")).alias("ptr"), F.when(F.col("lost"), F.array("node")).otherwise(F.col("path")).alias("path"), "total", "lost")
        new = materialize(new, "paths")
        discard(state)
        state = new
    return state.where(~F.col("lost")).select("conv", "node", "path", "total")


def reply_trees(messages: DataFrame, keep: int | None = None, opening: str = "<|{role}|>\n", closing: str = "<|end|>\n") -> DataFrame:
    """All branches of each conversation, or the best `keep`, by rank: conv_id, branch, n_messages, score, text."""
    messages = materialize(messages, "messages")  # read several times
    paths = root_paths(messages)
    parents = messages.where("parent is not null").select("conv", F.col("parent").alias("node")).distinct()
    leaves = paths.join(parents, ["conv", "node"], "left_anti")
    score = (F.col("total") / F.size("path")).alias("score")
    order = Window.partitionBy("conv").orderBy(F.desc("score"), F.desc(F.size("path")), "path")
    best = leaves.select("conv", "path", score).withColumn("branch", F.row_number().over(order))
    best = best if keep is None else best.where(F.col("branch") <= keep)
    each = best.select("conv", "branch", "score", F.posexplode("path").alias("at", "node"))
    texts = messages.groupBy("conv", "node").agg(F.min(F.struct("role", "text")).alias("m"))
    before, after = opening.split("{role}")
    line = F.concat(F.lit(before), F.coalesce(F.col("m.role"), F.lit("unknown")), F.lit(after), F.coalesce(F.col("m.text"), F.lit("")), F.lit(closing))
    parts = each.join(texts, ["conv", "node"]).groupBy("conv", "branch", "score").agg(F.sort_array(F.collect_list(F.struct("at", line.alias("line")))).alias("p"))
    return parts.select(F.col("conv").alias("conv_id"), "branch", F.size("p").alias("n_messages"), "score", F.array_join(F.col("p.line"), "").alias("text"))
