"""Line dedup over overlapping windows of three consecutive lines.

Every run of three consecutive non-blank lines is a window.  A window that occurs more than once anywhere keeps
its first occurrence, in order of document and position; the lines that any later occurrence covers are removed
(the union of the covered positions, so overlapping occurrences merge).  Every removed line still stands at an
earlier place of the corpus.

Defined cases
* Lines are compared without spaces, tabs and carriage returns at their ends; blank lines form no window and stay,
  unless nothing else is left of a document, which then has the text "".
* A null text stays null; empty tables give empty tables; a text of fewer than three non-blank lines stays as it is.
* Order of documents: by id, null ids last, then by the hash of the text.  Repeated identical rows are one document:
  each copy of the row gets the same text.
* Other columns pass through whatever their names; only the text column changes and `lines_removed` is added, replacing a
  column of that name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinnabar.llm.common import key_columns, materialize

BLANKS = " \t\r"
WINDOW = 3


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each window: the document's key, the raw positions of its lines, and 96 bits of hash."""
    stripped = F.transform(F.split(F.col("__text"), "\n", -1), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(BLANKS)).alias("s")))
    filled = F.filter(stripped, lambda x: x["s"] != "")
    base = docs.select(*key_columns(id_col, text_col), F.col(text_col).alias("__text")).where(F.col("__text").isNotNull())
    lines = base.select("__n", "__d", "__h", filled.alias("__l")).where(F.size("__l") >= WINDOW)

    def window(j):
        parts = [F.get(F.col("__l"), j + k) for k in range(WINDOW)]
        words = [p["s"] for p in parts]
        return F.struct(
            F.xxhash64(*words).alias("__w"), F.hash(*words).alias("__v"),
            F.array(*[p["i"] for p in parts]).alias("__at"),
        )

    each = F.transform(F.sequence(F.lit(0), F.size("__l") - WINDOW), window)
    return lines.select("__n", "__d", "__h", F.inline(each))


def covered(win: DataFrame) -> DataFrame:
    """The line positions to remove of each document that has any."""
    place = F.struct("__n", "__d", "__h", "__at")
    first = win.groupBy("__w", "__v").agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("__c")).where("__c > 1")
    later = win.join(first.drop("__c"), ["__w", "__v"]).where(place != F.col("__first"))
    return later.groupBy("__n", "__d", "__h").agg(F.array_distinct(F.flatten(F.collect_list("__at"))).alias("__gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """docs with the repeated lines removed; drop_emptied leaves out documents of which no line is left."""
    win = materialize(windows(docs, id_col, text_col), "windows")
    gone = covered(win)
    names = [c for c in docs.columns if c.lower() != "lines_removed"]
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("__row"), *key_columns(id_col, text_col))
    joined = packed.join(gone, ["__n", "__d", "__h"], "left")
    text = F.col("__row")[text_col]
    kept = F.array_except(F.sequence(F.lit(0), F.size("__all") - 1), F.col("__gone"))
    joined = joined.withColumn("__all", F.when(F.col("__gone").isNotNull(), F.split(text, "\n", -1)))
    rebuilt = F.array_join(F.transform(kept, lambda i: F.get(F.col("__all"), i)), "\n")
    rebuilt = F.when(F.btrim(rebuilt, F.lit(BLANKS + "\n")) == "", F.lit("")).otherwise(rebuilt)
    out = joined.select(
        *[F.when(F.col("__gone").isNull(), text).otherwise(rebuilt).alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in names],
        F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("long").alias("lines_removed"),
    )
    return out.where(~((F.col("lines_removed") > 0) & (F.col(f"`{text_col}`") == ""))) if drop_emptied else out
