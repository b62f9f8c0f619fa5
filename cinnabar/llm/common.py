"""Shared helpers: intermediate tables, and null- and repeat-safe row keys."""

from __future__ import annotations

import ctypes
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinnabar.sources.scratch import discard, give_back, materialize, settings, shared_dir, small_batches

__all__ = ["arrays_apart", "discard", "give_back", "key_columns", "materialize", "settings", "shared_dir", "small_batches", "table", "whole_id"]

def whole_id(c: str | Column) -> Column:
    """An id as a whole number; one that isn't, as most texts, counts as null."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("long")


def arrays_apart(least: int = 1 << 21) -> None:
    """Arrays of at least so many bytes get memory of their own, which goes back to the system as soon as they are freed."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        mallopt(-3, least)  # M_MMAP_THRESHOLD, which else grows with what is freed


def key_columns(doc_id: str | Column, text: str | Column, prefix: str = "__") -> list[Column]:
    """A document's identity where ids may be null or repeated: (id is null, id, hash of its text)."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    text = F.col(text) if isinstance(text, str) else text
    return [
        whole_id(doc_id).isNull().alias(f"{prefix}n"),
        F.coalesce(whole_id(doc_id), F.lit(0)).alias(f"{prefix}d"),
        F.xxhash64(text).alias(f"{prefix}h"),
    ]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(str(Path(sf_dir) / f"{name}.parquet"))
