"""End to end: files or records to duplicates, tags and statistics."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinnabar.functions import text as X
from cinnabar.functions.parsing import extract_units
from cinnabar.operators import detect, ignore, rules
from cinnabar.sources.store import discover, insert_or_ignore


@dataclass
class Config:
    algorithm: str = "exact_match"
    options: dict = field(default_factory=dict)
    patterns: list[str] = field(default_factory=list)
    max_files: int | None = None
    ignore: frozenset[str] = ignore.DEFAULTS
    include_tests: bool = False
    root: str | None = None
    #: A record table: new contents are added to it, and all that it holds is analysed.
    table: str | None = None


def records(units: DataFrame) -> DataFrame:
    """Units as records; the id is a hash of place and name."""
    return units.select(
        F.xxhash64("file_path", "start_line", "name").alias("id"), F.sha2("source_code", 256).alias("code_hash"), F.col("source_code").alias("code_content"),
        F.col("name").alias("function_name"), "file_path", "type",
    )


def check(spark: SparkSession, path: str, config: Config = Config()) -> dict[str, DataFrame]:  # noqa: B008
    """records (tagged by the first rule), pairs, summary and types of the Python files below a path."""
    # patterns hold below the path: a folder of that name above it doesn't matter
    below = X.relative(F.regexp_replace("file_path", "^file:/*", "/"), config.root or os.path.abspath(path))
    ignored = ignore.is_ignored(below, config.ignore, tests=not config.include_tests)
    files = discover(spark, path, max_files=config.max_files).where(~ignored & (F.btrim("code_content") != ""))
    every = records(extract_units(files))
    if config.table is not None:
        insert_or_ignore(spark, every, config.table)
        every = spark.read.parquet(config.table)
    found = every.withColumn("rule_applied", rules.first_match(F.col("function_name"), config.patterns))
    return {
        "records": found, "pairs": detect.detect(found, config.algorithm, **config.options),
        "summary": detect.duplicate_summary(detect.exact_duplicates(found), found), "types": found.groupBy("type").count(),
    }
