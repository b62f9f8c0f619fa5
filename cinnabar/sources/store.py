"""Record tables kept as Parquet: discovery, insert-or-ignore, upsert-latest, change and deletion detection, paging.

Null keys: a record whose key is null isn't stored, as it couldn't be told from the next one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinnabar.exceptions import StoreError

VERSION = 1
#: The tables of a store, and the columns that files are partitioned by.
SCHEMAS: dict[str, tuple[str, list[str]]] = {
    "code_records": ("id long, code_hash string, code_content string, normalized_code string, function_name string, file_path string, timestamp timestamp, metadata string, simhash long", []),
    "code_units": ("name string, type string, source_code string, start_line int, end_line int, file_path string, tokens array<string>, ast_structure string, complexity_score int, dependencies array<string>, hash string", ["type"]),
    "classification_rules": ("id long, pattern string, category string, confidence double, rule_type string, created_at timestamp", ["rule_type"]),
    "file_tracking": ("file_path string, last_modified timestamp, file_hash string, scan_timestamp timestamp", []),
    "split_rules": ("id long, pattern string, reasoning string, created_at timestamp, success_count long, failure_count long", []),
}


def discover(spark: SparkSession, path: str, pattern: str = "*.py", max_files: int | None = None) -> DataFrame:
    """(file_path, last_modified, code_content) of the files below a path; the first max_files by path, which are chosen before
    any is read.  Bytes that aren't UTF-8 are replaced."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if max_files is not None:
        names = read.option("pathGlobFilter", pattern).load(path).select("path").orderBy("path").limit(max_files)
        chosen = [r["path"] for r in names.collect()]
        files = read.load(chosen) if chosen else read.option("pathGlobFilter", pattern).load(path).limit(0)
    else:
        files = read.option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("file_path"), F.col("modificationTime").alias("last_modified"), F.make_valid_utf8(F.col("content").cast("string")).alias("code_content"))


def line_functions(files: DataFrame, path_col: str = "file_path", code_col: str = "code_content") -> DataFrame:
    """(file_path, function_name, line_number, code_content, code_hash): functions by lines alone.

    A stripped line that starts with "def " begins one; it reaches to the next line that isn't blank and begins in the
    first column.  Bodies overlap where definitions are nested; async ones aren't seen.
    """
    lines = F.split(F.col(code_col), "\n", -1)
    at = files.where(F.regexp_replace(F.col(code_col), r"(?U)\s", "") != "").select(F.col(path_col).alias("file_path"), lines.alias("l"))
    # the lines at which a body must end
    stops = F.filter(F.sequence(F.lit(1), F.size("l")), lambda k: F.get("l", k - 1).rlike(r"(?U)\S") & ~F.get("l", k - 1).rlike("^[ \t]"))
    starts = F.filter(F.sequence(F.lit(1), F.size("l")), lambda k: F.get("l", k - 1).rlike(r"(?U)^\s*def "))
    found = at.withColumn("stops", stops).select("file_path", "l", "stops", F.explode(starts).alias("line_number"))
    end = F.coalesce(F.array_min(F.filter("stops", lambda k: k > F.col("line_number"))), F.size("l") + 1)
    body = F.array_join(F.slice("l", F.col("line_number"), end - F.col("line_number")), "\n")
    head = F.get("l", F.col("line_number") - 1)
    name = F.regexp_replace(F.substring_index(F.get(F.split(head, "def ", -1), F.lit(1)), "(", 1), r"(?U)^\s+|\s+$", "")
    return found.select("file_path", name.alias("function_name"), "line_number", body.alias("code_content"), F.sha2(body, 256).alias("code_hash"))


def new_records(incoming: DataFrame, stored: DataFrame, key: str = "code_hash") -> DataFrame:
    """Incoming rows, one of each key that isn't null, whose key isn't stored."""
    return incoming.where(F.col(key).isNotNull()).dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def insert_or_ignore(spark: SparkSession, incoming: DataFrame, path: str, key: str = "code_hash") -> int:
    """Append new records to a table; how many were added, as counted while they are written."""
    fresh = new_records(incoming, spark.read.parquet(path), key) if exists(spark, path) else incoming.where(F.col(key).isNotNull()).dropDuplicates([key])
    seen = Observation(f"added-{uuid.uuid4().hex}")
    fresh.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get.get("n", 0)


def with_metadata(records: DataFrame, *columns: str) -> DataFrame:
    """records with these columns as JSON in `metadata`."""
    return records.withColumn("metadata", F.to_json(F.struct(*columns)))


def save(rows: DataFrame, path: str, replace: bool = False) -> None:
    """Append rows to a table, or replace it: written beside it first, then renamed, so that readers see one or the other."""
    spark = rows.sparkSession
    if not replace or not exists(spark, path):
        rows.write.mode("append").parquet(path)
        return
    jvm = spark.sparkContext._jvm
    made = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    beside, old = f"{path.rstrip('/')}.{uuid.uuid4().hex}", f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    rows.write.parquet(beside)
    files = made(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.rename(made(path), made(old)) or not files.rename(made(beside), made(path)):
        raise StoreError(f"{path} can't be replaced")
    files.delete(made(old), True)
    spark.catalog.refreshByPath(path)


def save_units(units: DataFrame, path: str) -> None:
    """Append units, with the kind "function" and line 0 where these are missing."""
    save(units.withColumn("type", F.coalesce("type", F.lit("function"))).withColumn("start_line", F.coalesce("start_line", F.lit(0))).withColumn("end_line", F.coalesce("end_line", F.lit(0))), path)


def has_data(rows: DataFrame) -> bool:
    return not rows.isEmpty()


def with_units(records: DataFrame, units: DataFrame, on: str = "code_hash", unit_key: str = "hash") -> DataFrame:
    """Records with their units, by hash."""
    return records.join(units.withColumnRenamed(unit_key, on), on)


def by_file(units: DataFrame, path: str, file_col: str = "file_path") -> DataFrame:
    return units.where(F.col(file_col) == path).orderBy("start_line")


def file_paths(units: DataFrame, file_col: str = "file_path") -> DataFrame:
    return units.where(F.col(file_col).isNotNull()).select(file_col).distinct()


def without_file(rows: DataFrame, *paths: str, file_col: str = "file_path") -> DataFrame:
    """Rows of other files; to delete, save() the result in the table's place."""
    return rows.where(F.col(file_col).isNull() | ~F.col(file_col).isin(*paths))


def classification_rules(rules: DataFrame, kind: str = "pattern") -> DataFrame:
    return rules.where(F.col("rule_type") == kind).orderBy("id")


def new_rules(rules: DataFrame) -> DataFrame:
    """Rules to append: confidence 0.5, type "pattern" and the present time where these are missing."""
    return rules.withColumn("confidence", F.coalesce("confidence", F.lit(0.5))).withColumn("rule_type", F.coalesce("rule_type", F.lit("pattern"))).withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of each key the row that is last by `order`."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("__k", last).where("__k = 1").drop("__k")


def upsert(tracked: DataFrame, incoming: DataFrame, key: str = "file_path", order: str = "scan_timestamp") -> DataFrame:
    """The table after incoming rows have taken the place of those with their keys."""
    return latest(tracked.unionByName(incoming), key, order)


def changed(tracked: DataFrame, current: DataFrame, key: str, state: str) -> DataFrame:
    """Current rows that aren't tracked, or under another state."""
    known = tracked.select(key, F.col(state).alias("__known"))
    return current.join(known, key, "left").where(~F.col(state).eqNullSafe(F.col("__known"))).drop("__known")


def stale(tracking: DataFrame, reference: str | None = None) -> DataFrame:
    """Tracked files that were modified after their scan, or have another hash than the reference."""
    other = F.col("file_hash") != F.lit(reference) if reference is not None else F.lit(False)
    return tracking.where(F.coalesce(F.col("last_modified") > F.col("scan_timestamp"), F.lit(False)) | F.coalesce(other, F.lit(False)))


def deleted(tracked: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Tracked keys that aren't there any more."""
    return tracked.select(key).distinct().join(current.select(key), key, "left_anti")


def page(rows: DataFrame, order: list, limit: int = 100, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def statistics(records: DataFrame, units: DataFrame, tracked: DataFrame, current: DataFrame) -> DataFrame:
    """Records, units, files, MB of code and deleted files of a store, in one row."""
    size = F.round(F.coalesce(F.sum(F.octet_length("code_content")), F.lit(0)) / 2**20, 2)
    one = records.agg(F.count(F.lit(1)).alias("records"), size.alias("mb"))
    two = units.agg(F.count(F.lit(1)).alias("units"), F.countDistinct("file_path").alias("files"))
    three = deleted(tracked, current, "file_path").agg(F.count(F.lit(1)).alias("deleted"))
    key = F.lit(1).alias("__k")
    return one.select("*", key).join(two.select("*", key), "__k").join(three.select("*", key), "__k").drop("__k")


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table][0])


def initialize(spark: SparkSession, root: str) -> None:
    """Make the tables of a store that aren't there yet, and note its version."""
    for table, (ddl, parts) in SCHEMAS.items():
        if not exists(spark, f"{root}/{table}"):
            spark.createDataFrame([], ddl).write.partitionBy(*parts).parquet(f"{root}/{table}")
    if not exists(spark, f"{root}/version"):
        spark.createDataFrame([(VERSION, json.dumps({t: d for t, (d, _) in SCHEMAS.items()}))], "version int, schemas string").coalesce(1).write.parquet(f"{root}/version")


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.schema(schema(table)).parquet(f"{root}/{table}")


def version(spark: SparkSession, root: str) -> int:
    """The version of a store; 0 if it has none."""
    return spark.read.parquet(f"{root}/version").first()["version"] if exists(spark, f"{root}/version") else 0


def needs_migration(spark: SparkSession, root: str) -> bool:
    return version(spark, root) < VERSION


def query(spark: SparkSession, sql: str, args: list | dict | None = None, **tables: DataFrame) -> DataFrame:
    """Any SQL over tables given by name."""
    return spark.sql(sql, args=args, **tables)


def to_dicts(rows: DataFrame, convert: Callable[[Row], dict] = lambda r: r.asDict(recursive=True)) -> list[dict]:
    """The rows of a small table."""
    return [convert(r) for r in rows.toLocalIterator()]
