"""What must not grow with copies of a row, or with the rows of one file."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinnabar.functions import parsing as P
from cinnabar.operators import cluster, detect, similarity, trivial
from cinnabar.plans import queries as Q


@pytest.fixture
def written(monkeypatch):
    """The names of the tables that similarity writes."""
    names = []
    made = similarity.materialize
    monkeypatch.setattr(similarity, "materialize", lambda df, name, *rest: names.append(name) or made(df, name, *rest))
    return names


def _copies(spark):
    each = [(f"get_{w}", f"return {w} + {w}" if k % 2 else w * 9) for k, w in enumerate("apple bread cream dough eggs flour".split())]
    return spark.createDataFrame(each * 20, "name string, code string")


def test_copies_are_looked_at_once(spark, written):
    rows = similarity.leaders(_copies(spark), block=4).collect()
    # six different functions are left for two rounds, and nothing for a third; each of 20 copies would fill five by itself
    assert written.count("leaders") <= 2
    by = {}
    for r in rows:
        by.setdefault((r["name"], r["code"]), []).append(r)
    assert len(rows) == 120 == len({r["row_id"] for r in rows}) and all(len(v) == 20 and len({r["leader"] for r in v}) == 1 for v in by.values())
    first = {k: min(r["row_id"] for r in v) for k, v in by.items()}
    assert {r["leader"] for r in rows} <= set(first.values())
    null = spark.createDataFrame([("get_a", None), ("get_a", ""), ("get_a", None)], "name string, code string")
    assert [r["size"] for r in similarity.similarity_clusters(null).collect()] == [3]


def test_merged_clusters_walk_once(spark, written):
    merged = similarity.merged_clusters(_copies(spark)).collect()
    assert written.count("families") == 1 and sum(r["size"] for r in merged) == 120


SOURCES = ["def f(a):\n    return a\n", "class A(B):\n    pass\n", "def f(:", "", None, "x = 1"]


@pytest.fixture
def sources(spark, tmp_path):
    """300 rows of six sources, in one file that one task reads."""
    rows = [(str(k), SOURCES[k % 6]) for k in range(300)]
    spark.createDataFrame(rows, "file_path string, code_content string").coalesce(1).write.parquet(str(tmp_path / "s"))
    return spark.read.parquet(str(tmp_path / "s"))


def test_units_of_each_source_once(spark, sources):
    """Units come from all cores, and each different source of a batch is parsed once."""
    got = P.extract_units(sources)
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    rows = got.collect()
    assert sorted(r["file_path"] for r in rows) == sorted(str(k) for k in range(300) if k % 6 < 2)
    assert all((r["name"], r["type"], r["end_line"]) == (("f", "function", 2) if int(r["file_path"]) % 6 == 0 else ("A", "class", 2)) for r in rows)
    assert cluster.functions_of(got).count() == 50 and P.structure_report(got).count() == 100
    asked = []
    made = P.each_once(pa.array(SOURCES * 50), lambda texts: asked.extend(texts) or pa.array([len(t or "") for t in texts]))
    assert asked == SOURCES and made.to_pylist() == [len(s or "") for s in SOURCES] * 50


def test_one_file_of_sources_is_analysed_by_all_cores(spark, sources):
    least = spark.sparkContext.defaultParallelism
    for df in (trivial.keep(sources), detect.structural_simhashes(sources.withColumn("id", F.col("file_path")).withColumn("function_name", F.lit("f")))):
        assert df.rdd.getNumPartitions() >= least
    stats = trivial.exclusion_stats(sources)
    assert "hashpartitioning(code_content" in stats._jdf.queryExecution().toString()
    r = stats.first()
    assert (r["total"], r["excluded"], r["single_return"], r["trivial_class"], r["parse_error"]) == (300, 250, 50, 50, 50)
    for name in ("source_analysis", "exclusion_reasons", "normal_sources"):
        assert Q.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= least


def test_structural_simhash_by_its_features(spark, sources):
    got = {r["id"]: r["simhash"] % 2**64 for r in detect.structural_simhashes(sources.withColumn("id", F.col("file_path")).withColumn("function_name", F.lit("f"))).collect()}
    assert len(got) == 200
    for k, h in got.items():
        f = P.structure(SOURCES[int(k) % 6])["features"]
        assert h == detect.simhash_int(f, [3 if x.startswith("class:") else 2 if x.startswith("func:") else 1 for x in f])
    named = {r["id"]: r for r in detect.classes(spark.createDataFrame([(1, 5), (2, 5), (3, None), (4, None)], "id long, simhash long"), "simhash").collect()}
    assert [(named[k]["class_id"], named[k]["copies"]) for k in (1, 2, 3, 4)] == [(1, 2), (1, 2), (3, 2), (3, 2)]


def test_simhash_memory_follows_no_batch():
    """A batch of 600,000 different words takes the memory of some rows of it."""
    import tracemalloc

    words = pa.array([[f"{i}-{k}" for k in range(500)] for i in range(1200)])
    tracemalloc.start()
    got = detect._simhashes(words, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6 and got[7].as_py() % 2**64 == detect.simhash_int([f"7-{k}" for k in range(500)])


def test_simhash_batches_are_small(spark):
    detect.word_simhashes(spark.createDataFrame([(1, "a b")], "id long, code_content string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_searches_make_codes_once(spark):
    for name in ("simhash_search_12", "confidence_bands"):
        assert "EvalPython" not in Q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
