"""Pairs of sets that share much, against all pairs."""

import random

from pyspark.sql import functions as F

from cinnabar.operators import detect, overlap


def brute(sets, threshold):
    first = {}
    for k in sorted(sets):
        first.setdefault(frozenset(sets[k]), k)
    nodes = {k: s for s, k in first.items() if s}
    near = lambda a, b: len(nodes[a] & nodes[b]) / max(len(nodes[a]), len(nodes[b]))
    return {(a, b): near(a, b) for a in nodes for b in nodes if a < b and near(a, b) > threshold}


def test_overlap_pairs_against_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    sets = {}
    for k in range(150):
        n = rng.choice([1, 2, 3, 5, 30, 30, 30, 60, 100])
        old = sorted(sets[rng.randrange(k)]) if k else []
        sets[k] = set(rng.sample(old, min(len(old), rng.randrange(n + 1)))) | {f"w{int(rng.paretovariate(0.4)) % 3000}" for _ in range(n)}
    sets[150], sets[151] = set(), set(sets[7])
    table = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "id long, features array<string>")
    # blocks of a few sets, and sizes that are parted by ids
    monkeypatch.setattr(overlap, "BLOCK", 1500)
    monkeypatch.setattr(overlap, "BLOCK_SETS", 35)
    monkeypatch.setattr(overlap, "EXTRA", 4)
    for threshold in (0.2, 0.6):
        want = brute(sets, threshold)
        found = detect.set_overlap_pairs(table, threshold)
        rows = found.collect()
        assert len(rows) == len(want) and {(r["id_a"], r["id_b"]): r["similarity_score"] for r in rows} == want and want
    rows = detect.feature_overlap_pairs(table.select("id", F.explode("features").alias("feature"))).collect()
    assert {(r["id_a"], r["id_b"]): r["similarity_score"] for r in rows} == brute(sets, 0.5)
    # no row for each feature of two sets: nothing is joined, on disk or elsewhere
    assert "Join" not in found._jdf.queryExecution().toString()


def test_overlap_of_odd_sets(spark):
    rows = [("b", ["x", "y", None]), ("a", ["x", "y"]), ("c", ["x"]), ("c", ["y", "z"]), (None, ["x", "y"]), ("d", None), ("e", []), ("é", ["x", "y", "z", "w"])]
    table = spark.createDataFrame(rows, "id string, features array<string>")
    got = {(r["id_a"], r["id_b"]): round(r["similarity_score"], 6) for r in detect.set_overlap_pairs(table, 0.5).collect()}
    assert got == {("a", "c"): 0.666667, ("c", "é"): 0.75}
    assert detect.set_overlap_pairs(table.limit(0)).count() == 0
