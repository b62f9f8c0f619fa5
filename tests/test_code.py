"""Functions and operators on small tables of source code."""

import hashlib

from pyspark.sql import functions as F

from cinnabar.functions import parsing as P
from cinnabar.functions import text as X
from cinnabar.operators import detect, ignore, judge, rules, similarity, trivial
from cinnabar.plans import analysis
from cinnabar.sources import store
from cinnabar.streaming.ingest import ingest

SOURCE = '''import os
from json import dumps as d

@decorate
def add(a, b):
    # sum
    return a + b

class Box(Base):
    def get_it(self):
        if self.x and self.y:
            return self.x
        return None

async def later():
    pass
'''


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_units_and_broken_source(spark):
    files = spark.createDataFrame([("a.py", SOURCE), ("b.py", "def broken("), ("c.py", None), ("d.py", "")], "file_path string, code_content string")
    got = {r["name"]: r for r in P.extract_units(files).collect()}
    assert set(got) == {"add", "Box", "get_it"}
    assert got["Box"]["type"] == "class" and got["Box"]["dependencies"] == ["Base"]
    assert got["get_it"]["source_code"].startswith("def get_it") and got["get_it"]["complexity_score"] == 2
    assert got["add"]["hash"] == hashlib.md5(f"add:{got['add']['source_code']}".encode()).hexdigest()


def test_structure():
    s = P.structure(SOURCE)
    assert s["functions"] == ["add", "get_it"] and s["methods"] == ["get_it"] and s["classes"] == ["Box"]
    assert s["imports"] == ["os", "json"] and s["decorators"] == ["decorate"] and s["control_flow"] == ["if"] and s["nesting_depth"] == 2
    assert {"func:add", "class:Box", "import:os", "args:2", "return", "BASE:Base"} <= set(s["features"])
    assert P.structure("def f(:")["error"] and P.structure("")["loc"] == 0 and P.structure(None)["error"] is None


def test_normalize_and_statements(spark):
    df = spark.createDataFrame([("x  =  1 # c",), ("def f(:\n\n  y ",), (None,)], "c string").select(P.normalize("c").alias("n"), P.count_statements("c").alias("s"))
    assert [r["n"] for r in df.collect()] == ["x = 1", "def f(:\n  y", None]
    units = spark.createDataFrame([("get_x", "function", "def get_x(self):\n    return self.x"), ("work", "function", "def work():\n    a = 1\n    b = 2\n    return a + b"), ("E", "class", "class E:\n    pass")], "name string, kind string, code string")
    got = units.select("name", trivial.exclude_reason(P.count_statements("code")).alias("why")).collect()
    assert {r["name"]: r["why"] for r in got} == {"get_x": "single_return", "work": None, "E": "trivial_class"}


def test_text_functions(spark):
    c = F.col("c")
    assert one(spark, X.squeeze(c, True), c="A b_\n\tC") == "abc"
    assert one(spark, X.without_comments(c), c="a # x\n\n  b  \n# only") == "a\nb"
    assert one(spark, X.skeleton(c), c='x = foo(1) # no\n"""doc"""') == "var = var(1)"
    assert one(spark, X.content_hash(c), c=None) == hashlib.sha256(b"").hexdigest()
    assert [one(spark, X.prefix_key(c), c=n) for n in ("get_x", "_x", "ab", "größe")] == ["get", "", "ab", "grö"]
    assert one(spark, X.feature_key(F.lit("Ab cdefghijk"), c), c="") == "short_abcdefghi_unkno"
    assert one(spark, X.code_tokens(c), c="a = 'b c'") == ["a", "b", "c", "b c"]
    assert one(spark, X.token_likeness(F.array().cast("array<string>"), F.array().cast("array<string>")), c="") == 1.0
    assert one(spark, X.shape_family(c), c="def f(self):\n self.x = 1") == "state_modifiers"
    assert one(spark, X.is_test_name(c), c="testThing") and not one(spark, X.is_test_name(c), c="latest")
    assert one(spark, X.is_test_path(c), c="a/tests/b.txt") and not one(spark, X.is_test_path(c), c="a/b.py")
    assert one(spark, ignore.is_ignored(c), c="x/__pycache__/y.py") and one(spark, ignore.is_ignored(c), c="x/y.pyc") and not one(spark, ignore.is_ignored(c), c="x/y.py")
    assert one(spark, X.intent_likeness(F.lit("get the user"), F.lit("get a user")), c="") == 0.8
    assert one(spark, X.outer_json(c), c='ok {"a": {"b": 1}} end') == '{"a": {"b": 1}}'
    ratio = spark.createDataFrame([("abcd", "bcde")], "a string, b string").select(P.sequence_ratio("a", "b").alias("x")).first()["x"]
    assert ratio == 0.75


def test_simhash_by_its_definition(spark):
    rows = [(1, f, w) for f, w in (("alpha", 3), ("beta", 2), ("gamma", 1))] + [(2, "alpha", 1), (2, "beta", 1)]
    got = {r["id"]: r["simhash"] % 2**64 for r in detect.simhash(spark.createDataFrame(rows, "id long, feature string, weight int")).collect()}
    for i in (1, 2):
        votes = [sum(w if int(hashlib.md5(f.encode()).hexdigest(), 16) >> k & 1 else -w for j, f, w in rows if j == i) for k in range(64)]
        assert got[i] == sum((v > 0) << k for k, v in enumerate(votes))


def test_hamming_pairs_against_all_pairs(spark):
    import random

    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(30)]
    codes = base[:] + [b ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for b in base] + base[:5] + [-1, -1, 0]
    far = lambda a, b: bin((a ^ b) % 2**64).count("1")
    first = {c: codes.index(c) for c in codes}
    table = spark.createDataFrame(list(enumerate(codes)), "id long, simhash long")
    for radius in (0, 3, 10, 12):
        got = {(r["id_a"], r["id_b"], r["distance"]) for r in detect.hamming_pairs(table, radius).collect()}
        assert got == {(first[a], first[b], far(a, b)) for a in first for b in first if first[a] < first[b] and far(a, b) <= radius}
    assert [detect.spare_parts(n, r) for n, r in ((100, 3), (10**6, 3), (10**9, 3), (10**9, 12))] == [1, 1, 3, None]
    named = {r["id"]: (r["class_id"], r["copies"]) for r in detect.classes(table, "simhash").collect()}
    assert all(named[k] == (first[c], codes.count(c)) for k, c in enumerate(codes))


def test_unknown_detector_and_empty_tables(spark):
    import pytest

    empty = spark.createDataFrame([], "id long, code_hash string, code_content string, function_name string, file_path string")
    with pytest.raises(ValueError):
        detect.detect(empty, "no such")
    for name in detect.DETECTORS:
        assert detect.detect(empty, name).count() == 0
    assert detect.duplicate_summary(detect.exact_duplicates(empty), empty).first()["health"] == "Excellent"


def test_rules(spark):
    members = spark.createDataFrame([("g", f"{p}_{k}", 0.9) for p in ("get", "set") for k in range(60)], "group_id string, name string, confidence double")
    got = {r["group_id"]: r["count"] for r in rules.bisect(members, ["zzz", "(", "^get"], most=100, text_col="name").groupBy("group_id").count().collect()}
    assert got == {"g_a": 60, "g_b": 60}
    table = spark.createDataFrame([(1, "a", "2024", 1, 9), (2, "b", "2024", 5, 0), (3, "c", "2025", 5, 0)], "id long, pattern string, created_at string, success_count long, failure_count long")
    assert rules.ordered(table) == ["c", "b", "a"]
    assert {r["pattern"] for r in rules.effective(table).collect()} == {"b", "c"}


def test_store_and_check(spark, tmp_path):
    rows = spark.createDataFrame([("h1", "a"), ("h1", "b"), ("h2", "c")], "code_hash string, x string")
    assert store.insert_or_ignore(spark, rows, str(tmp_path / "t")) == 2
    assert store.insert_or_ignore(spark, rows, str(tmp_path / "t")) == 0
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def one():\n    return 1\n")
    (src / "b.py").write_text("def one():\n    return 1\n\ndef two(:\n")
    (src / "c.py").write_text("def one():\n    return 1\n\nclass Two:\n    x = 1\n")
    got = analysis.check(spark, str(src), analysis.Config(patterns=["^one$"]))
    assert got["records"].count() == 3 and got["pairs"].count() == 1
    assert got["records"].where("rule_applied = '^one$'").count() == 2 and got["summary"].first()["duplicates"] == 1
    for _ in range(2):  # a table holds each content once, however often it is seen
        kept = analysis.check(spark, str(src), analysis.Config(table=str(tmp_path / "records")))
        assert kept["records"].count() == 2 and kept["pairs"].count() == 0


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"code_content": "x"}\n{"code_content": "x"}\n{"code_content": "y"}\n')
    source = spark.readStream.schema("code_content string").json(str(tmp_path / "in"))
    for _ in range(2):
        ingest(spark, source, str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_wide_searches_against_all_pairs(spark):
    from cinnabar.plans import queries as Q

    table = detect.word_simhashes(Q._records(spark, "/root/testdata/sf0.01")).where("words > 0")
    codes = [(r["id"], r["simhash"]) for r in table.collect()]
    first = {}
    for i, c in sorted(codes):
        first.setdefault(c, i)
    asked = {}
    for i, c in sorted(codes):
        if i % 50 == 0:
            asked.setdefault(c, i)
    near = {(i, j, ((a ^ b) % 2**64).bit_count()) for a, i in asked.items() for b, j in first.items() if a != b}
    got = {(r["id_a"], r["id_b"], r["distance"]) for r in Q.QUERIES["simhash_search_12"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {p for p in near if p[2] <= 12} and any(p[2] > 3 for p in got)


TOKENS = {
    "def f(a: int, *, k: Dict[str, int]=1) -> 'x | y':\n    yield a\n    yield from g(a).b\n    return [1, 2]": "FUNC:1|DECORATOR:0|ARG:0:a|ARG_TYPE:0:int|KWARG:0:k|KWARG_TYPE:0:Dict[str,int]|KW_DEFAULTS:1|RETURN_TYPE:x | y|YIELD|YIELD_VALUE|YIELD_FROM|CALL:g|CALL_ARGS:1|RETURN|RETURN_VALUE|RETURN_LIST_SIZE:2|SUBSCRIPT|INDEX",
    "class A(B, m.C, metaclass=M):\n    x = 1\n    y: int = 2\n    def __len__(self):\n        return cls.z": "FUNC:1|DECORATOR:0|ARG:0:self|RETURN|RETURN_VALUE|CLASS:2|CLASS_DECORATOR:0|BASE:B|BASE_ATTR:m.C|METACLASS|METACLASS_NAME:M|CLASS_ATTR|CLASS_ATTR_ANNOTATED|DUNDER:__len__|METHODS:1|ATTR:m.C|CLS_ATTR:z|ASSIGN_VAR:x|ASSIGN_VALUE:int|ANN_ASSIGN|ANN_TYPE:int|ANN_VAR:y",
}


def test_structure_tokens():
    import ast

    from cinnabar.functions import tokens as K

    for source, want in TOKENS.items():
        assert "|".join(K.structure(ast.parse(source).body[0])[0]) == want
    both = lambda s: K.structure(ast.parse(s))
    t, n, needs = both("for i in range(3):\n    if a == 1 and not b: d.e(i)\n    elif c: pass\nwith open(p) as f, g: lambda q: q")
    assert t == (
        "CALL:range BUILTIN:range CALL_ARGS:1 CALL_ATTR:e CALL_ARGS:1 CALL:open CALL_ARGS:1 LAMBDA:1 ATTR:d.e FOR ITER_RANGE IF CONDITION_BOOL:And HAS_ELSE ELIF IF PASS "
        "WITH:2 WITH_CALL:open WITH_AS BOOL:And BOOL_VALUES:2 CMP:Eq UNARY:Not"
    ).split()
    assert n == 1 + 2 + 1 + 3 + 1 and needs == ["d"]
    t, n, _ = both("match x:\n    case 1: pass\n    case _: raise E(1) from e\nimport a as b, c\nfrom .m import d as e")
    assert t == "CALL:E CALL_ARGS:1 MATCH:2 PASS RAISE RAISE_CALL:E RAISE_FROM IMPORT:2 IMPORT_AS:b FROM_IMPORT:m IMPORT_NAMES:1 IMPORT_AS:e".split() and n == 3
    t, _, _ = both("x, y = [f(k) for k in g(z) if k], {k for k in w}\nq.r += 1 if (n := 3) else s[1:2]")
    assert t == "CALL:f CALL_ARGS:1 CALL:g CALL_ARGS:1 ATTR:q.r UNPACK:2 ASSIGN_VALUE:unknown LISTCOMP:1 COMP_ITER_CALL:g COMP_FILTERS:1 SETCOMP:1 COMP_ITER_VAR AUGASSIGN:Add IFEXP NAMED_EXPR WALRUS_VAR:n SUBSCRIPT SLICE".split()
    t, _, _ = both("try:\n    raise E\nexcept (A, B) as e:\n    assert a, 'm'\nexcept:\n    while not a: break\nelse:\n    x = 1 + y\nfinally:\n    z = a < b < c")
    assert t == "TRY EXCEPT_COUNT:2 EXCEPT_SPECIFIC:1 TRY_ELSE FINALLY RAISE RAISE_TYPE:E EXCEPT_MULTI:2 EXCEPT_AS:e ASSERT ASSERT_MSG EXCEPT_ALL WHILE CONDITION_NOT BREAK UNARY:Not ASSIGN_VAR:x ASSIGN_VALUE:unknown BINOP:Add BINOP_TYPES:int_Add_var ASSIGN_VAR:z ASSIGN_VALUE:unknown CMP:Lt CMP:Lt CMP_CHAIN:2".split()
    assert P.unit_source(["    def f():", "  x", "", "        y"], 1, 4) == "  def f():\nx\n\n      y"


def test_simhash_sizes_and_missing_weights(spark):
    import pytest

    for size in (0, -1):
        with pytest.raises(ValueError):
            detect.simhash_int(["a"], size=size)
    assert detect.simhash_int([]) == 0 and 0 < detect.simhash_int(["a", "b", "c"], [1, 2], 128) < 1 << 128
    assert detect.simhash_int(["a", "b"], [1, 1]) != detect.simhash_int(["a", "b"], [2, 1])
    rows = [(1, "b a A c"), (2, ""), (3, None), (4, "x " * 300_000 + "y")]
    got = {r["id"]: r["simhash"] % 2**64 for r in detect.word_simhashes(spark.createDataFrame(rows, "id long, code_content string")).collect()}
    assert got == {1: detect.simhash_int(["a", "b", "c"]), 2: 0, 3: 0, 4: detect.simhash_int(["x", "y"])}


def test_ignore_patterns(spark, tmp_path):
    (tmp_path / ".gitignore").write_text("# c\n!keep.py\nout/\n*.gen.py\n")
    (tmp_path / ".cinnabarignore").write_text("drafts/\n")
    i = ignore.Ignore(tmp_path)
    paths = {"a.py": False, "venv/x.py": True, "a/venv/x.py": True, "out/a.py": True, "a/out/b.py": False, "a/b.gen.py": True, "drafts/a.py": True, "x/tests/a.py": True, "a/my_test.py": True, "docs/_build/x": True, "a/__init__.py": True, "secrets.yml": True, "lib/python3.9/site-packages/z.py": True, "a/environment.py": False, "b.swp": True}
    got = {r["p"]: r["i"] for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", i.ignored(F.col("p")).alias("i")).collect()}
    assert got == paths
    i.add("mine*")
    i.remove("drafts/")
    i.save()
    assert set(ignore.Ignore(tmp_path).patterns) - ignore.DEFAULTS == {"mine*"} and len(ignore.DEFAULTS) == 67
    i.remove("mine*")
    i.save()
    assert not (tmp_path / ".cinnabarignore").exists()


def test_central_filter_and_kinds(spark):
    rows = [("latest", "x = 1"), ("f", ""), ("g", None), (None, "x"), ("__init__", "def __init__(self):\n" + "    self.x = 1\n" * 10), ("__init__", "def __init__(self):\n" + "    self.x = 1\n" * 11), ("__eq__", "  def __eq__(self, o):\n      return 1"), ("it_works", "x"), ("edit_x", "x")]
    c = spark.createDataFrame(rows, "n string, c string").withColumn("k", P.count_statements("c"))
    got = [r["x"] for r in c.select(trivial.centrally_excluded(F.col("n"), F.col("c"), F.col("k.body_statements")).alias("x")).collect()]
    assert got == [True, True, True, False, True, False, True, True, False]
    kinds = spark.createDataFrame([("# only",), ("def f(:",), ("x = 1",), ("async def f():\n    return 1",), ("class A(NamedTuple):\n    x = 1",), ("class A:\n    def __init__(self):\n        self.x = 1",), ("def to_dict(self):\n    return self.d",)], "code_content string")
    assert [r["w"] for r in kinds.select(trivial.exclude_reason(P.count_statements("code_content"), trivial.Trivial(single_return=False, converter=True, simple_property=False)).alias("w")).collect()] == ["empty", None, None, None, "data_model_class", "data_model_class", "simple_converter"]
    assert trivial.keep(kinds).count() == 3


def test_judges(spark):
    import json

    import pytest

    from cinnabar.exceptions import ConfigurationError

    rows = [(1, "add", "f", "return a + b"), (2, "sum_up", "f", "return a + b"), (3, "other", "f", "print(zzz)"), (4, "add", "g", "return a + b"), (5, "", "g", "x"), (6, "n", "g", None)]
    r = spark.createDataFrame(rows, "id long, function_name string, file_path string, code_content string")
    # of the two called add the last one, by id, answers for both
    assert sorted((x["id_a"], x["id_b"]) for x in judge.whole_set(r, judge.rule_judge).collect()) == [(2, 4), (4, 2), (4, 4)]
    many = spark.range(30).selectExpr("id", "concat('n', id) as function_name", "'f' as file_path", "'x' as code_content")
    assert judge.whole_set(many, judge.rule_judge).count() == 0 and judge.whole_set(r.limit(1), judge.rule_judge).count() == 0
    pairs = judge.group_pairs(r)
    assert {(x["id_a"], x["id_b"]) for x in pairs.collect()} == {(1, 3)}
    prompt = judge.pair_prompt(("add", "return a + b"), ("other", "print(zzz)"))
    recorded = judge.recorded_judge(spark.createDataFrame([(judge.prompt_key(prompt), 'well: {"similar": true, "similarity_score": 0.9, "reasoning": "r"} so')], "key string, response string"))
    assert [(x["id_a"], x["similarity_score"], x["reasoning"]) for x in judge.compare_pairs(pairs, recorded).collect()] == [(1, 0.9, "r")]
    assert judge.compare_pairs(pairs.withColumn("code_a", F.lit("unknown")), recorded).count() == 0  # no answer: not similar
    named = spark.createDataFrame([("add", "other", 0.8, "x"), ("add", "none", 0.9, "y"), ("add", "other", 0.1, "z")], "function1_name string, function2_name string, similarity_score double, reasoning string")
    assert [(x["id_a"], x["id_b"]) for x in judge.converted(named, r).collect()] == [(4, 3)]
    with pytest.raises(ConfigurationError):
        judge.from_environment("NO_SUCH_VARIABLE")
    with pytest.raises(ValueError):
        judge.parsed("[1]")
    assert [p for p, _ in judge.split_rules([("a", "get x"), ("b", "set y")], judge.rule_judge)] == [r"\bget\b"]
    assert json.loads(judge.rule_judge()(judge.split_prompt([("a", "p q"), ("b", "p r")])))["pattern"] == r"\bq\b"


def test_splits_with_a_judge(spark):
    import pytest

    from cinnabar.exceptions import AnalysisError

    rows = [("g", f"f{k}", ("return value" if k % 2 else "print item") + f" number{k % 3}", 1.0) for k in range(40)]
    m = spark.createDataFrame(rows, "group_id string, name string, code string, confidence double")
    now, new = rules.bisect_with_judge(m, [], judge.rule_judge, most=25, depth=2)
    sizes = {r["group_id"]: (r["count"], r["c"]) for r in now.groupBy("group_id").agg(F.count(F.lit(1)).alias("count"), F.min("confidence").alias("c")).collect()}
    assert len(new) >= 1 and set(sizes) >= {"g_a", "g_b"} and all(n <= 25 for n, _ in sizes.values()) and sum(n for n, _ in sizes.values()) == 40
    with pytest.raises(AnalysisError):
        rules.bisect_with_judge(m.withColumn("code", F.lit("same")), [], judge.rule_judge, most=25)
    assert rules.bisect_with_judge(m, ["print"], judge.rule_judge, most=25)[1] == []
    large = judge.rules_for_large_groups(m.withColumn("file", F.lit("x.py")), judge.rule_judge, threshold=20)
    assert [r["file"] for r in large.collect()] == ["x.py"]


def test_limiter_and_batches():
    now = [0.0]
    limiter = judge.Limiter(clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    limiter.acquire()
    limiter.acquire()
    assert abs(now[0] - 0.1) < 1e-9
    for _ in range(10):
        limiter.success()
    assert abs(limiter.rate - 12) < 1e-9
    limiter.failure()
    assert abs(limiter.rate - 12) < 1e-9
    limiter.failure()
    assert abs(limiter.rate - 9.6) < 1e-9
    limiter.failure(limited=True)
    assert abs(limiter.rate - 4.8) < 1e-9
    b = judge.Batches()
    assert b.size(1000) == 80 and b.size(0.01) == 10 and b.adapted(50, 0.7, 1) == 40 and b.adapted(50, 0.9, 31) == 45 and b.adapted(50, 1, 1) == 60 and b.adapted(50, 0.9, 20) == 50
    tries = []
    slow = judge.retry(lambda: tries.append(1) or (_ for _ in ()).throw(OSError()), sleep=lambda s: None)
    try:
        slow()
    except OSError:
        pass
    assert len(tries) == 3


def test_similarity_clusters_by_the_greedy_walk(spark):
    from difflib import SequenceMatcher

    import numpy as np

    rng = np.random.default_rng(2)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(f"get_{words[rng.integers(4)]}{rng.integers(3)}", "return " + " ".join(words[k] for k in rng.integers(0, 4, rng.integers(1, 4)))) for _ in range(40)] + [("zz", "for x in y: pass")] * 2
    f = spark.createDataFrame(rows, "name string, code string")
    import re

    def like(a, b):
        tokens = lambda c: set(re.findall(r"\b[a-zA-Z_]\w*\b", c))
        longest = max(len(a[1]), len(b[1]), 1)
        one, two = tokens(a[1]), tokens(b[1])
        return 0.2 * SequenceMatcher(None, a[0], b[0]).ratio() + 0.4 * SequenceMatcher(None, a[1], b[1]).ratio() + 0.1 * (1 - abs(len(a[1]) - len(b[1])) / longest) + 0.3 * (len(one & two) / len(one | two) if one | two else 1)

    left, want = sorted(r for r in rows if r[0].startswith("get_")), []
    while left:
        own = [left[0]] + [r for r in left[1:] if like(left[0], r) >= 0.7]
        rest = list(left)
        for r in own:
            rest.remove(r)
        left = rest
        if len(own) >= 3:
            want.append(sorted(own))
    members = similarity.leaders(f, block=4)
    led = {}
    for r in members.where("family = 'data_accessors'").collect():
        led.setdefault(r["leader"], []).append((r["name"], r["code"]))
    assert sorted(sorted(v) for v in led.values() if len(v) >= 3) == sorted(want)
    clusters = {r["group_id"]: r for r in similarity.similarity_clusters(f).collect()}
    assert len(clusters) == len(want)
    for k, own in enumerate(want):
        r = clusters[f"similarity_data_accessors_{k}" if len(want) > 1 else "similarity_data_accessors"]
        pairs = [like(a, b) for i, a in enumerate(own) for b in own[i + 1 :]]
        mean = sum(pairs) / len(pairs)
        assert r["size"] == len(own) and abs(r["avg_similarity"] - mean) < 1e-5 and abs(r["confidence"] - (0.7 * mean + 0.3 * min(1, len(own) / 10))) < 1e-5
        assert r["label"].startswith("get_")
    merged = {r["group_id"]: r for r in similarity.merged_clusters(f).collect()}
    assert sum(r["size"] for r in merged.values()) == 42 and all(k.startswith(("hybrid_", "category_")) for k in merged)


def test_store_tables(spark, tmp_path):
    root = str(tmp_path / "store")
    assert store.version(spark, root) == 0 and store.needs_migration(spark, root)
    store.initialize(spark, root)
    store.initialize(spark, root)
    assert store.version(spark, root) == 1 and not store.needs_migration(spark, root)
    assert not store.has_data(store.read(spark, root, "code_units")) and store.read(spark, root, "split_rules").columns[1] == "pattern"
    u = spark.createDataFrame([("f", None, "a.py", None, None), ("g", "class", "b.py", 3, 4), ("h", "function", "a.py", 1, 2)], "name string, type string, file_path string, start_line int, end_line int")
    path = str(tmp_path / "u")
    store.save_units(u, path)
    saved = spark.read.parquet(path)
    assert [r["name"] for r in store.by_file(saved, "a.py").collect()] == ["f", "h"] and saved.where("name = 'f' and type = 'function' and start_line = 0").count() == 1
    assert sorted(r["file_path"] for r in store.file_paths(saved).collect()) == ["a.py", "b.py"]
    store.save(store.without_file(saved, "a.py"), path, replace=True)
    assert [r["name"] for r in spark.read.parquet(path).collect()] == ["g"] and [p.name for p in tmp_path.iterdir() if p.name.startswith("u.")] == []
    t = spark.createDataFrame([("h", "x"), (None, "a"), (None, "b")], "code_hash string, x string")
    for want in (1, 0, 0):
        assert store.insert_or_ignore(spark, t, str(tmp_path / "t")) == want
    rules_table = spark.createDataFrame([(1, "p", "c", None, None, None), (2, "q", "c", 0.9, "other", None)], "id long, pattern string, category string, confidence double, rule_type string, created_at timestamp")
    assert [(r["id"], r["confidence"]) for r in store.classification_rules(store.new_rules(rules_table)).collect()] == [(1, 0.5)]
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_bytes(b"def f():\n  x = '\xff'\n\ny = 1\n    def g(a):\n\n  z\nasync def h(): pass\n")
    (src / "b.py").write_text("")
    files = store.discover(spark, str(src))
    got = [(r["function_name"], r["line_number"], r["code_content"]) for r in store.line_functions(files).orderBy("line_number").collect()]
    assert [g[:2] for g in got] == [("f", 1), ("g", 5)] and got[0][2].count("\n") == 2 and got[1][2] == "    def g(a):\n\n  z"
    assert store.discover(spark, str(src), max_files=1).count() == 1
    nulls = spark.createDataFrame([(1, None), (2, None)], "id long, code_hash string")
    assert detect.exact_duplicates(nulls).count() == 0


def test_command_line(spark, tmp_path):
    from cinnabar import cli

    (tmp_path / "a.py").write_text("def one(x):\n    y = x + 1\n    return y\n")
    (tmp_path / "b.py").write_text("def one(x):\n    y = x + 1\n    return y\n")
    said = []
    assert cli.main(["check", str(tmp_path)], spark, said.append) == 0 and "duplicates: 1 (50.0%)" in said[0]
    said.clear()
    assert cli.main(["similar", "def one(x):\n    y = x + 1\n    return y", "--in", str(tmp_path)], spark, said.append) == 0 and said[0] == "2 similar"
    assert cli.main(["similar", " ", "--in", str(tmp_path)], spark, said.append) == 1
    assert cli.main(["check", str(tmp_path / "none")], spark, said.append) == 1
    assert cli.main(["patterns", str(tmp_path)], None, said.append) == 0


def test_progress_lines():
    from cinnabar.plans.progress import Progress

    now, said = [0.0], []
    p = Progress(100, "files", 5, say=said.append, clock=lambda: now[0])
    for k in (1, 50, 100):
        now[0] += 4
        p.report(k)
    assert len(said) == 2 and said[0].startswith("50 of 100 files (50.0%)") and not Progress(10, say=said.append).report(10)


def test_small_functions(spark):
    one_ = lambda column: spark.range(1).select(column.alias("x")).first()["x"]
    lit = F.lit
    assert one_(X.group_likeness(lit("get_a"), lit("get_b"), lit("x = 1"), lit("y + 22"))) == 0.85 and one_(X.group_likeness(lit("a"), lit("b"), lit("x = f(1)"), lit("y = g(1)"))) == 1.0
    assert one_(X.cluster_label(lit("load_abc"), lit("load_xyz"), lit("cba_daol"), lit("zyx_daol"), lit("f_g"))) == "load_* functions"
    assert one_(X.cluster_label(lit("a_handler"), lit("b_handler"), lit("reldnah_a"), lit("reldnah_b"), lit("f_g"))) == "*_handler functions" and one_(X.cluster_label(lit("a"), lit("b"), lit("a"), lit("b"), lit("f_g"))) == "F G"
    assert one_(X.relative(lit("/a/b/c.py"), "/a/b/")) == "c.py" and one_(X.relative(lit("/x"), "/a")) == "/x" and one_(X.within(lit("/ab"), "/a")) is False
    assert one_(X.iso(lit("2024-01-02 03:04:05.5").cast("timestamp"))) == "2024-01-02T03:04:05.500000"
    assert one_(P.dedent(lit("\n\n    a\n  \n      b\n\n"))) == "a\n\n  b"
    f = one_(X.structure_flags(lit("async def f():\n    try:\n        return await g()\n    except E: pass")))
    assert f["category"] == "async_handler" and f["confidence"] == 0.7 and f["reasoning"] == "async operations detected; error handling present" and f["line_count"] == 4
    assert one_(X.name_taxonomy(lit("get_x")))["confidence"] == 0.3 and one_(X.cut(lit("a" * 600))) == "a" * 500
    for n, want in (("fetch_x", "data_accessors"), ("HAS_x", "state_checkers"), ("x_helper", "general_functions"), ("_helper", "utilities"), ("__init__", "special_methods"), ("on_click", "event_handlers"), ("handle_it", "processors")):
        assert one_(X.pattern_family(lit(n), lit("x"))) == want
    log = spark.createDataFrame([("p", True), ("p", False), ("p", True)], "pattern string, success boolean")
    table = spark.createDataFrame([("p", 1, 1), ("q", 0, 0)], "pattern string, success_count long, failure_count long")
    assert sorted(map(tuple, rules.apply_statistics(table, log).collect())) == [("p", 3, 2), ("q", 0, 0)]
    m = spark.createDataFrame([("g", "a\nb"), ("g", "c"), ("g", None)], "group_id string, code string")
    got = {r["pattern"]: (r["matched"], r["valid"]) for r in rules.validity(m, ["^b", "a.b", "A", "(", "."]).collect()}
    assert got == {"^b": (1, True), "a.b": (1, True), "A": (0, False), "(": (0, False), ".": (2, True)}
