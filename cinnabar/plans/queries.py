"""The queries of the reference's operators over the driver's tables, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinnabar.functions import parsing as P
from cinnabar.functions import text as X
from cinnabar.operators import cluster, detect, ignore, judge, rules, similarity, trivial
from cinnabar.sources import store
from cinnabar.sources.scratch import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PATTERNS = ["^red", "bolt$", "small", "^b", "ring"]


def _query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("code_hash"), F.col("text").alias("code_content"), F.col("lang").alias("function_name"), F.col("source").alias("file_path"))


def _functions(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("category"), F.col("p_brand").alias("file"), F.col("p_size").alias("complexity"))


FUN = "f as (select replace(p_name,' ','_') as name, lower(replace(p_type,' ','_')) as category, p_brand as file, p_size as complexity from part)"
TITLE = "upper(category[1]) || category[2:]"
PREFIX = "case when contains(name,'_') then split_part(name,'_',1) else name[1:3] end"
CATS = f"{FUN}, m as (select *, 'category_' || category as group_id, {TITLE} || ' Functions' as label from f)"


@_query("select sha256(text) as code_hash, count(*) as n, min(doc_id) as first_id from documents where text is not null group by 1 having count(*) > 1")
def exact_duplicates(spark, d):
    return detect.exact_duplicates(_records(spark, d))


@_query("with g as (select sha256(text) as h, min(doc_id) as a from documents where text is not null group by 1) select a as id_a, doc_id as id_b, 1.0::double as similarity_score from documents join g on sha256(text) = h where doc_id > a")
def exact_pairs(spark, d):
    return detect.detect(_records(spark, d), "exact_match")


@_query("select doc_id, md5(translate(lower(text), ' ' || chr(9) || chr(10) || '_', '')) as normal, length(text) as chars, case when length(text) < 100 then 'short' when length(text) < 500 then 'medium' else 'long' end as bucket from documents")
def normalized_texts(spark, d):
    t = F.col("text")
    return _table(spark, d, "documents").select("doc_id", F.md5(X.squeeze(t, True)).alias("normal"), F.length(t).cast("long").alias("chars"), X.length_bucket(t).alias("bucket"))


KEY = "case when length(text) < 100 then 'short' when length(text) < 500 then 'medium' else 'long' end || '_' || replace(lower(text[1:10]), ' ', '') || '_' || coalesce(nullif(lang, ''), 'unknown')[1:5]"


@_query(f"select {KEY} as feature_key, count(*) as n from documents group by 1")
def blocking_keys(spark, d):
    r = _records(spark, d)
    return r.groupBy(X.feature_key(F.col("code_content"), F.col("function_name")).alias("feature_key")).agg(F.count(F.lit(1)).alias("n"))


LAYERED = f"""r as (select doc_id as id, {KEY} as key, translate(lower(text), ' ' || chr(9) || chr(10) || '_', '') as norm from documents where length(text) > 0),
s as (select id, key, list_sort(list_distinct(string_split(norm, ''))) as c from r)"""


@_query(f"""with {LAYERED}, n as (select key, c, min(id) as id from s where len(c) > 0 group by 1, 2),
p as (select a.id as id_a, b.id as id_b, len(list_intersect(a.c, b.c))::double / (len(a.c) + len(b.c) - len(list_intersect(a.c, b.c))) as s from n a join n b on a.key = b.key and a.id < b.id)
select id_a, id_b, round(s, 6) as similarity_score from p where round(s, 6) >= 0.7""")
def layered_pairs(spark, d):
    """Pairs of classes; layered_classes tells who is in them."""
    return detect.detect(_records(spark, d), "layered")


@_query(f"with {LAYERED} select id, min(id) over w as class_id, count(*) over w as copies from s window w as (partition by key, c)")
def layered_classes(spark, d):
    return detect.classes(detect.layered_sides(_records(spark, d)), "key", "chars")


SIMHASH = """w as (select distinct doc_id as id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\r\\n]+'), lambda x: x <> '')) as f from documents),
b as (select id, ('0x' || substr(md5(f), 17, 16))::ubigint as h from w),
v as (select id, k, sum(case when (h >> k) & 1 = 1 then 1 else -1 end) as s from b, range(64) t(k) group by id, k),
u as (select id, sum(case when s > 0 then (1::hugeint << k::int) else 0 end)::hugeint as x from v group by id),
s as (select id, x, (case when x >= 9223372036854775808 then x - 18446744073709551616 else x end)::bigint as simhash from u)"""


@_query(f"with {SIMHASH} select doc_id as id, coalesce(simhash, 0) as simhash from documents left join s on doc_id = s.id")
def simhash_codes(spark, d):
    return detect.word_simhashes(_records(spark, d)).select("id", "simhash")


NODES = f"{SIMHASH}, n as (select x::ubigint as x, min(id) as id from s group by 1)"
FOUND = f"""{NODES}, q as (select x::ubigint as x, min(id) as id from s where id % 50 = 0 group by 1),
p as (select q.id as id_a, n.id as id_b, bit_count(xor(q.x, n.x))::int as distance from q, n where q.x <> n.x)"""


@_query(f"""with {NODES}, p as (select a.id as id_a, b.id as id_b, bit_count(xor(a.x, b.x))::int as distance from n a join n b on a.id < b.id)
select id_a, id_b, distance, 1 - distance / 64.0::double as similarity_score from p where distance <= 3""")
def simhash_pairs(spark, d):
    """All pairs of codes within 3; simhash_classes tells whose codes they are."""
    return detect.detect(_records(spark, d), "simhash", radius=3)


@_query(f"with {SIMHASH} select id, min(id) over w as class_id, count(*) over w as copies from s window w as (partition by x)")
def simhash_classes(spark, d):
    return detect.classes(detect.word_simhashes(_records(spark, d)).where("words > 0"), "simhash")


def _search(spark, d, radius):
    codes = detect.known_codes(_records(spark, d))
    return detect.hamming_search(codes.where("id % 50 = 0"), codes, radius)


@_query(f"with {FOUND} select id_a, id_b, distance, 1 - distance / 64.0::double as similarity_score from p where distance <= 12")
def simhash_search_12(spark, d):
    """What lies within the reference's production radius of every 50th document."""
    return _search(spark, d, 12)


@_query(f"""with {FOUND} select case when 1 - distance / 64.0 >= 0.9 then 'high' when 1 - distance / 64.0 >= 0.7 then 'medium' else 'low' end as band, count(*) as n from p where distance <= 24 group by 1""")
def confidence_bands(spark, d):
    """All bands, down to a similarity of 0.625, of what lies near every 50th document."""
    return detect.bands(_search(spark, d, 24))


@_query("""with t as (select distinct doc_id as id, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) as f from documents), s as (select id, md5(string_agg(f, chr(10) order by f)) as h, count(*) as n from t group by 1),
n as (select h, n, min(id) as id from s group by 1, 2), r as (select t.id, f, n.n from t join n on t.id = n.id), p as (select a.id as id_a, b.id as id_b, count(*) as common, max(greatest(a.n, b.n)) as most from r a join r b on a.f = b.f and a.id < b.id group by 1, 2)
select id_a, id_b, common::double / most as similarity_score from p where common::double / most > 0.5""")
def feature_overlap_pairs(spark, d):
    """Classes of documents by their words."""
    words = F.filter(F.split("text", " "), lambda x: x != "").alias("features")
    return detect.set_overlap_pairs(_table(spark, d, "documents").select(F.col("doc_id").alias("id"), words))


@_query("""with g as (select count(*) as n from documents where text is not null group by text having count(*) > 1), t as (select count(*) as total from documents),
s as (select count(*) as groups, coalesce(sum(n - 1), 0)::bigint as duplicates from g), c as (select quality * 0.6 + toxic * 0.3 as confidence from labels),
m as (select count(*) as pairs, count(*) filter (confidence > 0.8) as high_confidence, count(*) filter (confidence > 0.5 and confidence <= 0.8) as medium_confidence from c),
r as (select *, duplicates * 100.0::double / total as rate0 from s, t, m)
select groups, duplicates, total, round(rate0, 4) as rate, printf('%.1f%%', rate0) as duplication_rate, high_confidence, medium_confidence,
case when rate0 < 5 and pairs < 5 then 'Excellent' when rate0 < 10 and pairs < 10 then 'Good' when rate0 < 20 and pairs < 20 then 'Fair' else 'Needs Improvement' end as health,
coalesce(nullif(concat_ws(' ', case when groups > 10 then groups || ' groups of structural duplicates: consolidate them.' end,
case when high_confidence > 0 then high_confidence || ' semantically similar pairs: review them.' end), ''), 'Duplication is within acceptable limits.') as recommendation from r""")
def duplicate_summary(spark, d):
    r = _records(spark, d)
    confidence = (F.col("quality") * 0.6 + F.col("toxic") * 0.3).alias("confidence")
    return detect.duplicate_summary(detect.exact_duplicates(r), r, _table(spark, d, "labels").select(confidence))


@_query("select count(*) as records, count(distinct source) as files, count(lang) as named from documents")
def repository_statistics(spark, d):
    return _records(spark, d).agg(F.count(F.lit(1)).alias("records"), F.countDistinct("file_path").alias("files"), F.count("function_name").alias("named"))


@_query("select sha256(text) as code_hash, min(conv_id) as conv_id from conversations c where text is not null and not exists (select 1 from documents where text = c.text) group by 1")
def new_records(spark, d):
    turns = _table(spark, d, "conversations").where("text is not null").groupBy(F.sha2("text", 256).alias("code_hash")).agg(F.min("conv_id").alias("conv_id"))
    return store.new_records(turns, _records(spark, d)).select("code_hash", "conv_id")


@_query(f"with {CATS} select group_id, label, count(*) as size, 0.9::double as confidence from m group by 1, 2")
def category_clusters(spark, d):
    return cluster.clusters(_functions(spark, d), "category").groupBy("group_id", "label", "confidence").agg(F.count(F.lit(1)).alias("size"))


@_query(f"""with {FUN}, p as (select {PREFIX} as prefix, count(*) as n from f group by 1)
select case when n > 1 then 'semantic_' || prefix else 'semantic_unclustered' end as group_id, case when n > 1 then 0.7::double else 0.5 end as confidence, sum(n)::bigint as size from p group by 1, 2""")
def prefix_clusters(spark, d):
    return cluster.clusters(_functions(spark, d), "prefix").groupBy("group_id", "confidence").agg(F.count(F.lit(1)).alias("size"))


@_query(f"""with {FUN}, p as (select category, {PREFIX} as prefix, count(*) as m from f group by 1, 2), q as (select *, sum(m) over (partition by category) as n from p)
select case when n > 5 then 'category_' || category || '_' || case when m > 1 then prefix else 'unclustered' end else 'category_' || category end as group_id,
case when n > 5 then case when m > 1 then 0.7::double else 0.5 end else 0.9 end as confidence, sum(m)::bigint as size from q group by 1, 2""")
def hybrid_clusters(spark, d):
    return cluster.clusters(_functions(spark, d), "hybrid").groupBy("group_id", "confidence").agg(F.count(F.lit(1)).alias("size"))


@_query(f"""with {CATS}, s as (select group_id, count(*) as size from m group by 1)
select count(*) as clusters, sum(size)::bigint as members, round_even(avg(size), 2) as avg_size, (select group_id from s order by size desc, group_id limit 1) as largest, (select group_id from s order by size, group_id limit 1) as smallest from s""")
def cluster_quality(spark, d):
    return cluster.quality(cluster.by_category(_functions(spark, d)))


@_query(f"""with {CATS}, c as (select group_id, file, count(*) as n, row_number() over (partition by group_id order by count(*) desc, file) as r, sum(count(*)) over (partition by group_id) as size, count(*) over (partition by group_id) as files from m group by 1, 2)
select group_id, file as main_file, n as in_main, (size - n)::bigint as elsewhere from c where r = 1 and size >= 4 and files > 1""")
def split_suggestions(spark, d):
    return cluster.split_suggestions(cluster.by_category(_functions(spark, d)))


@_query(f"with {CATS}, s as (select group_id, count(*) as size from m group by 1) select count(*) as groups, max(size) as max_size, round(avg(size), 4) as avg_size, count(*) filter (size > 20) as over_20, count(*) filter (size <= 15) as up_to_15 from s")
def split_metrics(spark, d):
    return cluster.split_metrics(cluster.by_category(_functions(spark, d)))


@_query(f"""with {FUN}, g as (select name as group_id, count(*) as size from f group by 1)
select group_id, size, kind, impact, effort from (
  select *, 'extract_class' as kind, 'high' as impact, 'medium' as effort from g where contains(group_id, 'set') and size > 10
  union all select *, 'unify_interface', 'medium', 'low' from g where contains(group_id, 'set') and size > 15
  union all select *, 'centralize_access', 'medium', 'low' from g where contains(group_id, 'get') and size > 10
  union all select *, 'layer_logic', 'high', 'high' from g where regexp_matches(group_id, 'business|logic|process') and size > 8
  union all select *, 'layer_module', 'high', 'high' from g where size > 20)""")
def refactoring_proposals(spark, d):
    groups = _functions(spark, d).groupBy(F.col("name").alias("group_id")).agg(F.count(F.lit(1)).alias("size"))
    return cluster.proposals(groups.withColumn("label", F.col("group_id")))


@_query(f"with {FUN} select case when complexity < 5 then 'low' when complexity < 10 then 'medium' when complexity < 20 then 'high' else 'very_high' end as band, count(*) as n from f where complexity > 0 group by 1")
def complexity_histogram(spark, d):
    return cluster.complexity_histogram(_functions(spark, d))


@_query(f"with {FUN} select * from f where complexity >= 10")
def complexity_report(spark, d):
    return cluster.complexity_report(_functions(spark, d))


@_query(f"with {FUN} select file, count(*) as units, sum(complexity)::bigint as total, round(avg(complexity), 4) as mean, max(complexity) as most from f group by 1")
def file_statistics(spark, d):
    return cluster.file_statistics(_functions(spark, d))


@_query(f"with {FUN} select file, count(*) as n from f group by 1 having count(*) > 20")
def large_groups(spark, d):
    return cluster.large_groups(_functions(spark, d))


@_query(f"with {FUN} select name, file, case " + " ".join(f"when regexp_matches(name, '(?i){p}') then '{p}'" for p in PATTERNS) + " end as rule_applied from f")
def first_match_rules(spark, d):
    return _functions(spark, d).select("name", "file", rules.first_match(F.col("name"), PATTERNS).alias("rule_applied"))


@_query(f"""with {CATS}, r as (select unnest({PATTERNS}) as pattern), c as (select group_id, pattern, count(*) as size, count(*) filter (regexp_matches(name, pattern)) as matched from m, r group by 1, 2)
select group_id, pattern, size, matched, matched > 0 and matched < size as valid from c""")
def rule_validity(spark, d):
    return rules.validity(cluster.by_category(_functions(spark, d)), PATTERNS, "name").drop("ord")


BISECT = "".join(f"""g{k} as (select group_id, count(*) as size, {", ".join(f"count(*) filter (regexp_matches(name, '{p}')) as m{i}" for i, p in enumerate(PATTERNS))} from l{k} group by 1),
c{k} as (select group_id, case {" ".join(f"when m{i} > 0 and m{i} < size then {i}" for i in range(len(PATTERNS)))} end as rule from g{k} where size > 100),
l{k + 1} as (select name, l.group_id || case when rule is null then '' when ({" or ".join(f"(rule = {i} and regexp_matches(name, '{p}'))" for i, p in enumerate(PATTERNS))}) then '_a' else '_b' end as group_id,
  case when rule is null then confidence else confidence * 0.9 end as confidence from l{k} l left join c{k} c on l.group_id = c.group_id){"," if k < 2 else ""}
""" for k in range(3))


@_query(f"with {CATS}, l0 as (select name, group_id, 0.9::double as confidence from m), {BISECT} select group_id, count(*) as size, round(min(confidence), 6) as confidence from l3 group by 1")
def rule_bisection(spark, d):
    return rules.bisect(cluster.by_category(_functions(spark, d)).select("name", "group_id", "confidence"), PATTERNS, text_col="name").groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), F.round(F.min("confidence"), 6).alias("confidence"))


OUT = "o as (select event_type as pattern, count(*) filter (value > 10) as success_count, count(*) filter (not value > 10) as failure_count from events group by 1)"


def _outcomes(spark, d):
    return rules.outcomes(_table(spark, d, "events").select(F.col("event_type").alias("pattern"), (F.col("value") > 10).alias("success")))


@_query(f"with {OUT} select count(*) as rules, sum(success_count)::bigint as successes, sum(failure_count)::bigint as failures, round(avg(success_count / (success_count + failure_count)), 6) as avg_success from o")
def rule_statistics(spark, d):
    return rules.statistics(_outcomes(spark, d))


@_query(f"with {OUT} select * from o where success_count + failure_count <= 5 or success_count / (success_count + failure_count) >= 0.2")
def effective_rules(spark, d):
    return rules.effective(_outcomes(spark, d))


@_query("select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 1")
def upsert_latest(spark, d):
    return store.latest(_table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


TRACKED = "l as (select o_custkey, case when o_custkey % 5 = 0 then 'old' else c_mktsegment end as s from (select distinct o_custkey from orders where o_orderstatus = 'P') join customer on c_custkey = o_custkey)"


def _tracked(spark, d):
    """Customers with an open order as tracked files: every fifth under an old state."""
    named = _table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("file")).distinct()
    state = F.when(F.col("file") % 5 == 0, "old").otherwise(F.col("c_mktsegment"))
    return named.join(_table(spark, d, "customer"), F.col("c_custkey") == F.col("file")).select("file", state.alias("state"))


def _current(spark, d):
    """Customers with money as the files that are there now."""
    return _table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("file"), F.col("c_mktsegment").alias("state"))


@_query(f"with {TRACKED} select c_custkey as file, c_mktsegment as state from customer left join l on o_custkey = c_custkey where c_acctbal > 0 and s is distinct from c_mktsegment")
def changed_files(spark, d):
    return store.changed(_tracked(spark, d), _current(spark, d), "file", "state")


@_query(f"with {TRACKED} select o_custkey as file from l where not exists (select 1 from customer where c_custkey = o_custkey and c_acctbal > 0)")
def deleted_files(spark, d):
    return store.deleted(_tracked(spark, d), _current(spark, d), "file")


@_query("select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 100 offset 100")
def newest_page(spark, d):
    return store.page(_table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), "o_orderkey"], 100, 100)


@_query("select event_type, json_extract(props, '$.k')::int as k, count(*) as n from events group by 1, 2")
def metadata_json(spark, d):
    return _table(spark, d, "events").groupBy("event_type", F.from_json("props", "k int")["k"].alias("k")).agg(F.count(F.lit(1)).alias("n"))


@_query("select coalesce(lang, 'unknown') as type, count(*) as n from documents group by 1")
def type_histogram(spark, d):
    return _records(spark, d).groupBy(F.coalesce("function_name", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


# Python source, of one shape for each remainder of the part's key, so that SQL can say what must be found in it.
SHAPES = [
    "def get_{w}(self, key):\n    return self.{w}\n",
    "class {W}(Base):\n    pass\n",
    "def test_{w}():\n    assert check({n})\n",
    "import os.path\n\ndef {w}(a, b={n}):\n    if a and b:\n        return a\n    for x in range(b):\n        print(x)\n    return None\n",
    "def __str__(self):\n    text = str(self.{w})\n    text += '{n}'\n    return text\n",
    "def {w}(:\n    pass\n",
    "@dataclass\nclass {W}:\n    {w}: int = {n}\n\n    def area(self):\n        return self.{w} * {n}\n",
    "",
]


def _by_shape(values: list, kind: str = "") -> str:
    """SQL: one of these literals by a part's shape."""
    said = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "case p_partkey % 8 " + " ".join(f"when {k} then {said(v)}" for k, v in enumerate(values)) + f" end{kind}"


SOURCE_SQL = f"""c as (select p_partkey, p_partkey % 8 as shape, split_part(p_name, ' ', 1) as w, p_size as n,
  replace(replace(replace({_by_shape(SHAPES)}, '{{w}}', split_part(p_name, ' ', 1)), '{{W}}', 'C' || split_part(p_name, ' ', 1)), '{{n}}', p_size::varchar) as code from part)"""


def _sources(spark, d):
    """(file_path, shape, code_content): a source of each part."""
    w = F.split("p_name", " ")[0]
    code = F.element_at(F.array(*[F.lit(x) for x in SHAPES]), (F.col("p_partkey") % 8 + 1).cast("int"))
    for mark, value in (("{w}", w), ("{W}", F.concat(F.lit("C"), w)), ("{n}", F.col("p_size").cast("string"))):
        code = F.replace(code, F.lit(mark), value)
    return _table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("file_path"), (F.col("p_partkey") % 8).alias("shape"), code.alias("code_content"))


UNITS = [  # (shape, name, type, first and last line, complexity, dependencies, tokens)
    (0, "get_{w}", "function", 1, 2, 1, "", "FUNC:2|DECORATOR:0|ARG:0:self|ARG:1:key|RETURN|RETURN_VALUE|SELF_ATTR:{w}"),
    (1, "{W}", "class", 1, 2, 1, "Base", "CLASS:1|CLASS_DECORATOR:0|BASE:Base|METHODS:0|PASS"),
    (2, "test_{w}", "function", 1, 2, 2, "", "FUNC:0|DECORATOR:0|CALL:check|CALL_ARGS:1|ASSERT"),
    (3, "{w}", "function", 3, 8, 5, "", "FUNC:2|DECORATOR:0|ARG:0:a|ARG:1:b|DEFAULTS:1|RETURN|RETURN_VALUE|RETURN_VAR:a|CALL:range|BUILTIN:range|CALL_ARGS:1|CALL:print|CALL_ARGS:1|RETURN|RETURN_VALUE|RETURN_CONST:NoneType|IF|CONDITION_BOOL:And|FOR|ITER_RANGE|BOOL:And|BOOL_VALUES:2"),
    (4, "__str__", "function", 1, 4, 2, "", "FUNC:1|DECORATOR:0|ARG:0:self|CALL:str|CALL_ARGS:1|RETURN|RETURN_VALUE|RETURN_VAR:text|SELF_ATTR:{w}|ASSIGN_VAR:text|ASSIGN_VALUE:call:str|AUGASSIGN:Add|AUGASSIGN_VAR:text"),
    (6, "{W}", "class", 2, 6, 2, "", "FUNC:1|DECORATOR:0|ARG:0:self|RETURN|RETURN_VALUE|CLASS:0|CLASS_DECORATOR:1|DECORATOR_NAME:dataclass|CLASS_ATTR_ANNOTATED|METHODS:1|SELF_ATTR:{w}|ANN_ASSIGN|ANN_TYPE:int|ANN_VAR:{w}|BINOP:Mult|BINOP_TYPES:expr_Mult_int"),
    (6, "area", "function", 5, 6, 1, "", "FUNC:1|DECORATOR:0|ARG:0:self|RETURN|RETURN_VALUE|SELF_ATTR:{w}|BINOP:Mult|BINOP_TYPES:expr_Mult_int"),
]
_FILLED = lambda x: f"replace(replace({x}, '{{w}}', w), '{{W}}', 'C' || w)"
UNITS_SQL = f"""{SOURCE_SQL}, shapes(s, name0, type, start_line, end_line, complexity_score, dep, tok) as (values {", ".join(str(u) for u in UNITS)}),
u as (select p_partkey::varchar as file_path, {_FILLED("name0")} as name, type, start_line, end_line, complexity_score, dep, {_FILLED("tok")} as sig,
  array_to_string(list_transform(string_split(code, chr(10))[start_line:end_line], lambda l: case when name0 = 'area' then l[5:] else l end), chr(10)) as source from c join shapes on shape = s)"""


@_query(f"""with {UNITS_SQL} select file_path, name, type, start_line, end_line, complexity_score, dep as dependencies, sig as signature,
sha256(sig)[1:16] as structure_hash, md5(name || ':' || source) as hash from u""")
def code_units(spark, d):
    """Every function and class of the sources, with structure tokens, complexity, dependencies and hashes."""
    u = P.extract_units(_sources(spark, d))
    return u.select("file_path", "name", "type", "start_line", "end_line", "complexity_score", F.array_join("dependencies", ",").alias("dependencies"), P.signature(F.col("tokens")).alias("signature"), P.structure_hash(F.col("tokens")).alias("structure_hash"), "hash")


@_query(f"""with {UNITS_SQL} select file_path, count(*) as total_units, count(*) filter (type = 'function') as functions, count(*) filter (type = 'class') as classes,
sum(complexity_score)::bigint as total_complexity, round(avg(complexity_score), 4) as average_complexity, sum(end_line - start_line + 1)::bigint as total_lines,
max(end_line - start_line + 1) as largest_unit, coalesce(string_agg(nullif(dep, ''), ','), '') as dependencies from u group by 1""")
def structure_reports(spark, d):
    r = P.structure_report(P.extract_units(_sources(spark, d)))
    return r.withColumn("dependencies", F.array_join("dependencies", ","))


FEATS = [
    "func:get_{w}|FUNC:2|DECORATOR:0|ARG:0:self|ARG:1:key|RETURN|RETURN_VALUE|SELF_ATTR:{w}|args:2|return", "class:{W}|" + UNITS[1][7], "func:test_{w}|" + UNITS[2][7] + "|args:0",
    "func:{w}|" + UNITS[3][7] + "|import:os.path|args:2|return|return", "func:__str__|" + UNITS[4][7] + "|args:1|return", "",
    "class:{W}|" + UNITS[5][7] + "|func:area|" + UNITS[6][7] + "|args:1|return", "",
]
_COLUMNS = {
    "functions": ["get_{w}", "", "test_{w}", "{w}", "__str__", "", "area", ""], "classes": ["", "{W}", "", "", "", "", "{W}", ""], "methods": ["", "", "", "", "", "", "area", ""],
    "imports": ["", "", "", "os", "", "", "", ""], "decorators": ["", "", "", "", "", "", "dataclass", ""], "control_flow": ["", "", "", "if,for", "", "", "", ""],
}


@_query(f"""with {SOURCE_SQL} select p_partkey::varchar as file_path, shape = 5 as failed, {", ".join(f"{_FILLED(_by_shape(v).replace('p_partkey % 8', 'shape'))} as {k}" for k, v in _COLUMNS.items())},
{_by_shape([2, 2, 2, 7, 4, None, 5, 0]).replace('p_partkey % 8', 'shape')} as loc, {_by_shape([1, 1, 1, 4, 1, None, 1, 1]).replace('p_partkey % 8', 'shape')} as complexity,
{_by_shape([1, 1, 1, 1, 1, None, 2, 0]).replace('p_partkey % 8', 'shape')} as nesting_depth, {_FILLED(_by_shape(FEATS).replace('p_partkey % 8', 'shape'))} as features,
{_by_shape([sum(3 if x.startswith("class:") else 2 if x.startswith("func:") else 1 for x in f.split("|") if x) for f in FEATS]).replace('p_partkey % 8', 'shape')} as weight from c""")
def source_analysis(spark, d):
    """Names, imports, metrics, features and the weight of all features of every source."""
    a = spread(_sources(spark, d), "code_content").withColumn("a", P.analyze("code_content"))
    joined = [F.array_join(f"a.{k}", ",").alias(k) for k in _COLUMNS]
    weight = F.aggregate(P.feature_weights(F.col("a.features")), F.lit(0), lambda x, y: x + y)
    return a.select("file_path", F.col("a.error").isNotNull().alias("failed"), *joined, "a.loc", "a.complexity", "a.nesting_depth", F.array_join("a.features", "|").alias("features"), weight.alias("weight"))


WHY = ["single_return", "trivial_class", "test_function", None, "simple_special_method", None, "data_model_class", "empty"]
CENTRAL = [False, False, True, False, True, False, False, True]


@_query(f"""with {SOURCE_SQL} select p_partkey::varchar as file_path, {_by_shape(WHY).replace('p_partkey % 8', 'shape')} as reason,
{_by_shape([str(x).lower() for x in CENTRAL]).replace('p_partkey % 8', 'shape')}::boolean as central from c""")
def exclusion_reasons(spark, d):
    """Why a source is trivial, and whether the central filter leaves it out under the name of its first definition."""
    c = spread(_sources(spark, d), "code_content").withColumn("c", P.count_statements("code_content"))
    central = trivial.centrally_excluded(F.col("c.name"), F.col("code_content"), F.col("c.body_statements"))
    return c.select("file_path", trivial.exclude_reason(F.col("c")).alias("reason"), central.alias("central"))


@_query(f"""with {SOURCE_SQL}, r as (select {_by_shape([*WHY[:5], "parse_error", *WHY[6:]]).replace('p_partkey % 8', 'shape')} as why from c)
select count(*) as total, count(why) as excluded, count(*) - count(why) as included, round(count(why) / count(*), 6) as exclusion_rate,
{", ".join(f"count(*) filter (why = '{x}') as {x}" for x in [*trivial.REASONS, "parse_error"])} from r""")
def exclusion_statistics(spark, d):
    return trivial.exclusion_stats(_sources(spark, d))


@_query(f"""with {SOURCE_SQL}, u as (select *, {_by_shape([1, None, 1, 3, 1, 1, 5, None]).replace('p_partkey % 8', 'shape')} as l from c),
b as (select p_partkey, shape, l, w, case when shape = 6 then code[instr(code, '    def area'):] else array_to_string(string_split(code, chr(10))[l:], chr(10)) end as body from u where l is not null)
select p_partkey::varchar as file_path, case shape when 0 then 'get_' || w when 2 then 'test_' || w when 4 then '__str__' when 6 then 'area' else w end as function_name, l as line_number, sha256(body) as code_hash from b""")
def line_functions(spark, d):
    return store.line_functions(_sources(spark, d)).select("file_path", "function_name", "line_number", "code_hash")


@_query(f"""with {SOURCE_SQL} select p_partkey::varchar as file_path, md5(case shape
when 0 then 'def get_' || w || '(self, key):' || chr(10) || '    return self.' || w when 1 then code[:length(code) - 1] when 2 then code[:length(code) - 1]
when 3 then code[:length(code) - 1] when 4 then code[:length(code) - 1]
when 5 then code[:length(code) - 1] when 6 then code[:length(code) - 1] else '' end) as normal from c""")
def normal_sources(spark, d):
    return spread(_sources(spark, d), "code_content").select("file_path", F.md5(P.normalize("code_content")).alias("normal"))


# Functions whose code is words of other columns, for the judges and the clusters by similarity.
VERBS_OF = ["get", "set", "validate", "process", "convert", "create", "calculate", "on"]
CODED_SQL = f"""k as (select p_partkey as id, {_by_shape(VERBS_OF)} || '_' || split_part(p_name, ' ', 1) as name, 'return ' || lower(p_type) as code, p_brand as file from part)"""
JUDGED_SQL = "k as (select p_partkey as id, split_part(p_name, ' ', 1) || '_' || split_part(p_name, ' ', 2) as name, 'return ' || lower(p_type) as code from part)"


def _coded(spark, d):
    """(id, name, code, file) of every part: a verb and a colour, and the words of its type."""
    verb = F.element_at(F.array(*[F.lit(x) for x in VERBS_OF]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return _table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("_", verb, F.split("p_name", " ")[0]).alias("name"), F.concat(F.lit("return "), F.lower("p_type")).alias("code"), F.col("p_brand").alias("file"))


def _judged(spark, d):
    """Parts as records named by two of their colours."""
    name = F.array_join(F.slice(F.split("p_name", " "), 1, 2), "_")
    return _table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("function_name"), F.concat(F.lit("return "), F.lower("p_type")).alias("code_content"), F.col("p_brand").alias("file_path"))


WORDS_SQL = "list_distinct(regexp_extract_all(lower(code), '[a-z]+'))"


@_query(f"""with {JUDGED_SQL}, u as (select name, code, min(id) as id, {WORDS_SQL} as w from k group by name, code), p as (
select a.id as id_a, b.id as id_b, len(list_intersect(a.w, b.w))::double / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) as s
from u a join u b on split_part(a.name, '_', 1) = split_part(b.name, '_', 1) and a.id < b.id)
select id_a, id_b, round(s, 6) as similarity_score from p where s >= 0.7""")
def judged_pairs(spark, d):
    """Pairs of one name prefix that the rule-based judge finds similar."""
    found = judge.pairwise(_judged(spark, d), judge.rule_judge)
    return found.select("id_a", "id_b", F.round("similarity_score", 6).alias("similarity_score"))


@_query(f"""with k as (select r_regionkey as id, r_name as name, 'return region code ' || r_name as code from region), w as (select *, {WORDS_SQL} as w from k),
p as (select a.id as id_a, b.id as id_b, len(list_intersect(a.w, b.w))::double / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) as s from w a join w b on a.id < b.id)
select id_a::bigint as id_a, id_b::bigint as id_b, round(s, 6) as similarity_score from p where s >= 0.6""")
def judged_whole_set(spark, d):
    """One question about all regions as functions."""
    code = F.concat(F.lit("return region code "), "r_name")
    r = _table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("function_name"), F.lit("r").alias("file_path"), code.alias("code_content"))
    return judge.whole_set(r, judge.rule_judge, 0.6).select("id_a", "id_b", F.round("similarity_score", 6).alias("similarity_score"))


@_query(f"""with {JUDGED_SQL}, u as (select name, code, min(id) as id from k group by name, code), c as (
select a.id as id_a, b.id as id_b, a.code as ca, b.code as cb, greatest(0, 1 - abs(length(a.code) - length(b.code)) / greatest(length(a.code), length(b.code), 1)::double) as l
from u a join u b on split_part(a.name, '_', 1) = split_part(b.name, '_', 1) and a.id < b.id),
t as (select * from c order by l desc, id_a, id_b limit 20), w as (select *, list_distinct(regexp_extract_all(lower(ca), '[a-z]+')) as wa, list_distinct(regexp_extract_all(lower(cb), '[a-z]+')) as wb from t),
s as (select id_a, id_b, round(len(list_intersect(wa, wb))::double / (len(wa) + len(wb) - len(list_intersect(wa, wb))), 6) as semantic_similarity from w)
select *, semantic_similarity >= 0.8 as is_duplicate from s""")
def semantic_pairs(spark, d):
    """The 20 candidates likest in length, by what the rule-based judge says they are for."""
    pairs = judge.group_pairs(_judged(spark, d)).withColumn("similarity_score", X.length_likeness(F.col("code_a"), F.col("code_b")))
    return judge.semantic(pairs, judge.rule_judge).select("id_a", "id_b", "semantic_similarity", "is_duplicate")


@_query(f"""with {JUDGED_SQL}, g as (select split_part(name, '_', 1) as group_id, lower(regexp_replace(code, '[A-Za-z_][0-9A-Za-z_]*', 'VAR', 'g')) as norm, id from k),
f as (select group_id, norm, min(id) as id_a from g group by 1, 2)
select group_id, id_a, id as id_b, 1.0::double as similarity_score from g join f using (group_id, norm) where id > id_a""")
def group_duplicates(spark, d):
    """Functions of one skeleton within their prefix group."""
    return similarity.group_detector(_judged(spark, d))


@_query(f"""with {CODED_SQL} select id, case split_part(name, '_', 1) when 'get' then 'data_accessors' when 'set' then 'data_mutators' when 'validate' then 'validators' when 'process' then 'processors'
when 'convert' then 'transformers' when 'create' then 'factories' when 'calculate' then 'calculators' else 'event_handlers' end as family, name[1:3] as three from k""")
def pattern_families(spark, d):
    return _coded(spark, d).select("id", X.pattern_family(F.col("name"), F.col("code")).alias("family"), F.substring("name", 1, 3).alias("three"))


@_query("""with t as (select page_id, url, array_to_string(list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> ''), '/') as path from pages)
select page_id, path, regexp_matches(path, '(^|/)(build|dist|tmp|temp|env|venv)(/|$)') or regexp_matches(path, '\\.(log|db|so|tmp)$') as ignored from t""")
def ignored_paths(spark, d):
    """Paths of pages under a few patterns."""
    url = F.regexp_replace("url", "^[a-z]+://", "")
    path = F.array_join(F.filter(F.split(url, "/"), lambda x: x != ""), "/")
    some = ["build/", "dist/", "tmp/", "temp/", "env/", "venv/", "*.log", "*.db", "*.so", "*.tmp"]
    return _table(spark, d, "pages").select("page_id", path.alias("path")).withColumn("ignored", ignore.is_ignored(F.col("path"), some, tests=False))


@_query(f"""with o2 as (select o_orderkey, o_orderdate as scan_timestamp, (select max(l_shipdate) from lineitem where l_orderkey = o_orderkey) as last_modified, o_orderstatus as file_hash from orders)
select o_orderkey from o2 where last_modified > scan_timestamp or file_hash <> 'F'""")
def stale_files(spark, d):
    """Orders as files: shipped after they were scanned, or under another state than the reference."""
    shipped = _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last_modified"))
    files = _table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("scan_timestamp"), F.col("o_orderstatus").alias("file_hash"))
    return store.stale(files.join(shipped, "o_orderkey", "left"), "F").select("o_orderkey")


@_query("select distinct source as file_path from documents where source is not null")
def file_paths(spark, d):
    return store.file_paths(_records(spark, d))


@_query("select o_orderstatus as status, count(*) as n from orders where o_totalprice > 100000 group by 1")
def custom_query(spark, d):
    return store.query(spark, "select o_orderstatus as status, count(*) as n from {orders} where o_totalprice > :least group by 1", {"least": 100000}, orders=_table(spark, d, "orders"))


@_query(f"""with {CODED_SQL}, r as (select split_part(name, '_', 1) as p, name, reverse(name) as rn from k) select p as prefix, min(name) as least, max(name) as most, p || '_' as start from r group by 1
having left(min(name), length(p) + 2) <> left(max(name), length(p) + 2)""")
def common_starts(spark, d):
    """The common start of the names of each prefix that doesn't reach into their second word."""
    g = _coded(spark, d).groupBy(F.substring_index("name", "_", 1).alias("prefix")).agg(F.min("name").alias("least"), F.max("name").alias("most"))
    found = g.withColumn("start", X.common_start(F.col("least"), F.col("most")))
    return found.where(F.length("start") == F.length("prefix") + 1)


@_query(f"""with {CODED_SQL}, f as (select id, code, length(code) - length(replace(code, ' ', '')) as blanks from k)
select id, 1 as line_count, contains(code, 'return ') as has_return_value, 'unknown' as category, 0.5::double as confidence, 'Basic structural analysis' as reasoning from f""")
def structural_flags(spark, d):
    f = X.structure_flags(F.col("code"))
    return _coded(spark, d).select("id", f.alias("f")).select("id", "f.line_count", "f.has_return_value", "f.category", "f.confidence", "f.reasoning")


@_query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as iso from orders")
def iso_times(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", X.iso(F.col("o_orderdate")).alias("iso"))


def similarity_clusters(spark, d):
    """Clusters of every tenth part's function by similarity; no SQL for the matching-blocks ratio."""
    return similarity.similarity_clusters(_coded(spark, d))


def merged_clusters(spark, d):
    """Clusters by category and similarity, merged; no SQL."""
    return similarity.merged_clusters(_coded(spark, d))


QUERIES |= {"similarity_clusters": similarity_clusters, "merged_clusters": merged_clusters}


@_query(f"""with {UNITS_SQL}, f as (select name, md5(source) as code, file_path as file, start_line as line_number, complexity_score as complexity from u where type = 'function')
select name, code, file, 'unknown' as category, line_number, complexity from f""")
def loaded_functions(spark, d):
    f = cluster.functions_of(P.extract_units(_sources(spark, d)))
    return f.withColumn("code", F.md5("code"))


@_query(f"""with {CATS}, b as (select group_id, count(*) as size from m group by 1), a as (select group_id || '_' || file as g, count(*) as size from m group by 1)
select (select count(*) from b) as original_groups, (select max(size) from b) as original_largest, (select round(avg(size), 4) from b) as original_average,
count(*) as split_groups, max(size) as split_largest, round(avg(size), 4) as split_average, count(*) filter (size > 20) as over_20, count(*) filter (size <= 15) as up_to_15,
round(count(*) / (select count(*) from b), 4) as factor from a""")
def split_change(spark, d):
    """Category clusters against the same parted by file."""
    before = cluster.by_category(_functions(spark, d))
    return cluster.split_change(before, before.withColumn("group_id", F.concat_ws("_", "group_id", "file")))


@_query(f"""with {CATS} select group_id, '{{"group_id":"' || group_id || '","size":' || count(*) || ',"functions":["' || string_agg(name, '","' order by name) || '"]}}' as json from m group by 1""")
def exported_clusters(spark, d):
    return cluster.exported(cluster.by_category(_functions(spark, d)))


@_query(f"""with t as (select distinct source as id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\r\\n]+'), lambda x: x <> '')) as f from documents where source is not null), s as (select id, md5(string_agg(f, chr(10) order by f)) as h, count(*) as n from t group by 1),
n as (select h, n, min(id) as id from s group by 1, 2), r as (select t.id, f, n.n from t join n on t.id = n.id), p as (select a.id as id_a, b.id as id_b, count(*) as common, max(greatest(a.n, b.n)) as most from r a join r b on a.f = b.f and a.id < b.id group by 1, 2)
select id_a, id_b, common::double / most as similarity_score from p where common::double / most > 0.2""")
def file_pairs(spark, d):
    """Sources of documents as files, by all of their words."""
    each = _table(spark, d, "documents").where("source is not null").select(F.col("source").alias("id"), detect.words(F.col("text")).alias("features"))
    return detect.set_overlap_pairs(each, 0.2)


def structural_classes(spark, d):
    """Sources by the weighted SimHash of their syntax trees; no SQL (SimHash by its definition is tested)."""
    known = _sources(spark, d).select(F.col("file_path").cast("long").alias("id"), F.col("file_path").alias("function_name"), "code_content")
    return detect.classes(detect.structural_simhashes(known), "simhash")


QUERIES |= {"structural_classes": structural_classes}
