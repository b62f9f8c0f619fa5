"""The queries of this subpackage and, where SQL can express them, the SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinnabar.llm.chunk_store import chunk_store_with_manifest
from cinnabar.llm.common import table
from cinnabar.llm.language_id import fit_prototypes, identify
from cinnabar.llm.line_dedup import line_dedup
from cinnabar.llm.media import declared_by_url, sniff_media
from cinnabar.llm.mixing import DOMAINS, mixing_rates
from cinnabar.llm.near_dedup import near_duplicates
from cinnabar.llm.order_minhash import order_minhash
from cinnabar.llm.packing import pack
from cinnabar.llm.reply_tree import reply_trees, tree_from_turns
from cinnabar.llm.url_filter import url_filter

#: Entries of the production URL filter: (entry, action).
URL_ENTRIES = [
    ("cheap-pills.example.com", "block"), ("casino-win.example.org", "block"), ("spam-farm.example.org", "block"),
    ("ads-track.example.org", "block"), ("free-bets.example.com", "block"), ("www.cheap-pills.example.com/en", "allow"),
    ("m.free-bets.example.com", "allow"), ("m.free-bets.example.com/de", "block"), ("example.net", "allow"),
    ("blog.ththan.example.net", "block"), ("blog.ththan.example.net/en", "allow"), ("blog.ththan.example.net/en/369", "block"),
    ("ththble.example.net/es", "block"), ("ththble.example.net/es", "allow"),
]


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP3_SQL = r"""
with lines as (
  select doc_id, i - 1 as i, t[i] as raw, trim(t[i], ' ' || chr(9) || chr(13)) as s
  from (select doc_id, string_split(text, chr(10)) as t from documents where text is not null),
       lateral (select unnest(range(1, len(t) + 1)) as i)
), wins as (
  select doc_id, i as a, lead(i) over w as b, lead(i, 2) over w as c,
         s as s1, lead(s) over w as s2, lead(s, 2) over w as s3
  from lines where s <> '' window w as (partition by doc_id order by i)
), ranked as (
  select *, row_number() over (partition by s1, s2, s3 order by doc_id, a) as r from wins where c is not null
), gone as (
  select distinct doc_id, unnest([a, b, c]) as i from ranked where r > 1
), kept as (
  select l.doc_id, string_agg(l.raw, chr(10) order by l.i) as text
  from lines l left join gone g on l.doc_id = g.doc_id and l.i = g.i where g.i is null group by l.doc_id
), n as (select doc_id, count(*) as lines_removed from gone group by doc_id)
select d.doc_id,
       case when n.doc_id is null then d.text
            when trim(coalesce(k.text, ''), ' ' || chr(9) || chr(13) || chr(10)) = '' then '' else k.text end as text,
       coalesce(n.lines_removed, 0) as lines_removed
from documents d left join n on n.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rates.select(F.when(~F.col("__n"), F.col("__d")).alias("doc_id"), "tokens", *[f"p_{d}" for d in DOMAINS], "rate")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_prototypes(docs), keep=["doc_id"])


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame(URL_ENTRIES, "entry string, action string")
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), entries)


OP6_SQL = rf"""
with rules as (
  select e, a, list_concat(list_reverse(string_split(string_split(e, '/')[1], '.')),
         list_transform(list_filter(string_split(e, '/')[2:], lambda s: s <> ''), lambda s: '/' || s)) as k
  from (values {", ".join(f"('{e}', '{a}')" for e, a in URL_ENTRIES)}) v(e, a)
), best as (
  select k, arg_min(a, (a <> 'block')::int) as a, arg_min(e, (a <> 'block')::int) as e from rules group by k
), bare as (
  select page_id, url, regexp_replace(regexp_replace(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '^//', '') as b from pages
), parts as (
  select page_id, url,
         regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(b, '^([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '\.+$', '') as host,
         regexp_extract(b, '^[^/?#]*([^?#]*)', 1) as path
  from bare
), ways as (
  select page_id, url, list_concat(list_reverse(string_split(host, '.')),
         list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: '/' || s)) as way
  from parts
), hits as (
  select w.page_id, w.url, b.a, b.e, len(b.k) as depth,
         row_number() over (partition by w.page_id order by len(b.k) desc) as r
  from ways w left join best b on w.way[1:len(b.k)] = b.k
)
select page_id, url, coalesce(a, 'allow') as decision, e as entry, coalesce(depth, 0) as depth from hits where r = 1
"""


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html", declared_by_url(F.col("url")).alias("declared"))
    return sniff_media(pages, "html", "declared", keep=["page_id", "declared"])


def op7_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_store_with_manifest(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_trees(tree_from_turns(table(spark, sf_dir, "conversations")))


OP10_SQL = r"""
with recursive base as (
  select distinct conv_id as conv, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text
  from conversations where conv_id is not null and turn is not null
), numbered as (
  select *, row_number() over (partition by conv order by turn, role, text) as node from base
), firsts as (select conv, turn, min(node) as first from numbered group by conv, turn
), links as (
  select conv, turn, max(first) over (partition by conv order by turn rows between unbounded preceding and 1 preceding) as parent from firsts
), msgs as (
  select n.conv, n.node, l.parent, n.role, n.text,
         len(list_filter(regexp_split_to_array(n.text, '[ 
]'), lambda w: w <> ''))::double as score
  from numbered n join links l on n.conv = l.conv and n.turn = l.turn
), walk as (
  select conv, node, [node] as path, score as total,
         '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as said from msgs where parent is null
  union all
  select m.conv, m.node, list_append(w.path, m.node), w.total + m.score,
         w.said || '<|' || m.role || '|>' || chr(10) || m.text || '<|end|>' || chr(10)
  from walk w join msgs m on m.conv = w.conv and m.parent = w.node
), leaves as (
  select *, total / len(path) as score from walk w
  where not exists (select 1 from msgs m where m.conv = w.conv and m.parent = w.node)
), ranked as (
  select *, row_number() over (partition by conv order by score desc, len(path) desc, path) as branch from leaves
)
select conv as conv_id, branch, len(path) as n_messages, score, said as text from ranked
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_mixing": op2_mixing,
    "op3_line_dedup": op3_line_dedup,
    "op4_order_minhash": op4_order_minhash,
    "op5_language_id": op5_language_id,
    "op6_url_filters": op6_url_filters,
    "op7_chunk_store": op7_chunk_store,
    "op8_packing": op8_packing,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_reply_trees": op10_reply_trees,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": OP3_SQL,
    "op6_url_filters": OP6_SQL,
    "op10_reply_trees": OP10_SQL,
}
