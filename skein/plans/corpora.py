"""Graphs and note collections made of the parquet tables, each in Spark and as a piece of DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph, undirected
from ..operators.notes import Corpus
from ..operators.stack import Layers, layered

WIKI = r"\[\[([^\]|#^]+)(?:[#^][^\]|]*)?(?:\|[^\]]*)?\]\]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# graphs: parts have even ids, suppliers odd ones; customers even, suppliers odd


def part_supplier(spark: SparkSession, d: str) -> Graph:
    li = table(spark, d, "lineitem")
    return undirected(li.select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")))


def parts_in_orders(spark: SparkSession, d: str) -> Graph:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    pairs = li.select("l_orderkey", F.col("l_partkey").alias("src")).join(li.select("l_orderkey", F.col("l_partkey").alias("dst")), "l_orderkey")
    return undirected(pairs.filter("src < dst").select("src", "dst"))


def customer_supplier(spark: SparkSession, d: str) -> Layers:
    """Layers are regions."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("vault_ord"))
    c = table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("id"), F.col("c_nationkey").alias("n_nationkey"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("id"), F.col("s_nationkey").alias("n_nationkey"))
    v = c.union(s).join(n, "n_nationkey").select("id", "vault_ord")
    links = li.join(o.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))
    return layered(v, links)


def word_notes(spark: SparkSession, d: str) -> Corpus:
    """Documents as notes: their first word is an alias, capitalised words are links, languages are vaults."""
    first = F.regexp_extract("text", "^([A-Za-z]+)", 1)
    vault = F.coalesce(F.array_position(F.array(*map(F.lit, ("de", "en", "es", "fr"))), F.col("lang")), F.lit(0)).cast("int")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    content = F.concat(F.lit("---\naliases: "), first, F.lit("\n---\n"), F.regexp_replace("text", "([A-Z][a-z]{3,})", "[[$1]]"))
    return Corpus(table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), vault.alias("vault_ord"), F.col("lang").alias("vault"), F.concat(name, F.lit(".md")).alias("relpath"), name.alias("stem"), content.alias("content")))


def supplier_notes(spark: SparkSession, d: str) -> Corpus:
    """Suppliers as notes with tags, properties and links of both kinds; regions are vaults."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    name = F.concat(F.lit("supplier-"), k.cast("string"))
    status = F.when(k % 2 == 0, "status: open\n").otherwise("")
    content = F.concat(F.lit("---\ntags: [seg-"), k % 7, F.lit(", band-"), k % 3, F.lit("]\n"), status, F.lit("---\n[["), "n_name", F.lit("]] [[Supplier-"), (k * 7 + 1) % 100, F.lit("|next]] [peer](supplier-"), (k * 3 + 2) % 100, F.lit(".md) #zone/"), k % 5)
    return Corpus(s.select(k.alias("note_id"), F.col("n_regionkey").alias("vault_ord"), F.col("r_name").alias("vault"), F.concat(name, F.lit(".md")).alias("relpath"), name.alias("stem"), content.alias("content")))


def sibling_notes(spark: SparkSession, d: str) -> Corpus:
    """Suppliers as notes that link to files of the next region's folder, some of which exist; regions are vaults side by side."""
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("next"), F.col("r_name").alias("other"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, (F.col("n_regionkey") + 1) % 5 == F.col("next"))
    k = F.col("s_suppkey")
    name = F.concat(F.lit("supplier-"), k.cast("string"))
    content = F.concat(F.lit("[a](../"), "other", F.lit("/supplier-"), (k * 3 + 2) % 100, F.lit(".md) [b]( supplier-"), (k * 7 + 1) % 100, F.lit(".md)"))
    return Corpus(s.select(k.alias("note_id"), F.col("n_regionkey").alias("vault_ord"), F.col("r_name").alias("vault"), F.concat(name, F.lit(".md")).alias("relpath"), name.alias("stem"), content.alias("content")))


def order_notes(spark: SparkSession, d: str) -> Corpus:
    """Orders as notes of four lines, two of which are tasks."""
    k = F.col("o_orderkey").cast("string")
    box = F.when(F.col("o_orderstatus") == "F", "x").when(F.col("o_orderstatus") == "P", "X").otherwise(" ")
    content = F.concat(F.lit("- ["), box, F.lit("] ship "), k, F.lit("\n* [ ] call "), "o_orderpriority", F.lit("\n1. [ ] no\n+ [x] no"))
    name = F.concat(F.lit("order-"), k)
    return Corpus(table(spark, d, "orders").select(F.col("o_orderkey").alias("note_id"), F.lit(0).alias("vault_ord"), F.lit("orders").alias("vault"), F.concat(name, F.lit(".md")).alias("relpath"), name.alias("stem"), content.alias("content")))


def named_notes(spark: SparkSession, d: str) -> DataFrame:
    """Documents by their first word: several vaults share names."""
    c = word_notes(spark, d)
    first = F.regexp_extract("text", "^([A-Za-z]+)", 1)
    stems = table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), first.alias("first")).filter("first <> ''")
    return c.notes.drop("stem").join(stems, "note_id").withColumnRenamed("first", "stem")


def note_graph(c: Corpus) -> Graph:
    return undirected(c.links().select("src", "dst"), c.facts.select(F.col("note_id").alias("id")), closed=True)


# the same in SQL: parts of a WITH clause


def graph_sql(pairs: str, vertices: str = "select distinct src as id from e") -> str:
    return f"""one as (select distinct least(a, b) as a, greatest(a, b) as b from ({pairs}) where a <> b),
e as (select a as src, b as dst from one union all select b, a from one), v as ({vertices}),
deg as (select v.id, count(e.src) as degree from v left join e on e.src = v.id group by v.id)"""


PART_SUPPLIER = graph_sql("select l_partkey * 2 as a, l_suppkey * 2 + 1 as b from lineitem")
PARTS_IN_ORDERS = graph_sql("select x.l_partkey as a, y.l_partkey as b from lineitem x join lineitem y on x.l_orderkey = y.l_orderkey")
LAYERS = """lv as (select c_custkey * 2 as id, n_regionkey as vo from customer join nation on c_nationkey = n_nationkey
union all select s_suppkey * 2 + 1, n_regionkey from supplier join nation on s_nationkey = n_nationkey),
""" + graph_sql("select o_custkey * 2 as a, l_suppkey * 2 + 1 as b from lineitem join orders on l_orderkey = o_orderkey", "select id from lv") + """,
ce as (select e.src, e.dst, case when p.vo = q.vo then 'intra' else 'inter' end as class from e join lv p on p.id = e.src join lv q on q.id = e.dst)"""
WORDS = rf"""notes as (select doc_id as id, case lang when 'de' then 1 when 'en' then 2 when 'es' then 3 when 'fr' then 4 else 0 end as vo,
lang as vault, 'doc-' || doc_id || '.md' as relpath, 'doc-' || doc_id as stem, regexp_extract(text, '^([A-Za-z]+)', 1) as alias,
regexp_replace(text, '([A-Z][a-z]{{3,}})', '[[\1]]', 'g') as body from documents),
idx as (select distinct * from (select lower(stem) as key, id, vo, relpath from notes union all select lower(alias), id, vo, relpath from notes where alias <> '')),
keys as (select distinct id, vo, lower(trim(k)) as key from (select id, vo, unnest(regexp_extract_all(body, '{WIKI}', 1)) as k from notes)),
res as (select id, vo, key, dst from (select k.id, k.vo, k.key, i.id as dst, row_number() over (partition by k.id, k.key order by (i.vo = k.vo) desc, i.vo, i.relpath) as rn
from keys k join idx i on i.key = k.key) where rn = 1),
links as (select id as src, dst, key from res where dst <> id),
lost as (select k.id as src, k.vo, k.key from keys k where k.key not in (select key from idx))"""
WORD_GRAPH = WORDS + ",\n" + graph_sql("select src as a, dst as b from links", "select id from notes")
SUPPLIERS = """notes as (select s_suppkey as id, n_regionkey as vo, r_name as vault, n_name, 'supplier-' || s_suppkey || '.md' as relpath, 'supplier-' || s_suppkey as stem,
'supplier-' || ((s_suppkey * 7 + 1) % 100) as next, 'supplier-' || ((s_suppkey * 3 + 2) % 100) as peer
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
keys as (select id, vo, lower(n_name) as key from notes union select id, vo, next from notes),
wiki as (select k.id as src, n.id as dst, k.key from keys k join notes n on n.stem = k.key where n.id <> k.id),
md as (select b.id as src, t.id as dst, b.peer as key from notes b join notes t on t.vo = b.vo and t.stem = b.peer where t.id <> b.id and b.peer <> b.next),
links as (select *, 'wiki' as kind from wiki union all select *, 'md' from md),
lost as (select k.id as src, k.vo, k.key from keys k where k.key not in (select stem from notes)),
tags as (select id, 'seg-' || (id % 7) as tag, 'frontmatter' as origin from notes union all select id, 'band-' || (id % 3), 'frontmatter' from notes
union all select id, 'zone/' || (id % 5), 'body' from notes)"""
