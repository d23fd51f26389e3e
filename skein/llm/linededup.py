"""Removal of repeated passages of lines.

Every window of three consecutive lines that aren't blank is hashed (128 bits). Windows that occur more than once are
found over the whole corpus; the first occurrence, by document and position, stays. All later occurrences are covered,
overlapping covers are merged, and covered lines go, with blank lines between them.

Defined results. Lines end at a line feed and are compared without outer spaces. A document of one or two such lines has
one window of them all, which only another document of the same lines repeats. A text without such lines, a null one
among them, stays as it is. A document all of whose lines go is dropped. Ids may be of any type with an order. Occurrences
are ordered by doc_id, nulls first, then by a hash of the text; rows equal in both are one document listed more than
once, and are treated alike. Every column of the input is kept; n_chars, where there, is counted anew for changed rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_key, written

WINDOW = 3


def windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row a window: its hash, its document, the window's first and last line."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda t, i: F.struct(i.alias("i"), F.trim(t).alias("t"))), lambda x: x["t"] != "")
    n = F.size("l")
    at = F.when(n >= window, F.sequence(F.lit(0), n - window)).when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))

    def one(p):
        parts = [F.get("l", p + k)["t"] for k in range(window)]  # nulls behind the last line leave the hash as it is
        return F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("2"), *parts).alias("h2"), F.get("l", p)["i"].alias("a"), F.get("l", F.least(p + (window - 1), n - 1))["i"].alias("b"))

    base = docs.select(F.col("doc_id").alias("d"), text_key(F.col("text")).alias("k"), F.coalesce(lines, F.array().cast("array<struct<i:int,t:string>>")).alias("l"))
    return base.select("d", "k", F.inline(F.transform(at, one)))


def covered(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row a document that has later occurrences: d, k, and the array of line numbers to remove."""
    w = written(windows(docs, window), "windows")
    place = F.struct("d", "k", "a")
    repeated = w.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n")
    later = w.join(repeated, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("d", "k").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("a", "b")))).alias("gone"))


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without later occurrences; the same columns."""
    d, k, gone, kept = (fresh(docs, x) for x in ("sk_d", "sk_k", "sk_gone", "sk_kept"))
    cover = covered(docs, window).select(F.col("d").alias(d), F.col("k").alias(k), F.col("gone").alias(gone))
    joined = docs.withColumn(k, text_key(F.col("text"))).alias("x").join(cover.alias("y").hint("shuffle_hash"), F.col("x.doc_id").eqNullSafe(F.col(f"y.{d}")) & (F.col(f"x.{k}") == F.col(f"y.{k}")), "left")
    joined = joined.select("x.*", f"y.{gone}").drop(k)
    # each step is bound to a variable by an array of one, so that a text is split once and not for each of its lines
    lines = F.array(F.split("text", "\n", -1))
    left = F.transform(lines, lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(gone)), lambda i: ls[i]))
    new = F.array_compact(F.transform(left, lambda ts: F.when(F.exists(ts, lambda t: F.trim(t) != ""), F.array_join(ts, "\n"))))
    # explode works the text out once, and lets documents without lines go
    joined = joined.withColumn(kept, F.explode(F.when(F.col(gone).isNull(), F.array("text")).otherwise(new)))
    out = {"text": F.col(kept)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(kept).cast(docs.schema["n_chars"].dataType))
    return joined.select(*(out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns))


#: The definition in DuckDB's SQL, for documents.
SQL = """
with l as (select doc_id, lang, source, n_chars, text, string_split(text, chr(10)) as ls from documents),
e as (select doc_id, unnest(range(len(ls))) as i, unnest(ls) as t from l),
f as (select doc_id, i, trim(t, ' ') as t from e where trim(t, ' ') <> ''),
w as (select doc_id, i as a, lead(i, 2) over q as b, t as t0, lead(t) over q as t1, lead(t, 2) over q as t2, row_number() over q as p,
      count(*) over d as c, max(i) over d as z from f window q as (partition by doc_id order by i), d as (partition by doc_id)),
r as (select doc_id, a, coalesce(b, z) as b, row_number() over (partition by t0, t1, t2 order by doc_id, a) as n from w
      where b is not null or c < 3 and p = 1),
g as (select distinct doc_id, unnest(range(a, b + 1)) as i from r where n > 1),
k as (select e.doc_id, string_agg(e.t, chr(10) order by e.i) as text, bool_or(trim(e.t, ' ') <> '') as some
      from e anti join g on e.doc_id = g.doc_id and e.i = g.i where e.doc_id in (select doc_id from g) group by e.doc_id)
select l.doc_id, case when k.doc_id is null then l.text else k.text end as text, l.lang, l.source,
       case when k.doc_id is null then l.n_chars else length(k.text) end as n_chars
from l left join k on l.doc_id = k.doc_id
where l.doc_id not in (select doc_id from g) or k.some
"""
