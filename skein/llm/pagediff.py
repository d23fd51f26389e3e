"""Main text of web pages by differencing each with the page of the nearest URL on its host.

Pages become lines of text at block-level tags. Within a host, paths are put in order; of a path's two neighbours the
one that shares the longer prefix is its partner, the earlier at a tie (no other path of the host shares more). The
lines of a page and of its partner are aligned by longest common subsequence, and the page's aligned lines go: menus,
banners and notices that a template repeats. What stays is the page's own text.

Neighbours are found on the distinct paths alone, in ranges that cut large hosts, too. Lines travel as 64-bit hashes;
the text itself is moved once, compressed, and written nowhere: pages are read twice instead.

Defined results. Scheme, query, fragment, letter case of the host, and slashes at the end make no difference: pages that
differ in nothing else are one path, and share their partner; it's compared by its least page, by page_id, nulls first,
then by a hash of the row. On a host that has one path only (index.php?id=1, ?id=2, ...) the query belongs to the path. A page alone on its host, or whose URL is null or has no host, keeps all lines. A null or
empty html has no lines, and an empty text. Of several longest alignments any one may count; the choice depends on the
two pages alone. Repeated rows count each. Ids of whole numbers come as bigint, others in their own type. Other columns
are ignored.
"""

from __future__ import annotations

import html as entities

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import key, key_type, slices, written

#: Bits of the alignment's table that are held at once; beyond that it's split in two (Hirschberg).
TABLE_BITS = 1 << 28
_QUOTED = r"""(?:"[^"]*"|'[^']*'|[^'">])*"""
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script[^>]*>|<style\b.*?</style[^>]*>|<template\b.*?</template[^>]*>|<noscript\b.*?</noscript[^>]*>"
_BLOCK = rf"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|table|thead|tbody|tr|td|th|section|article|nav|header|footer|aside|main|title|head|body|html|form|pre|blockquote|hr|dl|dt|dd|figure|figcaption|option|select|fieldset)(?:[\s/]{_QUOTED})?>"
_TAG = rf"<[a-zA-Z/!?]{_QUOTED}>"
_BROKEN = r"<[a-zA-Z/!?][^>]*>"


def lines_of(html: pa.Array) -> list[list[str]]:
    """The lines of text of each page."""
    x = pc.fill_null(html, "")
    for pattern, by in ((_HIDDEN, " "), (r"\s+", " "), (_BLOCK, "\n"), (_TAG, ""), (_BROKEN, "")):
        x = pc.replace_substring_regex(x, pattern, by)
    out = []
    for t in x.to_pylist():
        t = entities.unescape(t) if "&" in t else t
        out.append([s for s in (" ".join(line.split()) for line in t.split("\n")) if s])
    return out


def _rows(a: list[int], b: list[int]):
    """The rows of the bit-parallel table: after each of b, bit i is 0 where a's i-th adds to the subsequence."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & at.get(y, 0)
        v = (v + u | v - u) & full
        yield v


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of b and each prefix of a."""
    v = (1 << len(a)) - 1
    for v in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(a) + 7 >> 3, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _align(a: list[int], b: list[int], table_bits: int) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > table_bits and len(b) > 1:
        half = len(b) // 2
        score = _lengths(a, b[:half]) + _lengths(a[::-1], b[half:][::-1])[::-1]
        cut = int(np.argmax(score))
        return _align(a[:cut], b[:half], table_bits) + [cut + i for i in _align(a[cut:], b[half:], table_bits)]
    table = list(_rows(a, b))
    i, j, out = len(a), len(b), []
    while i and j:
        if table[j - 1] >> (i - 1) & 1:
            i -= 1
        elif j > 1 and not table[j - 2] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def aligned(a: list[int], b: list[int], table_bits: int = TABLE_BITS) -> list[int]:
    """Places in a of a longest common subsequence of a and b."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ma, mb = a[head : len(a) - tail], b[head : len(b) - tail]
    both = set(ma) & set(mb)
    where = [i for i, x in enumerate(ma) if x in both]
    mid = _align([ma[i] for i in where], [x for x in mb if x in both], table_bits)
    return [*range(head), *(head + where[i] for i in mid), *range(len(a) - tail, len(a))]


def extracted(pages: DataFrame, bodies: bool) -> DataFrame:
    """page_id, url, host, path, full (path and query), k (hash of the row), hashes of the lines, and, with bodies, the
    lines compressed."""
    base = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"
    host = F.lower(F.regexp_extract("url", base + r"([^/?#]+)", 1))
    path = F.regexp_replace(F.regexp_extract("url", base + r"[^/?#]+([^?#]*)", 1), "/+$", "")
    full = F.concat(path, F.regexp_extract("url", base + r"[^?#]+(\?[^#]+)", 1))
    src = pages.select(key(pages, "page_id", "page_id"), "url", F.when(host != "", host).alias("host"), path.alias("path"), full.alias("full"), F.xxhash64(F.col("url"), F.col("html")).alias("k"), F.col("html").alias("text"))
    keep = ["page_id", "url", "host", "path", "full", "k"]

    def run(batches):
        import xxhash
        import zstandard

        for batch in batches:
            squash = zstandard.ZstdCompressor(level=3)
            for b in slices(batch):
                each = lines_of(b.column("text"))
                hashes = [np.array([xxhash.xxh64_intdigest(s) for s in x], np.uint64).tobytes() for x in each]
                out = {c: b.column(c) for c in keep} | {"hashes": pa.array(hashes, pa.binary())}
                if bodies:
                    out["body"] = pa.array([squash.compress("\n".join(x).encode()) for x in each], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    return src.mapInArrow(run, f"page_id {key_type(pages, 'page_id')}, url string, host string, path string, full string, k bigint, hashes binary" + ", body binary" * bodies)


def common_prefix(a: Column, b: Column) -> Column:
    """Characters at the start that both have, found by halving steps; -1 where one is null."""
    most = F.least(F.length(a), F.length(b))

    def longer(n: Column, step: Column) -> Column:
        return F.when((n + step <= most) & (F.substr(a, F.lit(1), n + step) == F.substr(b, F.lit(1), n + step)), n + step).otherwise(n)

    steps = F.array(*(F.lit(1 << k) for k in range(29, -1, -1)))
    return F.when(a.isNull() | b.isNull(), -1).otherwise(F.aggregate(steps, F.lit(0), longer))


def paths_of(rows: DataFrame) -> DataFrame:
    """host, full and path for each distinct full of a host; the path takes in the query where the host has one path."""
    known = rows.select("host", "path", "full").distinct()
    one = known.groupBy("host").agg((F.min("path") == F.max("path")).alias("one"))
    return known.join(one, "host").select("host", "full", F.when(F.col("one"), F.col("full")).otherwise(F.col("path")).alias("path"))


def partners(paths: DataFrame) -> DataFrame:
    """host, path and partner for distinct host and path; a null partner where the path is alone."""
    keys = paths.filter("host is not null").select("host", "path").distinct()
    keys = written(keys.repartitionByRange("host", "path").withColumn("part", F.spark_partition_id()), "paths")
    both = F.struct("host", "path")
    ends = keys.groupBy("part").agg(F.min(both).alias("low"), F.max(both).alias("high"))
    over = W.orderBy("part")  # one row a partition
    ends = ends.select("part", F.lag("high").over(over).alias("before"), F.lead("low").over(over).alias("after"))
    w = W.partitionBy("part").orderBy("host", "path")
    near = keys.withColumn("l", F.lag(both).over(w)).withColumn("r", F.lead(both).over(w)).join(F.broadcast(ends), "part")
    near = near.withColumn("l", F.coalesce("l", "before")).withColumn("r", F.coalesce("r", "after"))
    left, right = (F.when(F.col(f"{x}.host") == F.col("host"), F.col(f"{x}.path")) for x in "lr")
    near = near.select("host", "path", left.alias("l"), right.alias("r"))
    near = near.withColumn("nl", common_prefix(F.col("path"), F.col("l"))).withColumn("nr", common_prefix(F.col("path"), F.col("r")))
    return near.select("host", "path", F.when(F.col("nl") >= F.col("nr"), F.col("l")).otherwise(F.col("r")).alias("partner"))


def main_text(pages: DataFrame, table_bits: int = TABLE_BITS) -> DataFrame:
    """page_id, url, text, n_lines, n_removed and partner (its path) of each page."""
    rows = written(extracted(pages, False), "lines").filter("host is not null")
    known = written(paths_of(rows), "urls")
    least = rows.groupBy("host", "full").agg(F.min(F.struct("page_id", "k", "hashes")).alias("least"))
    least = least.join(known, ["host", "full"]).groupBy("host", F.col("path").alias("partner")).agg(F.min("least").alias("least"))
    pairs = partners(known).filter("partner is not null").join(least.select("host", "partner", F.col("least.hashes").alias("other")), ["host", "partner"])
    joined = extracted(pages, True).drop("k", "path").join(known.join(pairs, ["host", "path"]), ["host", "full"], "left").select("page_id", "url", "hashes", "body", "partner", "other")

    def run(batches):
        import zstandard

        d = zstandard.ZstdDecompressor()
        for batch in batches:
            for b in slices(batch, "body"):
                texts, n, removed = [], [], []
                for hashes, body, other in zip(*(b.column(c).to_pylist() for c in ("hashes", "body", "other"))):
                    own = np.frombuffer(hashes, np.uint64).tolist()
                    gone = set(aligned(own, np.frombuffer(other, np.uint64).tolist(), table_bits)) if other else ()
                    lines = d.decompress(body).decode().split("\n") if own else []
                    texts.append("\n".join(s for i, s in enumerate(lines) if i not in gone))
                    n.append(len(own))
                    removed.append(len(gone))
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(n, pa.int32()), pa.array(removed, pa.int32()), b.column("partner")], ["page_id", "url", "text", "n_lines", "n_removed", "partner"])

    return joined.mapInArrow(run, f"page_id {key_type(pages, 'page_id')}, url string, text string, n_lines int, n_removed int, partner string")
