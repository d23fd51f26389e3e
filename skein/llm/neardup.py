"""Near-duplicate documents by SimHash, searched by May-Ozerov recursion.

A fingerprint has BITS bits: the signs of the sums over a document's distinct pairs of consecutive words (lower case,
letters and digits only), each hashed. Two documents are near duplicates where their fingerprints differ in at most
RADIUS bits, and groups are closed under that. Fingerprints that are equal are one in the search.

The search repeats the following. The coordinates are permuted at random and cut into strips. A list is filtered into
many: each has a random centre, and keeps the fingerprints whose partial weight on the next strip, counted from the
centre, is at most a threshold. These are filtered again on the next strip, until lists are small; within each, all
pairs are compared. A close pair passes a filter together far more often than two strangers do. Depth, threshold,
number of centres and of repetitions follow from the number of fingerprints, so that a pair at RADIUS is found with a
probability of RECALL at least; closer pairs are likelier. Every fingerprint takes part, and no list is cut short.

Defined results. A text without words (null or empty, too) has no fingerprint: it's in no group and stays. A single
word stands for its own pair. Of a group the least row stays, by doc_id, nulls first, then by a hash of the text, then,
where both are equal, by the row as JSON. Ids may be of any type with an order. All columns are kept.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.components import components
from .common import fresh, key, key_type, mix, slices, spread, text_key, words, written

BITS, RADIUS, RECALL = 256, 52, 0.9
STRIPS, LEAF = (64, 128), 512
WORDS = BITS // 64
#: Fingerprints that one task filters: some seconds of work, though their bytes are few.
FILTERED = 1 << 13
#: Fingerprints of a list that are compared all with all; of a larger one, groups of copies are taken out first.
LARGE = 4096
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(distinct: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))


def fingerprint(pairs: np.ndarray) -> np.ndarray:
    """The fingerprint of a document with these distinct features, at least one."""
    total, n = np.zeros(BITS, np.int64), len(pairs)
    for at in range(0, n, 1 << 15):
        part = pairs[at : at + (1 << 15)]
        with np.errstate(over="ignore"):
            wide = np.stack([mix(part + _GOLD * np.uint64(j)) for j in range(1, WORDS + 1)], 1)
        total += np.unpackbits(wide.view(np.uint8), axis=1).sum(0, dtype=np.int32)
    return np.packbits(total * 2 > n)


def fingerprints_of(text: pa.Array) -> list[bytes | None]:
    distinct, code, offsets = words(text)
    h = word_hashes(distinct)[code]
    with np.errstate(over="ignore"):
        joined = mix(h[:-1] * _GOLD + h[1:]) if len(h) else h
    out: list[bytes | None] = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        out.append(None if a == b else fingerprint(np.unique(joined[a : b - 1]) if b - a > 1 else h[a:b]).tobytes())
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """d (doc_id), k (hash of the text) and fp of each row that has words."""

    def run(batches):
        for batch in batches:
            for b in slices(batch):
                out = pa.RecordBatch.from_arrays([b.column("d"), b.column("k"), pa.array(fingerprints_of(b.column("text")), pa.binary())], ["d", "k", "fp"])
                yield out.filter(out.column("fp").is_valid())

    return docs.select(key(docs, "doc_id", "d"), text_key(F.col("text")).alias("k"), "text").mapInArrow(run, f"d {key_type(docs, 'doc_id')}, k bigint, fp binary")


@lru_cache(None)
def _alone(strip: int, h: int) -> float:
    """Probability that a fingerprint has a weight of at most h on a strip."""
    return sum(comb(strip, i) for i in range(h + 1)) / 2**strip


@lru_cache(None)
def _together(strip: int, h: int, j: int) -> float:
    """The same for two fingerprints that differ in j bits of the strip."""
    total = 0
    for b in range(j + 1):
        top = h - max(b, j - b)
        if top >= 0:
            total += comb(j, b) * sum(comb(strip - j, a) for a in range(min(top, strip - j) + 1))
    return total / 2**strip


def _found(strip: int, h: int, centres: int, depth: int, radius: int) -> float:
    """Probability that one repetition brings a pair at this radius into one list."""
    js = range(max(0, radius - (BITS - strip)), min(strip, radius) + 1)
    weight = {j: comb(radius, j) * comb(BITS - radius, strip - j) / comb(BITS, strip) for j in js}
    f = 1.0
    for _ in range(depth):
        f = sum(w * (1 - (1 - _together(strip, h, j) * f) ** centres) for j, w in weight.items())
    return f


@lru_cache(None)
def plan(n: int, radius: int = RADIUS, recall: float = RECALL, leaf: int = LEAF) -> tuple[int, int, int, int, int]:
    """(strip, depth, threshold, centres, repetitions) of least estimated cost for n fingerprints."""
    if n <= leaf:
        return STRIPS[0], 0, 0, 1, 1
    best = None
    for strip, depth in ((s, d) for s in STRIPS for d in range(1, BITS // s + 1)):
        h = max((h for h in range(strip // 2) if n * _alone(strip, h) ** depth <= leaf), default=None)
        if h is None:
            continue
        p, q = _alone(strip, h), _together(strip, h, round(radius * strip / BITS))
        for share in (0.3, 0.7, 1.2, 2.0):
            centres = max(1, round(share / q)) if q else 1 << 20
            if centres > 1 << 14:
                continue
            f = _found(strip, h, centres, depth, radius)
            times = max(1, ceil(log(1 - recall) / log(1 - f))) if f < 1 else 1
            tests = times * sum(centres * (centres * p) ** i for i in range(depth))
            rows = times * (centres * p) ** depth
            cost = tests * strip / 16 + rows * (6000 + n * p**depth * 10)
            if best is None or cost < best[0]:
                best = cost, (strip, depth, h, centres, times)
    return best[1]


def lists_of(fp: np.ndarray, strip: int, depth: int, h: int, centres: int, times: int):
    """For each repetition, rows of fp (n x BITS / 8 bytes) and the lists they fall into."""
    bits = np.unpackbits(fp, axis=1)
    for t in range(times):
        seed = mix(np.array([t + 1], np.uint64))
        if not depth:
            yield np.arange(len(fp)), np.repeat(seed, len(fp))
            continue
        order = np.random.default_rng(t).permutation(BITS)[: depth * strip]
        strips = np.ascontiguousarray(np.packbits(bits[:, order], axis=1)).view(np.uint64).reshape(len(fp), depth, -1)
        row, node = np.arange(len(fp)), np.repeat(seed, len(fp))
        for level in range(depth):
            rows, nodes = [], []
            step = max(1, (1 << 20) // centres)
            for at in range(0, len(row), step):
                with np.errstate(over="ignore"):
                    child = mix(node[at : at + step, None] * _GOLD + np.arange(1, centres + 1, dtype=np.uint64))
                    weight = np.zeros(child.shape, np.uint8)
                    for w in range(strip // 64):
                        weight += np.bitwise_count(strips[row[at : at + step], level, w, None] ^ mix(child + _GOLD * np.uint64(w + 2)))
                i, c = np.nonzero(weight <= h)
                rows.append(row[at + i])
                nodes.append(child[i, c])
            row, node = np.concatenate([row[:0], *rows]), np.concatenate([node[:0], *nodes])
        yield row, node


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of all of a and b, each n x WORDS."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for w in range(WORDS):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def grown(x: np.ndarray, root: int, left: np.ndarray, radius: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges from root to all that links of radius reach from it among `left`, and those that they don't."""
    front, out = np.array([root]), []
    while len(front) and len(left):
        reached = np.zeros(len(left), bool)
        for at in range(0, len(front), 256):
            some = np.flatnonzero(~reached)
            for to in range(0, len(some), 4096):
                reached[some[to : to + 4096]] |= (distances(x[front[at : at + 256]], x[left[some[to : to + 4096]]]) <= radius).any(0)
        front, left = left[reached], left[~reached]
        out += [(root, v) for v in front.tolist()]
    return out, left


def linked(x: np.ndarray, radius: int, large: int = LARGE) -> list[tuple[int, int]]:
    """Edges (i, j) that join the same rows as all pairs within radius do.

    A large list is so for the copies of some text: these go first, each group in a time that follows the list's length.
    """
    left, out, missed = np.arange(len(x)), [], 0
    while len(left) > large and missed < 16:
        root = int(left[missed * len(left) // 16])
        more, rest = grown(x, root, left[left != root], radius)
        missed += len(more) < len(left) // 64
        left, out = rest, out + more
    near = np.zeros(len(left), bool)
    for at in range(0, len(left), 256):
        for to in range(at, len(left), 4096):
            hit = distances(x[left[at : at + 256]], x[left[to : to + 4096]]) <= radius
            i, j = np.nonzero(hit)
            off = at + i != to + j
            near[at + i[off]] = near[to + j[off]] = True
    left = left[near]
    while len(left):
        more, left = grown(x, int(left[0]), left[1:], radius)
        out += more
    return out


def matrix(cells: pa.Array) -> np.ndarray:
    """Fingerprints as n x BITS / 8 bytes."""
    return np.frombuffer(b"".join(cells.to_pylist()), np.uint8).reshape(-1, BITS // 8)


def search(fps: DataFrame, radius: int = RADIUS, recall: float = RECALL, leaf: int = LEAF) -> DataFrame:
    """Edges a, b between the distinct fingerprints of the column fp."""
    distinct = written(fps.select("fp").distinct(), "fps")
    n = distinct.count()
    shape = plan(n, radius, recall, leaf)

    def filtered(batches):
        for b in batches:
            fp = matrix(b.column("fp"))
            for row, node in lists_of(fp, *shape):
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), b.column("fp").take(pa.array(row))], ["list", "fp"])

    def compare(table: pa.Table) -> pa.Table:
        cells = table.column("fp").combine_chunks()
        order = pc.array_sort_indices(cells)
        cells = cells.take(order)
        pairs = linked(matrix(cells).view(np.uint64), radius)
        i, j = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.table({"a": cells.take(pa.array(j)), "b": cells.take(pa.array(i))})

    return spread(distinct, n, FILTERED).mapInArrow(filtered, "list bigint, fp binary").groupBy("list").applyInArrow(compare, "a binary, b binary")


def groups(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL, leaf: int = LEAF) -> DataFrame:
    """d, k, group and first (the least d and k) of each row that isn't alone in its group."""
    fps = written(fingerprints(docs), "fingerprints")
    label = components(search(fps, radius, recall, leaf))
    named = fps.join(label, fps["fp"] == label["node"], "left").select("d", "k", F.coalesce("label", "fp").alias("group"))
    some = named.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "k")).alias("first")).filter("n > 1").drop("n")
    return named.join(some, "group")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL, leaf: int = LEAF) -> DataFrame:
    """doc_id and kept_doc_id: a row for each document that goes, and the one of its group that stays."""
    g = written(groups(docs, radius, recall, leaf), "groups")
    gone = g.filter(~F.struct("d", "k").eqNullSafe(F.col("first"))).select("d", F.col("first.d").alias("kept"))
    # the least row itself, listed more than once
    again = g.filter(F.struct("d", "k").eqNullSafe(F.col("first"))).groupBy("d", "k").count().filter("count > 1").select("d", F.col("d").alias("kept"), F.explode(F.sequence(F.lit(2), "count")).alias("i")).drop("i")
    return gone.union(again).toDF("doc_id", "kept_doc_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL, leaf: int = LEAF) -> DataFrame:
    """docs with one row of each group; the same columns."""
    d, k, n, m = (fresh(docs, x) for x in ("nd_d", "nd_k", "nd_n", "nd_m"))
    g = written(groups(docs, radius, recall, leaf), "groups")
    stays = F.struct("d", "k").eqNullSafe(F.col("first"))
    told = written(g.groupBy("d", "k").agg(F.bool_or(stays).alias("stays"), F.count(F.lit(1)).alias("n")).filter("not stays or n > 1"), "told")
    told_ = told.select(F.col("d").alias(d), F.col("k").alias(m), F.when(F.col("stays"), F.col("n")).otherwise(0).alias(n))
    x = docs.withColumn(k, text_key(F.col("text")))
    x = x.join(told_.hint("shuffle_hash"), x["doc_id"].cast(key_type(docs, "doc_id")).eqNullSafe(told_[d]) & (x[k] == told_[m]), "left").drop(d, m)
    columns = [f"`{c}`" for c in docs.columns]
    # both branches read the same shuffled documents; the window sees the few rows that are listed more than once
    one = F.row_number().over(W.partitionBy("doc_id", k).orderBy(F.to_json(F.struct(*columns))))
    several = x.filter(F.coalesce(n, F.lit(0)) > 0).withColumn(d, one).filter(F.col(d) == 1)
    return x.filter(F.col(n).isNull()).select(*columns).union(several.select(*columns))
