"""Benchmark decontamination by greedy string tiling.

Texts are sequences of words: lower case, letters and digits only. Documents and benchmark items are joined by seeds,
runs of MIN_MATCH words that both have. For each such pair running Karp-Rabin greedy string tiling covers the item: of
all matches outside earlier tiles the longest is marked, and again, down to MIN_MATCH words. Tiles may lie in any order
in the document, so reordered passages are caught. A pair counts where tiles cover at least COVERAGE of the item.

A pair is only tiled where its seeds alone could cover that much: tiles lie within seeds, so no pair is lost by it. A
benchmark of at most PART words goes to all tasks, and documents are read once and moved nowhere. A larger one is joined
with the documents' seeds by a shuffle, for which a filter of fixed size (FILTER_BITS bits) first lets those go that no
item has; pairs that could count are tiled after that. Both ways give the same rows.

Defined results. An item of fewer than MIN_MATCH words, or a null one, has no tiles and is in no pair; nor is a document
of so few words, or a null one. Among matches of one length the one first in the item, then first in the document, is
marked. Repeated rows, of documents or of items, each give their own rows, null ids among them; ids of whole numbers as
bigint, others in their own type. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import fresh, key, key_type, mix, ragged, slices, text_key, words, written
from .neardup import word_hashes

MIN_MATCH, COVERAGE = 4, 0.5
#: Words of a benchmark that goes to all tasks: 16 bytes and a seed of 8 for each.
PART = 1 << 20
FILTER_BITS = 27
_BASE = np.uint64(0x100000001B3)


def seeds(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    out = h[: max(0, len(h) - n + 1)].copy()
    with np.errstate(over="ignore"):
        for j in range(1, n):
            out = mix(out * _BASE + h[j : len(h) - n + 1 + j])
    return out


class KarpRabin:
    """Rolling hashes of a sequence: any run's hash by two lookups."""

    def __init__(self, h: np.ndarray, powers: np.ndarray):
        self.powers = powers
        with np.errstate(over="ignore"):
            self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h) * powers[: len(h)], dtype=np.uint64)))

    def runs(self, starts: np.ndarray, n: int) -> np.ndarray:
        """Comparable hashes of the runs of n from each start; the same power of the base for all."""
        with np.errstate(over="ignore"):
            return (self.prefix[starts + n] - self.prefix[starts]) * self.powers[len(self.powers) - 1 - starts]


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE))), dtype=np.uint64)


def free_runs(marked: np.ndarray, n: int) -> np.ndarray:
    """Starts of runs of n that touch no mark."""
    total = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(total[n:] == total[: len(total) - n]) if len(marked) >= n else np.zeros(0, np.int64)


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length) of the tiles, in the order of marking."""
    p = powers(max(len(item), len(doc)) + 1)
    a, b = KarpRabin(item, p), KarpRabin(doc, p)
    mark_a, mark_b = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    out = []
    # the longest run in common: a run of n can only be common where runs of every smaller length are
    low, high = least, min(len(item), len(doc))
    while low < high:
        n = (low + high + 1) // 2
        common = np.isin(a.runs(np.arange(len(item) - n + 1), n), b.runs(np.arange(len(doc) - n + 1), n)).any()
        low, high = (n, high) if common else (low, n - 1)
    n = low
    while n >= least:
        i, j = free_runs(mark_a, n), free_runs(mark_b, n)
        hb = b.runs(j, n)
        order = np.argsort(hb, kind="stable")
        hb = hb[order]
        for s, x in zip(i.tolist(), a.runs(i, n).tolist()):
            if mark_a[s] or mark_a[s + n - 1]:
                continue
            for t in j[order[np.searchsorted(hb, np.uint64(x)) : np.searchsorted(hb, np.uint64(x), "right")]].tolist():
                if not mark_b[t] and not mark_b[t + n - 1] and np.array_equal(item[s : s + n], doc[t : t + n]):
                    mark_a[s : s + n] = mark_b[t : t + n] = True
                    out.append((s, t, n))
                    break
        n -= 1
        if n >= least:  # go on at the longest length that's left
            low, high = least - 1, n
            while low < high:
                k = (low + high + 1) // 2
                common = np.isin(a.runs(free_runs(mark_a, k), k), b.runs(free_runs(mark_b, k), k)).any()
                low, high = (k, high) if common else (low, k - 1)
            n = low
    return out


class Items:
    """A part of the benchmark, made ready for the join."""

    def __init__(self, rows: list[tuple[int | None, np.ndarray]], least: int):
        self.least = least
        self.ids = [i for i, _ in rows]
        self.words = [h for _, h in rows]
        each = [seeds(h, least) for h in self.words]
        seed = np.concatenate([np.zeros(0, np.uint64), *each])
        order = np.argsort(seed, kind="stable")
        self.item = np.repeat(np.arange(len(each)), np.array([len(x) for x in each], np.int64))[order]
        self.at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) for x in each)])[order]
        self.distinct, self.first, self.count = np.unique(seed[order], return_index=True, return_counts=True)

    def pairs(self, h: np.ndarray, offsets: np.ndarray, coverage: float) -> Iterable[tuple[int, int, float, int, int]]:
        """(document, item, coverage, tiles, words of the longest tile) of the pairs that count."""
        n = self.least
        doc_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        s = seeds(h, n)
        if not len(s) or not len(self.distinct):
            return
        k = np.minimum(np.searchsorted(self.distinct, s), len(self.distinct) - 1)
        hit = np.flatnonzero((doc_of[: len(s)] == doc_of[n - 1 :]) & (self.distinct[k] == s))
        if not len(hit):
            return
        # each document's distinct seeds, and the positions of items that they reach
        key = np.unique(np.stack([doc_of[hit], k[hit]], 1), axis=0)
        doc, k = key[:, 0], key[:, 1]
        entry = ragged(self.first[k], self.count[k])
        doc = np.repeat(doc, self.count[k])
        it, pos = self.item[entry], self.at[entry]
        order = np.lexsort((pos, it, doc))
        doc, it, pos = doc[order], it[order], pos[order]
        new = np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(it) != 0)))
        step = np.where(new, n, np.minimum(np.diff(pos, prepend=-n), n))
        starts = np.flatnonzero(new)
        for g, reach in zip(starts.tolist(), np.add.reduceat(step, starts).tolist()):
            i, d = int(it[g]), int(doc[g])
            size = len(self.words[i])
            if reach < coverage * size:
                continue
            got = tiles(self.words[i], h[offsets[d] : offsets[d + 1]], n)
            covered = sum(t[2] for t in got)
            if covered >= coverage * size:
                yield d, i, covered / size, len(got), got[0][2]


def prepared(benchmark: DataFrame, least: int) -> DataFrame:
    """u (a number for each row), item_id, n and h: the hashed words of the items that have a tile's length."""

    def run(batches):
        for batch in batches:
            for b in slices(batch):
                distinct, code, at = words(b.column("text"))
                h = word_hashes(distinct)[code]
                cells = pa.array([h[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
                out = pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(np.diff(at)), cells], ["item_id", "n", "h"])
                yield out.filter(pa.array(np.diff(at) >= least))

    rows = benchmark.select(key(benchmark, "item_id", "item_id"), "text")
    made = rows.mapInArrow(run, f"item_id {key_type(benchmark, 'item_id')}, n bigint, h binary")
    return written(made.withColumn("u", F.monotonically_increasing_id()), "items")


def seed_filter(items: DataFrame, least: int, bits: int = FILTER_BITS) -> bytes:
    """2 ** bits bits, set where a seed of the benchmark begins with their number."""
    segment = 1 << min(16, bits - 3)

    def run(batches):
        held = np.zeros(1 << bits - 3, np.uint8)
        for b in batches:
            for cell in b.column("h"):
                at = seeds(np.frombuffer(cell.as_buffer(), np.uint64), least) >> np.uint64(64 - bits)
                np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        parts = held.reshape(-1, segment)
        some = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([parts[i].tobytes() for i in some.tolist()], pa.binary())], ["segment", "part"])

    def both(t: pa.Table) -> pa.Table:
        part = np.zeros(segment, np.uint8)
        for cell in t.column("part").to_pylist():
            part |= np.frombuffer(cell, np.uint8)
        return pa.table({"segment": t.column("segment").slice(0, 1), "part": pa.array([part.tobytes()], pa.binary())})

    out = np.zeros((1 << bits - 3) // segment * segment, np.uint8).reshape(-1, segment)
    got = items.select("h").mapInArrow(run, "segment bigint, part binary").groupBy("segment").applyInArrow(both, "segment bigint, part binary").toArrow()
    for i, part in zip(got.column("segment").to_pylist(), got.column("part").to_pylist()):
        out[i] = np.frombuffer(part, np.uint8)
    return out.tobytes()


def found_at_once(base: DataFrame, items: DataFrame, least: int, coverage: float, ids: pa.DataType, fields: str) -> DataFrame:
    """The pairs that count, for a benchmark that every task can hold."""
    t = items.orderBy("u").select("item_id", "h").toArrow()
    shared = base.sparkSession.sparkContext.broadcast([(i, np.frombuffer(h, np.uint64)) for i, h in zip(t.column("item_id").to_pylist(), t.column("h").to_pylist())])

    def run(batches):
        made = Items(shared.value, least)
        for batch in batches:
            for b in slices(batch):
                distinct, code, offsets = words(b.column("text"))
                got = list(made.pairs(word_hashes(distinct)[code], offsets, coverage))
                doc, it, c, n, m = zip(*got) if got else ((),) * 5
                row = pa.array(doc, pa.int64())
                columns = [pa.array([made.ids[i] for i in it], ids), pa.array(c, pa.float64()), pa.array(n, pa.int32()), pa.array(m, pa.int32())]
                yield pa.RecordBatch.from_arrays([b.column("d").take(row), b.column("k").take(row), *columns], ["d", "k", "item_id", "coverage", "n_tiles", "longest"])

    return base.mapInArrow(run, fields)


def found_by_join(base: DataFrame, items: DataFrame, least: int, coverage: float, kind: str, fields: str) -> DataFrame:
    """The same for a benchmark of any size."""
    shared = base.sparkSession.sparkContext.broadcast(seed_filter(items, least))

    def of_docs(batches):
        known = np.frombuffer(shared.value, np.uint8)
        shift = np.uint64(64 - (len(known) * 8).bit_length() + 1)
        for batch in batches:
            for b in slices(batch):
                distinct, code, at = words(b.column("text"))
                s = seeds(word_hashes(distinct)[code], least)
                doc = np.repeat(np.arange(b.num_rows), np.diff(at))
                inside = doc[: len(s)] == doc[least - 1 :]
                where = s >> shift
                hit = np.flatnonzero(inside & (known[(where >> np.uint64(3)).astype(np.int64)] >> (where & np.uint64(7)).astype(np.uint8) & 1 > 0))
                pairs = np.unique(np.rec.fromarrays([doc[hit], s[hit]]))
                row = pa.array(pairs["f0"].astype(np.int64))
                yield pa.RecordBatch.from_arrays([b.column("d").take(row), b.column("k").take(row), pa.array(pairs["f1"].astype(np.uint64).view(np.int64))], ["d", "k", "seed"])

    def of_items(batches):
        for b in batches:
            each = [seeds(np.frombuffer(c.as_buffer(), np.uint64), least) for c in b.column("h")]
            row = pa.array(np.repeat(np.arange(len(each)), [len(x) for x in each]))
            yield pa.RecordBatch.from_arrays([b.column("u").take(row), b.column("n").take(row), pa.array(np.concatenate([np.zeros(0, np.uint64), *each]).view(np.int64))], ["u", "n", "seed"])

    def tile(batches):
        for batch in batches:
            for b in slices(batch):
                distinct, code, at = words(b.column("text"))
                h, hit, got = word_hashes(distinct)[code], [], []
                for i, cell in enumerate(b.column("h")):
                    item = np.frombuffer(cell.as_buffer(), np.uint64)
                    t = tiles(item, h[at[i] : at[i + 1]], least)
                    n = sum(x[2] for x in t)
                    if t and n >= coverage * len(item):
                        hit.append(i)
                        got.append((n / len(item), len(t), t[0][2]))
                row = pa.array(hit, pa.int64())
                c, n, m = zip(*got) if got else ((),) * 3
                yield pa.RecordBatch.from_arrays([*(b.column(x).take(row) for x in ("d", "k", "item_id")), pa.array(c, pa.float64()), pa.array(n, pa.int32()), pa.array(m, pa.int32())], ["d", "k", "item_id", "coverage", "n_tiles", "longest"])

    left = base.mapInArrow(of_docs, f"d {kind}, k bigint, seed bigint")
    right = items.select("u", "n", "h").mapInArrow(of_items, "u bigint, n bigint, seed bigint")
    # a seed of an item covers at most `least` of its words
    pairs = left.join(right, "seed").groupBy("d", "k", "u", "n").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") * least >= F.col("n") * coverage)
    pairs = written(pairs.select(F.col("d").alias("pd"), F.col("k").alias("pk"), "u"), "pairs")
    rows = base.join(pairs, F.col("d").eqNullSafe(F.col("pd")) & (F.col("k") == F.col("pk"))).join(items.select("u", "item_id", "h"), "u")
    return rows.select("d", "k", "text", "item_id", "h").mapInArrow(tile, fields)


def contamination(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE, part: int = PART) -> DataFrame:
    """d, k (hash of the text), item_id, coverage, n_tiles, longest: a row for each pair that counts."""
    kind = key_type(docs, "doc_id")
    base = docs.select(key(docs, "doc_id", "d"), text_key(F.col("text")).alias("k"), "text")
    items = prepared(benchmark, least)
    fields = f"d {kind}, k bigint, item_id {key_type(benchmark, 'item_id')}, coverage double, n_tiles int, longest int"
    total = items.agg(F.sum("n")).first()[0] or 0
    if total <= part:
        return found_at_once(base, items, least, coverage, to_arrow_type(items.schema["item_id"].dataType), fields)
    return found_by_join(base, items, least, coverage, kind, fields)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE, part: int = PART) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest."""
    return contamination(docs, benchmark, least, coverage, part).drop("k").withColumnRenamed("d", "doc_id")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE, part: int = PART) -> DataFrame:
    """docs without those of any pair that counts; the same columns."""
    d, k, m = (fresh(docs, x) for x in ("bd_d", "bd_k", "bd_m"))
    gone = written(contamination(docs, benchmark, least, coverage, part).select("d", "k").distinct(), "contaminated").toDF(d, m)
    x = docs.withColumn(k, text_key(F.col("text")))
    x = x.join(gone.hint("shuffle_hash"), x["doc_id"].cast(key_type(docs, "doc_id")).eqNullSafe(gone[d]) & (x[k] == gone[m]), "left_anti")
    return x.select(*(f"`{c}`" for c in docs.columns))

