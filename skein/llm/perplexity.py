"""Quality by perplexity under a modified Kneser-Ney model of n-grams, one model a language.

Symbols are the UTF-8 bytes of a text in lower case, outer white space removed and inner white space as single spaces;
each text begins after ORDER - 1 zero bytes. So an n-gram of ORDER bytes is a 64-bit number, whatever the language, and
counts are exact. Spark counts all n-grams of all distinct texts of a language, each text once however many documents
hold it (texts are compared as normalised, by length and a 64-bit hash); lower orders count distinct extensions (Kneser-Ney), with
three discounts an order and language (Chen and Goodman). The model is one table in the shared folder, n-grams of all
orders with count, log probability, and total and back-off weight of their context. A task that scores holds a
language's rows as arrays sorted by hash (a bijection of order and n-gram, so no two collide), and looks each distinct
n-gram of a batch up once. Of a model of more than MODEL_ROWS rows it holds only those that its own chunk of the texts
needs: each chunk's distinct n-grams are joined with the table, and what they may back off to, order by order.

A text has two scores, mean negative log probabilities a byte. The first is under the model as it is. The second is held
out: the text's own occurrences are taken from the counts, an n-gram that is left without any counts as unseen, and backs
off with its context's weight where other texts have that context; shorter n-grams lose what such n-grams had added to
them. Others keep the model's probability.

A language's lower band lies BANDS[0] widths below the median of the first score, its upper band BANDS[1] widths above
the median of the held-out one; a width is the root of the squares of the scaled median absolute deviation and, since
short texts vary more, of NOISE / sqrt(bytes). What lies outside is rejected: above, it reads unlike the language; below,
it is monotonous, or, like long random letters, foretold by its own counts alone. Median and deviation come from
histograms of the distinct texts with steps of STEP, so no verdict depends on how often a text is repeated.

Defined results. A null lang is treated as an empty one. A text that is null, empty or white space has no score and is
rejected. Where all deviations of a language are 0, NOISE alone counts. Repeated rows count each; ids may be of any type.
All columns are kept.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SLICE_BYTES, SLICE_ROWS, fresh, fresh_path, key, key_type, mix, release, slices, text_key, written

ORDER = 6
BANDS, NOISE, STEP = (2.0, 2.8), 2.5, 1e-4
#: Rows of all languages' models that a worker holds at most, 32 bytes each.
MODEL_ROWS = 8 << 20
#: Bytes of text that are scored in one step; a step takes some 40 bytes for each.
SCORED_BYTES = 2 << 20
#: Bytes of the texts that are scored together where a model is larger.
CHUNK = 32 << 20
#: Distinct n-grams that a counting task holds before it passes them on.
HELD = 3 << 19


def normal(text: pa.Array) -> pa.Array:
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(text, "")), r"[\s\x{85}\x{a0}]+", " ")
    return pc.utf8_trim_whitespace(plain)


def grams(text: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of normalised texts, one for each byte, and the number of bytes by text."""
    flat = text.cast(pa.large_binary())
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    out = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    width = 1
    while width < order:  # longer n-grams of shorter ones
        step = min(width, order - width)
        out[step:] |= out[:-step] << np.uint64(8 * step)
        width += step
    n, starts = np.diff(ends), ends[:-1] - ends[0]
    for k in range(order - 1):  # nothing of the text before
        out[starts[n > k] + k] &= np.uint64((1 << 8 * (k + 1)) - 1)
    return out, n


def parts(text: pa.Array, order: int = ORDER, size: int = SLICE_BYTES):
    """The n-grams of normalised texts, and their number by text; a text alone that's longer than size comes in pieces."""
    if len(text) != 1 or (data := text[0].as_buffer()).size <= size:
        yield grams(text, order)
        return
    for at in range(0, data.size, size):
        before = min(at, order - 1)
        g, n = grams(pa.array([data.slice(at - before, min(size, data.size - at) + before).to_pybytes()]), order)
        yield g[before:], n - before


def by_language(b: pa.RecordBatch):
    """Each language of a batch, with the rows that are in it."""
    lang = pc.fill_null(b.column("lang"), "").dictionary_encode()
    code = lang.indices.to_numpy()
    for i, name in enumerate(lang.dictionary.to_pylist()):
        yield name, np.flatnonzero(code == i)


def squeeze(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)


def _base(docs: DataFrame) -> DataFrame:
    return docs.select(key(docs, "doc_id", "d"), text_key(F.col("text")).alias("k"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text")


def text_hash(text: bytes) -> int:
    import xxhash

    return int.from_bytes(xxhash.xxh3_64_digest(text), "big", signed=True)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """lang, n_bytes, h and body (the normalised text, compressed), a row for each text of a language that isn't empty."""

    def run(batches):
        import zstandard

        squash = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for b in slices(batch):
                each = normal(b.column("text")).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [b.column("lang"), pa.array([len(t) for t in each], pa.int64()), pa.array([text_hash(t) for t in each], pa.int64()), pa.array([squash.compress(t) for t in each], pa.binary())],
                    ["lang", "n_bytes", "h", "body"],
                )

    rows = _base(docs).select("lang", "text").mapInArrow(run, "lang string, n_bytes bigint, h bigint, body binary").filter("n_bytes > 0")
    return rows.groupBy("lang", "n_bytes", "h").agg(F.first("body").alias("body"))


def unpacked(batch: pa.RecordBatch, size: int = SLICE_BYTES):
    """lang and text of consecutive rows of a batch with at most `size` bytes of text; a longer text stands alone, whole."""
    import zstandard

    d = zstandard.ZstdDecompressor()
    ends = np.cumsum(batch.column("n_bytes").to_numpy())
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, min(start + SLICE_ROWS, int(np.searchsorted(ends, before + size, "right"))))
        b = batch.slice(start, stop - start)
        text = pa.array([d.decompress(x).decode() for x in b.column("body").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([b.column("lang"), text], ["lang", "text"])
        pa.default_memory_pool().release_unused()
        start = stop
    release()


def counted(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, n over all distinct texts."""

    def run(batches):
        held: dict[str, tuple[list, list]] = {}
        size = 0

        def out():
            for lang, (k, c) in held.items():
                key, n = squeeze(k, c)
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(key), np.int32))), pa.array(key.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            for b in unpacked(batch):
                text = b.column("text")
                for lang, rows in by_language(b):
                    for g, _ in parts(text.take(pa.array(rows)), order):
                        found = pc.value_counts(pa.array(g.view(np.int64)))
                        k, c = held.setdefault(lang, ([], []))
                        k.append(found.field("values").to_numpy().view(np.uint64))
                        c.append(found.field("counts").to_numpy())
                        size += len(found)
                if size >= HELD:
                    held = {lang: tuple([x] for x in squeeze(*kc)) for lang, kc in held.items()}
                    size = sum(len(k[0]) for k, _ in held.values())
                    if size >= HELD * 3 // 4:
                        yield from out()
                        held, size = {}, 0
        yield from out()
        held.clear()
        release()

    return distinct_texts(docs).mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def discounted(n: Column) -> Column:
    return F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))


def model(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, order, gram, n, logp, and total and logb (log of the back-off weight) of its context."""
    levels = {order: written(counted(docs, order), f"grams{order}")}
    for k in range(order - 1, 0, -1):
        levels[k] = written(levels[k + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"grams{k}")
    out, lower = [], None
    for k in range(1, order + 1):
        t = levels[k]
        of = [F.count_if(F.col("n") == i).cast("double").alias(f"c{i}") for i in (1, 2, 3, 4)]
        y = F.when(F.col("c1") > 0, F.col("c1") / (F.col("c1") + 2 * F.col("c2"))).otherwise(0.0)
        ds = [F.when(F.col(f"c{i}") > 0, F.greatest(F.lit(0.0), i - (i + 1) * y * F.col(f"c{i + 1}") / F.col(f"c{i}"))).otherwise(0.0).alias(f"d{i}") for i in (1, 2, 3)]
        t = t.join(t.groupBy("lang").agg(*of).select("lang", *ds), "lang")
        t = t.select("lang", "gram", F.shiftright("gram", 8).alias("context"), "n", discounted(F.col("n")).alias("cut"))
        c = t.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("cuts"))
        t = t.join(c.select("lang", "context", "total", (F.col("cuts") / F.col("total")).alias("share")), ["lang", "context"])
        low = F.lit(1 / 256)
        if lower is not None:
            t = t.withColumn("tail", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("low")), ["lang", "tail"])
            low = F.col("low")
        lower = written(t.select("lang", "gram", "n", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("share") * low).alias("p"), "total", "share"), f"p{k}")
        logb = F.when(F.col("share") > 0, F.ln("share")).otherwise(-99.0)
        out.append(lower.select("lang", F.lit(k).alias("order"), "gram", "n", F.ln("p").alias("logp"), "total", logb.alias("logb")))
    return reduce(DataFrame.union, out)


def stored(df: DataFrame) -> str:
    """Writes the model as sorted hash arrays, whose files each hold few languages; returns its path."""
    path = fresh_path(df.sparkSession, "model")

    def hashed(batches):
        for b in batches:
            h = HashArrays.key(b.column("gram").to_numpy(), b.column("order").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(h), clipped(b.column("n")), b.column("logp"), clipped(b.column("total")), b.column("logb")], ["lang", *HashArrays.FIELDS])

    made = df.mapInArrow(hashed, "lang string, h bigint, n int, logp double, total int, logb double")
    made.repartitionByRange("lang", "h").sortWithinPartitions("lang", "h").write.parquet(path)
    return path


def clipped(count: pa.Array) -> pa.Array:
    """A count as 32 bits: it's only compared with those of one text."""
    return pc.min_element_wise(count, pa.scalar(np.iinfo(np.int32).max, pa.int64())).cast(pa.int32())


def pairs(text: pa.Array, order: int, size: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, n-gram and number of occurrences of each n-gram of each text, sorted; and bytes by text. At most 2 ** 16 texts."""
    if len(text) == 1:  # it may be long
        found = [(*np.unique(g, return_counts=True), int(n[0])) for g, n in parts(text, order, size)]
        gram, own = squeeze([x[0] for x in found], [x[1] for x in found])
        return np.zeros(len(gram), np.int64), gram, own, np.array([sum(x[2] for x in found)])
    g, n = grams(text, order)
    both, own = np.unique(np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(48) | g, return_counts=True)
    return (both >> np.uint64(48)).astype(np.int64), both & _LOW, own, n


_LOW = np.uint64((1 << 48) - 1)


class HashArrays:
    """Rows of one language's model as arrays: hashes in order, and n, logp, total and logb."""

    FIELDS = ("h", "n", "logp", "total", "logb")

    def __init__(self, order: int, t: pa.Table):
        self.order = order
        self.keys, self.n, self.logp, self.total, self.logb = (t.column(c).to_numpy() for c in self.FIELDS)
        if (self.keys[1:] <= self.keys[:-1]).any():
            raise ValueError("the model isn't in order")

    @classmethod
    def of_rows(cls, order: int, t: pa.Table) -> "HashArrays":
        h = cls.key(t.column("gram").to_numpy(), t.column("order").to_numpy())
        made = pa.table({"h": h, "n": clipped(t.column("n").combine_chunks()), "logp": t.column("logp"), "total": clipped(t.column("total").combine_chunks()), "logb": t.column("logb")})
        return cls(order, made.take(pa.array(np.argsort(h))))

    @staticmethod
    def key(gram: np.ndarray, order) -> np.ndarray:
        return mix(gram.view(np.uint64) | np.asarray(order, np.uint64) << np.uint64(56)).view(np.int64)

    def find(self, gram: np.ndarray, k: int) -> np.ndarray:
        """Places of distinct n-grams of order k, each of which the model has."""
        h = self.key(gram, k)
        order = np.argsort(h)  # near keys one after another
        at = np.empty(len(h), np.int64)
        at[order] = np.minimum(np.searchsorted(self.keys, h[order]), max(0, len(self.keys) - 1))
        if len(h) and (not len(self.keys) or (self.keys[at] != h).any()):
            raise ValueError("the model lacks an n-gram of a text that it should have counted")
        return at

    def places(self, gram: np.ndarray, k: int) -> np.ndarray:
        """The same for n-grams that may be repeated."""
        found = pa.array(gram.view(np.int64)).dictionary_encode()
        return self.find(found.dictionary.to_numpy().view(np.uint64), k)[found.indices.to_numpy()]

    def held_out(self, row: np.ndarray, gram: np.ndarray, own: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
        """Log probabilities by text of its n-grams, sorted and each once, without the text's own occurrences. at: their places."""
        out, weight = np.zeros(m), own.astype(float)
        for k in range(self.order, 0, -1):
            if not len(gram):
                return out
            if k < self.order:
                at = self.places(gram, k)
            left = self.n[at] <= own
            out += np.bincount(row[~left], weight[~left] * self.logp[at[~left]], m)
            # how much of each context's total is the text's own
            context = gram >> np.uint64(8)
            first = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (context[1:] != context[:-1]))))
            ours = np.repeat(np.add.reduceat(own, first), np.diff(np.append(first, len(row))))
            other = left & (self.total[at] > ours)
            out += np.bincount(row[other], weight[other] * self.logb[at[other]], m)
            shorter = row[left].astype(np.uint64) << np.uint64(48) | gram[left] & np.uint64((1 << 8 * (k - 1)) - 1)
            both, back, own = np.unique(shorter, return_inverse=True, return_counts=True)
            weight = np.bincount(back, weight[left], len(both))
            row, gram = (both >> np.uint64(48)).astype(np.int64), both & _LOW
        return out + (np.bincount(row, weight, m) * np.log(1 / 256) if len(row) else 0)

    def score(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of each normalised text, and its two scores (0 where there are no bytes)."""
        m = len(text)
        if m == 1:
            row, gram, own, size = pairs(text, self.order)
            at = self.find(gram, self.order)
            score, held = np.bincount(row, own * self.logp[at], 1), self.held_out(row, gram, own, at, 1)
        else:
            g, size = grams(text, self.order)
            found = pa.array(g.view(np.int64)).dictionary_encode()
            distinct, code = found.dictionary.to_numpy().view(np.uint64), found.indices.to_numpy()
            at = self.find(distinct, self.order)
            # what the model has more often than all these texts together is none's own alone; of the rest, all of a context counts
            rare = self.n[at] <= np.bincount(code, minlength=len(distinct))
            context = distinct >> np.uint64(8)
            rare = np.isin(context, np.unique(context[rare]))
            each, some = self.logp[at][code], rare[code]
            full = np.flatnonzero(size)
            starts = (np.cumsum(size) - size)[full]
            score, held = np.zeros(m), np.zeros(m)
            if len(full):
                score[full] = np.add.reduceat(each, starts)
                each[some] = 0
                held[full] = np.add.reduceat(each, starts)
            row = np.repeat(np.arange(m, dtype=np.uint64), size)[some]
            both, own = np.unique(row << np.uint64(48) | g[some], return_counts=True)
            row, gram = (both >> np.uint64(48)).astype(np.int64), both & _LOW
            held += self.held_out(row, gram, own, self.places(gram, self.order), m)
        bytes_ = np.maximum(size, 1)
        return size, np.round(-score / bytes_, 9), np.round(-held / bytes_, 9)


_MODELS: dict[tuple[str, str], HashArrays] = {}


def loaded(path: str, lang: str, order: int) -> HashArrays:
    """The model of a language; a worker holds models of at most MODEL_ROWS rows together."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSystem

    key = path, lang
    if key not in _MODELS:
        for other in [k for k in _MODELS if k[0] != path]:
            del _MODELS[other]
        fs, at = FileSystem.from_uri(path if "://" in path else f"file://{path}")
        made = HashArrays(order, pq.read_table(at, columns=list(HashArrays.FIELDS), filesystem=fs, filters=[("lang", "=", lang)], partitioning=None, use_threads=False))
        while _MODELS and sum(len(m.keys) for m in _MODELS.values()) + len(made.keys) > MODEL_ROWS:
            del _MODELS[next(iter(_MODELS))]
        _MODELS[key] = made
        release()
    return _MODELS[key]


_SCORED = ", lang string, n_bytes bigint, h bigint"


def scores(docs: DataFrame, order: int = ORDER, model_rows: int = MODEL_ROWS) -> DataFrame:
    """d, k, lang, n_bytes, h (hash of the normalised text), score and held of each document; null scores where there are no bytes."""
    table = model(docs, order)
    base, first = _base(docs), f"d {key_type(docs, 'doc_id')}, k bigint"
    if table.count() > model_rows:
        def named(batches):
            for batch in batches:
                for b in slices(batch):
                    text = normal(b.column("text")).cast(pa.binary())
                    h = pa.array([text_hash(t) for t in text.to_pylist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column("d"), b.column("k"), b.column("lang"), pc.binary_length(text).cast(pa.int64()), h], ["d", "k", "lang", "n_bytes", "h"])

        return base.mapInArrow(named, first + _SCORED).join(chunked_scores(docs, table, order), ["lang", "n_bytes", "h"], "left").select("d", "k", "lang", "n_bytes", "h", "score", "held")
    path = stored(table)

    def run(batches):
        for batch in batches:
            for b in slices(batch, size=SCORED_BYTES):
                text = normal(b.column("text"))
                size, score, held = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows), np.zeros(b.num_rows)
                for lang, rows in by_language(b):
                    own = text.take(pa.array(rows))
                    if pc.sum(pc.binary_length(own)).as_py():
                        size[rows], score[rows], held[rows] = loaded(path, lang, order).score(own)
                h = pa.array([text_hash(t) for t in text.cast(pa.binary()).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("d"), b.column("k"), b.column("lang"), pa.array(size), h, pa.array(score, mask=size == 0), pa.array(held, mask=size == 0)], ["d", "k", "lang", "n_bytes", "h", "score", "held"])

    return base.mapInArrow(run, first + _SCORED + ", score double, held double")


def chunked_scores(docs: DataFrame, table: DataFrame, order: int, chunk: int = CHUNK) -> DataFrame:
    """lang, n_bytes, h, score and held of the distinct texts. A task has one chunk of a language's texts, and of the model what these need."""
    texts = written(distinct_texts(docs), "texts")
    chunks = max(1, -(-(texts.agg(F.sum("n_bytes")).first()[0] or 0) // chunk))
    texts = texts.withColumn("chunk", F.pmod(F.xxhash64("h", "n_bytes"), F.lit(chunks)))

    def asked(t: pa.Table) -> pa.Table:
        """The distinct n-grams of a chunk, and how often one text has each at most."""
        gram, most = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in t.to_batches():
            for b in unpacked(batch):
                _, g, own, _ = pairs(b.column("text"), order)
                g, own = np.concatenate((gram, g)), np.concatenate((most, own))
                at = np.argsort(g, kind="stable")
                first = np.flatnonzero(np.diff(g[at], prepend=~g[at[:1]]))
                gram, most = g[at[first]], np.maximum.reduceat(own[at], first)
        same = pa.array(np.zeros(len(gram), np.int32))
        return pa.table({"lang": t.column("lang").take(same), "chunk": t.column("chunk").take(same), "gram": pa.array(gram.view(np.int64)), "most": pa.array(most)})

    wanted, got = texts.groupBy("lang", "chunk").applyInArrow(asked, "lang string, chunk bigint, gram bigint, most bigint"), []
    for k in range(order, 0, -1):
        got.append(written(wanted.join(table.filter(F.col("order") == k), ["lang", "gram"]), f"needed{k}"))
        # a text may lack other occurrences of these, and then goes on to shorter ones
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)).alias("gram")
        wanted = got[-1].filter("n <= most").groupBy("lang", "chunk", shorter).agg(F.count(F.lit(1)).alias("most"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        m, out = HashArrays.of_rows(order, right), []
        for batch in left.to_batches():
            size = 0
            for b in unpacked(batch, SCORED_BYTES):
                _, score, held = m.score(b.column("text"))
                own = batch.slice(size, b.num_rows)
                size += b.num_rows
                out.append(pa.table({"lang": own.column("lang"), "n_bytes": own.column("n_bytes"), "h": own.column("h"), "score": score, "held": held}))
        return pa.concat_tables(out) if out else left.select(["lang", "n_bytes", "h"]).append_column("score", pa.array([], pa.float64())).append_column("held", pa.array([], pa.float64()))

    needed = reduce(DataFrame.union, got)
    return texts.groupBy("lang", "chunk").cogroup(needed.groupBy("lang", "chunk")).applyInArrow(run, "lang string, n_bytes bigint, h bigint, score double, held double")


def median(values: DataFrame, name: str) -> DataFrame:
    """lang and the lower median of the column bin, from its histogram."""
    w = W.partitionBy("lang").orderBy("bin")
    h = values.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"))
    h = h.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(W.partitionBy("lang")))
    return h.filter(F.col("upto") * 2 >= F.col("all")).groupBy("lang").agg(F.min("bin").alias(name))


def judged(docs: DataFrame, order: int = ORDER, bands: tuple[float, float] = BANDS, noise: float = NOISE, model_rows: int = MODEL_ROWS) -> DataFrame:
    """d, k, lang, n_bytes, score, held, lower (band of score), upper (band of held), keep for each document."""
    s = written(scores(docs, order, model_rows), "scores")
    each = s.filter("score is not null").dropDuplicates(["lang", "n_bytes", "h"])
    each = written(each.select("lang", *(F.round(F.col(c) / STEP).cast("bigint").alias(c) for c in ("score", "held"))), "bins")
    out = s
    for c, name, by in (("score", "lower", -bands[0]), ("held", "upper", bands[1])):
        b = each.select("lang", F.col(c).alias("bin"))
        centre = median(b, "centre")
        spread = median(b.join(centre, "lang").select("lang", F.abs(F.col("bin") - F.col("centre")).alias("bin")), "spread")
        width = F.sqrt(F.pow(F.col("spread") * (STEP * 1.4826), 2) + noise**2 / F.greatest("n_bytes", F.lit(1)))
        out = out.join(centre.join(spread, "lang"), "lang", "left").withColumn(name, F.col("centre") * STEP + by * width).drop("centre", "spread")
    keep = F.coalesce((F.col("score") >= F.col("lower")) & (F.col("held") <= F.col("upper")), F.lit(False))
    return out.withColumn("keep", keep).select("d", "k", "lang", "n_bytes", "score", "held", "lower", "upper", "keep")


def accepted(docs: DataFrame, **options) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity (a byte) and held-out perplexity with their bands for each document that is kept."""
    j = judged(docs, **options).filter("keep")
    return j.select(F.col("d").alias("doc_id"), "lang", "n_bytes", F.exp("score").alias("perplexity"), F.exp("held").alias("held_out"), F.exp("lower").alias("lower_band"), F.exp("upper").alias("upper_band"))


def drop_rejected(docs: DataFrame, **options) -> DataFrame:
    """docs without the rejected; the same columns."""
    d, k, m, l, g = (fresh(docs, x) for x in ("qr_d", "qr_k", "qr_m", "qr_l", "qr_g"))
    gone = written(judged(docs, **options).filter("not keep").select("d", "k", "lang").distinct(), "rejected").toDF(d, m, l)
    x = docs.withColumn(k, text_key(F.col("text"))).withColumn(g, F.coalesce(F.col("lang").cast("string"), F.lit("")))
    x = x.join(gone.hint("shuffle_hash"), x["doc_id"].cast(key_type(docs, "doc_id")).eqNullSafe(gone[d]) & (x[k] == gone[m]) & (x[g] == gone[l]), "left_anti")
    return x.select(*(f"`{c}`" for c in docs.columns))
