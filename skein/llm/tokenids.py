"""Token ids under a canonical, length-limited Huffman code.

Ids are made once and written to the shared folder. Their counts over the whole corpus give code lengths of at most
MAX_BITS (package-merge); codes are canonical, so the lengths alone are the code book. Each block of BLOCK ids is coded
on its own, and notes the bit offset of every CHECKPOINT-th id, from which decoding by table can begin.

Defined results. An empty text has no ids, and a piece of length 0; a null text's piece is marked. A document that
doesn't fit the rest of a block goes on in the next, as another piece; nothing is cut off. Null or repeated doc_ids are
kept, each row on its own; ids of whole numbers as bigint, others in their own type. Other columns are ignored. An empty table gives no blocks. A corpus of one distinct id has a
code of one bit.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import VOCABULARY, encoder, vocabulary
from .common import key, key_type, slices, written

BLOCK, CHECKPOINT, MAX_BITS = 1 << 18, 1024, 20


def schemas(kind: str, arrow: pa.DataType) -> tuple[str, pa.Schema]:
    """Of the blocks, for ids of this type."""
    piece = pa.struct([("doc_id", arrow), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("is_null", pa.bool_())])
    block = pa.schema([("block", pa.string()), ("n_ids", pa.int64()), ("payload", pa.binary()), ("every", pa.int32()), ("checkpoints", pa.list_(pa.int64())), ("pieces", pa.list_(piece)), ("code_lengths", pa.binary())])
    return f"block string, n_ids bigint, payload binary, every int, checkpoints array<bigint>, pieces array<struct<doc_id: {kind}, first_id: bigint, n_ids: bigint, is_null: boolean>>, code_lengths binary", block


def id_type(n: int):
    """The narrowest type for ids below n."""
    return np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")


def token_ids(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (binary, little endian) and is_null, row by row."""
    data = vocabulary(docs.sparkSession, path)

    def run(batches):
        bpe = encoder(data.value)
        kind = id_type(len(bpe.width))
        for batch in batches:
            for b in slices(batch):
                ids, n = bpe.ids(b.column("text"))
                ids, at = ids.astype(kind), np.concatenate(([0], np.cumsum(n)))
                cells = [ids[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cells, pa.binary()), b.column("text").is_null()], ["doc_id", "ids", "is_null"])

    return docs.select(key(docs, "doc_id", "doc_id"), "text").mapInArrow(run, f"doc_id {key_type(docs, 'doc_id')}, ids binary, is_null boolean")


def id_counts(ids: DataFrame, size: int) -> np.ndarray:
    """How often each id below size occurs, over all rows. What comes to the driver is as long as the vocabulary."""
    kind = id_type(size)

    def run(batches):
        n = np.zeros(size, np.int64)
        for b in batches:
            cell = b.column("ids")
            at = np.frombuffer(cell.buffers()[1], np.int32)[cell.offset : cell.offset + len(cell) + 1]
            if len(cell):
                n += np.bincount(np.frombuffer(memoryview(cell.buffers()[2] or b"")[at[0] : at[-1]], kind), minlength=size)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(n[some])], ["id", "n"])

    got = ids.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return out


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most limit bits, 0 for ids that don't occur (package-merge). Ties go to lower ids."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{limit} bits are too few for {len(used)} ids")
    order = used[np.argsort(counts[used], kind="stable")]
    weight, n = counts[order].astype(np.float64), len(order)
    levels, now = [], weight
    for _ in range(limit - 1):
        pairs = now[: len(now) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate((weight, pairs))
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)
        now = merged[rank]
    take = 2 * n - 2
    total = np.zeros(n, np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        total[:leaves] += 1
        take = 2 * (take - leaves)
    total[:take] += 1
    lengths[order] = total
    return lengths


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then by id."""
    out = np.zeros(len(lengths), np.uint64)
    order = np.flatnonzero(lengths)
    order = order[np.argsort(lengths[order], kind="stable")]
    code, last = 0, 0
    for n in np.unique(lengths[order]).tolist():
        these = order[lengths[order] == n]
        code <<= n - last
        out[these] = code + np.arange(len(these), dtype=np.uint64)
        code, last = code + len(these), n
    return out


def pack_bits(ids: np.ndarray, lengths: np.ndarray, code: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The coded ids, and the bit at which each begins. A code spans at most two 32-bit words."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    word = starts >> 5
    value = code[ids] << (64 - (starts & 31) - n).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    sums = np.add.reduceat(value, first)  # no two codes share a bit
    out = np.zeros(int(ends[-1] + 31 >> 5) + 1, np.uint32)
    out[word[first]] = sums >> np.uint64(32)
    out[word[first] + 1] |= (sums & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out.astype(">u4").tobytes()[: int(ends[-1] + 7 >> 3)], starts


def encoded(docs: DataFrame, path: str = VOCABULARY, block: int = BLOCK, checkpoint: int = CHECKPOINT, max_bits: int = MAX_BITS) -> DataFrame:
    """One row a block, and one row named book, which alone holds the code lengths, compressed."""
    spark = docs.sparkSession
    size = len(encoder(vocabulary(spark, path).value).width)
    kind = id_type(size)
    ids = written(token_ids(docs, path), "ids")
    lengths = code_lengths(id_counts(ids, size), max_bits)
    ddl, arrow = schemas(key_type(docs, "doc_id"), to_arrow_type(ids.schema["doc_id"].dataType))
    shared = spark.sparkContext.broadcast(lengths)  # as long as the vocabulary

    def run(batches):
        lengths = shared.value
        code = codes(lengths)
        part, made = TaskContext.get().partitionId(), 0
        held, n, pieces = [], 0, []

        def close():
            nonlocal held, n, pieces, made
            data, starts = pack_bits(np.concatenate(held), lengths, code) if n else (b"", np.zeros(0, np.int64))
            row = {"block": f"{part:06d}-{made:06d}", "n_ids": n, "payload": data, "every": checkpoint, "checkpoints": starts[::checkpoint].tolist(), "pieces": pieces}
            held, n, pieces, made = [], 0, [], made + 1
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for b in batches:
            for doc, cell, null in zip(b.column("doc_id").to_pylist(), b.column("ids"), b.column("is_null").to_pylist()):
                x, at = np.frombuffer(cell.as_buffer(), kind), 0
                while True:
                    step = min(len(x) - at, block - n)
                    pieces.append({"doc_id": doc, "first_id": at, "n_ids": step, "is_null": null})
                    if step:
                        held.append(x[at : at + step])
                    at, n = at + step, n + step
                    if n >= block:
                        yield close()
                    if at >= len(x):
                        break
        if pieces:
            yield close()

    made = ids.mapInArrow(run, ddl)
    if not lengths.any():
        return made
    book = spark.createDataFrame([("book", zlib.compress(lengths.tobytes(), 9))], "block string, code_lengths binary")
    return made.unionByName(book, allowMissingColumns=True)


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and length by the next `bits` bits, and that number of bits."""
    bits = int(lengths.max(initial=1))
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    spans = 1 << (bits - lengths[used].astype(np.int64))
    ids, size = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.uint8)
    total = int(spans.sum())
    ids[:total], size[:total] = np.repeat(used, spans), np.repeat(lengths[used], spans)
    return ids, size, bits


def decode(payload: bytes, n: int, gap: int, checkpoints: list[int], table: tuple[np.ndarray, np.ndarray, int], first: int = 0, count: int | None = None) -> np.ndarray:
    """Ids first, ..., first + count - 1 of a block, from the checkpoint before (one every gap ids) on, all checkpoints advancing together."""
    ids, size, bits = table
    count = n - first if count is None else count
    if not count:
        return np.zeros(0, np.uint32)
    low, high = first // gap, (first + count - 1) // gap + 1
    at = np.asarray(checkpoints[low:high], np.int64)
    data = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint64)
    out = np.zeros((len(at), gap), np.uint32)
    for k in range(min(gap, n)):
        byte = np.minimum(at >> 3, len(payload))
        window = data[byte] << np.uint64(24) | data[byte + 1] << np.uint64(16) | data[byte + 2] << np.uint64(8) | data[byte + 3]
        peek = (window >> (32 - bits - (at & 7)).astype(np.uint64)) & np.uint64((1 << bits) - 1)
        out[:, k] = ids[peek]
        at = at + size[peek]
    return out.ravel()[first - low * gap : first - low * gap + count]


def decoded(blocks: DataFrame) -> DataFrame:
    """One row a piece: doc_id, first_id, ids, is_null. The code book, as long as the vocabulary, is read first."""
    books = blocks.filter("code_lengths is not null").select("code_lengths").take(1)
    data = books[0].code_lengths if books else zlib.compress(bytes(1))
    kind = blocks.select(F.inline("pieces")).schema[0].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("first_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("is_null", pa.bool_())])

    def run(batches):
        table = decoding_table(np.frombuffer(zlib.decompress(data), np.uint8))
        for b in batches:
            for r in b.to_pylist():
                ids, at, rows = decode(r["payload"], r["n_ids"], r["every"], r["checkpoints"], table), 0, []
                for p in r["pieces"]:
                    rows.append({"doc_id": p["doc_id"], "first_id": p["first_id"], "ids": ids[at : at + p["n_ids"]].tolist(), "is_null": p["is_null"]})
                    at += p["n_ids"]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return blocks.filter("payload is not null").drop("code_lengths").mapInArrow(run, f"doc_id {kind.simpleString()}, first_id bigint, ids array<bigint>, is_null boolean")
