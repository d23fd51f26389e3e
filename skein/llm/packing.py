"""Vector bin packing of training examples by the dot-product heuristic.

An example is a vector (tokens, segments, loss-bearing tokens). A pack has a limit in each dimension. One pack is open
at a time: of the examples that fit its residual capacity, the one whose demand has the largest weighted dot product
with that residual goes in; where none fits, the pack is closed. Weights are each dimension's mean demand.

Examples are dealt by a hash (of the row's place, too, so that copies don't crowd) into shards of about SHARD examples,
each packed on its own: the work is linear in the input, and two runs over the same files agree. Only each shard's last pack can stay emptier than the heuristic would leave it.

Defined results. A null text or an empty one has no tokens. An example without tokens is returned with a null pack.
An example beyond a limit is cut into consecutive pieces, each as long as the limits allow; nothing is dropped. A
conversation is also cut at the first turn beyond every CHAPTER tokens; piece numbers follow its order. Turns
with a null conv_id form one example. Repeated rows count each. Ids of whole numbers come back as bigint, others (strings)
in their own type. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY, encoder, vocabulary
from .common import key, key_type, running, slices, spread, text_key, written

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 4096, 24, 3072
LOSS_ROLES = ("assistant",)
SHARD = 4096
#: Shards that one task packs, one after another: some seconds of work.
SHARDS_A_TASK = 2
#: Tokens after which a conversation is cut in any case, so that none, however long, is held whole by one task.
CHAPTER = 1 << 20


def token_counts(df: DataFrame, keys: list[str], path: str = VOCABULARY) -> DataFrame:
    """keys and n_tokens of the column text, row by row."""
    data = vocabulary(df.sparkSession, path)

    def count(batches):
        bpe = encoder(data.value)
        for batch in batches:
            for b in slices(batch):
                n = pa.array(bpe.counts(b.column("text")))
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), n], [*keys, "n_tokens"])

    schema = ", ".join(f"{k} {df.select(k).dtypes[0][1]}" for k in keys) + ", n_tokens bigint"
    return df.select(*keys, "text").mapInArrow(count, schema)


def pieces(runs: list[tuple[int, bool]], max_tokens: int, max_loss: int) -> list[tuple[int, int, int]]:
    """(start, tokens, loss tokens) of consecutive pieces, each as long as both limits allow."""
    out, at, start, tokens, loss = [], 0, 0, 0, 0
    for n, bears in runs:
        while n:
            step = min(n, max_tokens - tokens, max_loss - loss if bears else n)
            if not step:
                out.append((start, tokens, loss))
                start, tokens, loss = at, 0, 0
                continue
            tokens, loss, at, n = tokens + step, loss + step * bears, at + step, n - step
    if tokens:
        out.append((start, tokens, loss))
    return out


def place(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pack and slot of each example; examples are taken in the given order where scores tie."""
    n = len(tokens)
    if n and (tokens.max() > limits[0] or loss.max() > limits[2] or limits[1] < 1):
        raise ValueError("an example beyond a limit fits no pack")
    demand = np.stack([tokens, np.ones(n), loss], 1) / np.asarray(limits, float)
    weight = demand.mean(0)
    kinds, first, kind = np.unique(np.stack([tokens, loss], 1), axis=0, return_index=True, return_inverse=True)
    by_kind = np.argsort(first, kind="stable")  # kinds in order of their first example
    rank = np.empty_like(by_kind)
    rank[by_kind] = np.arange(len(by_kind))
    vector, kind = demand[first[by_kind]], rank[kind.ravel()]
    whole = np.stack([tokens, np.ones(n, np.int64), loss], 1)[first[by_kind]].astype(np.int64)
    waiting = [np.flatnonzero(kind == k)[::-1].tolist() for k in range(len(vector))]
    left = np.array([len(w) for w in waiting])
    pack, slot = np.empty(n, np.int64), np.empty(n, np.int64)
    room, p, s, done = np.asarray(limits, np.int64), 0, 0, 0
    score_of = vector * weight
    while done < n:
        fits = (left > 0) & (whole <= room).all(1)
        if not fits.any():
            room, p, s = np.asarray(limits, np.int64), p + 1, 0
            continue
        k = int(np.argmax(np.where(fits, score_of @ (room / np.asarray(limits, float)), -1.0)))
        i = waiting[k].pop()
        left[k] -= 1
        pack[i], slot[i] = p, s
        room, s, done = room - whole[k], s + 1, done + 1
    return pack, slot


def pack(examples: DataFrame, limits: tuple[int, int, int], shard: int = SHARD) -> DataFrame:
    """examples: id, sub, base (tokens before it), first (its first piece's number), runs array<struct<n bigint, bears boolean>>.

    Ids stay in Arrow, and so exact.
    """
    max_tokens, max_segments, max_loss = limits
    if min(limits) < 1:
        raise ValueError("every limit is at least 1")
    kind = key_type(examples, "id")
    numbers = ["piece", "start_token", "n_tokens", "loss_tokens"]

    def cut(batches):
        for b in batches:
            row, out = [], []
            for i, (runs, base, first) in enumerate(zip(*(b.column(c).to_pylist() for c in ("runs", "base", "first")))):
                got = pieces([(r["n"], r["bears"]) for r in runs], max_tokens, max_loss) or [(0, 0, 0)]
                row += [i] * len(got)
                out += [(first + k, base + at, *x) for k, (at, *x) in enumerate(got)]
            columns = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(row, pa.int64())) for c in ("id", "sub")] + [pa.array(c) for c in columns], ["id", "sub", *numbers])

    made = examples.mapInArrow(cut, f"id {kind}, sub bigint, " + ", ".join(f"{c} bigint" for c in numbers))
    items = written(made.withColumn("row", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-items.count() // shard))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_tokens", "descending"), ("loss_tokens", "descending"), ("id", "ascending"), ("sub", "ascending"), ("piece", "ascending")])
        n, loss = t.column("n_tokens").to_numpy(), t.column("loss_tokens").to_numpy()
        some = n > 0
        p, s = place(n[some], loss[some], limits)
        number = t.column("shard")[0].as_py() if len(t) else 0
        name, slot = np.full(len(t), None, object), np.zeros(len(t), np.int64)
        name[some] = [f"{number:08d}-{x:08d}" for x in p.tolist()]
        slot[some] = s
        return t.select(["id", *numbers]).append_column("pack_id", pa.array(name, pa.string())).append_column("slot", pa.array(slot, mask=~some))

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("id", "sub", "piece", "row"), F.lit(shards)))
    out = f"id {kind}, " + ", ".join(f"{c} bigint" for c in numbers) + ", pack_id string, slot bigint"
    return spread(dealt, shards, SHARDS_A_TASK, "shard").groupBy("shard").applyInArrow(run, out)


def pack_conversations(turns: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, loss_roles=LOSS_ROLES, path: str = VOCABULARY, shard: int = SHARD, chapter: int = CHAPTER) -> DataFrame:
    """One example a conversation, its turns in order; turns of loss_roles bear loss. Returns one row a piece."""
    rows = turns.select(key(turns, "conv_id", "id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").isin(*loss_roles), F.lit(False)).alias("bears"), text_key(F.col("text")).alias("sub"), "text")
    rows = written(token_counts(rows, ["id", "turn", "bears", "sub"], path).withColumn("row", F.monotonically_increasing_id()), "turns")
    order = ["turn", "bears", "sub", "row"]
    rows = running(rows, "id", order, "n_tokens", "before").withColumn("chapter", F.floor(F.col("before") / chapter).cast("bigint"))
    turn = F.when(F.col("n_tokens") > 0, F.struct(*order, "n_tokens"))
    runs = F.transform(F.sort_array(F.collect_list(turn)), lambda r: F.struct(r["n_tokens"].alias("n"), r["bears"].alias("bears")))
    examples = rows.groupBy("id", F.col("chapter")).agg(runs.alias("runs"), F.min("before").alias("base")).filter((F.col("chapter") == 0) | (F.size("runs") > 0))
    examples = examples.select("id", F.col("chapter").alias("sub"), "base", (F.col("chapter") * chapter).alias("first"), "runs")
    return pack(examples, (max_tokens, max_segments, max_loss), shard).withColumnRenamed("id", "conv_id")


def pack_documents(docs: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_TOKENS, path: str = VOCABULARY, shard: int = SHARD) -> DataFrame:
    """One example a document, each of its tokens bearing loss."""
    rows = token_counts(docs.select(key(docs, "doc_id", "id"), text_key(F.col("text")).alias("sub"), "text"), ["id", "sub"], path)
    runs = F.array(F.struct(F.col("n_tokens").alias("n"), F.lit(True).alias("bears")))
    return pack(rows.select("id", "sub", F.lit(0).cast("bigint").alias("base"), F.lit(0).cast("bigint").alias("first"), runs.alias("runs")), (max_tokens, max_segments, max_loss), shard).withColumnRenamed("id", "doc_id")
