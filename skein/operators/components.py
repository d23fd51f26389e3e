"""Connected components of an edge table by alternating large and small stars; each round is a written table.

The number of rounds grows with the logarithm of a component's size, not with its diameter. Edges between whole numbers
are first cut to a forest of each partition; a forest of ONE_TASK rows at most is finished by one task, in memory that
follows the vertices, and only larger ones take the stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, written
from .bins import forest

ONE_TASK, WHOLE = 20_000_000, ("tinyint", "smallint", "int", "bigint")


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(r)


def _cut(edges: DataFrame, one_task: int) -> tuple[DataFrame, bool]:
    """A forest of few rows in place of the edges, and whether it's of one task: then b is the least of a's component."""
    e = written(forest(edges), "forest")
    n, tasks = e.count(), 9
    while n > one_task:
        old, last, e = e, n, written(forest(e.coalesce(tasks)), "forest")
        n, tasks = e.count(), tasks // 3
        dropped(old)
        if n > 0.7 * last or not tasks:
            break
    if n > one_task:
        return e, False
    return written(forest(e.repartition(1)), "forest"), True


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """edges: a, b of any orderable type. Returns node and label, the least node of its component, label itself included."""
    kind = dict(edges.select("a", "b").dtypes)
    if kind["a"] == kind["b"] and kind["a"] in WHOLE:
        # a loop stays one, as in the stars: its node has no label unless another edge has it
        edges, done = _cut(edges.filter("a <> b"), one_task)
        edges = edges.select(*(F.col(c).cast(kind[c]).alias(c) for c in "ab"))
        if done:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    state = _state(e)
    while state[0]:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        old, e = e, written(small, "edges")
        dropped(old, large)
        state, last = _state(e), state
        if state == last:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
