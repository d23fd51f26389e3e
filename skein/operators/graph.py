"""Undirected simple graphs: structure, cycles, colourings. Vertices: id. Edges: src, dst, symmetric, without loops."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import qualified, stored, written
from .bins import Members, Part, bins, has_square, sides, triangles_of
from .components import WHOLE
from .components import components as stars

LOCAL_EDGES = 5_000_000


@dataclass
class Graph:
    vertices: DataFrame
    edges: DataFrame


def halves(links: DataFrame) -> DataFrame:
    """a, b with a < b: each undirected edge once, loops dropped."""
    return links.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()


def both_ways(one: DataFrame) -> DataFrame:
    """src, dst and what else there is, for both directions of edges a, b."""
    more = [c for c in one.columns if c not in ("a", "b")]
    ways = F.array(*(F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), *more) for x, y in ("ab", "ba")))
    return one.select(F.explode(ways).alias("e")).select("e.*")


def undirected(links: DataFrame, vertices: DataFrame | None = None, closed: bool = False) -> Graph:
    """From links (src, dst): both directions, distinct, loops dropped, and edges that leave the given vertices (closed: none does)."""
    one = halves(links)
    if vertices is None:
        vertices = written(links.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "vertices")
    else:
        vertices = vertices.select("id") if closed else vertices.select("id").distinct()
        one = one if closed else one.join(vertices, F.col("a") == F.col("id"), "left_semi").join(vertices, F.col("b") == F.col("id"), "left_semi")
    return Graph(vertices, both_ways(written(one, "graph")))


def whole(g: Graph) -> bool:
    """Are ids whole numbers, as arrays need them?"""
    return g.edges.schema["src"].dataType.simpleString() in WHOLE and g.vertices.schema["id"].dataType.simpleString() in WHOLE


def within(g: Graph, vertices: DataFrame) -> Graph:
    """The part of the graph over some whole components. vertices: id and more."""
    v = vertices.select("id")
    return Graph(v, written(g.edges.join(v.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst"), "within"))


def degrees(g: Graph) -> DataFrame:
    d = g.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return g.vertices.join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def degree_stats(g: Graph) -> DataFrame:
    d = F.col("degree")
    buckets = [F.count_if(d == k).alias(f"deg_{k}") for k in range(4)]
    return degrees(g).agg(F.count(F.lit(1)).alias("n"), (F.coalesce(F.sum(d), F.lit(0)) / 2).cast("bigint").alias("edges"), F.avg(d).alias("mean"), F.percentile(d, 0.5).alias("median"), F.max(d).alias("max"), *buckets, F.count_if(d >= 10).alias("deg_10_up"))


def hubs(g: Graph, top: int = 20) -> DataFrame:
    return degrees(g).orderBy(F.desc("degree"), "id").limit(top)


def density(g: Graph) -> DataFrame:
    """Null for fewer than two vertices."""
    c = degrees(g).agg(F.count(F.lit(1)).alias("n"), (F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("bigint").alias("edges"))
    return c.select("n", "edges", F.when(F.col("n") >= 2, F.col("edges") / (F.col("n") * (F.col("n") - 1) / 2)).alias("density"))


def triangle_rows(g: Graph) -> DataFrame:
    """a, b, c: each triangle once. Edges point from lower to higher degree, so hubs open few wedges."""
    d = degrees(g)
    e = g.edges.join(d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    e = written(e.filter(F.struct("ds", "src") < F.struct("dd", "dst")).select("src", "dst", F.struct("dd", "dst").alias("rank")), "oriented")
    x, y = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("rank").alias("rb")), e.select(F.col("src").alias("a"), F.col("dst").alias("c"), F.col("rank").alias("rc"))
    wedges = x.join(y, "a").filter("rb < rc").select("a", "b", "c")
    return wedges.join(e.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"], "left_semi").select("a", "b", "c")


def triangles(g: Graph, local_edges: int = LOCAL_EDGES) -> DataFrame:
    return local_triangles(g, local_edges).agg((F.coalesce(F.sum("triangles"), F.lit(0)) / 3).cast("bigint").alias("triangles"))


def local_triangles(g: Graph, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """id, triangles, degree for every vertex. Components of at most local_edges directed edges are counted as arrays, wedges of larger ones are joined."""
    def joined(g: Graph) -> DataFrame:
        return triangle_rows(g).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))

    if not whole(g):
        t = joined(g)
    else:
        lab = written(labels(g), "labels")
        b = bins(g.edges, lab, local_edges)
        t = b.run(lambda p, k: {"id": p.ids, "triangles": triangles_of(p), "degree": p.degree}, "id bigint, triangles bigint, degree bigint").select("id", "degree", "triangles")
        if not b.n_large:
            return t
        t = t.select("id", "triangles").union(joined(within(g, lab.join(b.large, "label", "left_semi"))).select("id", "triangles"))
    return degrees(g).join(t, "id", "left").select("id", "degree", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def clustering(g: Graph) -> DataFrame:
    """Mean local coefficient over vertices of degree 2 at least; 0 where there are none."""
    t = local_triangles(g).filter("degree >= 2").select((2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).alias("c"))
    return t.agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("clustering"), F.count(F.lit(1)).alias("n_evaluated"))


def labels(g: Graph) -> DataFrame:
    """id, label: the least vertex of each vertex's component."""
    lab = stars(g.edges.filter("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return g.vertices.join(lab, F.col("id") == F.col("node"), "left").select("id", F.coalesce("label", "id").alias("label"))


def component_sizes(g: Graph) -> DataFrame:
    return labels(g).groupBy("label").agg(F.count(F.lit(1)).alias("size"))


def component_stats(g: Graph) -> DataFrame:
    return component_sizes(g).agg(F.count(F.lit(1)).alias("components"), F.max("size").alias("largest"), F.count_if(F.col("size") == 1).alias("isolates"))


def parity(g: Graph, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """id, label, color: the parity of the distance to the component's least vertex.

    Components of at most local_edges directed edges are walked as arrays. Larger ones that are bipartite are coloured
    through the double cover, in rounds that grow with the logarithm of their size; only the others are walked breadth
    first, a level at a time.
    """
    lab = written(labels(g), "labels")
    if not whole(g):
        return _parity(g, lab)
    b = bins(g.edges, lab, local_edges)
    kind = lab.schema["id"].dataType
    out = b.run(lambda p, k: {"id": p.ids, "label": p.names[p.label], "color": sides(p).astype("int32")}, "id bigint, label bigint, color int")
    out = written(out.select(F.col("id").cast(kind).alias("id"), F.col("label").cast(kind).alias("label"), "color"), "parity")
    if not b.n_large:
        return out
    rest = written(lab.join(b.large.select(F.col("label").cast(kind).alias("label")), "label", "left_semi").select("id", "label"), "labels")
    return out.union(_parity(within(g, rest), rest).select("id", "label", "color"))


def _parity(g: Graph, lab: DataFrame) -> DataFrame:
    """parity on tables. lab: id, label."""
    numbers = whole(g) and fits_twice(g.vertices)

    def side(c: str, s: int):
        # as a whole number the cover takes the forests of components; its order is that of the pair
        return (F.col(c).cast("bigint") * 2 + s) if numbers else F.struct(F.col(c).alias("id"), F.lit(s).alias("side"))

    def parts_of(c: str) -> tuple:
        return (F.shiftright(c, 1), F.pmod(F.col(c), F.lit(2)).cast("int")) if numbers else (F.col(f"{c}.id"), F.col(f"{c}.side"))

    one = g.edges.filter("src < dst") if numbers else g.edges
    cover = one.select(F.explode(F.array(*(F.struct(side("src", s).alias("a"), side("dst", 1 - s).alias("b")) for s in (0, 1)))).alias("e")).select("e.*")
    (node, node_side), (least, least_side) = parts_of("node"), parts_of("label")
    two = stars(cover).select(node.alias("id"), node_side.alias("side"), F.struct(least.alias("id"), least_side.alias("side")).alias("cl"))
    even = lab.join(two.filter("side = 0").drop("side"), "id", "left")
    odd = written(even.filter("cl is not null and cl.id = label and cl.side = 0").join(two.filter("side = 1").select("id", F.col("cl").alias("other")), "id").filter("cl = other").select("label").distinct(), "odd")
    easy = even.join(odd, "label", "left_anti").select("id", "label", F.when(F.col("cl").isNull() | (F.col("cl.side") == 0), 0).otherwise(1).alias("color"))
    hard = written(lab.join(odd, "label", "left_semi").select("id", "label"), "hard")
    return written(easy.union((walked if whole(g) else _walked)(g, hard).select("id", "label", "color")), "parity")


def fits_twice(vertices: DataFrame) -> bool:
    """Is the double of every id still a bigint?"""
    low, high = vertices.agg(F.min("id"), F.max("id")).first()
    return low is None or low > -(1 << 61) and high < 1 << 61


def walked(g: Graph, hard: DataFrame) -> DataFrame:
    """id, label, color of whole components, walked breadth first from their least vertices.

    Each task reads the level's vertices and those of the level before, and looks its edges up among them: a level costs a
    scan of the edges and a grouping of vertices, no join. Memory of a task follows the vertices.
    """
    kind = hard.schema["id"].dataType
    edges = g.edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))
    front, back, depth = written(hard.filter("id = label").select(F.col("id").cast("bigint").alias("id")), "front"), None, 0
    levels = []
    while not front.isEmpty():
        levels.append(front.select("id", F.lit(depth % 2).alias("color")))
        at, seen = qualified(front), [qualified(x) for x in (back, front) if x is not None]

        def near(batches: Iterator[pa.RecordBatch], at: str = at, seen: list[str] = seen) -> Iterator[pa.RecordBatch]:
            here, known = Members(stored(at)), Members(np.concatenate([stored(p) for p in seen]))
            found = np.zeros(0, np.int64)
            for b in batches:
                src, dst = (b.column(c).to_numpy(zero_copy_only=False) for c in ("src", "dst"))
                dst = dst[here.holds(src)]
                found = np.union1d(found, dst[~known.holds(dst)])
            yield pa.record_batch({"id": found})

        back, front, depth = front, written(edges.mapInArrow(near, "id bigint").distinct(), "front"), depth + 1
    out = hard.select("id", "label")
    if not levels:
        return out.withColumn("color", F.lit(0))
    return out.join(reduce(DataFrame.union, levels).select(F.col("id").cast(kind).alias("id"), "color"), "id")


def _walked(g: Graph, hard: DataFrame) -> DataFrame:
    """walked for ids of any type, a join a level."""
    seen = written(hard.filter("id = label").select("id", "label", F.lit(0).alias("color")), "seen")
    parts, front, depth = [seen], seen, 0
    while not front.isEmpty():
        depth += 1
        step = front.join(g.edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), "label").distinct()
        # what a walk reaches again lies one or two steps back
        for back in parts[-2:]:
            step = step.join(back, "id", "left_anti")
        front = written(step.select("id", "label", F.lit(depth % 2).alias("color")), "front")
        parts.append(front)
    return reduce(DataFrame.union, parts)


def clashes(g: Graph, colors: DataFrame) -> DataFrame:
    """Edges, once each, whose ends have the same colour."""
    a, b = (colors.select(F.col("id").alias(x), F.col("color").alias(c)).hint("shuffle_hash") for x, c in (("src", "ca"), ("dst", "cb")))
    return g.edges.filter("src < dst").join(a, "src").join(b, "dst").filter("ca = cb").select("src", "dst")


def odd_edge(g: Graph, colors: DataFrame) -> DataFrame:
    """src and dst of the least edge within a colour: it closes an odd cycle. No row where there is none."""
    return clashes(g, colors).agg(F.min(F.struct("src", "dst")).alias("e")).filter("e is not null").select("e.*")


def bipartite(g: Graph, colors: DataFrame | None = None) -> DataFrame:
    """bipartite, a and b (vertices by colour), ratio a / max(b, 1), clashes (edges within a colour)."""
    colors = parity(g) if colors is None else colors
    c = colors.agg(F.count_if(F.col("color") == 0).alias("a"), F.count_if(F.col("color") == 1).alias("b"))
    return c.crossJoin(clashes(g, colors).agg(F.count(F.lit(1)).alias("clashes"))).select((F.col("clashes") == 0).alias("bipartite"), "a", "b", (F.col("a") / F.greatest("b", F.lit(1))).alias("ratio"), "clashes")


def _square(g: Graph) -> bool:
    """Is there a cycle of four?"""
    d, n = degrees(g), g.vertices.count()
    wedges = d.agg(F.sum(F.col("degree").cast("double") * (F.col("degree") - 1) / 2)).first()[0]
    if wedges > n * (n - 1) / 2:
        return True
    rank = d.select(F.col("id").alias("src"), F.struct("degree", "id").alias("rank"))
    e = g.edges.join(rank, "src")
    x = e.select(F.col("src").alias("u"), F.col("dst").alias("a"), "rank")
    y = e.select(F.col("src").alias("w"), F.col("dst").alias("a"), F.col("rank").alias("below"))
    inner = rank.select(F.col("src").alias("a"), F.col("rank").alias("middle"))
    return not x.join(inner, "a").filter("middle < rank").join(y, "a").filter("below < rank").groupBy("u", "w").count().filter("count > 1").isEmpty()


def girth(g: Graph, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Length of the shortest cycle; null where there is none.

    In components of at most local_edges directed edges triangles and cycles of four are sought as arrays; what follows is
    for larger ones, and for all where neither is found.

    Triangles first; then cycles of four, which there must be where vertices open more wedges than there are pairs, and
    else are looked for among wedges below their end of highest degree; then all vertices are walked breadth first, level
    by level. Up to the level of the shortest cycle every walk reaches a vertex along one path only.
    """
    spark = g.edges.sparkSession

    def answer(n):
        return spark.createDataFrame([(n,)], "girth int")

    lab = written(labels(g), "labels")
    counts = g.vertices.agg(F.count(F.lit(1))).first()[0], g.edges.count() // 2
    if counts[1] == counts[0] - lab.select("label").distinct().count():
        return answer(None)
    small, rest = None, g  # the shortest cycle in small components if it's of 3 or 4; the other components
    if whole(g):
        b = bins(g.edges, lab, local_edges)

        def short(p: Part, k: int) -> dict:
            return {"cycle": pa.array([3 if triangles_of(p).any() else 4 if has_square(p) else None], pa.int32())}

        small = b.run(short, "cycle int").agg(F.min("cycle")).first()[0]
        if small == 3:
            return answer(3)
        rest = within(g, lab.join(b.large, "label", "left_semi")) if b.n_large else None
    if rest and not triangle_rows(rest).isEmpty():
        return answer(3)
    if small == 4 or rest and _square(rest):
        return answer(4)
    core = g.edges
    for _ in range(8):  # dangling paths hold no cycle; what's left of longer ones does no harm
        ends = core.groupBy("src").count().filter("count = 1").select("src")
        if ends.isEmpty():
            break
        core = written(core.join(ends, "src", "left_anti").join(ends.select(F.col("src").alias("dst")), "dst", "left_anti").select("src", "dst"), "core")
    e = core.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    front = e.select(F.col("node").alias("root"), F.col("node").alias("parent"), F.col("next").alias("node"))
    depth = 1
    while True:
        step = written(front.join(e, "node").filter("next <> parent").select("root", F.col("node").alias("parent"), F.col("next").alias("node")), "walk")
        if not step.join(front.select("root", "node"), ["root", "node"], "left_semi").isEmpty():
            return answer(2 * depth + 1)
        if not step.groupBy("root", "node").count().filter("count > 1").isEmpty():
            return answer(2 * depth + 2)
        front, depth = step, depth + 1


def dirac_single(g: Graph, least: int = 4, top: int = 15) -> DataFrame:
    """Vertices of high degree whose neighbours balance the two colours: score = min / max of these, times degree."""
    c = parity(g).select(F.col("id").alias("dst"), "color")
    s = g.edges.join(c, "dst").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.count_if(F.col("color") == 0).alias("a"), F.count_if(F.col("color") == 1).alias("b")).filter(F.col("degree") >= least)
    s = s.withColumn("score", F.least("a", "b") / F.greatest("a", "b") * F.col("degree"))
    return s.orderBy(F.desc("score"), F.desc("degree"), F.desc("id")).limit(top)


def dirac_stack(g: Graph, vaults: DataFrame, least: int = 4, top: int = 15) -> DataFrame:
    """The same over several vaults: score = entropy of the neighbours' vaults, times degree. vaults: id, vault_ord.

    The order is that of scores to six digits, summed in order of vaults, so that vertices with equal neighbourhoods tie.
    """
    v = vaults.select(F.col("id").alias("dst"), "vault_ord").hint("shuffle_hash")
    # dealt by vertex first: both groupings then need no shuffle, and hold no rows but a vertex's vaults
    near = g.edges.join(v, "dst").select(F.col("src").alias("id"), "vault_ord").repartition("id")
    per = near.groupBy("id", "vault_ord").agg(F.count(F.lit(1)).alias("n"))
    s = per.groupBy("id").agg(F.sum("n").alias("degree"), F.sort_array(F.collect_list(F.struct("vault_ord", "n"))).alias("spread")).filter(F.col("degree") >= least)
    s = s.withColumn("h", F.aggregate("spread", F.lit(0.0), lambda h, x: h + x["n"] * F.ln(x["n"].cast("double"))))
    s = s.withColumn("score", (F.ln("degree") - F.col("h") / F.col("degree")) * F.col("degree"))
    return s.orderBy(F.desc(F.round("score", 6)), F.desc("degree"), F.desc("id")).limit(top).select("id", "degree", "score", F.map_from_entries("spread").alias("spread"))
