"""Graph operators against closed forms and a plain checker on random graphs."""

import itertools
import math
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import graph as G
from skein.operators import spectral, stack


def make(spark, edges, vertices=None):
    e = spark.createDataFrame(edges or [(0, 0)], "src bigint, dst bigint")
    e = e if edges else e.limit(0)
    v = spark.createDataFrame([(x,) for x in vertices], "id bigint") if vertices is not None else None
    return G.undirected(e, v)


def path(n):
    return [(i, i + 1) for i in range(n - 1)]


def cycle(n):
    return [(i, (i + 1) % n) for i in range(n)]


def complete(n):
    return list(itertools.combinations(range(n), 2))


class Plain:
    def __init__(self, edges, vertices):
        self.adj = {v: set() for v in vertices}
        for a, b in edges:
            if a != b:
                self.adj[a].add(b)
                self.adj[b].add(a)

    def parity(self):
        color, label = {}, {}
        for r in sorted(self.adj):
            if r in color:
                continue
            color[r], label[r], q = 0, r, deque([r])
            while q:
                u = q.popleft()
                for w in self.adj[u]:
                    if w not in color:
                        color[w], label[w] = 1 - color[u], r
                        q.append(w)
        return color, label

    def girth(self):
        best = math.inf
        for s in self.adj:
            dist, parent, q = {s: 0}, {s: None}, deque([s])
            while q:
                u = q.popleft()
                for w in self.adj[u]:
                    if w not in dist:
                        dist[w], parent[w] = dist[u] + 1, u
                        q.append(w)
                    elif parent[u] != w:
                        best = min(best, dist[u] + dist[w] + 1)
        return None if best == math.inf else best

    def local(self, v):
        n = sorted(self.adj[v])
        return sum(b in self.adj[a] for a, b in itertools.combinations(n, 2))


@pytest.mark.parametrize("seed,n,m", [(1, 12, 9), (2, 14, 22), (3, 20, 60), (4, 30, 31)])
def test_random_graphs(spark, seed, n, m):
    r = random.Random(seed)
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
    g, p = make(spark, edges, range(n)), Plain(edges, range(n))
    color, label = p.parity()
    assert {x.id: (x.label, x.color) for x in G.parity(g).collect()} == {v: (label[v], color[v]) for v in p.adj}
    assert G.girth(g).first().girth == p.girth()
    assert {x.id: x.triangles for x in G.local_triangles(g).collect()} == {v: p.local(v) for v in p.adj}
    c = [2 * p.local(v) / (len(a) * (len(a) - 1)) for v, a in p.adj.items() if len(a) > 1]
    assert G.clustering(g).first().clustering == pytest.approx(sum(c) / len(c))
    bad = sum(color[a] == color[b] for a in p.adj for b in p.adj[a] if a < b)
    b = G.bipartite(g).first()
    assert (b.bipartite, b.clashes, b.a) == (bad == 0, bad, sum(not x for x in color.values()))


@pytest.mark.parametrize("edges,want", [(path(9), None), (cycle(7), 7), (cycle(8), 8), (cycle(5) + [(5, 6), (6, 0)], 5), (complete(4), 3), ([(a, b + 3) for a in range(3) for b in range(3)], 4), (cycle(6) + [(10, 11)], 6)])
def test_girth(spark, edges, want):
    assert G.girth(make(spark, edges)).first().girth == want


def test_sixteen_notes(spark):
    """Names stand for numbers: index, alpha, beta, gamma, delta, mom, dad, honeycomb, caller, windows, six isolated."""
    g = make(spark, [(0, 1), (0, 2), (0, 3), (1, 2), (1, 4), (2, 3), (4, 0), (5, 6), (6, 5), (7, 1), (8, 7), (8, 7), (9, 1)], range(16))
    s = G.degree_stats(g).first()
    assert (s.n, s.edges, s.mean, s["median"], s["max"], s.deg_0) == (16, 11, 1.375, 1.0, 5, 6)
    assert G.density(g).first().density == pytest.approx(11 / 120)
    assert G.triangles(g).first().triangles == 3
    c = G.clustering(g).first()
    assert (round(c.clustering, 6), c.n_evaluated) == (0.561111, 6)
    assert G.girth(g).first().girth == 3 and not G.bipartite(g).first().bipartite
    k = G.component_stats(g).first()
    assert (k.components, k.largest, k.isolates) == (8, 8, 6)


def test_no_edges(spark):
    g = make(spark, [], range(3))
    assert G.degree_stats(g).first().edges == 0 and G.girth(g).first().girth is None
    assert G.clustering(g).first().clustering == 0 and G.component_stats(g).first().components == 3
    assert G.bipartite(g).first().bipartite
    assert [r.rho for r in spectral.density_of_states(g.vertices, g.edges).collect()] == [1.0]
    empty = make(spark, [], [])
    assert G.density(empty).first().density is None and G.hubs(empty).count() == 0


@pytest.mark.parametrize("edges,top,low", [(complete(6), 6, 6), ([(a, b + 2) for a in range(2) for b in range(4)], 6, 2), (path(6), 2 - 2 * math.cos(math.pi * 5 / 6), 2 - 2 * math.cos(math.pi / 6)), (cycle(6), 4, 1)])
def test_closed_spectra(spark, edges, top, low):
    g = make(spark, edges)
    s = spectral.spectrum(g.vertices, g.edges, iters=600, tol=1e-14).first()
    assert (s.lambda_max, s.lambda_2) == (pytest.approx(top, abs=1e-4), pytest.approx(low, abs=1e-3))


def test_both_ways_agree(spark):
    r = random.Random(7)
    g = make(spark, [(r.randrange(15), r.randrange(15)) for _ in range(30)], range(15))
    v = spark.createDataFrame([(i, i % 2) for i in range(15)], "id bigint, vault_ord int")
    x = stack.layered(v, g.edges)
    a = stack.layered_spectrum(x, [0.0, 0.5, 2.0], 4, 0).orderBy("step").collect()
    b = stack.layered_spectrum(x, [0.0, 0.5, 2.0], 4, 0, local_edges=0).orderBy("step").collect()
    for p, q in zip(a, b, strict=True):
        assert p.asDict() == pytest.approx(q.asDict(), abs=1e-9)
    for k in (7, 8):
        m = [r.mu for r in spectral.kpm_moments(g.vertices, g.edges, 20.0, k, 2).orderBy("k").collect()]
        n = [r.mu for r in spectral.kpm_moments(g.vertices, g.edges, 20.0, k, 2, local_edges=0).orderBy("k").collect()]
        assert len(m) == k and m == pytest.approx(n, abs=1e-9) and m[0] == pytest.approx(1)


@pytest.mark.parametrize("shift", [1 << 31, 1 << 33, (1 << 61) + 7, -(1 << 40)])
def test_large_ids(spark, shift):
    """Arrays and tables agree for vertices of any bigint."""
    e = [(a + shift, b + shift) for a, b in [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (3, 4)]]
    g = make(spark, e)
    a, b = (spectral.spectrum(g.vertices, g.edges, iters=5, tol=0, local_edges=n).first().asDict() for n in (100, 0))
    assert a == pytest.approx(b, abs=1e-9) and a["lambda_max"] > 3
    m, n = ([r.mu for r in spectral.kpm_moments(g.vertices, g.edges, 9.0, 4, 2, local_edges=n).orderBy("k").collect()] for n in (100, 0))
    assert m == pytest.approx(n, abs=1e-9)
    x, y = ({r.id: r.x for r in spectral.fiedler(g.vertices, g.edges, iters=5, tol=0, local_edges=n).collect()} for n in (100, 0))
    assert x == pytest.approx(y, abs=1e-9) and set(x) == {i for p in e for i in p}
    for i in x:
        want = (i * spectral._M + 7919) % spectral._P / spectral._P - 0.5
        assert spectral.start_array(np.array([i]), 1)[0] == pytest.approx(want) == spark.range(1).select(spectral.start_value(F.lit(i), 1).alias("v")).first().v


def test_odd_edge(spark):
    g = make(spark, cycle(5) + path(3))
    u, v = G.odd_edge(g, G.parity(g)).first()
    assert (u, v) == (2, 3)
    even = make(spark, cycle(4))
    assert G.odd_edge(even, G.parity(even)).count() == 0


def test_dirac_and_layers(spark):
    links = spark.createDataFrame([(0, 1), (0, 2), (1, 0), (2, 0), (3, 6), (4, 5), (4, 6), (5, 4), (6, 4)], "src bigint, dst bigint")
    v = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 1), (7, 1)], "id bigint, vault_ord int")
    x = stack.layered(v, links)
    c = stack.layer_counts(x).first()
    assert (c.n, c.intra, c.inter) == (8, 4, 1)
    col = stack.colors(x)
    assert {r.vault_ord: r.quality for r in stack.quality(x, col).collect()} == {0: 1.0, 1: 1.0}
    k = stack.sublattice_counts(x, col).first()
    assert k.intra == 4 and k.aa + k.bb + k.ab == 1
    assert stack.sublattice_spectrum(x, [1.0], coloring=col).count() == 1
    alone = stack.layered(v, links.filter("dst <> 6 and src <> 6"))
    assert stack.sublattice_spectrum(alone, [1.0]).count() == 0


def test_classed_once(spark):
    """A layered graph's edges come from one written table: reading them joins nothing, whatever reads them."""
    def joins(df):
        return str(df._jdf.queryExecution().optimizedPlan().toString()).count("Join")

    links = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 2), (2, 3), (3, 9)], "src bigint, dst bigint")
    x = stack.layered(spark.createDataFrame([(i, i // 2) for i in range(4)], "id bigint, vault_ord int"), links)
    assert sorted(tuple(r) for r in x.edges.collect()) == [(0, 1, "intra"), (1, 0, "intra"), (1, 2, "inter"), (2, 1, "inter"), (2, 3, "intra"), (3, 2, "intra")]
    assert joins(x.edges) == 0
    e = stack.sublattice_edges(x, stack.colors(x))
    assert sorted(tuple(r) for r in e.collect()) == [(0, 1, "intra"), (1, 0, "intra"), (1, 2, "ab"), (2, 1, "ab"), (2, 3, "intra"), (3, 2, "intra")]
    assert joins(e) == 0


def test_dirac_ties(spark):
    """Vertices whose neighbours have the same vaults tie, and the greater id comes first; wherever rows lie."""
    r = random.Random(5)
    counts = [r.randrange(3, 60) for _ in range(7)]
    links, vaults, at = [], [], 1000
    for hub in range(12):
        vaults.append((hub, 0))
        for k, n in enumerate(counts):
            for _ in range(n):
                links.append((hub, at))
                vaults.append((at, k))
                at += 1
    r.shuffle(links)
    g = G.undirected(spark.createDataFrame(links, "src bigint, dst bigint").repartition(7))
    got = G.dirac_stack(g, spark.createDataFrame(vaults, "id bigint, vault_ord int")).collect()
    assert [x.id for x in got] == list(range(11, -1, -1)) and len({x.score for x in got}) == 1
    assert got[0].spread == dict(enumerate(counts)) and got[0].degree == sum(counts)
