"""Every registered query over the smallest tables, against DuckDB where it has an SQL definition."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import differences, views
from skein.operators import spectral, stack
from skein.plans import corpora as C
from skein.plans import registry

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(TABLES).exists(), reason="the tables aren't here")


@pytest.fixture(scope="module")
def con():
    return views(TABLES)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, con, name):
    assert differences(spark, con, TABLES, registry.QUERIES[name], registry.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, TABLES).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def dense(vertices, edges, weight):
    """The Laplacian of a small graph as a matrix, vertices in order of id."""
    ids = sorted(r.id for r in vertices.collect())
    at = {x: i for i, x in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for r in edges.collect():
        a[at[r.src], at[r.dst]] += weight(r)
    return np.array(ids), np.diag(a.sum(1)) - a


def close_to(x, lap):
    """Is a row of a spectrum what many steps give, as far as its tolerance lets it?"""
    e = np.linalg.eigvalsh(lap)
    assert x.lambda_max == pytest.approx(e[-1], rel=2e-3) and x.lambda_max <= e[-1] + 1e-9
    assert e[1] - 1e-6 <= x.lambda_2 <= e[1] + 2e-2 * e[-1] and 0 < x.ipr <= 1


def test_default_spectra(spark):
    g = C.part_supplier(spark, TABLES)
    close_to(registry.QUERIES["spectral_spectrum_default"](spark, TABLES).first(), dense(g.vertices, g.edges, lambda r: 1.0)[1])
    x = C.customer_supplier(spark, TABLES)
    rows = registry.QUERIES["spectral_layered_sweep_default"](spark, TABLES).orderBy("step").collect()
    assert len(rows) == 5
    for k, row in enumerate(rows[1:], 1):
        close_to(row, dense(x.vertices, x.edges, lambda r, k=k: 1.0 if r["class"] == "intra" else k * 0.5)[1])
    color = {r.id: r.color for r in stack.colors(x).collect()}
    rows = registry.QUERIES["spectral_sublattice_sweep_default"](spark, TABLES).orderBy("step").collect()
    assert len(rows) == 3
    for k, row in enumerate(rows):
        close_to(row, dense(x.vertices, x.edges, lambda r, k=k: 1.0 if r["class"] == "intra" or color[r.src] != color[r.dst] else 0.5 + k * 0.5)[1])


def test_default_density(spark):
    g = C.part_supplier(spark, TABLES)
    ids, lap = dense(g.vertices, g.edges, lambda r: 1.0)
    e, u = np.linalg.eigh(lap)

    def moments(top):
        of = np.mean([(u.T @ spectral.sign_array(ids, r)) ** 2 / len(ids) for r in range(8)], 0)
        return [float(of @ np.cos(k * np.arccos(np.clip(2 / top * e - 1, -1, 1)))) for k in range(200)]

    got = [r.mu for r in registry.QUERIES["spectral_kpm_moments_default"](spark, TABLES).orderBy("k").collect()]
    assert got == pytest.approx(moments(2.0 * np.diag(lap).max()), abs=1e-8)
    top = 1.01 * spectral.lambda_max(g.vertices, g.edges)
    mu = np.array(moments(top))
    k, x = np.arange(200), 0.999 * np.cos((99 - np.arange(100) + 0.5) * np.pi / 100)
    damp = ((200 - k + 1) * np.cos(np.pi * k / 201) + np.sin(np.pi * k / 201) / np.tan(np.pi / 201)) / 201
    rho = np.maximum(0, ((np.where(k, 2, 1) * damp * mu) * np.cos(np.outer(np.arccos(x), k))).sum(1) / (np.pi * np.sqrt(1 - x * x)))
    z = (rho - rho.mean()) / rho.std()
    want = sorted((rho[i] for i in range(1, 99) if rho[i] > rho[i - 1] and rho[i] > rho[i + 1] and z[i] >= 2), reverse=True)[:5]
    assert [r.rho for r in registry.QUERIES["spectral_peaks_default"](spark, TABLES).orderBy(F.desc("rho")).collect()] == pytest.approx(want, abs=1e-6)
    dos = registry.QUERIES["spectral_dos_default"](spark, TABLES).orderBy("bin").collect()
    assert [r.energy for r in dos] == pytest.approx((top / 2 * (x + 1)).tolist(), abs=1e-6) and [r.rho for r in dos] == pytest.approx(rho.tolist(), abs=1e-6)


def test_localized(spark):
    """The default Fiedler vector against the same iteration on a matrix."""
    g = C.part_supplier(spark, TABLES)
    ids, lap = dense(g.vertices, g.edges, lambda r: 1.0)

    def power(x, step, deflate):
        value = 0.0
        for k in range(200):
            x = x - x.mean() if deflate else x
            x = x / np.sqrt(x @ x)
            y = step(x)
            new = x @ y
            if k and abs(new - value) < 1e-6 * (abs(value) + 1):
                value = new
                break
            value, x = new, y
        x = x - x.mean() if deflate else x
        return value, x / np.sqrt(x @ x)

    top, _ = power(spectral.start_array(ids), lambda x: lap @ x, False)
    _, vec = power(spectral.start_array(ids, 1), lambda x: top * x - lap @ x, True)
    got = {r.id: r.x for r in spectral.fiedler(g.vertices, g.edges).collect()}
    assert [got[i] for i in ids.tolist()] == pytest.approx(vec.tolist(), abs=1e-6)
    best = registry.QUERIES["spectral_localized"](spark, TABLES).collect()
    assert [r.id for r in best] == sorted(got, key=lambda i: (-abs(got[i]), i))[:10]
