"""Corrections of read depth against plain numpy, and planted effects."""

from __future__ import annotations

import numpy as np
import pytest

from genoframe.operators import normalise
from genoframe.session import Scratch

COUNTS, BINS = "cell string, bin_id int, n long", "bin_id int, gc double, mapp double"


def plain_loess(xs, ys, x0, span):
    """Over single observations: the nearest share, tricube weights, least squares of a parabola."""
    d = np.abs(xs - x0)
    h = np.sort(d)[int(np.ceil(span * len(xs) - 1e-9)) - 1]
    if h == 0:
        return ys[d == 0].mean()
    w = np.sqrt(np.clip(1 - (d / h) ** 3, 0, None) ** 3)
    t = (xs - x0) / h
    return np.linalg.lstsq(w[:, None] * np.stack([t**0, t, t**2], axis=1), w * ys, rcond=1e-7)[0][0]


def test_curves_are_a_plain_loess(spark):
    rng = np.random.default_rng(5)
    points = {c: [(int(k), float(v)) for k, v in zip(rng.integers(0, 30 if c != "tight" else 2, 200), rng.normal(5, 1, 200), strict=True)] for c in ("a", "b", "tight")} | {"one": [(7, 2.0)] * 3}
    frame = spark.createDataFrame([(c, k, v) for c, rows in points.items() for k, v in rows] + [("a", 3, None), ("nothing", 1, None)], "cell string, k long, value double")
    got = {(r["cell"], r["k"]): r["fit"] for r in normalise.curves(frame, 0.3).collect()}
    want = {}
    for c, rows in points.items():
        xs, ys = (np.array(v, float) for v in zip(*rows, strict=True))
        want |= {(c, k): plain_loess(xs, ys, k, 0.3) for k in range(int(xs.min()), int(xs.max()) + 1)}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def plain_correction(n, gc, mapp):
    """Of one cell, over its single bins."""
    usual = (n <= np.quantile(n[n > 0], 0.99)) & (n > 0) & (gc >= round(np.quantile(gc[n > 0], 0.01), 9)) & (gc <= round(np.quantile(gc[n > 0], 0.99), 9)) & (mapp >= 0.9)
    out = []
    value, keys = n, np.round(gc / 0.1)
    for other, span in ((np.round(mapp / 0.01), 0.3), (None, 2 / 3)):
        known = {k: plain_loess(keys[usual], value[usual], k, span) for k in set(keys) if keys[usual].min() <= k <= keys[usual].max()}
        value = np.array([v / known[k] if known.get(k, 0) > 0 else np.nan for v, k in zip(value, keys, strict=True)])
        usual = (value > 0) & (value <= round(np.nanquantile(value[value > 0], 0.99), 9))
        out, keys = [*out, value], other
    return out


def test_planted_gc_and_mappability_go(spark):
    rng = np.random.default_rng(6)
    gc, mapp = rng.uniform(35, 60, 1200), rng.uniform(0.9, 1.0, 1200)
    rows, gained = [], np.arange(1200) >= 1100
    for c, bend in (("a", 0.02), ("b", -0.03)):
        depth = 800 * np.where(gained & (c == "b"), 1.5, 1.0) * np.exp(bend * (gc - 47) - 0.004 * (gc - 47) ** 2) * mapp**2
        rows += [(c, i, int(n)) for i, n in enumerate(rng.poisson(depth))]
    bins = spark.createDataFrame([(i, float(g), float(m)) for i, (g, m) in enumerate(zip(gc, mapp, strict=True))] + [(1200, None, None)], BINS)
    counts = spark.createDataFrame([*rows, ("a", 1200, 50), *[("empty", i, 0) for i in range(5)]], COUNTS)
    out = normalise.depth_corrected(counts, bins, Scratch(spark)).toPandas()
    assert len(out) == 2406
    for c in "ab":
        mine = out[(out.cell == c) & (out.bin_id < 1200)].set_index("bin_id").sort_index()
        n = np.array([n for x, i, n in rows if x == c], float)
        by_gc, by_mapp = plain_correction(n, gc, mapp)
        assert np.allclose(mine.by_gc, by_gc, equal_nan=True) and np.allclose(mine.by_mapp, by_mapp, equal_nan=True)
        assert np.allclose(np.log2(by_mapp), mine["copy"], equal_nan=True) and np.isfinite(by_mapp).sum() > 1150
        known = np.isfinite(by_mapp)
        if c == "a":
            assert all(abs(np.corrcoef(by_mapp[known], what[known])[0, 1]) < 0.1 < abs(np.corrcoef(n, what)[0, 1]) for what in (gc, mapp))
        else:
            assert 1.45 < by_mapp[known & gained].mean() / by_mapp[known & ~gained].mean() < 1.55
    assert out[(out.cell == "empty") | (out.bin_id == 1200)].by_gc.isna().all()


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(7)
    gc = rng.uniform(35, 60, 60)
    x = (gc - gc.mean()) / gc.std()
    effect = rng.uniform(0.5, 2, 60)
    a = np.stack([rng.uniform(3, 5, 12), rng.uniform(-0.4, 0.4, 12), rng.uniform(-0.1, 0.1, 12)], axis=1)
    mean = effect * np.exp(a @ np.stack([x**0, x, x**2]))
    return gc, x, mean, rng.poisson(mean)


def frames(spark, gc, n, extra=()):
    counts = spark.createDataFrame([(f"c{j:02}", i, int(n[j, i])) for j in range(n.shape[0]) for i in range(n.shape[1])] + list(extra), COUNTS)
    return counts, spark.createDataFrame([(i, float(g), 1.0) for i, g in enumerate(gc)], BINS)


def test_poisson_fit_is_the_greatest_likelihood(spark, planted):
    gc, x, mean, n = planted
    counts, bins = frames(spark, gc, n, [("none", i, 0) for i in range(60)])
    cells, effects, logliks = normalise.poisson_fit(counts, bins, Scratch(spark), most_rounds=25, tolerance=1e-10)
    assert len(logliks) > 2 and all(b >= a - 1e-6 for a, b in zip(logliks, logliks[1:], strict=False))
    out = normalise.poisson_normalised(counts, cells, effects).toPandas()
    got = out.pivot(index="cell", columns="bin_id", values="mean").to_numpy()
    assert got.shape == n.shape
    assert np.allclose(got.sum(axis=0), n.sum(axis=0), rtol=1e-4)  # the equations of the greatest likelihood
    for p in (x**0, x, x**2):
        assert np.allclose(got @ p, n @ p, atol=0.002 * n.sum(axis=1).max())
    assert np.abs(got / mean - 1).mean() < 0.1
    full = effects.toPandas().set_index("bin_id").sort_index()["effect"].to_numpy()
    plain = np.log(n.mean(axis=1))[:, None] * np.array([1.0, 0, 0])
    for _ in range(200):  # plain Newton steps of all cells, effects of bins between
        b = n.sum(axis=0) / np.exp(plain @ np.stack([x**0, x, x**2])).sum(axis=0)
        for j in range(len(n)):
            design = np.stack([x**0, x, x**2], axis=1)
            m = b * np.exp(design @ plain[j])
            plain[j] += np.linalg.solve(design.T @ (m[:, None] * design), design.T @ (n[j] - m))
    assert np.allclose(b * np.exp(plain @ np.stack([x**0, x, x**2])), got, rtol=2e-3) and full.shape == b.shape


def test_bins_effects_come_from_normal_cells(spark, planted):
    gc, x, mean, n = planted
    n = n.copy()
    n[6:, 40:] = n[6:, 40:] * 2  # gains of the cells that are not normal
    n[:6, 0] = 0
    counts, bins = frames(spark, gc, n)
    normal = spark.createDataFrame([(f"c{j:02}",) for j in range(6)], "cell string")
    cells, effects, logliks = normalise.poisson_fit(counts, bins, Scratch(spark), normal)
    assert all(b >= a - 1e-6 for a, b in zip(logliks, logliks[1:], strict=False))
    out = normalise.poisson_normalised(counts, cells, effects).toPandas()
    ratio = out.pivot(index="cell", columns="bin_id", values="ratio").to_numpy(dtype=float)
    assert np.isnan(ratio[:, 0]).all()
    assert (ratio[6:, 40:].mean(axis=1) / ratio[6:, 1:40].mean(axis=1) > 1.6).all()
    assert np.abs(ratio[:6, 1:].mean(axis=1) - 1).max() < 0.1


def test_empty_tables(spark):
    counts, bins = spark.createDataFrame([], COUNTS), spark.createDataFrame([], BINS)
    assert normalise.depth_corrected(counts, bins, Scratch(spark)).count() == 0
    cells, effects, logliks = normalise.poisson_fit(counts, bins, Scratch(spark))
    assert normalise.poisson_normalised(counts, cells, effects).count() == 0
