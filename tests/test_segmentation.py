"""Hidden Markov segmentation and shared circular segmentation against plain programs; agreement of clusterings."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from genoframe.operators import agreement, arcs, hmm
from genoframe.plans import catalog
from genoframe.session import Scratch

DDL = "cell string, chrom string, bin_id int, value double"


def profile(rng, levels, noise):
    return [float(x + rng.normal(0, noise)) for x in levels]


@pytest.fixture(scope="module")
def cells():
    """Two chromosomes of different lengths, steps of several cells, a missing value, a chromosome of one bin."""
    rng = np.random.default_rng(5)
    out = {}
    for c in range(6):
        out[f"c{c}", "chr1"] = profile(rng, [1.0] * 20 + [0.5 if c % 2 else 1.5] * 15 + [1.0] * 15, 0.08)
        out[f"c{c}", "chr2"] = profile(rng, [2.0 if c > 2 else 1.0] * 30, 0.08)
        out[f"c{c}", "chrX"] = [1.02]
    out["c0", "chr1"][7] = None
    return out


def frame(spark, cells):
    return spark.createDataFrame([(c, h, b, x) for (c, h), xs in cells.items() for b, x in enumerate(xs)], DDL)


def density(x, mu, sd):
    return 1.0 if x is None else math.exp(-0.5 * ((x - mu) / sd) ** 2) / (sd * math.sqrt(2 * math.pi))


def log_density(x, mu, sd):
    return 0.0 if x is None else -0.5 * ((x - mu) / sd) ** 2 - math.log(sd * math.sqrt(2 * math.pi))


def plain_round(chroms, mu, sd, first, moves, least):
    """One round of Baum-Welch of a cell, value by value."""
    k, loglik = len(mu), 0.0
    g0, n, sx, sxx, xi = np.zeros(k), np.zeros(k), np.zeros(k), np.zeros(k), np.zeros((k, k))
    for xs in chroms:
        e = np.array([[density(x, mu[i], sd[i]) for i in range(k)] for x in xs])
        f, b, scale = np.zeros_like(e), np.ones_like(e), np.zeros(len(xs))
        for t in range(len(xs)):
            f[t] = [(first[j] if t == 0 else sum(f[t - 1][i] * moves[i][j] for i in range(k))) * e[t][j] for j in range(k)]
            scale[t] = f[t].sum()
            f[t] /= scale[t]
        for t in range(len(xs) - 2, -1, -1):
            b[t] = [sum(moves[i][j] * e[t + 1][j] * b[t + 1][j] for j in range(k)) / scale[t + 1] for i in range(k)]
        loglik += np.log(scale).sum()
        for t, x in enumerate(xs):
            g = f[t] * b[t]
            g0 += g if t == 0 else 0
            if x is not None:
                n, sx, sxx = n + g, sx + g * x, sxx + g * x * x
            if t + 1 < len(xs):
                xi += [[f[t][i] * moves[i][j] * e[t + 1][j] * b[t + 1][j] / scale[t + 1] for j in range(k)] for i in range(k)]
    mean = sx / n
    return mean, np.sqrt(np.maximum(sxx / n - mean**2, least**2)), g0 / g0.sum(), xi / xi.sum(1, keepdims=True), loglik


def plain_path(xs, mu, sd, first, moves):
    k = len(mu)
    with np.errstate(divide="ignore"):
        score, back, step = [np.log(first[i]) + log_density(xs[0], mu[i], sd[i]) for i in range(k)], [], np.log(moves)
    for x in xs[1:]:
        best = [max(range(k), key=lambda i, j=j: score[i] + step[i][j]) for j in range(k)]
        score = [score[best[j]] + step[best[j]][j] + log_density(x, mu[j], sd[j]) for j in range(k)]
        back.append(best)
    path = [max(range(k), key=lambda i: score[i])]
    for best in reversed(back):
        path.append(best[path[-1]])
    return path[::-1]


def test_hidden_markov_against_a_plain_program(spark, cells):
    start = hmm.Start((0.5, 1.0, 1.5, 2.0), 0.2, 0.95)
    rows = hmm.sequences(frame(spark, cells))
    logliks = {}
    for rounds in (1, 2, 4):
        models = {r["cell"]: r for r in hmm.fit(rows, start, Scratch(spark), rounds).collect()}
        for c in models:
            logliks.setdefault(c, []).append(models[c]["loglik"])
    got = {}
    for r in hmm.decode(rows, hmm.fit(rows, start, Scratch(spark), 4)).collect():
        got.setdefault((r["cell"], r["chrom"]), {})[r["bin_id"]] = r["state"]
    for c in models:
        mu, sd, first, moves = start.row()
        model = (np.array(mu), np.array(sd), np.array(first), np.array(moves).reshape(4, 4))
        for _ in range(4):
            *model, loglik = plain_round([cells[c, h] for h in ("chr1", "chr2", "chrX")], *model, start.least_spread)
        assert np.allclose(loglik, models[c]["loglik"]) and logliks[c] == sorted(logliks[c])
        for name, want in zip(hmm.MODEL, model, strict=True):
            assert np.allclose(np.ravel(want), models[c][name], atol=1e-8), (c, name)
        for h in ("chr1", "chr2", "chrX"):
            assert [got[c, h][b] for b in range(len(cells[c, h]))] == plain_path(cells[c, h], *model)
    planted = {}
    for r in hmm.decode(rows, hmm.fit(rows, start, Scratch(spark), 0)).where("chrom = 'chr1'").collect():
        planted.setdefault(r["cell"], {})[r["bin_id"]] = r["state"]
    for c, states in planted.items():
        assert [states[b] for b in range(50)] == [1] * 20 + [0 if int(c[1]) % 2 else 2] * 15 + [1] * 15


def test_runs_of_states(spark):
    states = spark.createDataFrame([("a", "chr1", b, s) for b, s in enumerate([1, 1, 2, 2, 2, 1])] + [("a", "chr2", 9, 3)], "cell string, chrom string, bin_id int, state int")
    got = sorted(tuple(r) for r in hmm.segments(states).collect())
    assert got == [("a", "chr1", 0, 0, 1, 2, 1), ("a", "chr1", 1, 2, 4, 3, 2), ("a", "chr1", 2, 5, 5, 1, 1), ("a", "chr2", 0, 9, 9, 1, 3)]


def plain_arcs(xs, width):
    """The best arc, from the values of all cells themselves."""
    n, best = len(xs[0]), (-math.inf, 0, 0)
    for i, j in itertools.combinations(range(n + 1), 2):
        m = j - i
        if m < width or n - m < width or 0 < i < width or 0 < n - j < width:
            continue
        z = sum((np.mean(x[i:j]) - np.mean(np.r_[x[:i], x[j:]])) ** 2 * m * (n - m) / n for x in xs)
        if z > best[0] + 1e-9:
            best = (z, i, j)
    return best


def plain_breaks(xs, alpha, permutations, seed, width=2):
    found, todo = {0}, [(0, len(xs[0]))]
    while todo:
        a, b = todo.pop()
        if b - a < 2 * width:
            continue
        part = [x[a:b] for x in xs]
        z, i, j = plain_arcs(part, width)
        rng, beaten = np.random.default_rng([seed, a, b]), 0
        for _ in range(permutations):
            order = rng.permutation(b - a)
            beaten += plain_arcs([x[order] for x in part], width)[0] >= z
        if z > 0 and (1 + beaten) / (1 + permutations) <= alpha:
            edges = sorted({a, a + i, a + j, b})
            found.update(edges[:-1])
            todo.extend(zip(edges, edges[1:], strict=False))
    return sorted(found)


def test_shared_arcs_against_a_plain_program(spark):
    rng = np.random.default_rng(6)
    xs = [np.array(profile(rng, [1.0] * 9 + [1.0 + 0.6 * (c % 3 - 1)] * 7 + [1.0] * 6, 0.15)) for c in range(5)]
    sd = [math.sqrt(np.mean(np.diff(x) ** 2) / 2) for x in xs]
    scaled = [(x - x.mean()) / s for x, s in zip(xs, sd, strict=True)]
    want = plain_breaks(scaled, 0.1, 19, 3)
    assert {9, 16} <= set(want)
    rows = [(f"c{c}", "chr1", b, float(x)) for c, v in enumerate(xs) for b, x in enumerate(v)]
    got = arcs.shared_segments(spark.createDataFrame(rows, DDL), alpha=0.1, permutations=19, seed=3).orderBy("bin_id").collect()
    assert [r["bin_id"] for p, r in zip([None, *got], got, strict=False) if p is None or p["seg_id"] != r["seg_id"]] == want


def test_shared_arcs_over_blocks_of_cells(spark, monkeypatch):
    """Weak steps that no cell shows alone; many blocks; a chromosome without steps; a cell without noise."""
    monkeypatch.setattr(arcs, "BLOCK", 16)
    rng = np.random.default_rng(7)
    rows = [("flat", h, b, 1.0) for h in ("chr1", "chr2") for b in range(40)]
    for c in range(150):
        for h, levels in (("chr1", [0.0] * 14 + [0.5 * (-1) ** c] * 10 + [0.0] * 16), ("chr2", [0.0] * 40)):
            rows += [(f"c{c}", h, b, x) for b, x in enumerate(profile(rng, levels, 1.0))]
    values = spark.createDataFrame(rows, DDL)
    shared = arcs.shared_segments(values, alpha=0.01)
    got = {(r["chrom"], r["bin_id"]): r["seg_id"] for r in shared.collect()}
    assert [got["chr1", b] for b in range(40)] == [0] * 14 + [1] * 10 + [2] * 16 and {got["chr2", b] for b in range(40)} == {0}
    means = arcs.segment_means(values, shared).where("cell = 'flat'").collect()
    assert sorted((r["chrom"], r["seg_id"], r["first_bin"], r["last_bin"], r["mean"]) for r in means) == [("chr1", 0, 0, 13, 1.0), ("chr1", 1, 14, 23, 1.0), ("chr1", 2, 24, 39, 1.0), ("chr2", 0, 0, 39, 1.0)]
    with pytest.raises(Exception, match="differ in their bins"):
        arcs.shared_segments(values.where("not (cell = 'c3' and bin_id = 5)")).collect()


def test_queries_over_the_tables(spark, small):
    d = catalog.Data(spark, small)
    per_cell = {(r["cell"], r["n"]) for r in d.norm().groupBy("cell").count().withColumnRenamed("count", "n").collect()}
    got = catalog.QUERIES["hmm_segments"](spark, small).groupBy("cell").agg({"n_bins": "sum"}).collect()
    assert {tuple(r) for r in got} == per_cell
    shared = catalog.QUERIES["shared_arc_segments"](spark, small).collect()
    assert {r["cell"] for r in shared} == {c for c, _ in per_cell}
    value = {(r["cell"], r["bin_id"]): r["y"] for r in d.norm().collect()}
    for r in shared:
        inside = [v for (c, b), v in value.items() if c == r["cell"] and r["first_bin"] <= b <= r["last_bin"]]
        assert math.isclose(np.mean(inside), r["mean"])


def plain_rand(a, b):
    """By all pairs of cells."""
    both = ones = twos = total = 0
    for i, j in itertools.combinations(range(len(a)), 2):
        x, y = a[i] == a[j], b[i] == b[j]
        both, ones, twos, total = both + (x and y), ones + x, twos + y, total + 1
    chance = ones * twos / total
    return (total + 2 * both - ones - twos) / total, (both - chance) / ((ones + twos) / 2 - chance)


def test_agreement(spark, same):
    same(catalog.QUERIES["label_agreement"], catalog.ORACLES["label_agreement"])
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 4, 80).tolist(), rng.integers(0, 3, 80).tolist()
    rows = [*zip(a, b, strict=True), (None, 1), (2, None)]
    frame = lambda rows: spark.createDataFrame(rows, "a int, b int")
    got = agreement.adjusted_rand(frame(rows), "a", "b").first()
    assert got["cells"] == 80 and np.allclose(got[1:], plain_rand(a, b))
    assert tuple(agreement.adjusted_rand(frame([(x, 9 - x) for x in a]), "a", "b").first()) == (80, 1.0, 1.0)
    assert tuple(agreement.adjusted_rand(frame([]), "a", "b").first()) == (0, 1.0, 1.0)
