"""Read depth without the effects of GC content and mappability, cell by cell.

``depth_corrected`` divides counts by curves of local regression. ``poisson_fit`` explains counts by effects of bins,
cells and the GC content in each cell, as Poisson means, and ``poisson_normalised`` divides by them.

Defined cases: bins without gc (or mapp) are left out of the curves and get no corrected value, and stand at the mean
gc in the Poisson fit; cells without a read have no curve and no effects; a bin in which no fitted cell has a read has
effect 0 and no normalised value; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoframe.session import Scratch


def local_fit(x: np.ndarray, n: np.ndarray, y: np.ndarray, at: np.ndarray, span: float) -> np.ndarray:
    """Local quadratic regression at the places ``at``, of ``n`` observations with mean ``y`` at each distinct ``x``.

    A place looks at the nearest share ``span`` of observations with tricube weights. Where all of them lie at one x,
    their mean is the fit; where they do not determine a parabola, the least one that fits best is taken.
    """
    away = x[None, :] - at[:, None]
    near = np.argsort(np.abs(away), axis=1, kind="stable")
    enough = np.cumsum(n[near], axis=1) >= np.ceil(span * n.sum() - 1e-9)
    last = np.take_along_axis(near, enough.argmax(axis=1)[:, None], axis=1)
    reach = np.abs(np.take_along_axis(away, last, axis=1))
    t = away / np.where(reach > 0, reach, 1.0)
    w = np.where(reach > 0, n * np.clip(1 - np.abs(t) ** 3, 0, None) ** 3, np.where(away == 0, n, 0))
    moment = [(w * t**k).sum(axis=1) for k in range(5)]
    left = np.stack([np.stack(moment[k : k + 3], axis=1) for k in range(3)], axis=1)
    right = np.stack([(w * t**k * y).sum(axis=1) for k in range(3)], axis=1)
    return (np.linalg.pinv(left, rcond=1e-10, hermitian=True) @ right[:, :, None])[:, 0, 0]


def curves(points: DataFrame, span: float) -> DataFrame:
    """cell, k, fit: each cell's curve of ``points`` (cell, k, value) at all whole k from its least to its greatest.

    ``k`` counts steps of a fixed scale, so a cell is a list of sums as long as the scale at most, however many bins
    there are; sums are taken before anything is shuffled.
    """
    sums = points.groupBy("cell", "k").agg(F.count("value").alias("n"), F.avg("value").alias("y")).where("n > 0")
    lists = sums.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("k", "n", "y"))).alias("p"))
    lists = lists.select("cell", *[F.col("p")[c].alias(c) for c in ("k", "n", "y")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell, k, n, y in batch.itertuples(index=False):
                at = np.arange(k[0], k[-1] + 1)
                yield pd.DataFrame({"cell": [cell] * len(at), "k": at, "fit": local_fit(k.astype(float), n.astype(float), y, at.astype(float), span)})

    return lists.mapInPandas(run, f"cell {points.schema['cell'].dataType.simpleString()}, k long, fit double")


def depth_corrected(
    counts: DataFrame, bins: DataFrame, scratch: Scratch, gc_step: float = 0.1, mapp_step: float = 0.01, gc_span: float = 0.3, mapp_span: float = 2 / 3, outlier: float = 0.01, least_mapp: float = 0.9
) -> DataFrame:
    """cell, bin_id, by_gc, by_mapp, copy: counts over the curve of gc, that over the curve of mapp, and its logarithm.

    Curves are learnt from a cell's usual bins: with reads, no more than 1 - ``outlier`` of them have, gc between these
    quantiles, and ``least_mapp``. Values are null outside the range of a curve and where it is not positive.
    """
    places = bins.select("bin_id", F.round(F.col("gc") / gc_step).cast("long").alias("gk"), F.round(F.col("mapp") / mapp_step).cast("long").alias("mk"), "gc", "mapp")
    rows = scratch.save(counts.select("cell", "bin_id", "n").join(places, "bin_id"))
    seen = rows.where("n > 0 AND gc IS NOT NULL")
    quantile = lambda c, q: F.round(F.percentile(c, q), 9)
    bars = seen.groupBy("cell").agg(quantile("n", 1 - outlier).alias("top"), quantile("gc", outlier).alias("low"), quantile("gc", 1 - outlier).alias("high"))
    usual = seen.join(bars, "cell").where((F.col("n") <= F.col("top")) & F.col("gc").between(F.col("low"), F.col("high")) & (F.col("mapp") >= least_mapp))
    gc_curve = curves(usual.select("cell", F.col("gk").alias("k"), F.col("n").cast("double").alias("value")), gc_span).withColumnsRenamed({"k": "gk", "fit": "g"})
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    flat = scratch.save(rows.join(gc_curve, ["cell", "gk"], "left").select("cell", "bin_id", "mk", "mapp", "n", over("n", "g").alias("by_gc")))
    bar = flat.where("by_gc > 0").groupBy("cell").agg(quantile("by_gc", 1 - outlier).alias("top"))
    usual = flat.join(bar, "cell").where("by_gc > 0 AND by_gc <= top AND mapp IS NOT NULL").select("cell", F.col("mk").alias("k"), F.col("by_gc").alias("value"))
    mapp_curve = curves(usual, mapp_span).withColumnsRenamed({"k": "mk", "fit": "m"})
    done = flat.join(mapp_curve, ["cell", "mk"], "left").select("cell", "bin_id", "by_gc", over("by_gc", "m").alias("by_mapp"))
    return done.withColumn("copy", F.when(F.col("by_mapp") > 0, F.log2("by_mapp")))


def _solved(m: list, g: list) -> tuple[list, F.Column]:
    """Unknowns of three equations with the matrix of moments m0 to m4, and the determinant over its scale."""
    a, b, c, d, e = m
    cofactors = [[c * e - d * d, c * d - b * e, b * d - c * c], [c * d - b * e, a * e - c * c, b * c - a * d], [b * d - c * c, b * c - a * d, a * c - b * b]]
    det = a * cofactors[0][0] + b * cofactors[0][1] + c * cofactors[0][2]
    return [F.try_divide(sum((x * y for x, y in zip(row, g, strict=True)), F.lit(0.0)), det) for row in cofactors], F.try_divide(det, a * c * e)


def poisson_fit(counts: DataFrame, bins: DataFrame, scratch: Scratch, normal: DataFrame | None = None, most_rounds: int = 30, tolerance: float = 1e-7) -> tuple[DataFrame, DataFrame, list[float]]:
    """Cells (cell, a0, a1, a2), bins (bin_id, x, effect) and the log-likelihood of each round, but for a constant.

    The mean of a count is effect * exp(a0 + a1 x + a2 x^2), x being the bin's gc in deviations from the mean. Effects
    of bins come from the cells in ``normal`` (all by default), those of cells from a Newton step whose length is the
    best of five, none among them; so the likelihood of those cells never falls. A round is an aggregate by bin and
    two by cell. Rounds end when the likelihood gains less than the share ``tolerance``. Only it reaches the driver.
    """
    middle = bins.agg(F.avg("gc").alias("m"), F.stddev_pop("gc").alias("s"))
    x = F.coalesce(F.try_divide(F.col("gc") - F.col("m"), F.col("s")), F.lit(0.0))
    places = bins.join(F.broadcast(middle)).select("bin_id", x.alias("x"))
    marked = counts.select("cell", "bin_id", F.col("n").cast("double").alias("n")).join(places, "bin_id")
    if normal is None:
        marked = marked.withColumn("own", F.lit(True))
    else:
        marked = marked.join(normal.select("cell", F.lit(True).alias("own")).distinct(), "cell", "left").withColumn("own", F.coalesce("own", F.lit(False)))
    rows = scratch.save(marked.withColumn("all", F.sum("n").over(Window.partitionBy("cell"))).where(F.col("all") > 0))
    cells = scratch.save(rows.groupBy("cell").agg(F.log(F.first("all") / F.count("*")).alias("a0"), F.first("own").alias("own")).select("cell", "a0", F.lit(0.0).alias("a1"), F.lit(0.0).alias("a2"), "own"))
    eta = F.col("a0") + F.col("x") * (F.col("a1") + F.col("x") * F.col("a2"))
    steps, logliks = (1.0, 0.5, 0.25, 0.0625, 0.0), []
    while True:
        with_cells = rows.drop("own").join(cells, "cell")
        seen = with_cells.where("own").groupBy("bin_id").agg(F.first("x").alias("x"), F.sum("n").alias("n"), F.sum(F.exp(eta)).alias("m"))
        effects = scratch.save(seen.select("bin_id", "x", F.coalesce(F.try_divide("n", "m"), F.lit(0.0)).alias("effect")))
        if len(logliks) == most_rounds or (len(logliks) > 1 and logliks[-1] - logliks[-2] <= tolerance * abs(logliks[-1])):
            return cells.drop("own"), effects, logliks
        used = with_cells.join(effects.select("bin_id", "effect").where("effect > 0"), "bin_id").withColumn("mean", F.col("effect") * F.exp(eta))
        powers = [F.lit(1.0), F.col("x"), F.col("x") ** 2, F.col("x") ** 3, F.col("x") ** 4]
        sums = used.groupBy("cell", "a0", "a1", "a2", "own").agg(
            *[F.sum(F.col("mean") * p).alias(f"m{k}") for k, p in enumerate(powers)], *[F.sum((F.col("n") - F.col("mean")) * p).alias(f"g{k}") for k, p in enumerate(powers[:3])]
        )
        moves, scale = _solved([F.col(f"m{k}") for k in range(5)], [F.col(f"g{k}") for k in range(3)])
        sound = F.coalesce(scale > 1e-9, F.lit(False))
        alone = [F.coalesce(F.try_divide("g0", "m0"), F.lit(0.0)), F.lit(0.0), F.lit(0.0)]
        moved = scratch.save(sums.select("cell", "own", "a0", "a1", "a2", *[F.when(sound, m).otherwise(o).alias(f"d{k}") for k, (m, o) in enumerate(zip(moves, alone, strict=True))]))
        there = rows.drop("own").join(moved, "cell").join(effects.select("bin_id", "effect").where("effect > 0"), "bin_id")
        slope = F.col("d0") + F.col("x") * (F.col("d1") + F.col("x") * F.col("d2"))
        gain = [F.sum(F.col("n") * (F.log("effect") + eta + t * slope) - F.col("effect") * F.exp(eta + t * slope)) for t in steps]
        tried = there.groupBy("cell", "own", *[f"{c}{k}" for c in "ad" for k in range(3)]).agg(F.array_max(F.array(*[F.struct(F.when(F.isnan(g), float("-inf")).otherwise(g).alias("ll"), F.lit(t).alias("t")) for g, t in zip(gain, steps, strict=True)])).alias("best"))
        after = scratch.save(tried.select("cell", *[(F.col(f"a{k}") + F.col("best")["t"] * F.col(f"d{k}")).alias(f"a{k}") for k in range(3)], "own", F.col("best")["ll"].alias("ll")))
        logliks.append(after.where("own").agg(F.sum("ll")).first()[0] or 0.0)
        cells = after.drop("ll")


def poisson_normalised(counts: DataFrame, cells: DataFrame, bins: DataFrame) -> DataFrame:
    """cell, bin_id, mean, ratio: the fitted mean of each count, and the count over it."""
    eta = F.col("a0") + F.col("x") * (F.col("a1") + F.col("x") * F.col("a2"))
    fitted = counts.join(bins, "bin_id").join(cells, "cell").withColumn("mean", F.col("effect") * F.exp(eta))
    return fitted.select("cell", "bin_id", "mean", F.try_divide(F.col("n").cast("double"), F.col("mean")).alias("ratio"))
