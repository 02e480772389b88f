"""Circular binary segmentation shared by all cells: breakpoints of a chromosome that the cells have in common.

An arc of a segment is compared with the rest of it; its statistic is the sum over cells of the squared difference of
means in units of the cell's noise. All that depends on cells is the matrix of products of bins, summed over cells, so
Spark adds that up in blocks of cells (X'X of a block, then sums of blocks) and the search runs on the sum: its two-way
prefix sums give the statistic of every arc, and a permutation of bins permutes rows and columns. A task holds the
square of a chromosome's bins at a time, whatever the number of cells.

An arc is accepted if at most ``alpha`` of the seeded permutations of its segment have one as good; its ends are
breakpoints, and the parts are searched again. Cells without noise (equal neighbours everywhere) say nothing. All cells
need the same bins of a chromosome, an error otherwise; null values count as the cell's mean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoframe.operators.hmm import sequences

BLOCK, SALTS = 256, 64


def noise(values: DataFrame, value: str) -> DataFrame:
    """cell, noise: from differences of neighbouring bins, which breakpoints hardly touch; and the cell's mean."""
    along = Window.partitionBy("cell", "chrom").orderBy("bin_id")
    steps = values.select("cell", F.col(value).alias("x"), (F.col(value) - F.lag(value).over(along)).alias("d"))
    return steps.groupBy("cell").agg(F.sqrt(F.avg(F.col("d") * F.col("d")) / 2).alias("noise"), F.avg("x").alias("mean"))


def statistics(products: np.ndarray, width: int = 2) -> np.ndarray:
    """The statistic of every arc [i, j) of a segment, from its bins' products; -inf where a part would be too short."""
    n = len(products)
    sums = np.zeros((n + 1, n + 1))
    sums[1:, 1:] = products.cumsum(0).cumsum(1)
    own, whole = sums.diagonal(), sums[:, n]
    i, j = np.arange(n + 1)[:, None], np.arange(n + 1)[None, :]
    m = j - i
    share = m / n
    square = own[:, None] + own[None, :] - 2 * sums - 2 * share * (whole[None, :] - whole[:, None]) + share**2 * own[n]
    fits = (m >= width) & (n - m >= width) & ((i == 0) | (i >= width)) & ((j == n) | (n - j >= width))
    return np.where(fits, square / np.where(fits, m * (1 - share), 1), -np.inf)


def best_arc(products: np.ndarray, width: int) -> tuple[float, int, int]:
    """The greatest statistic and its arc, the first one of equals."""
    z = statistics(products, width)
    at = int(z.argmax())
    return float(z.flat[at]), *divmod(at, len(products) + 1)


def breakpoints(products: np.ndarray, alpha: float, permutations: int, seed: int, width: int = 2) -> list[int]:
    """Where segments begin, 0 first."""
    found, todo = {0}, [(0, len(products))]
    while todo:
        a, b = todo.pop()
        if b - a < 2 * width:
            continue
        part = products[a:b, a:b]
        best, i, j = best_arc(part, width)
        rng, beaten, bar = np.random.default_rng([seed, a, b]), 0, alpha * (permutations + 1) - 1
        for _ in range(permutations if np.isfinite(best) else 0):
            order = rng.permutation(b - a)
            beaten += best_arc(part[np.ix_(order, order)], width)[0] >= best
            if beaten > bar:
                break
        if np.isfinite(best) and best > 0 and beaten <= bar:
            edges = sorted({a, a + i, a + j, b})
            found.update(edges[:-1])
            todo.extend(zip(edges, edges[1:], strict=False))
    return sorted(found)


def shared_segments(values: DataFrame, value: str = "value", alpha: float = 0.05, permutations: int = 99, seed: int = 1) -> DataFrame:
    """chrom, bin_id, seg_id: the segments that all cells share. ``values`` has cell, chrom, bin_id and the value."""
    rows = sequences(values, value).join(noise(values, value).where("noise > 0"), "cell")
    blocks = max(1, -(-values.select("cell").distinct().count() // BLOCK))
    scaled = rows.select("chrom", "bins", F.expr("transform(xs, x -> coalesce((x - mean) / noise, 0d))").alias("xs"), F.pmod(F.xxhash64("cell"), F.lit(blocks)).alias("block"), F.pmod(F.xxhash64("cell"), F.lit(min(blocks, SALTS))).alias("salt"))
    kind = values.schema["bin_id"].dataType.simpleString()
    ddl = f"chrom string, salt long, bins array<{kind}>, products binary"

    def row(t: pa.Table, products: np.ndarray) -> pa.Table:
        return pa.table({"chrom": t["chrom"].slice(0, 1), "salt": t["salt"].slice(0, 1), "bins": t["bins"].slice(0, 1), "products": pa.array([products.tobytes()], pa.binary())})

    def same_bins(t: pa.Table) -> int:
        if len({tuple(b) for b in t["bins"].to_pylist()}) > 1:
            raise ValueError(f"cells differ in their bins of {t['chrom'][0].as_py()}")
        return len(t["bins"][0])

    def of_block(t: pa.Table) -> pa.Table:
        same_bins(t)
        x = np.array(t["xs"].to_pylist(), float)
        return row(t, x.T @ x)

    def added(t: pa.Table) -> np.ndarray:
        n = same_bins(t)
        return sum((np.frombuffer(p.as_py()).reshape(n, n) for p in t["products"]), np.zeros((n, n)))

    def of_chrom(t: pa.Table) -> pa.Table:
        starts = breakpoints(added(t), alpha, permutations, seed)
        bins = t["bins"][0].as_py()
        seg = np.searchsorted(starts, np.arange(len(bins)), "right") - 1
        return pa.table({"chrom": [t["chrom"][0].as_py()] * len(bins), "bin_id": pa.array(bins, t.schema.field("bins").type.value_type), "seg_id": pa.array(seg, pa.int32())})

    by_block = scaled.groupBy("chrom", "salt", "block").applyInArrow(of_block, ddl)
    by_salt = by_block.groupBy("chrom", "salt").applyInArrow(lambda t: row(t, added(t)), ddl)
    return by_salt.groupBy("chrom").applyInArrow(of_chrom, f"chrom string, bin_id {kind}, seg_id int")


def segment_means(values: DataFrame, shared: DataFrame, value: str = "value") -> DataFrame:
    """cell, chrom, seg_id, first_bin, last_bin, mean of the cell's values in each shared segment."""
    placed = values.join(shared, ["chrom", "bin_id"])
    return placed.groupBy("cell", "chrom", "seg_id").agg(F.min("bin_id").alias("first_bin"), F.max("bin_id").alias("last_bin"), F.avg(value).alias("mean"))
