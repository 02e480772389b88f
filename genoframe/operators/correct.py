"""Normal cells and the bias they show."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoframe.functions.scalar import ninth
from genoframe.session import Scratch


def lorenz(values: DataFrame, entity: str, value: str) -> DataFrame:
    """entity, rank, share: the cumulative share of the sorted values."""
    order = Window.partitionBy(entity).orderBy(value, "bin_id").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(entity)
    return values.select(entity, F.count("*").over(order).alias("rank"), F.try_divide(F.sum(value).over(order).cast("double"), F.sum(value).over(whole)).alias("share"))


def gini(values: DataFrame, entity: str = "cell", value: str = "n") -> DataFrame:
    """entity, gini: twice the area between diagonal and Lorenz curve, the area rounded to four digits half to even."""
    rank = F.row_number().over(Window.partitionBy(entity).orderBy(value, "bin_id"))
    ranked = values.select(entity, F.col(value).cast("double").alias("y"), rank.alias("i"))
    g = ranked.groupBy(entity).agg(F.sum(F.col("i") * F.col("y")).alias("iy"), F.sum("y").alias("y"), F.count("*").alias("c"))
    half = F.try_divide(2 * F.col("iy") - (F.col("c") + 1) * F.col("y"), 2 * F.col("c") * F.col("y"))
    return g.select(entity, (2 * F.bround(ninth(half), 4)).alias("gini"))


def first_loadings(counts: DataFrame, scale: bool = False, block: int = 128, most: int = 512) -> DataFrame:
    """bin_id, loading: the first principal component of cells as observations and bins as features.

    Bins are centred over cells (and scaled, if asked); its sign makes the largest cell score positive. Cells are rows of
    a table. A pass over it multiplies ``block`` vectors of one value a bin by the matrix of products of bins, which is
    never built, and the vectors grow into a Krylov space (to ``most`` vectors, then it starts again from the best) until
    the component's residual is nil: a single pass if there are no more than ``block`` bins. Only such vectors come to
    the driver. Without any spread all loadings are 0.
    """
    spark = counts.sparkSession
    stats = counts.groupBy("bin_id").agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("std")).orderBy("bin_id").toPandas()
    mean, std, n = stats["mean"].to_numpy(float), stats["std"].to_numpy(float), len(stats)
    per = np.divide(1.0, std, out=np.zeros(n), where=std > 0) if scale else np.ones(n)
    by_cell = counts.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("bin_id", "n"))).alias("v"))
    rows = Scratch(spark).save(by_cell.select(F.transform("v", lambda s: s["n"].cast("double")).alias("v")))

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for x in (b.column(0).slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            yield (x.flatten().to_numpy().reshape(len(x), n) - mean) * per

    def times(vectors: np.ndarray) -> np.ndarray:
        """The matrix of products of bins times ``vectors``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = sum((x.T @ (x @ vectors) for x in centred(batches)), np.zeros(vectors.shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.array(out.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

        sums = rows.mapInArrow(run, "i int, v array<double>").groupBy("i").agg(*[F.sum(F.col("v")[k]).alias(f"s{k}") for k in range(vectors.shape[1])])
        return sums.toPandas().sort_values("i").drop(columns="i").to_numpy(float)

    basis = np.eye(n) if n <= block else np.linalg.qr(np.random.default_rng(0).normal(size=(n, block)))[0]
    image = times(basis) if n else basis
    first, top = np.zeros(n), 0.0
    while n:
        values, y = np.linalg.eigh(basis.T @ image)
        first, top = basis @ y[:, -1], values[-1]
        new = image @ y[:, -block:] - basis @ y[:, -block:] * values[-block:]
        if top <= 0 or basis.shape[1] == n or np.linalg.norm(new[:, -1]) <= 1e-12 * top:
            break
        if basis.shape[1] + block > most:
            basis, image = basis @ y[:, -block:], image @ y[:, -block:]
        for bar in (1e-13 * top, 0.5):  # what is not in the space yet; once more, as rounding leaves a little
            new = new - basis @ (basis.T @ new)
            left, size, _ = np.linalg.svd(new, full_matrices=False)
            new = left[:, size > bar]
        if not new.shape[1]:
            break
        basis, image = np.hstack([basis, new]), np.hstack([image, times(new)])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = [x @ first for x in centred(batches)]
        if scores:
            ends = [[float(f(np.concatenate(scores)))] for f in (np.min, np.max)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()) for x in ends], names=["low", "high"])

    low, high = (rows.mapInArrow(reach, "low double, high double").agg(F.min("low"), F.max("high")).first() if top > 0 else None) or (0.0, 0.0)
    sign = 0.0 if top <= 0 else 1.0 if high >= -low else -1.0
    return spark.createDataFrame([(int(b), float(x) * sign) for b, x in zip(stats["bin_id"], first, strict=True)], "bin_id int, loading double")


def informative_bins(loadings: DataFrame, quantile: float = 0.4, mode: str = "signed") -> DataFrame:
    """bin_id of the bins whose loading reaches the quantile."""
    value = F.abs("loading") if mode == "abs" else F.col("loading")
    kept = loadings.withColumn("w", ninth(value))
    bar = kept.agg(F.percentile("w", quantile).alias("q"))
    return kept.join(F.broadcast(bar)).where("w >= q").select("bin_id")


def normal_cells(counts: DataFrame, bins: DataFrame, most: float = 0.12, listed: DataFrame | None = None) -> DataFrame:
    """cell: those that are listed, or else those whose Gini coefficient over ``bins`` is under ``most``."""
    if listed is not None:
        return counts.select("cell").distinct().join(listed.select("cell").distinct(), "cell", "left_semi")
    return gini(counts.join(F.broadcast(bins), "bin_id", "left_semi")).where(F.col("gini") < most).select("cell")


def bias(counts: DataFrame, normal: DataFrame) -> DataFrame:
    """bin_id, bias: the mean over normal cells of n / median(n of the cell); 0 becomes 1."""
    own = counts.join(normal, "cell", "left_semi")
    middle = own.groupBy("cell").agg(F.median("n").alias("m"))
    mean = own.join(middle, "cell").groupBy("bin_id").agg(ninth(F.avg(F.try_divide("n", "m"))).alias("bias"))
    return mean.select("bin_id", F.when(F.coalesce("bias", F.lit(0.0)) == 0, 1.0).otherwise(F.col("bias")).alias("bias"))


def corrected(counts: DataFrame, by_bin: DataFrame) -> DataFrame:
    """cell, bin_id, value: n divided by the bin's bias."""
    return counts.join(F.broadcast(by_bin), "bin_id").select("cell", "bin_id", (F.col("n") / F.col("bias")).alias("value"))


def plus_one(values: DataFrame, value: str = "n") -> DataFrame:
    """cell, bin_id, y: (value + 1) over its mean in the cell, summed by bin, so that cells with equal values have equal y."""
    x, whole = F.col(value) + 1, Window.partitionBy("cell").orderBy("bin_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return values.select("cell", "bin_id", (x / F.avg(x).over(whole)).alias("y"))


def spread_split(norm: DataFrame, most: float = 0.25) -> DataFrame:
    """cell, std, is_normal: the population deviation of y, and whether it is small."""
    std = norm.groupBy("cell").agg(ninth(F.stddev_pop("y")).alias("std"))
    return std.withColumn("is_normal", F.col("std") <= most)
