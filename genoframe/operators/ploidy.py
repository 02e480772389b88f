"""Ploidy by grid search, and integer copy numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoframe.functions.scalar import ninth


def grid(first: float = 1.15, step: float = 0.05, size: int = 87) -> Column:
    """The candidates as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.round(F.lit(first) + F.lit(step) * k, 2))


def residuals(profile: DataFrame, entity: str = "cluster", candidates: Column | None = None) -> DataFrame:
    """entity, p, rs: the sum over bins of |v p - nearest integer| for each candidate."""
    x = F.col("v") * F.col("p")
    per_bin = profile.select(entity, "v", F.explode(grid() if candidates is None else candidates).alias("p"))
    return per_bin.groupBy(entity, "p").agg(ninth(F.sum(F.abs(x - F.rint(ninth(x))))).alias("rs"))


def local_minima(rs: DataFrame, entity: str = "cluster") -> DataFrame:
    """Candidates strictly under both neighbours."""
    order = Window.partitionBy(entity).orderBy("p")
    return rs.withColumn("_l", F.lag("rs").over(order)).withColumn("_r", F.lead("rs").over(order)).where("rs < _l AND rs < _r").drop("_l", "_r")


def estimate(rs: DataFrame, entity: str = "cluster") -> DataFrame:
    """entity, ploidy: the least local minimum, at ties the smaller candidate; without one, the least of all."""
    best = lambda df, name: df.groupBy(entity).agg(F.min(F.struct("rs", "p"))["p"].alias(name))
    return best(rs, "any").join(best(local_minima(rs, entity), "local"), entity, "left").select(entity, F.coalesce("local", "any").alias("ploidy"))


def block_medians(values: DataFrame) -> DataFrame:
    """cluster, seg_id, block: the median over all cells and bins of a segment."""
    return values.groupBy("cluster", "seg_id").agg(F.median("y").alias("block"))


def cell_medians(values: DataFrame) -> DataFrame:
    """cluster, cell, seg_id, middle: the median over a cell's bins of a segment."""
    return values.groupBy("cluster", "cell", "seg_id").agg(F.median("y").alias("middle"))


def smoothed(values: DataFrame) -> DataFrame:
    """``values`` with y moved half-way to its segment's median."""
    return values.join(block_medians(values), ["cluster", "seg_id"]).withColumn("y", F.col("block") + (F.col("y") - F.col("block")) / 2).drop("block")


def calls(values: DataFrame, ploidy: DataFrame) -> DataFrame:
    """cell, seg_id, cn: the integer copy number of each cell in each segment of its cluster.

    A cell's median over smoothed values is (its median + the segment's median) / 2, so nothing is smoothed here.
    """
    both = cell_medians(values).join(block_medians(values), ["cluster", "seg_id"]).join(ploidy, "cell")
    level = (F.col("middle") + F.col("block")) / 2
    return both.select("cluster", "cell", "seg_id", F.rint(ninth(F.col("ploidy") * level)).cast("int").alias("cn"))


def call_matrix(called: DataFrame, placed: DataFrame) -> DataFrame:
    """cell, pos, cn: segment calls at each position."""
    return called.join(placed, ["cluster", "seg_id"]).select("cell", "pos", "cn")
