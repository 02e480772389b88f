"""Change points of profiles: windows over (cluster, pos)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoframe.functions.scalar import ninth


def mean_profile(norm: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster, bin_id, v: the mean of y over the cells of a cluster."""
    return norm.join(labels.select("cell", "cluster"), "cell").groupBy("cluster", "bin_id").agg(ninth(F.avg("y")).alias("v"))


def median_profile(norm: DataFrame) -> DataFrame:
    """bin_id, v: the median of y over all cells."""
    return norm.groupBy("bin_id").agg(F.median("y").alias("v"))


def neighbour_difference(profile: DataFrame, flank: int = 6, entity: str = "cluster") -> DataFrame:
    """``profile`` (entity, pos, v) with ``diff``: the absolute difference of the medians of ``flank`` values before a
    position and from it on; 0 within ``flank`` of either end."""
    order, whole = Window.partitionBy(entity).orderBy("pos"), Window.partitionBy(entity)
    before, after = (F.percentile("v", 0.5).over(order.rowsBetween(*r)) for r in ((-flank, -1), (0, flank - 1)))
    at, n = F.row_number().over(order) - 1, F.count("*").over(whole)
    return profile.withColumn("_at", at).withColumn("_n", n).withColumn("diff", F.when((F.col("_at") < flank) | (F.col("_at") >= F.col("_n") - flank), 0.0).otherwise(ninth(F.abs(before - after)))).drop("_at", "_n")


def cutoffs(diffs: DataFrame, mode: str = "q", quantile: float = 0.84, fixed: float = 0.1, entity: str = "cluster") -> DataFrame:
    """entity, cutoff: a quantile of the differences rounded to two digits half to even, or a fixed value."""
    if mode not in ("q", "h"):
        raise ValueError("the cut-off mode is q or h")
    value = F.bround(ninth(F.percentile("diff", quantile)), 2) if mode == "q" else F.first(F.lit(fixed))
    return diffs.groupBy(entity).agg(value.alias("cutoff"))


def islands(diffs: DataFrame, cutoff: DataFrame, least: int = 4, entity: str = "cluster") -> DataFrame:
    """entity, lo, hi, n: runs of at least ``least`` neighbouring positions whose difference reaches the cut-off."""
    high = diffs.join(F.broadcast(cutoff), entity).where("diff >= cutoff")
    run = F.col("pos") - F.row_number().over(Window.partitionBy(entity).orderBy("pos"))
    return high.withColumn("run", run).groupBy(entity, "run").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n")).where(F.col("n") >= least).drop("run")


def boundaries(found: DataFrame, profile: DataFrame, entity: str = "cluster") -> DataFrame:
    """entity, boundary: exclusive ends of segments, the middle of each island (half to even) and the end of all."""
    ends = profile.groupBy(entity).agg(F.count("*").cast("int").alias("boundary"))
    return found.select(entity, F.rint((F.col("lo") + F.col("hi")) / 2).cast("int").alias("boundary")).unionByName(ends).distinct()


def segments(bounds: DataFrame, entity: str = "cluster") -> DataFrame:
    """entity, seg_id, from_bin, to_bin (half-open, in positions)."""
    order = Window.partitionBy(entity).orderBy("boundary")
    out = bounds.select(entity, (F.row_number().over(order) - 1).cast("int").alias("seg_id"), F.coalesce(F.lag("boundary").over(order), F.lit(0)).alias("from_bin"), F.col("boundary").alias("to_bin"))
    return out.where("to_bin > from_bin")


def placed(positions: DataFrame, segs: DataFrame, entity: str = "cluster") -> DataFrame:
    """entity, pos, seg_id for each position of each entity: segments unfold to their positions."""
    return segs.select(entity, "seg_id", F.explode(F.sequence(F.col("from_bin"), F.col("to_bin") - 1)).alias("pos")).join(positions.select(entity, "pos").distinct(), [entity, "pos"])


def breakpoints(calls: DataFrame, entity: str, value: str) -> DataFrame:
    """entity, breakpoint: pos + 0.5 where the next value differs."""
    nxt = F.lead(value).over(Window.partitionBy(entity).orderBy("pos"))
    return calls.withColumn("_next", nxt).where(F.col("_next") != F.col(value)).select(entity, (F.col("pos") + 0.5).alias("breakpoint"))


def lag_difference(profile: DataFrame, step: int = 6, entity: str = "cluster") -> DataFrame:
    """entity, pos, d: v minus the value ``step`` positions before."""
    back = F.lag("v", step).over(Window.partitionBy(entity).orderBy("pos"))
    return profile.select(entity, "pos", ninth(F.col("v") - back).alias("d")).where("d IS NOT NULL")
