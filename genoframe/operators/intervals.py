"""Interval joins by bins: equi-joins instead of range conditions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_reads(reads: DataFrame, mapq: int, required: int = 0, forbidden: int = 0) -> DataFrame:
    """Reads of enough mapping quality with all required and none of the forbidden flag bits."""
    flag = F.col("flag")
    return reads.where((F.col("mapq") >= mapq) & (flag.bitwiseAND(required) == required) & (flag.bitwiseAND(forbidden) == 0))


def _cells(start: Column, end: Column, width: int) -> Column:
    """Coarse cells that [start, end) touches."""
    low, high = F.floor(start / width), F.floor((F.greatest(end - 1, start)) / width)
    return F.explode(F.sequence(low, high))


def _reached(spans: Column, start: Column, end: Column) -> Column:
    """Whether [start, end) overlaps one of ``spans``, sorted and apart: found by halving, in the logarithm of their number."""
    size, whole = F.size(spans), lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        before = F.coalesce(F.get(spans, middle)["ms"] < end, F.lit(False))
        return F.when(at["lo"] >= at["hi"], at).when(before, whole(middle + 1, at["hi"])).otherwise(whole(at["lo"], middle))

    found = F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int")), whole(F.lit(0), size), halve)["lo"]
    return F.coalesce(F.get(spans, found - 1)["me"] > start, F.lit(False))


def drop_masked(reads: DataFrame, mask: DataFrame, width: int | None = None, limit: int = 100_000) -> DataFrame:
    """Reads that overlap no mask interval (start < mask end and end > mask start).

    The axis is cut into coarse cells no narrower than the longest read, so a read touches one or two, and as many as
    the mask has intervals, if ``width`` is not given. The mask, its overlapping intervals merged, is a sorted list a
    cell, and a read searches the lists of its cells by halving. Up to ``limit`` mask rows (counted) the lists are
    broadcast and reads stay where they are; beyond, they are met by a shuffle of the reads' distinct keys.
    A stream's longest read is not known: each of its micro-batches is joined with the whole, small mask.
    """
    m = mask.select(F.col("chrom").alias("mc"), F.col("start").alias("ms"), F.col("end").alias("me")).where("mc IS NOT NULL AND ms IS NOT NULL AND me IS NOT NULL")
    if reads.isStreaming:
        return reads.join(F.broadcast(m), (F.col("chrom") == F.col("mc")) & (F.col("start") < F.col("me")) & (F.col("end") > F.col("ms")), "left_anti")
    first, last, count = m.agg(F.min("ms"), F.max(F.greatest("me", "ms")), F.count("*")).first()
    if not count:
        return reads
    width = max(width or (last - first) // count, reads.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0, 1)
    if count < limit:
        apart = merged(m.toDF("chrom", "start", "end"), gap=-1).toDF("mc", "ms", "me").withColumn("c", _cells(F.col("ms"), F.col("me"), width))
        lists = apart.groupBy("mc", "c").agg(F.array_sort(F.collect_list(F.struct("ms", "me"))).alias("spans"))
        free = reads.withColumn("_low", F.floor(F.col("start") / width)).withColumn("_high", F.floor(F.greatest(F.col("end") - 1, F.col("start")) / width))
        for at in ("_low", "_high"):
            here = lists.select(*[F.col(c).alias(f"_{c}") for c in lists.columns])
            free = free.join(F.broadcast(here), (F.col("chrom") == F.col("_mc")) & (F.col(at) == F.col("_c")), "left")
            free = free.where(F.col("_spans").isNull() | ~_reached(F.col("_spans"), F.col("start"), F.col("end"))).drop("_mc", "_c", "_spans")
        return free.select(*reads.columns)
    lists = m.distinct().withColumn("c", _cells(F.col("ms"), F.col("me"), width))
    keys = reads.select("chrom", "start", "end").distinct()
    by_read = keys.withColumn("c", _cells(F.col("start"), F.col("end"), width))
    hit = by_read.join(lists.withColumnRenamed("mc", "chrom"), ["chrom", "c"]).where("start < me AND end > ms").select("chrom", "start", "end").distinct()
    return reads.join(hit, ["chrom", "start", "end"], "left_anti")


def overlap_counts(reads: DataFrame, bins: DataFrame, size: int) -> DataFrame:
    """cell, bin_id, n: reads that overlap each bin; a read across an edge counts in both.

    Bins are regular, so a read knows its bins by arithmetic: bin i of a chromosome is (i size + 1, end) with both
    ends exclusive against half-open reads. Counts are summed per task before the shuffle.
    """
    spans = F.broadcast(bins.groupBy("chrom").agg(F.max("end").alias("length"), F.max(F.expr(f"(start - 1) div {size}")).alias("top")))
    touched = reads.join(spans, "chrom").where("end >= 2 AND start < length")
    touched = touched.select("cell", "chrom", F.expr(f"greatest(0, start div {size})").alias("lo"), F.expr(f"least(top, (end - 2) div {size})").alias("hi"))
    hits = touched.where("hi >= lo").select("cell", "chrom", F.explode(F.sequence("lo", "hi")).alias("i"))
    places = bins.select("bin_id", "chrom", F.expr(f"(start - 1) div {size}").alias("i"))
    return hits.join(F.broadcast(places), ["chrom", "i"]).groupBy("cell", "bin_id").agg(F.count("*").alias("n"))


def dense_counts(counts: DataFrame, cells: DataFrame, bins: DataFrame) -> DataFrame:
    """``counts`` with zeros for each pair of cell and bin that has none. The grid is what the matrix is made of."""
    grid = cells.select("cell").distinct().join(F.broadcast(bins.select("bin_id")))
    return grid.join(counts, ["cell", "bin_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def merged(intervals: DataFrame, gap: int = 0, per: int = 50_000) -> DataFrame:
    """chrom, start, end: the union of intervals; those that touch, or lie within ``gap``, become one.

    The sweep has two levels, so a chromosome is many tasks' work: within ranges of the axis, about one for each
    ``per`` intervals, and over the ranges, which carry how far intervals reach and how many islands came before.
    Of equal intervals the one that begins an island comes first, whatever order a sort that spills leaves them in.
    Intervals that lack a bound are left out; those without a chromosome are one.
    """
    known = intervals.select("chrom", "start", "end").where("start IS NOT NULL AND end IS NOT NULL")
    first, last, count = known.agg(F.min("start"), F.max("start"), F.count("*")).first()
    width = max(1, ((last or 0) - (first or 0)) * per // max(count, 1))
    rows = known.withColumn("range", F.floor(F.col("start") / width))
    here, ranges = Window.partitionBy("chrom", "range").orderBy("start", "end"), Window.partitionBy("_chrom").orderBy("_range")
    before, up_to = here.rowsBetween(Window.unboundedPreceding, -1), here.orderBy("start", "end", F.desc("fresh")).rowsBetween(Window.unboundedPreceding, 0)

    def carried(df: DataFrame, value: Column, fold: Callable, name: str) -> DataFrame:
        """``df`` with the fold of ``value`` over all earlier ranges."""
        sums = df.groupBy(F.col("chrom").alias("_chrom"), F.col("range").alias("_range")).agg(value.alias("_value"))
        sums = sums.withColumn(name, fold("_value").over(ranges.rowsBetween(Window.unboundedPreceding, -1))).drop("_value")
        return df.join(sums, F.col("chrom").eqNullSafe(F.col("_chrom")) & (F.col("range") == F.col("_range"))).drop("_chrom", "_range")

    reach = F.greatest(F.max("end").over(before), F.col("reach"))
    fresh = carried(rows, F.max("end"), F.max, "reach").withColumn("fresh", F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0))
    islands = carried(fresh, F.sum("fresh"), F.sum, "earlier").withColumn("island", F.sum("fresh").over(up_to) + F.coalesce("earlier", F.lit(0)))
    return islands.groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def extreme_bins(totals: DataFrame, low: float = 0.05, high: float = 0.999) -> DataFrame:
    """Bins (bin_id, n) at or under the low quantile of n or at or over the high one."""
    q = totals.agg(F.round(F.percentile("n", low), 9).alias("ql"), F.round(F.percentile("n", high), 9).alias("qh"))
    return totals.join(F.broadcast(q)).where("n <= ql OR n >= qh").drop("ql", "qh")
