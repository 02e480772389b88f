"""Intervals of one genome assembly in another's coordinates, by the aligned blocks of chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_chains(spark: SparkSession, path: str) -> DataFrame:
    """chain, score, chrom, start, end, to_chrom, to_start, flip: the blocks of chain files (plain or packed).

    Chains are parted by empty lines; a chain is a row of text, then a row a block. Places in the other assembly count
    from the start of its forward strand; ``flip`` blocks run against it. A chain whose blocks do not add up to the
    span in its first line is an error.
    """
    text = spark.read.text(path, lineSep="\n\n").select(F.filter(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#")).alias("lines")).where("size(lines) > 0")
    head = F.split(F.trim(F.col("lines")[0]), r"\s+")
    chain = text.select(
        head[12].alias("chain"), head[1].cast("double").alias("score"), head[2].alias("chrom"), head[5].cast("long").alias("t0"), head[6].cast("long").alias("t1"),
        head[7].alias("to_chrom"), head[8].cast("long").alias("to_size"), (head[9] == "-").alias("flip"), head[10].cast("long").alias("q0"), head[11].cast("long").alias("q1"),
        F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("i", "line"),
    )
    part = F.split(F.trim("line"), r"\s+")
    gap = lambda i: F.coalesce(F.get(part, F.lit(i)).cast("long"), F.lit(0))
    sized = chain.withColumns({"size": part[0].cast("long"), "dt": gap(1), "dq": gap(2)})
    so_far = Window.partitionBy("chain", "chrom", "t0", "to_chrom", "q0", "flip").orderBy("i")
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumns({"t": F.col("t0") + F.coalesce(F.sum(F.col("size") + F.col("dt")).over(before), F.lit(0)), "q": F.col("q0") + F.coalesce(F.sum(F.col("size") + F.col("dq")).over(before), F.lit(0)), "last": F.lead("i").over(so_far).isNull()})
    sound = ~F.col("last") | ((F.col("t") + F.col("size") == F.col("t1")) & (F.col("q") + F.col("size") == F.col("q1")))
    start = F.when(sound, F.col("t")).otherwise(F.raise_error(F.concat(F.lit("blocks do not fill the span of chain "), "chain")))
    to_start = F.when(F.col("flip"), F.col("to_size") - F.col("q") - F.col("size")).otherwise(F.col("q"))
    return placed.select("chain", "score", "chrom", start.alias("start"), (start + F.col("size")).alias("end"), "to_chrom", to_start.alias("to_start"), "flip")


def lifted(intervals: DataFrame, blocks: DataFrame, least: float = 0.95, width: int = 1 << 16, limit: int = 500_000) -> DataFrame:
    """``intervals`` (chrom, start, end and others) with status, to_chrom, to_start, to_end, flip, share.

    An interval is ``lifted`` by the chain that holds most of its bases, if that is at least the share ``least``: to
    the span of these bases' places. Otherwise it is ``split`` if all chains together hold that share, ``partly
    deleted`` if they hold less, and ``deleted`` if none; then the places are null. ``share`` is that of all chains, at
    most 1. Ties go to the greater score, then to the least chain.

    Defined cases: an interval without bases, or with a null, is deleted; equal intervals are lifted once and each row
    keeps its result; columns that have the name of a new one give way to it; bases that two blocks of a chain hold
    count twice, but chains have no such blocks; empty tables give no rows and deleted ones.

    Both sides are cut into coarse cells of the axis, and a pair is met in the cell where its overlap begins, so once.
    Up to ``limit`` blocks in cells (counted) are broadcast, and intervals stay where they are until their overlaps are
    added up; beyond, cells are joined by a shuffle. ``width`` should not be far under the usual interval's.
    """
    new = ["status", "to_chrom", "to_start", "to_end", "flip", "share"]
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    index = blocks.where("end > start").select("chain", "score", F.col("chrom").alias("bc"), F.col("start").alias("bs"), F.col("end").alias("be"), "to_chrom", F.col("to_start").alias("ts"), "flip", cells("start", "end").alias("bat"))
    spans = intervals.where("end > start").select(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e")).distinct()
    if index.limit(limit).count() < limit:
        index = F.broadcast(index)
    met = spans.withColumn("at", cells("_s", "_e")).join(index, (F.col("_c") == F.col("bc")) & (F.col("at") == F.col("bat")))
    low, high, by_span = F.greatest("_s", "bs"), F.least("_e", "be"), ["_c", "_s", "_e"]
    met = met.where((low < high) & (F.floor(low / width) == F.col("at")))
    to_low = F.col("ts") + F.when(F.col("flip"), F.col("be") - high).otherwise(low - F.col("bs"))
    parts = met.select(*by_span, "chain", "score", "to_chrom", "flip", (high - low).alias("bases"), to_low.alias("a"), (to_low + high - low).alias("b"))
    chains = parts.groupBy(*by_span, "chain", "score", "to_chrom", "flip").agg(F.sum("bases").alias("bases"), F.min("a").alias("a"), F.max("b").alias("b"))
    first = F.struct(-F.col("bases"), -F.col("score"), F.col("chain"), "to_chrom", "flip")
    best = chains.groupBy(*by_span).agg(F.sum("bases").alias("_all"), F.min_by(F.struct("bases", "to_chrom", "a", "b", "flip"), first).alias("_best"))
    joined = intervals.join(best, (F.col("chrom") == F.col("_c")) & (F.col("start") == F.col("_s")) & (F.col("end") == F.col("_e")), "left")
    length, of_best = F.col("end") - F.col("start"), F.col("_best")
    good = F.coalesce(of_best["bases"] >= least * length, F.lit(False))
    status = F.when(good, "lifted").when(F.col("_all").isNull(), "deleted").when(F.col("_all") >= least * length, "split").otherwise("partly deleted")
    places = [F.when(good, of_best[c]) for c in ("to_chrom", "a", "b", "flip")]
    values = [status, *places, F.least(F.lit(1.0), F.coalesce(F.try_divide("_all", length), F.lit(0.0)))]
    kept = [F.col(f"`{c}`") for c in intervals.columns if c not in new]
    return joined.select(*kept, *[v.alias(n) for v, n in zip(values, new, strict=True)])
