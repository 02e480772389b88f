"""Reads that copy another one: the same fragment of the same cell, seen again.

A fragment's signature is the places and strands of its reads' unclipped 5' ends. Of the fragments with one signature
the best stays: the greatest sum of scores, of equal ones the least name. A fragment with one placed read is a copy, too,
if a fragment with two has an end there.

Defined cases: reads that are unmapped or have no name are no copies and mark none; further lines of a read (secondary,
supplementary) follow their fragment without being part of its signature; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FURTHER = 0x100 | 0x800


def five_prime(start: Column, end: Column, reverse: Column, clipped_left: Column, clipped_right: Column) -> Column:
    """The place of a read's first base, as if nothing of it were clipped (start, end: half open, of what is aligned)."""
    return F.when(reverse, end + clipped_right - 1).otherwise(start - clipped_left)


def survivors(reads: DataFrame) -> DataFrame:
    """cell, name, ends, copies: the fragments that stay, and how many have their signature. See ``marked``.

    Names are spread evenly; signatures may not be, so the best fragment of each is found by an aggregate that starts
    before the shuffle, and no two rows of one signature meet but as partial results.
    """
    placed = reads.where(F.col("name").isNotNull() & F.col("chrom").isNotNull() & (F.col("flag").bitwiseAND(FURTHER | 4) == 0))
    ends = F.array_sort(F.collect_list(F.struct("chrom", "five", "reverse")))
    fragments = placed.groupBy("cell", "name").agg(ends.alias("ends"), F.sum("score").alias("score"))
    best = fragments.groupBy("cell", "ends").agg(F.min_by("name", F.struct(-F.col("score"), F.col("name"))).alias("name"), F.count("*").alias("copies"))
    single = F.size("ends") == 1
    taken = best.where(~single).select("cell", F.explode("ends").alias("e")).distinct()
    free = best.where(single).join(taken, (best["cell"].eqNullSafe(taken["cell"])) & (F.col("ends")[0] == F.col("e")), "left_anti")
    return best.where(~single).unionByName(free).select("cell", "name", "ends", "copies")


def marked(reads: DataFrame) -> DataFrame:
    """``reads`` (cell, name, chrom, five, reverse, score, flag and others) with ``duplicate``."""
    stay = survivors(reads).select(F.col("cell").alias("_cell"), F.col("name").alias("_name"))
    has_place = reads.where(F.col("name").isNotNull() & F.col("chrom").isNotNull() & (F.col("flag").bitwiseAND(FURTHER | 4) == 0))
    known = has_place.select(F.col("cell").alias("_cell"), F.col("name").alias("_name")).distinct()
    copies = known.join(stay, known["_cell"].eqNullSafe(stay["_cell"]) & (known["_name"] == stay["_name"]), "left_anti").withColumn("_copy", F.lit(True))
    out = reads.join(copies, F.col("cell").eqNullSafe(F.col("_cell")) & (F.col("name") == F.col("_name")), "left")
    columns = [F.col(f"`{c}`") for c in reads.columns if c != "duplicate"]
    placed = F.col("chrom").isNotNull() & (F.col("flag").bitwiseAND(4) == 0)
    return out.select(*columns, (F.coalesce("_copy", F.lit(False)) & placed).alias("duplicate"))


def metrics(marks: DataFrame) -> DataFrame:
    """cell, reads, duplicates, share: of the placed reads without further lines."""
    placed = marks.where(F.col("chrom").isNotNull() & (F.col("flag").bitwiseAND(FURTHER | 4) == 0))
    out = placed.groupBy("cell").agg(F.count("*").alias("reads"), F.count_if("duplicate").alias("duplicates"))
    return out.withColumn("share", F.col("duplicates") / F.col("reads"))
