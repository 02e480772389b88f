"""Bins of a genome."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoframe.functions.scalar import chrom_number

REFERENCES = {"hg19": 22, "hg38": 22, "mm10": 19}


def autosomes(sizes: DataFrame, reference: str, sex: bool = False) -> DataFrame:
    """The chromosomes of a reference, their names with ``chr``."""
    if reference not in REFERENCES:
        raise ValueError(f"unknown reference {reference}; known are {', '.join(REFERENCES)}")
    names = [f"chr{i}" for i in range(1, REFERENCES[reference] + 1)] + (["chrX", "chrY"] if sex else [])
    chrom = F.when(F.col("chrom").startswith("chr"), F.col("chrom")).otherwise(F.concat(F.lit("chr"), "chrom"))
    return sizes.withColumn("chrom", chrom).where(F.col("chrom").isin(names))


def bins(sizes: DataFrame, size: int) -> DataFrame:
    """bin_id, chrom, start, end: fixed-width bins with 1-based starts; bin_id runs over chromosomes in natural order.

    Offsets of ids come from one row a chromosome, so bins are made in parallel and never sorted.
    """
    if size <= 0:
        raise ValueError("the bin size has to be positive")
    counted = sizes.withColumn("k", chrom_number(F.col("chrom"))).withColumn("bins", F.ceil(F.col("length") / F.lit(size)).cast("long"))
    offset = F.sum("bins").over(Window.orderBy("k", "chrom").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bins")
    rows = counted.withColumn("offset", offset).where("bins > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)))
    return rows.select((F.col("offset") + F.col("i")).cast("int").alias("bin_id"), "chrom", (F.col("i") * size + 1).alias("start"), F.least((F.col("i") + 1) * size, F.col("length")).alias("end"))


def dense(bins: DataFrame) -> DataFrame:
    """``bins`` with ``pos``, 0 to n - 1 over the bins that are left: segmentation counts positions, not coordinates.

    One partition, of as many rows as a genome has bins.
    """
    return bins.withColumn("pos", (F.row_number().over(Window.orderBy("bin_id")) - 1).cast("int"))
