"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def chrom_number(chrom: Column) -> Column:
    """Natural order of chromosomes: 1 to 22, X, Y, others last."""
    name = F.regexp_replace(chrom, "^chr", "")
    return F.when(name == "X", 23).when(name == "Y", 24).otherwise(F.coalesce(F.try_to_number(name, F.lit("999")).cast("int"), F.lit(99)))


def bin_label(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def parse_label(label: Column) -> tuple[Column, Column, Column]:
    """chrom, start, end of a label chr:start-end or chr:start:end."""
    parts = F.split(label, "[:-]")
    return parts[0], parts[1].cast("long"), parts[2].cast("long")


def sample_name(path: Column) -> Column:
    """A sample's name in a path: the file's name up to its first comma, then to its first underscore."""
    return F.substring_index(F.substring_index(F.substring_index(path, "/", -1), ",", 1), "_", 1)


def cell_name(sample: Column) -> Column:
    return F.substring_index(sample, ".", 1)


def node_name(node: Column, cell: Column) -> Column:
    """node_cell, or the cell where it has no node."""
    return F.coalesce(F.concat(node, F.lit("_"), cell), cell)


def snapped(x: Column, size: int) -> Column:
    """The nearest multiple of ``size``, halves to even."""
    return (F.rint(x / F.lit(float(size))) * size).cast("long")


def ninth(x: Column) -> Column:
    """Nine decimals, so that sums in another order meet thresholds alike."""
    return F.round(x, 9)
