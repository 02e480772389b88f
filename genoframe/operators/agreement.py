"""How far two clusterings of the same cells agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def adjusted_rand(labels: DataFrame, one: str, two: str) -> DataFrame:
    """cells, rand, adjusted_rand of two label columns, in one row, by counts of pairs in their contingency table.

    Cells without one of the labels are left out. Fewer than two cells, and clusterings that leave nothing to chance,
    agree fully: 1. The table is one aggregate; its margins and sums are taken from it, so cells are shuffled once.
    """
    pairs = lambda n: n * (n - 1) / 2
    cells = labels.where(F.col(one).isNotNull() & F.col(two).isNotNull()).groupBy(F.col(one).alias("a"), F.col(two).alias("b")).agg(F.count("*").cast("double").alias("n"))
    total = lambda df, name: df.agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias(name))
    both = cells.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("cells"), F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("both"))
    ones, twos = (total(cells.groupBy(c).agg(F.sum("n").alias("n")), name) for c, name in (("a", "ones"), ("b", "twos")))
    sums = both.crossJoin(F.broadcast(ones)).crossJoin(F.broadcast(twos)).withColumn("all", pairs(F.col("cells")))
    chance = F.coalesce(F.try_divide(F.col("ones") * F.col("twos"), F.col("all")), F.lit(0.0))
    most = (F.col("ones") + F.col("twos")) / 2
    rand = F.coalesce(F.try_divide(F.col("all") + 2 * F.col("both") - F.col("ones") - F.col("twos"), F.col("all")), F.lit(1.0))
    return sums.select(F.col("cells").cast("long").alias("cells"), rand.alias("rand"), F.coalesce(F.try_divide(F.col("both") - chance, most - chance), F.lit(1.0)).alias("adjusted_rand"))
