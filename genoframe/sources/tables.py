"""The driver's star schema seen as reads, bins and masks: cell = supplier, position = day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoframe.operators import genome

BIN = 30
SPAN = 2520  # days that the tables' axis has at least, from 1995 on


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    size = F.col("l_quantity").cast("int")
    flag = F.when(F.col("l_linenumber") % 2 == 1, 65).otherwise(129) + F.when(F.col("l_returnflag") == "R", 1024).otherwise(0)
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("cell"), F.lit("chr1").alias("chrom"), day.alias("start"), (day + size).alias("end"), size.alias("mapq"), flag.alias("flag"), size.alias("query_length")
    )


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30-day bins up to the last day on which a line starts, with gc and mapp from the discounts and taxes of the lines that start in them."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    last = F.greatest(F.lit(SPAN), F.ceil((F.max(day) + 1) / BIN) * BIN)
    sizes = read(spark, sf_dir, "lineitem").agg(last.cast("long").alias("length")).select(F.lit("chr1").alias("chrom"), "length")
    plain = genome.bins(sizes, BIN)
    facts = read(spark, sf_dir, "lineitem").groupBy(F.floor(day / BIN).cast("int").alias("bin_id"))
    facts = facts.agg(F.round(F.avg("l_discount") * 1000, 6).alias("gc"), F.round(1 - F.avg("l_tax"), 6).alias("mapp"))
    return plain.join(facts, "bin_id", "left")


def mask(spark: SparkSession, sf_dir: str, quantile: float = 0.98) -> DataFrame:
    """Three days from each of the busiest days: those whose number of orders reaches the quantile of all days."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    by_day = read(spark, sf_dir, "orders").groupBy(day.alias("start")).agg(F.count("*").alias("n"))
    bar = by_day.agg(F.round(F.percentile("n", quantile), 9).alias("bar"))
    return by_day.join(F.broadcast(bar)).where("n >= bar").select(F.lit("chr1").alias("chrom"), "start", (F.col("start") + 3).alias("end"))


def cell_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("s_suppkey").alias("cell"), F.col("n_name").alias("node"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order, two at a time, as the reads of a fragment that starts in the first bin of a quarter."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    name = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.expr("cast((l_linenumber - 1) div 2 as string)"))
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 100).cast("int").alias("cell"), name.alias("name"), ((F.col("l_linenumber") - 1) % 2).cast("int").alias("mate"), F.lit("chr1").alias("chrom"),
        (F.floor(day / 90) * 90).alias("five"), (F.col("l_returnflag") == "R").alias("reverse"), F.col("l_quantity").cast("int").alias("score"), F.lit(1).alias("flag"),
    )


def calm_blocks(spark: SparkSession, sf_dir: str, quantile: float = 0.97, runs: int = 8) -> DataFrame:
    """Blocks of chains from all days with orders to an axis without the busiest: see ``lift``."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    by_day = read(spark, sf_dir, "orders").groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    bar = by_day.agg(F.round(F.percentile("n", quantile), 9).alias("bar"))
    calm = by_day.join(F.broadcast(bar)).where("n < bar").withColumn("run", F.col("day") - F.row_number().over(Window.orderBy("day")))
    blocks = calm.groupBy("run").agg(F.min("day").alias("start"), (F.max("day") + 1).alias("end")).withColumn("chain", F.floor((F.row_number().over(Window.orderBy("start")) - 1) / runs))
    size, of_chain = F.col("end") - F.col("start"), Window.partitionBy("chain")
    before, whole, flip = F.sum(size).over(of_chain.orderBy("start")) - size, F.sum(size).over(of_chain), F.col("chain") % 2 == 1
    to_start = F.when(flip, whole - before - size).otherwise(before)
    return blocks.select("chain", F.lit(1.0).alias("score"), F.lit("chr1").alias("chrom"), "start", "end", F.concat(F.lit("part"), F.col("chain").cast("string")).alias("to_chrom"), to_start.alias("to_start"), flip.alias("flip"))
