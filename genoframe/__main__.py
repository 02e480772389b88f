"""Command line: BAM files of single cells to copy numbers. On a cluster: spark-submit with this file."""

from __future__ import annotations

import argparse
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.functions.scalar import bin_label, node_name
from genoframe.operators import genome
from genoframe.params import Params
from genoframe.plans import pipeline
from genoframe.sources import bam, files, sinks


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="genoframe", description=__doc__)
    source = out.add_mutually_exclusive_group(required=True)
    source.add_argument("--bam-dirs", nargs="+", metavar="DIR", help="folders with a BAM file a cell")
    source.add_argument("--bam-list", nargs="+", metavar="FILE", help="BAM files")
    source.add_argument("--reads", metavar="PARQUET", help="reads as a table: " + files.READS)
    out.add_argument("--sizes", required=True, metavar="FASTA", help="FASTA file, or its index .fai")
    out.add_argument("--reference", default="hg38", choices=sorted(genome.REFERENCES))
    out.add_argument("--gc", required=True, help="table of GC content: chrom start end percent")
    out.add_argument("--mappability", required=True, help="a number a bin, in the order of bins")
    out.add_argument("--mask", help="BED file of regions whose reads are dropped")
    out.add_argument("--normal-cells", help="list of normal cells")
    out.add_argument("--bias", help="bias of bins, for samples without normal cells")
    out.add_argument("--cell-nodes", help="table of cells and their nodes, for names in the output")
    out.add_argument("--single-end", action="store_true", help="reads are not paired")
    out.add_argument("--prefix", default="sample")
    out.add_argument("--output", required=True, metavar="DIR")
    for f in fields(Params):
        if f.name != "paired":
            out.add_argument("--" + f.name.replace("_", "-"), type=type(f.default), default=f.default)
    return out


def run(spark: SparkSession, argv: list[str] | None = None) -> DataFrame:
    """Read, call and write; returns the calls (cell, bin_id, cn)."""
    a = parser().parse_args(argv)
    p = replace(Params(), paired=not a.single_end, **{f.name: getattr(a, f.name) for f in fields(Params) if f.name != "paired"})
    plain = genome.bins(genome.autosomes(files.chrom_sizes(spark, a.sizes), a.reference), p.bin_size)
    bins = files.bin_annotations(plain, files.gc_table(spark, a.gc), files.mappability(spark, a.mappability, plain))
    reads = spark.read.schema(files.READS).parquet(a.reads) if a.reads else bam.bam_reads(spark, *(a.bam_dirs or a.bam_list))
    optional = lambda read, path: read(spark, path) if path else None
    steps: dict[str, DataFrame] = {}
    called = pipeline.call_copy_numbers(reads, bins, p, optional(files.mask, a.mask), optional(files.normal_cells, a.normal_cells), optional(files.bias_file, a.bias), steps)

    sinks.write_raw_counts(steps["raw"], f"{a.output}/Y_raw.parquet")
    sinks.write_sample_metrics(reads, f"{a.output}/QCmetric_raw.csv")
    sinks.write_coverage(steps["kept"], bins, f"{a.output}/genome_cov.bed")
    sinks.write_corrected(steps["corrected"], f"{a.output}/RDmatrix.parquet")
    names = bins.select("bin_id", bin_label(F.col("chrom"), F.col("start"), F.col("end")).alias("label"))
    called.write.parquet(f"{a.output}/calls.parquet")
    called = spark.read.parquet(f"{a.output}/calls.parquet")
    shown, order = called, steps["clusters"]
    if a.cell_nodes:
        named = lambda df: df.join(files.cell_nodes(spark, a.cell_nodes), "cell", "left").withColumn("cell", node_name(F.col("node"), F.col("cell"))).drop("node")
        shown, order = named(called), named(order)
    pipeline.write_calls(shown, f"{a.output}/CNV_{a.prefix}.csv", order=order)
    pipeline.write_calls(shown, f"{a.output}/CNV_{a.prefix}.csv.T", transposed=True, order=order)
    names.orderBy("bin_id").write.csv(f"{a.output}/bins.csv", header=True)
    return called


def main() -> None:
    session = SparkSession.builder.appName("genoframe").getOrCreate()
    run(session)
    session.stop()


if __name__ == "__main__":
    main()
