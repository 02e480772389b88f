"""Readers of the pipeline's files. All schemas are given; no file is read by position except where it has no key."""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Iterator
from functools import reduce
from itertools import batched
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.functions.scalar import chrom_number, sample_name

READS = "cell string, chrom string, start bigint, end bigint, mapq int, flag int, query_length int"


def chrom_sizes(spark: SparkSession, fasta: str) -> DataFrame:
    """chrom, length of a FASTA file: each sequence is a row of text, from one header to the next.

    Files may be of any size; a single sequence has to stay well under 2 GiB, the limit of a value. Of a FASTA index
    (``.fai``), which has a line a sequence, the first two columns are the answer.
    """
    if fasta.endswith(".fai"):
        return spark.read.csv(fasta, sep="\t", schema="chrom string, length bigint")
    rows = spark.read.text(fasta, lineSep="\n>")
    head = F.rtrim(F.substring_index("value", "\n", 1), F.lit("\r"))
    letters = F.replace(F.replace("value", F.lit("\n")), F.lit("\r"))
    named = rows.select(F.regexp_extract(head, r"^>?\s*(\S+)", 1).alias("chrom"), (F.octet_length(letters) - F.octet_length(F.replace(head, F.lit("\r")))).cast("bigint").alias("length"))
    return named.where("chrom <> ''")


def gc_table(spark: SparkSession, path: str, fraction: bool = False) -> DataFrame:
    """chrom, start, end, gc in percent, or as a fraction of 1."""
    table = spark.read.csv(path, sep=" ", schema="chrom string, start bigint, end bigint, gc double")
    return table.withColumn("gc", F.col("gc") / 100) if fraction else table


def bins_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="chrom string, start bigint, end bigint, bin_id int")


def mappability(spark: SparkSession, path: str, bins: DataFrame) -> DataFrame:
    """bin_id, mapp. The file has a number a line in the order of bins; the n-th line is bin n."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\s+"), lambda x: x != "")).alias("bin_id", "v"))
    return lines.select("bin_id", F.col("v").cast("double").alias("mapp")).join(bins.select("bin_id"), "bin_id")


def mask(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", schema="chrom string, start bigint, end bigint, a string, b string, c string")
    return raw.select("chrom", (F.col("start") + 1).alias("start"), "end")


def normal_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="cell string").distinct()


def cell_nodes(spark: SparkSession, path: str) -> DataFrame:
    """cell, node; of several nodes of a cell the greatest counts."""
    return spark.read.csv(path, sep="\t", schema="cell string, node string").groupBy("cell").agg(F.max("node").alias("node"))


def bias_file(spark: SparkSession, path: str) -> DataFrame:
    words = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    return spark.read.text(path, wholetext=True).select(F.posexplode(words).alias("bin_id", "v")).select("bin_id", F.col("v").cast("double").alias("bias"))


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """Long counts (chrom, start, end, cell, n) of a tab-separated table with a column a cell."""
    wide = spark.read.csv(path, sep="\t", header=True, maxColumns=1 << 20)
    cells = wide.columns[3:]
    typed = wide.select(F.col(wide.columns[0]).alias("chrom"), F.col(wide.columns[1]).cast("bigint").alias("start"), F.col(wide.columns[2]).cast("bigint").alias("end"), *[F.col(f"`{c}`").cast("bigint").alias(c) for c in cells])
    return typed.unpivot(["chrom", "start", "end"], cells, "cell", "n")


def parse_bam(file: BinaryIO) -> Iterator[tuple]:
    """(chrom, start, end, mapq, flag, query_length) of each record of a BAM file, unpacked piece by piece."""
    raw = io.BufferedReader(gzip.GzipFile(fileobj=file), 1 << 20)
    number = lambda: struct.unpack("<i", raw.read(4))[0]
    raw.read(4)
    raw.read(number())
    names = []
    for _ in range(number()):
        names.append(raw.read(number())[:-1].decode())
        raw.read(4)
    while len(head := raw.read(4)) == 4:
        record = raw.read(*struct.unpack("<i", head))
        ref, pos, name, mapq, _, ops, flag, length = struct.unpack_from("<iiBBHHHi", record)
        cigar = struct.unpack_from(f"<{ops}I", record, 32 + name)
        spans = sum(c >> 4 for c in cigar if c & 15 in (0, 2, 3, 7, 8)) or 1
        yield names[ref] if ref >= 0 else None, pos, pos + spans, mapq, flag, length


def bam_reads(spark: SparkSession, *paths: str, pattern: str = "*.bam") -> DataFrame:
    """Reads of BAM files without splits: one file is one task's work. For compressed data of any size see ``bam``.

    A task holds one packed file and 50,000 of its reads. A file has to stay under 2 GiB, the limit of a value.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for cell, content in zip(b["cell"], b["content"], strict=True):
                for reads in batched(parse_bam(io.BytesIO(content)), 50_000):
                    out = pd.DataFrame(reads, columns=["chrom", "start", "end", "mapq", "flag", "query_length"])
                    out.insert(0, "cell", cell)
                    yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(list(paths))
    named = files.select(sample_name(F.col("path")).alias("cell"), "content", "path").where("cell <> 'all'")
    twice = named.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two files are named {twice[0]['cell']}")
    return named.select("cell", "content").mapInPandas(run, READS)


def grouped_reads(**groups: DataFrame) -> DataFrame:
    """Reads of several groups of samples, such as tumour and control, as one table with a column ``group``."""
    tables = [reads.withColumn("group", F.lit(name)) for name, reads in groups.items()]
    return reduce(DataFrame.unionByName, tables)


def bin_annotations(bins: DataFrame, gc: DataFrame, mapp: DataFrame) -> DataFrame:
    """``bins`` with gc and mapp. The three have to describe the same bins: a missing or an extra one is an error."""
    both = bins.join(gc.select("chrom", "start", "end", "gc"), ["chrom", "start", "end"], "full").join(mapp.select("bin_id", "mapp"), "bin_id", "full")
    whole = F.col("bin_id").isNotNull() & F.col("chrom").isNotNull() & F.col("gc").isNotNull() & F.col("mapp").isNotNull()
    return both.select("bin_id", "chrom", "start", "end", "gc", F.when(whole, F.col("mapp")).otherwise(F.raise_error(F.lit("bins, gc and mappability describe different bins"))).alias("mapp"))


def natural_order(df: DataFrame) -> DataFrame:
    return df.orderBy(chrom_number(F.col("chrom")), "start")
