"""Incremental read counts: an extension, as counting is the part of the pipeline that adds up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from genoframe.operators import intervals


def streaming_counts(reads: DataFrame, bins: DataFrame, size: int, mask: DataFrame | None = None) -> DataFrame:
    """cell, bin_id, n over a stream of reads, for output mode update or complete; ``bins`` and ``mask`` are static.

    A mask has to be a small table here: it is joined to every micro-batch.
    """
    return intervals.overlap_counts(intervals.drop_masked(reads, mask) if mask is not None else reads, bins, size)


def count_stream(spark: SparkSession, path: str, schema, bins: DataFrame, size: int, checkpoint: str, name: str) -> DataFrame:
    """Run a file stream of reads to its end and return the counts."""
    counts = streaming_counts(spark.readStream.schema(schema).parquet(path), bins, size)
    query = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
