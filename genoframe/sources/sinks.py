"""Writers of what the pipeline leaves between its steps. Tables are written long, as Parquet; matrices as text besides.

A line of a matrix is put together from the values of its row, sorted by their columns' places: no column of a table for
each cell or bin, so there may be any number of them. What a line and a task hold grows with the number of columns, as
the file's lines do; the names of the columns pass through the driver, as they are the first line of each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.operators import qc


def quoted(text: Column, sep: str) -> Column:
    """A text as a field: in quotes if it has the separator, a quote or a line end."""
    inner = F.replace(text, F.lit('"'), F.lit('\\"'))
    return F.when(text.rlike(f'["{sep}\\r\\n]'), F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(text)


def write_wide(values: DataFrame, row: str, column: str, value: str, path: str, rows: DataFrame, lead: list[str], by: list[str], columns: DataFrame, sep: str = ",") -> None:
    """Lines of ``rows`` in the order ``by``: its ``lead`` columns, then a value for each of ``columns``, in that order.

    ``columns`` is sorted and has one column, named as ``column``; a value that is missing or null is an empty field. A
    table without values leaves no lines.
    """
    spark = values.sparkSession
    keys = columns.select(F.col(column), quoted(F.col(column).cast("string"), sep).alias("_title")).collect()
    header, n = sep.join([*lead, *[k["_title"] for k in keys]]), len(keys)
    places = spark.createDataFrame([(k[column], at) for at, k in enumerate(keys)], f"`{column}` {values.schema[column].dataType.simpleString()}, _place int")
    each = F.struct(F.col("_place"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("v"))
    cells = values.join(places, column).groupBy(row).agg(F.array_sort(F.collect_list(each)).alias("_cells"))
    gap = lambda n: F.repeat(F.lit(sep), n)
    fields = F.transform("_cells", lambda x, i: F.concat(gap(x["_place"] - F.when(i == 0, 0).otherwise(F.get("_cells", i - 1)["_place"])), x["v"]))
    line = F.concat(F.array_join(fields, ""), gap(F.lit(n - 1) - F.get("_cells", F.size("_cells") - 1)["_place"]))
    front = [F.concat(F.coalesce(quoted(F.col(c).cast("string"), sep), F.lit("")), F.lit(sep)) for c in lead]
    lines = rows.join(cells, row, "left").orderBy(*by).select(F.concat(*front, F.coalesce(line, F.lit(sep * (n - 1)))).alias("value"))

    def titled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            if first and b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([header], b.schema.types[0])], schema=b.schema)
                first = False
            yield b

    lines.mapInArrow(titled, "value string").write.text(path)


def keys(values: DataFrame, column: str) -> DataFrame:
    return values.select(column).distinct().orderBy(column)


def write_raw_counts(counts: DataFrame, path: str, as_text: bool = False) -> None:
    """cell, bin_id, n of all cells and bins; as text a row a bin and a column a cell."""
    if as_text:
        write_wide(counts, "bin_id", "cell", "n", path, counts.select("bin_id").distinct(), [], ["bin_id"], keys(counts, "cell"))
    else:
        counts.write.parquet(path)


def write_sample_metrics(reads: DataFrame, path: str) -> None:
    qc.sample_metrics(reads).orderBy("cell").write.csv(path, header=True)


def write_coverage(counts: DataFrame, bins: DataFrame, path: str) -> None:
    """The tab-separated table that ``files.coverage`` reads: the bins that have counts, and a column a cell."""
    kept = bins.select("bin_id", "chrom", "start", "end").join(counts.select("bin_id").distinct(), "bin_id")
    write_wide(counts, "bin_id", "cell", "n", path, kept, ["chrom", "start", "end"], ["bin_id"], keys(counts, "cell"), "\t")


def write_corrected(values: DataFrame, path: str, as_text: bool = False) -> None:
    """cell, bin_id, value; as text a row a cell and a column a bin."""
    if as_text:
        write_wide(values, "cell", "bin_id", "value", path, values.select("cell").distinct(), ["cell"], ["cell"], keys(values, "bin_id"))
    else:
        values.write.parquet(path)
