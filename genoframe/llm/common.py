"""What the operators share: words, intermediate tables and joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from genoframe.session import Scratch  # noqa: F401

#: A word: a run of characters that are not ASCII white space. The same pattern works in Java, Python and RE2.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of Arrow data that ``map_texts`` works on at once, about; a single longer row is one piece.
PIECE = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(df: DataFrame, inputs: list[str | Column], make: Callable, schema: str, keep: list[str] = ()) -> DataFrame:
    """``keep`` columns of ``df`` and those of ``schema``, which ``make`` fills for a batch of rows.

    ``make`` gets a list of values for each of ``inputs`` and returns a list for each new column; one that returns a
    list of row numbers first makes any number of rows out of a row. Kept columns never leave Arrow: ids stay what
    they are, whatever their type and beside nulls.
    """
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.struct(*[F.col(c) if isinstance(c, str) else c for c in inputs]).alias("in"))
    new = StructType.fromDDL(schema)
    types, width = to_arrow_schema(new).types, len(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, step) for b in batches for step in [max(1, b.num_rows * PIECE // max(1, b.nbytes))] for i in range(0, b.num_rows, step)):
            made = make(*[x.to_pylist() for x in b.columns[-1].flatten()])
            kept = list(b.columns[:-1])
            if len(made) > width:
                rows = pa.array(made[0], pa.int64())
                kept, made = [x.take(rows) for x in kept], made[1:]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(x, t) for x, t in zip(made, types, strict=True)]], names=[*keep, *new.names])

    return source.mapInArrow(run, StructType([*[df.schema[c] for c in keep], *new.fields]))


def join_small(left: DataFrame, right: DataFrame, on, how: str, limit: int = 100_000) -> DataFrame:
    """Join with a table that is usually small: broadcast below ``limit`` rows (counted), shuffled from there on.

    ``right`` should have been saved, as it is read twice. Its rows must be of bounded width.
    """
    return left.join(F.broadcast(right) if right.limit(limit).count() < limit else right, on, how)


def join_hot(left: DataFrame, right: DataFrame, key: str, hot_share: float = 1e-3) -> DataFrame:
    """Inner join on ``key``, unique in ``right`` and perhaps very frequent in ``left``.

    ``right`` carries ``uses``, the number of rows of ``left`` with its key. Keys that hold over ``hot_share``
    of those rows are at most 1/hot_share many: they are broadcast, and their rows of ``left`` never meet in a
    task. The rest is shuffled, where no key is frequent any more.
    """
    total = right.agg(F.sum("uses")).first()[0] or 0
    bar = max(1000, int(total * hot_share))
    hot, cold = right.where(F.col("uses") > bar).drop("uses"), right.where(F.col("uses") <= bar).drop("uses")
    by_map = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return by_map.unionByName(rest.join(cold, key))


def save_lean(scratch: Scratch, df: DataFrame) -> DataFrame:
    """``scratch.save``, after which the shuffle files of the write are deleted at once: the table is read instead."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = scratch.spark.conf.get(setting)
    scratch.spark.conf.set(setting, "true")
    try:
        return scratch.save(df)
    finally:
        scratch.spark.conf.set(setting, before)


def key64(*cols: Column | str) -> Column:
    return F.xxhash64(*cols)


def join_salted(left: DataFrame, right: DataFrame, key: str, spread: Column, per: int = 1000) -> DataFrame:
    """Inner join on ``key`` with rows of any width, unique in ``right`` and perhaps very frequent in ``left``.

    ``right`` carries ``uses`` as in ``join_hot`` and should have been saved. A key with many uses gets a salt for
    each ``per`` of them, by a hash of ``spread``: its row is copied that often and nothing wide is broadcast. The
    salts of hot keys are (at most 1000 keys are hot).
    """
    total = right.agg(F.sum("uses")).first()[0] or 0
    salts = F.ceil(F.col("uses") / per).cast("int")
    hot = right.where(F.col("uses") > max(per, total // 1000)).select(key, salts.alias("_salts"))
    salted = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    copies = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts", "uses")
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components: ``edges`` (a, b) to (node, root), root being the least node of its component.

    Alternates large-star and small-star steps until no edge changes: the number of rounds grows with the
    logarithm of the number of nodes, and each round shuffles the edges alone, aggregating before it shuffles. The
    neighbours of a node that is the root of very many never meet in a task: see ``join_hot``.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        pairs = both(now)
        least = scratch.save(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("uses")).select("u", F.least("u", "m").alias("m"), "uses"))
        large = join_hot(pairs.where("v > u"), least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = scratch.save(large.where("a <> b").distinct().withColumnRenamed("a", "u").withColumnRenamed("b", "v"))
        low = scratch.save(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("uses")))
        small = join_hot(down, low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        after = scratch.save(small.where("a <> b").distinct())
        for old in (now, least, down, low):
            scratch.drop(old)
        now = after
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (was := state) == (state := tuple(row)):
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
