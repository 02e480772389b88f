"""Operator 3: mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Every document of a source waits in an order shuffled by a hash. Its virtual finish time is the number of source
words up to its end, divided by the source's target; a further pass over the source continues the count. All
passes of all sources are then put in the order of their finish times and cut where the words reach the budget: of
the document at the cut the mix takes the words that are left (``mix_plan`` with ``split_last``), or none.

Nothing but (doc_id, source, size) is shuffled: of each source and pass the mix takes a beginning of the queue, so
``mix`` finds the documents themselves by the last place taken, a row a source. Cumulative sums are two-level: sums of hash or time buckets, whose
number follows the number of documents, then a sum inside one bucket; so no source meets in a task, however large.

Defined cases: a null or empty text, or one of white space only, has size 0 and takes nothing; null sources form
one source that comes last; rows that repeat a doc_id count as documents of their own (ordered by size); a very long
text is counted whole and is one document, so its source may miss its target by its size in ``mix``, which takes whole
documents; finish times that tie go by the hash of doc_id, then size; an empty table gives an empty mix; other columns
are ignored, whatever their names, and passed through by ``mix``. The result is the same at every run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from genoframe.llm.common import WORD, Scratch, join_small, table


def targets(sources: DataFrame, weights: Sequence[float], most: int) -> DataFrame:
    """``sources`` (skey, source, source_size) with ``target``, in words.

    Sources in code point order, null last, get the weights in turn; the total of all sizes is shared by weight;
    no target exceeds ``most`` times its source's size, and what that leaves is shared again by weight.
    """
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", "skey")
    filled = (
        sources.withColumn("weight", w)
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "skey", "level"))).over(everything)["level"])
    )
    return filled.select("skey", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def row_hash(docs: DataFrame) -> Column:
    """Equal for rows that are copies in all columns but nested ones."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if isinstance(f.dataType, AtomicType)])


def source_key(docs: DataFrame) -> Column:
    return F.coalesce(F.concat(F.lit("="), docs["source"]), F.lit(""))


def queue_key(docs: DataFrame) -> Column:
    return F.md5(F.coalesce(docs["doc_id"].cast("string"), F.lit("null")).cast("binary"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def queue(docs: DataFrame, weights: Sequence[float], most: int, by_row: bool = False) -> tuple[DataFrame, list[Column], Column]:
    """The saved queue; of each pass, whether the mix takes a document of it whole; the words of the one at the cut.

    ``by_row`` adds ``h``, the hash of the row, which orders rows of equal doc_id and size.
    """
    h = ["h"] if by_row else []
    scratch = Scratch(docs.sparkSession)
    sized = scratch.save(
        docs.select(
            "doc_id",
            "source",
            source_key(docs).alias("skey"),
            n_words(docs["text"]).alias("size"),
            queue_key(docs).alias("k"),
            *[row_hash(docs).alias(c) for c in h],
        )
    )
    count, budget = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(256, count // 5000)
    spot = F.conv(F.substring("k", 1, 8), 16, 10).cast("long")
    sized = sized.withColumn("bucket", F.floor(spot * F.lit(buckets) / F.lit(2**32)))

    by_bucket = sized.groupBy("skey", "source", "bucket").agg(F.sum("size").alias("in_bucket"))
    offsets = by_bucket.withColumn("before", F.sum("in_bucket").over(Window.partitionBy("skey").orderBy("bucket")) - F.col("in_bucket"))
    sources = scratch.save(targets(by_bucket.groupBy("skey", "source").agg(F.sum("in_bucket").alias("source_size")), weights, most))
    offsets = join_small(offsets.select("skey", "bucket", "before"), sources, "skey", "inner")

    # Equal rows are one row with a count, and rows of equal hash and size (one doc_id, or none) a group of their own, so
    # a doc_id that very many rows share is not one task's work: it has as many groups as sizes.
    group = ["skey", "bucket", "k", "size"]
    inside = Window.partitionBy(*group).orderBy(F.col("doc_id").cast("string"), *h).rowsBetween(Window.unboundedPreceding, 0)
    equal = sized.groupBy(*group, "doc_id", *h).agg(F.count("*").alias("n")).withColumn("first", F.col("size") * (F.sum("n").over(inside) - F.col("n")))
    groups = sized.groupBy(*group).agg(F.sum("size").alias("words")).join(offsets, ["skey", "bucket"])
    ahead = F.sum("words").over(Window.partitionBy("skey", "bucket").orderBy("k", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    groups = groups.select(*group, "source_size", "target", (F.col("before") + ahead).alias("at"))
    queued = scratch.save(
        equal.join(groups, group)
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
        .select("skey", "doc_id", "k", "size", "source_size", "target", (F.col("at") + F.col("first") + F.col("i") * F.col("size")).alias("end"), *h)
    )

    # A pass of a document competes if it starts before its source has met its target: those passes hold the budget.
    passes = (
        queued.where("size > 0 AND target > 0")
        .select("k", "size", "target", F.col("end"), "source_size", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("turn"))
        .withColumn("done", F.col("turn") * F.col("source_size") + F.col("end"))
        .where(F.col("done") - F.col("size") < F.col("target"))
        .select("k", "size", "turn", (F.col("done") / F.col("target")).alias("finish"))
        .withColumn("slot", F.least(F.floor(F.col("finish") * buckets), F.lit(buckets)))
    )
    slots = passes.groupBy("slot").agg(F.sum("size").alias("words"))
    slots = slots.withColumn("upto", F.sum("words").over(Window.orderBy("slot")))
    full = slots.where(F.col("upto") > budget).agg(F.min("slot"), F.min_by(F.col("upto") - F.col("words"), "slot")).first()
    last = part = None
    if full[0] is not None:  # the cut lies in one slot, whose rows are few as slots follow the number of documents
        rank_names = ["finish", "k", "size", "turn"]
        rank = F.struct(*rank_names)
        here = passes.where(F.col("slot") == full[0]).withColumn("upto", F.lit(full[1]) + F.sum("size").over(Window.orderBy(*rank_names).rowsBetween(Window.unboundedPreceding, 0)))
        last, part = here.agg(F.max(F.when(F.col("upto") <= budget, rank)), F.min(F.when(F.col("upto") > budget, F.struct(*rank_names, (F.lit(budget) - F.col("upto") + F.col("size")).alias("words"))))).first()
    rest = F.lit(0).cast("long")
    if part is not None and part["words"] > 0:
        cut = (F.col("k") == part["k"]) & (F.col("size") == part["size"]) & (F.try_divide(F.lit(part["turn"]) * F.col("source_size") + F.col("end"), F.col("target")) == F.lit(part["finish"]))
        rest = F.when(F.coalesce(cut, F.lit(False)), F.lit(part["words"])).otherwise(F.lit(0)).cast("long")
    takes = []
    for turn in range(most):
        finish = F.try_divide(F.lit(turn) * F.col("source_size") + F.col("end"), F.col("target"))
        runs = F.lit(turn) * F.col("source_size") + F.col("end") - F.col("size") < F.col("target")
        if full[0] is not None:
            slot = F.least(F.floor(finish * buckets), F.lit(buckets))
            up_to = F.lit(False) if last is None else F.struct(finish.alias("finish"), F.col("k"), F.col("size"), F.lit(turn).alias("turn")) <= F.struct(F.lit(last[0]), F.lit(last[1]), F.lit(last[2]).cast("long"), F.lit(last[3]))
            runs = runs & ((slot < full[0]) | ((slot == full[0]) & up_to))
        takes.append(runs & (F.col("size") > 0) & (F.col("target") > 0))
    return queued, takes, rest


def mix_plan(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), most: int = 3, split_last: bool = False) -> DataFrame:
    """doc_id, size, source_size, target and ``taken``, the words that the mix takes of each document.

    ``split_last`` takes a part of the document at the cut, so that the mix is as long as its budget and a source of
    one or two documents comes near its target too.
    """
    queued, takes, taken = queue(docs, weights, most)
    if not split_last:
        taken = F.lit(0).cast("long")
    for take in takes:
        taken = taken + F.when(take, F.col("size")).otherwise(0)
    return queued.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), most: int = 3) -> DataFrame:
    """The mixed documents themselves, with the columns of ``docs``: each row as often as the mix takes it.

    A row is taken in a pass if its place in the queue is not after the last one taken of its source in that pass. Where
    that place is shared by copies of which only some are taken, one of them stands for all.
    """
    scratch = Scratch(docs.sparkSession)
    queued, takes, _ = queue(docs, weights, most, by_row=True)
    name = lambda i: F.coalesce(F.concat(F.lit("="), i.cast("string")), F.lit(""))
    place = ["k", "size", "id", "h"]
    queued = queued.withColumn("id", name(F.col("doc_id")))
    turns = range(most)
    cuts = scratch.save(queued.groupBy("skey").agg(*[F.max(F.when(t, F.struct(*place))).alias(f"cut{i}") for i, t in enumerate(takes)]))
    at_cut = F.lit(False)
    for i in turns:
        at_cut = at_cut | F.coalesce(F.struct(*place) == F.col(f"cut{i}"), F.lit(False))
    counts = [F.count_if(t).alias(f"n{i}") for i, t in enumerate(takes)]
    at_cut = join_small(queued, cuts, "skey", "inner").where(at_cut).groupBy("skey", "k", "id", "h").agg(F.count("*").alias("copies"), *counts)
    parted = F.lit(False)
    for i in turns:
        parted = parted | F.col(f"n{i}").between(1, F.col("copies") - 1)
    total = sum((F.col(f"n{i}") for i in turns), F.lit(0)).cast("int")
    shared = scratch.save(at_cut.where(parted).select("skey", "k", "id", "h", total.alias("total")))

    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, source_key(docs).alias("skey"), queue_key(docs).alias("k"), name(docs["doc_id"]).alias("id"), row_hash(docs).alias("h"))
    text = F.col("row")["text"]

    def upto(i: int) -> Column:
        """Words are counted again only where the keys are equal."""
        cut = F.col(f"cut{i}")
        equal = F.struct(n_words(text).alias("size"), "id", "h") <= F.struct(cut["size"].alias("size"), cut["id"].alias("id"), cut["h"].alias("h"))
        return F.when(F.col("k") < cut["k"], 1).when(F.col("k") == cut["k"], equal.cast("int")).otherwise(0)

    times = F.when(F.regexp_like(text, F.lit(WORD)), sum((upto(i) for i in turns), F.lit(0))).otherwise(0)
    if some := shared.limit(1).count():
        rows = join_small(rows, shared, ["skey", "k", "id", "h"], "left")
    found = join_small(rows.where("total IS NULL").drop("total") if some else rows, cuts, "skey", "inner").select("row", times.alias("times"))
    if some:
        one = rows.where("total IS NOT NULL").groupBy("skey", "k", "id", "h").agg(F.first("row").alias("row"), F.first("total").alias("times"))
        found = found.unionByName(one.select("row", "times"))
    return found.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*")


def op3(spark, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"), split_last=True)


SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, 'null')) AS k,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
  3.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
v AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
  sum(weight) OVER (ORDER BY ratio, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, total, least(cap, weight * (arg_min(level, ratio) FILTER (WHERE ratio >= level) OVER ())) AS target FROM v),
q AS (SELECT d.*, source_size, target, total, sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS UNBOUNDED PRECEDING) AS done
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT doc_id, k, size, total, turn, (turn * source_size + done) / target AS finish
  FROM q, (SELECT unnest([0, 1, 2]) AS turn) WHERE size > 0 AND target > 0 AND turn * source_size + done - size < target),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, k, size, turn ROWS UNBOUNDED PRECEDING) AS upto FROM p),
g AS (SELECT doc_id, sum(least(size, total - upto + size))::BIGINT AS taken FROM c WHERE upto - size < total GROUP BY doc_id)
SELECT q.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM q LEFT JOIN g ON q.doc_id IS NOT DISTINCT FROM g.doc_id
"""
