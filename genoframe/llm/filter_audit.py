"""Operator 13: how filters interact in every order, with wide packed counters.

A document's *mask* says which of the filters it fails. What happens to it in each of the orders and at each of their
steps follows from the mask alone: it is kept, removed here, or was removed before. ``Outcomes`` writes that for every
mask into big integers with a field of 64 bits for each (order, step), all 600 of them with five filters; one integer
for the documents kept, one for those removed and so on. Adding up documents is adding up integers: 600 counters move
at once. A field is as wide as Spark's own long counts, so no sum of documents carries into the next field, and a
sum's bytes are the counts.

Each task adds up its documents by part; its sums are a few kilobytes a part, which are added again in two steps, by
(part, salt) and by part, so that a part that holds most documents is no task's work alone. Rows cross a shuffle as
(doc_id, digest of the text) before that, to find texts that an earlier document has: equal rows are counted, the least
id of a text comes from partial aggregates, and it is matched on digest and id together, so that a group of copies
spreads over tasks.

Defined cases: null texts are empty; a null doc_id is smaller or greater than no id, so such a document neither is nor
has an earlier copy, and it has no labels; rows that repeat a doc_id are documents of their own, of equal ids none is
earlier; of a doc_id's labels one with 1 is enough; null parts are the empty string; very long texts are split into
words whole, in one row; an empty table gives no rows; other columns of the documents are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.llm.common import WORD, Scratch, table

FILTERS = "ABCDE"
KINDS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
SALTS = 64

#: Parts that a task holds sums of; at more it hands on what it has.
PARTS = 500


class Outcomes:
    """The fields of every (order, step) for a mask; bit k of a mask is filter k."""

    def __init__(self, filters: str):
        self.filters, self.orders = filters, ["".join(p) for p in permutations(filters)]
        self.steps = len(self.orders) * len(filters)
        self.masks = [self.of(mask) for mask in range(2 ** len(filters))]

    def of(self, mask: int) -> tuple[int, int, int, int]:
        """Packed: kept, removed, redundant, unique_fails of one document with this mask."""
        fields = np.zeros((4, self.steps), "<u8")
        for n, order in enumerate(self.orders):
            gone = False
            for k, f in enumerate(order):
                bit, at = 1 << self.filters.index(f), n * len(order) + k
                fails = bool(mask & bit)
                fields[:, at] = not (gone or fails), fails and not gone, fails and gone, mask == bit
                gone |= fails
        return tuple(int.from_bytes(x.tobytes(), "little") for x in fields)

    def add(self, sums: list[int], mask: int, good: bool, toxic: bool, n: int) -> None:
        """Add n documents to the integers of KINDS."""
        kept, removed, redundant, alone = self.masks[mask]
        for at, x in enumerate((kept, removed, redundant, alone, good and removed, toxic and removed)):
            if x:
                sums[at] += x * n

    def pack(self, sums: list[int]) -> list[bytes]:
        return [x.to_bytes(8 * self.steps, "little") for x in sums]

    def unpack(self, packed: list[bytes]) -> dict[str, list[int]]:
        """Counts by kind, in the order of (order, step)."""
        return {kind: np.frombuffer(x, "<u8").astype("i8").tolist() for kind, x in zip(KINDS, packed, strict=True)}


@lru_cache(maxsize=4)
def outcomes(filters: str) -> Outcomes:
    return Outcomes(filters)


#: The query's filters but E, by letter, over ``words`` and ``text``; E, an earlier copy, needs the whole table.
CONDITIONS = {
    "A": "size(_words) < 200",
    "B": "100L * size(array_distinct(_words)) < 50L * size(_words)",
    "C": "100L * regexp_count(_t, '[A-Z]') > 3L * length(_t)",
    "D": "_t rlike '[#$%&*|]'",
}


def masks(docs: DataFrame, labels: DataFrame, scratch: Scratch, part: str = "lang") -> DataFrame:
    """_part, _mask, _good, _toxic, _n: n documents have these values. A row is at most as many documents as are equal."""
    text = docs.select(F.col("doc_id").alias("_doc"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("_part"), F.coalesce("text", F.lit("")).alias("_t"))
    words = text.withColumn("_words", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    mask = sum((F.when(F.expr(c), 1 << FILTERS.index(f)).otherwise(0) for f, c in CONDITIONS.items()), F.lit(0))
    rows = words.select("_doc", "_part", F.unhex(F.sha2("_t", 256)).alias("_text"), mask.cast("int").alias("_mask"))
    rows = scratch.save(rows.groupBy("_doc", "_part", "_text", "_mask").agg(F.count("*").alias("_n")))
    known = rows.where("_doc is not null")
    first = known.groupBy("_text").agg(F.min("_doc").alias("_doc")).withColumn("_first", F.lit(True))
    by_label = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_doc")).agg((F.max("quality") == 1).alias("_good"), (F.max("toxic") == 1).alias("_toxic"))
    later = F.when(F.col("_first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    known = known.join(first, ["_text", "_doc"], "left").withColumn("_mask", F.col("_mask") + later).join(by_label, "_doc", "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("_good", "_toxic")]
    unknown = rows.where("_doc is null").select("_part", "_mask", F.lit(False).alias("_good"), F.lit(False).alias("_toxic"), "_n")
    return known.select("_part", "_mask", *flags, "_n").unionByName(unknown)


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Rows of ``masks`` to part, filter_order, step, the counts of KINDS, and shapley: a row for each part, order and step."""
    sums = ", ".join(f"{k} binary" for k in KINDS)

    def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        book, held, salt = outcomes(filters), {}, TaskContext.get().partitionId() % SALTS

        def out() -> pa.RecordBatch:
            packed = list(zip(*[book.pack(x) for x in held.values()], strict=True)) or [[]] * len(KINDS)
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([salt] * len(held), pa.int32()), *[pa.array(x, pa.binary()) for x in packed]], names=["part", "salt", *KINDS])

        for b in batches:
            for part, mask, good, toxic, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if part not in held:
                    if len(held) >= PARTS:
                        yield out()
                        held.clear()
                    held[part] = [0] * len(KINDS)
                book.add(held[part], mask, good, toxic, n)
        yield out()

    def added(t: pa.Table) -> list[bytes]:
        book = outcomes(filters)
        return book.pack([sum(int.from_bytes(x, "little") for x in t[k].to_pylist()) for k in KINDS])

    def by_salt(t: pa.Table) -> pa.Table:
        return pa.table({"part": t["part"].slice(0, 1), **{k: pa.array([x], pa.binary()) for k, x in zip(KINDS, added(t), strict=True)}})

    def by_part(t: pa.Table) -> pa.Table:
        book = outcomes(filters)
        counts, share = book.unpack(added(t)), dict.fromkeys(filters, 0)
        at = [(order, k) for order in book.orders for k in range(len(order))]
        for (order, k), n in zip(at, counts["removed"], strict=True):
            share[order[k]] += n
        columns = {"part": [t["part"][0].as_py()] * len(at), "filter_order": [o for o, _ in at], "step": pa.array([k + 1 for _, k in at], pa.int32()), **counts, "shapley": [share[o[k]] for o, k in at]}
        return pa.table(columns)

    tasks = counted.select("_part", "_mask", "_good", "_toxic", "_n").mapInArrow(by_task, f"part string, salt int, {sums}")
    salted = tasks.groupBy("part", "salt").applyInArrow(by_salt, f"part string, {sums}")
    return salted.groupBy("part").applyInArrow(by_part, "part string, filter_order string, step int, " + ", ".join(f"{k} long" for k in [*KINDS, "shapley"]))


def op13(spark, sf_dir: str) -> DataFrame:
    return audit(masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark)))


SQL = r"""
with texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
known as (select doc_id, max(quality) = 1 as good, max(toxic) = 1 as toxic from labels where doc_id is not null group by doc_id),
masked as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    case when len(w) < 200 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end
    + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 4 else 0 end + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
    + case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end as mask
    from texts left join known using (doc_id)),
counted as (select part, mask, good, toxic, count(*) as n from masked group by all),
f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as v(f, bit)),
orders as (select a.f || b.f || c.f || d.f || e.f as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
    from f a, f b, f c, f d, f e where (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps as (select filter_order, k as step, bits[k] as bit, coalesce(list_sum(bits[1:k-1]), 0)::int as before from orders, range(1, 6) as r(k)),
outcomes as (select part, filter_order, step, bit,
    sum(case when mask & (before | bit) = 0 then n else 0 end) as kept,
    sum(case when mask & bit > 0 and mask & before = 0 then n else 0 end) as removed,
    sum(case when mask & bit > 0 and mask & before > 0 then n else 0 end) as redundant,
    sum(case when mask = bit then n else 0 end) as unique_fails,
    sum(case when mask & bit > 0 and mask & before = 0 and good then n else 0 end) as good_lost,
    sum(case when mask & bit > 0 and mask & before = 0 and toxic then n else 0 end) as toxic_lost
    from counted, steps group by all)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
    good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from outcomes
"""
