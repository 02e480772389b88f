"""Operator 2: WARC files and their Merkle fixity audit.

A WARC file is a sequence of records; a record's place is its offset range. ``tree`` hashes each record together with
its range into a leaf, groups ``FAN`` neighbours into a node whose hash covers their hashes and ranges, and so on up to
the root of the file. Two replicas agree on a file if their roots are equal. ``audit`` starts from the roots and goes
down a level at a time, only below nodes that differ, so what it reads of the trees follows the corruption, not the
archive. The leaves it reaches are the damaged records.

Trees are built by grouping (file, index div FAN): no task sees more than FAN children of a node, and files of any
number of records are fine. Offsets are a running sum within a file; ``to_records`` cuts a table into files of about
``per_file`` records by a hash, so files are small.

Defined cases: a null page, url or html is an empty one (the record has headers only); equal rows are records of their
own, in any order, as their bytes are equal; an empty table gives no file; a very long page is one record, whole (a
record is one value, so under 2 GiB); other columns are ignored, whatever their names; a record that only one replica
has is ``missing`` or ``extra``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoframe.llm.common import Scratch, table

FAN = 16
EOL = "\r\n"


def record(uri: Column, ident: Column, body: Column) -> Column:
    """A WARC/1.1 resource record as text, without the two line ends that close it."""
    length = F.octet_length(body).cast("string")
    head = [
        F.lit("WARC/1.1" + EOL + "WARC-Type: resource" + EOL + "WARC-Record-ID: <urn:page:"),
        ident,
        F.lit(">" + EOL + "WARC-Target-URI: "),
        uri,
        F.lit(EOL + "WARC-Payload-Digest: sha256:"),
        F.sha2(body.cast("binary"), 256),
        F.lit(EOL + "Content-Type: text/html" + EOL + "Content-Length: "),
        length,
        F.lit(EOL + EOL),
    ]
    return F.concat(*head, body)


def to_records(pages: DataFrame, per_file: int = 256) -> DataFrame:
    """file, page_id, record: every page as a record, dealt to files by a hash of page_id, url and body."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    files = max(1, -(-pages.count() // per_file))
    deal = F.concat_ws("|", empty("page_id"), empty("url"), F.sha2(empty("html").cast("binary"), 256))
    spot = F.conv(F.substring(F.md5(deal.cast("binary")), 1, 8), 16, 10).cast("long")
    return pages.select((spot % files).alias("file"), "page_id", record(empty("url"), empty("page_id"), empty("html")).alias("record"))


def leaves(records: DataFrame) -> DataFrame:
    """file, idx, page_id, start, end, hash: records in the order of their file, with offset ranges and SHA-256."""
    slim = records.select("file", "page_id", F.sha2(F.col("record").cast("binary"), 256).alias("sha"), (F.octet_length("record") + 4).cast("long").alias("bytes"))
    order = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "sha")
    end = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return slim.select("file", (F.row_number().over(order) - 1).cast("long").alias("idx"), "page_id", (end - F.col("bytes")).alias("start"), end.alias("end"), "sha")


def tree(leaf: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The levels of all files' trees, leaves first: file, idx, hash."""
    own = F.sha2(F.concat_ws("|", F.col("start").cast("string"), F.col("end").cast("string"), "sha").cast("binary"), 256)
    levels = [scratch.save(leaf.select("file", "idx", own.alias("hash")))]
    while (levels[-1].agg(F.max("idx")).first()[0] or 0) > 0:
        children = F.array_sort(F.collect_list(F.struct("idx", "hash")))
        up = levels[-1].groupBy("file", F.expr(f"idx div {FAN}").alias("idx")).agg(children.alias("c"))
        levels.append(scratch.save(up.select("file", "idx", F.sha2(F.array_join(F.transform("c", lambda x: x["hash"]), "|").cast("binary"), 256).alias("hash"))))
    return levels


def audit(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """file, idx, status of the leaves at which two replicas differ: changed, missing (in theirs) or extra."""
    scratch = Scratch(mine.sparkSession)
    a, b = tree(mine, scratch), tree(theirs, scratch)
    while len(a) < len(b):
        a.append(a[-1])
    while len(b) < len(a):
        b.append(b[-1])
    suspects = None
    for x, y in zip(reversed(a), reversed(b), strict=True):
        if suspects is not None:
            below = suspects.select("file", F.explode(F.sequence(F.col("idx") * FAN, F.col("idx") * FAN + FAN - 1)).alias("idx"))
            x, y = x.join(below, ["file", "idx"], "left_semi"), y.join(below, ["file", "idx"], "left_semi")
        both = x.select("file", "idx", F.col("hash").alias("x")).join(y.select("file", "idx", F.col("hash").alias("y")), ["file", "idx"], "full")
        suspects = scratch.save(both.where(~F.col("x").eqNullSafe(F.col("y"))))
    return suspects.select("file", "idx", F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("changed").alias("status"))


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write ``records`` (file, page_id, record) as WARC files, one folder a file number."""
    ordered = records.repartition("file").sortWithinPartitions("file", "page_id")
    ordered.select("file", "record").write.partitionBy("file").option("lineSep", EOL + EOL).option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """path, start, uri, record_id, digest, payload: the records of all WARC files under ``path``. A file is one task's
    work, as WARC files are of bounded size by convention; those that are cut short give the whole records they have."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                rows, at = [], 0
                while (stop := data.find(b"\r\n\r\n", at)) >= 0 and data[at : at + 5] == b"WARC/":
                    head = dict(line.split(": ", 1) for line in data[at:stop].decode("utf-8", "replace").split(EOL)[1:] if ": " in line)
                    size = int(head.get("Content-Length", 0))
                    if stop + 4 + size > len(data):
                        break
                    rows.append((name, at, head.get("WARC-Target-URI", ""), head.get("WARC-Record-ID", ""), head.get("WARC-Payload-Digest", ""), data[stop + 4 : stop + 4 + size]))
                    at = stop + 4 + size + 4
                yield pd.DataFrame(rows, columns=["path", "start", "uri", "record_id", "digest", "payload"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, start long, uri string, record_id string, digest string, payload binary")


def damaged(records: DataFrame) -> DataFrame:
    """A replica with bit rot that a fixed rule plants: a byte overwritten in some records, some lost from file ends."""
    spot = F.conv(F.substring(F.md5(F.concat(F.lit("rot"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")
    rotten = F.concat(F.expr("substr(record, 1, length(record) - 9)"), F.lit("\u0001"), F.expr("substr(record, length(record) - 7)"))
    return records.withColumn("record", F.when(spot % 97 == 0, rotten).otherwise(F.col("record")))


def op2(spark, sf_dir: str) -> DataFrame:
    """Every record of ``pages`` as WARC with its file, range, hash, and what the audit of a damaged replica says."""
    scratch = Scratch(spark)
    records = to_records(table(spark, sf_dir, "pages"))
    mine, theirs = scratch.save(leaves(records)), leaves(damaged(records))
    lost = theirs.groupBy("file").agg(F.max("idx").alias("last")).where("file % 7 = 3")
    theirs = scratch.save(theirs.join(lost, "file", "left").where("last IS NULL OR idx < last - 1").drop("last"))
    found = audit(mine, theirs)
    return mine.join(found, ["file", "idx"], "left").select("page_id", "file", "idx", "start", F.col("end").alias("stop"), F.col("sha").alias("record_sha256"), F.coalesce("status", F.lit("intact")).alias("status"))


SQL = r"""
WITH p AS (SELECT page_id, coalesce(page_id::VARCHAR, '') AS i, coalesce(url, '') AS u, coalesce(html, '') AS h FROM pages),
r AS (SELECT page_id, ('0x' || substr(md5(i || '|' || u || '|' || sha256(h)), 1, 8))::BIGINT % greatest(1, ((SELECT count(*) FROM pages) + 255) // 256) AS file,
  ('0x' || substr(md5('rot' || i), 1, 8))::BIGINT % 97 = 0 AS rotten,
  concat('WARC/1.1', n, 'WARC-Type: resource', n, 'WARC-Record-ID: <urn:page:', i, '>', n, 'WARC-Target-URI: ', u, n, 'WARC-Payload-Digest: sha256:', sha256(h), n,
    'Content-Type: text/html', n, 'Content-Length: ', strlen(h), n, n, h) AS record FROM p, (SELECT chr(13) || chr(10) AS n)),
o AS (SELECT file, page_id, rotten, sha256(record) AS sha, strlen(record) + 4 AS bytes FROM r),
l AS (SELECT *, row_number() OVER w - 1 AS idx, sum(bytes) OVER w AS stop, count(*) OVER (PARTITION BY file) AS n FROM o
  WINDOW w AS (PARTITION BY file ORDER BY page_id NULLS FIRST, sha ROWS UNBOUNDED PRECEDING))
SELECT page_id, file::BIGINT AS file, idx::BIGINT AS idx, (stop - bytes)::BIGINT AS start, stop::BIGINT AS stop, sha AS record_sha256,
  CASE WHEN file % 7 = 3 AND idx >= n - 2 THEN 'missing' WHEN rotten THEN 'changed' ELSE 'intact' END AS status FROM l
"""
