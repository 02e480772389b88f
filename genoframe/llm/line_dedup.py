"""Operator 8: line dedup by winnowing over line hashes. DataFrame functions only.

A document is its list of lines, each hashed. A *gram* starts at a line and takes as many lines as hold ``GRAM``
words at least, so that one long line is a gram by itself. Of the grams that start within ``WINDOW`` words, the least
hash is a fingerprint. Any run of lines with GRAM + WINDOW words that two documents share therefore holds a common
fingerprint. Fingerprints are joined with their first occurrence (least doc_id, then text hash, then position): a
star, never all pairs. Along such an alignment of two documents the lines are compared both ways, and each stretch
of equal lines with GRAM words or more is a repeated run: it is deleted from the later document. Within a document
a fingerprint is aligned with its previous occurrence. What is first is never deleted.

Only hashes and counts of lines are exploded and shuffled; texts are joined once, with the ranges to delete. Hot
fingerprints and hot first documents go through a broadcast of their few keys (see ``join_hot``).

Defined cases: null and empty texts have no lines, and stay as they are; runs under GRAM words stay; a blank line
counts as a line of no words and goes with the run around it; rows with equal doc_id and text are one document (both
keep their lines); equal texts under two ids: the least id keeps them; null doc_ids come first; a document of very
many lines is rows of its own until its lines are compared, as one array; ties between fingerprints go to the earlier
place; an empty table gives an empty one; other columns, whatever their names, are passed through by ``dedup_lines``
(all but ``_n_lines`` and ``_n_deleted``, which it adds and so replaces).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoframe.llm.common import WORD, Scratch, join_hot, join_salted, save_lean, table

GRAM, WINDOW = 25, 25


def _hash(text):
    """60 bits of MD5 as a number, which SQL engines agree on."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _key(df: DataFrame) -> DataFrame:
    """``df`` with ``_d``: a document's place in the order of documents."""
    return df.withColumn("_d", F.struct(F.col("doc_id").alias("id"), _hash(F.coalesce("text", F.lit(""))).alias("th")))


def repeated_runs(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """_d, first, last: the line ranges (from 0) that repeat lines of an earlier document or place."""
    lines = (
        _key(docs.select("doc_id", "text").where("text <> ''"))
        .select("_d", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("_d", "pos", _hash(F.col("line")).alias("h"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("nw"))
        .distinct()
    )
    in_order = Window.partitionBy("_d").orderBy("pos")
    lines = save_lean(scratch, lines.withColumn("at", F.sum("nw").over(in_order) - F.col("nw")))

    by_word = Window.partitionBy("_d").orderBy("at")
    grams = (
        lines.where("nw > 0")
        .withColumn("hs", F.collect_list("h").over(by_word.rangeBetween(0, GRAM - 1)))
        .withColumn("held", F.sum("nw").over(by_word.rangeBetween(0, GRAM - 1)))
        .where(F.col("held") >= GRAM)
        .select("_d", "pos", "at", _hash(F.array_join(F.col("hs").cast("array<string>"), ",")).alias("g"))
    )
    picked = grams.withColumn("least", F.min(F.struct("g", "pos")).over(by_word.rangeBetween(0, WINDOW - 1))).select("_d", F.col("least.g").alias("g"), F.col("least.pos").alias("pos")).distinct()
    prints = save_lean(scratch, picked.withColumn("prev", F.lag("pos").over(Window.partitionBy("_d", "g").orderBy("pos"))))

    # Alignments: (later document, earlier document, how far apart the lines are).
    starts = prints.where("prev IS NULL").drop("prev")
    firsts = starts.groupBy("g").agg(F.min(F.struct(F.col("_d").alias("d0"), F.col("pos").alias("p0"))).alias("f"), F.count("*").alias("uses")).where("uses > 1")
    firsts = save_lean(scratch, firsts.select("g", "f.d0", "f.p0", "uses"))
    across = join_hot(starts, firsts, "g").where("_d <> d0").select("_d", "d0", (F.col("p0") - F.col("pos")).alias("shift"))
    within = prints.where("prev IS NOT NULL").select("_d", F.col("_d").alias("d0"), (F.col("prev") - F.col("pos")).alias("shift"))
    aligned = save_lean(scratch, across.unionByName(within).distinct())
    scratch.drop(prints)
    scratch.drop(firsts)

    # Both documents' lines as arrays, through join_salted as one may serve many.
    wanted = aligned.select("_d").unionByName(aligned.select(F.col("d0").alias("_d"))).distinct()
    arrays = save_lean(scratch, lines.join(wanted, "_d", "left_semi").groupBy("_d").agg(F.array_sort(F.collect_list(F.struct("pos", "h", "nw"))).alias("ls")))
    scratch.drop(lines)
    uses = aligned.groupBy(F.col("d0").alias("_d")).agg(F.count("*").alias("uses"))
    earlier = save_lean(scratch, arrays.join(uses, "_d").select(F.col("_d").alias("d0"), F.col("ls.h").alias("h0"), "uses"))
    own = save_lean(scratch, aligned.groupBy("_d").agg(F.count("*").alias("uses")).join(arrays, "_d"))
    scratch.drop(arrays)
    both = join_salted(join_salted(aligned, own, "_d", F.struct("d0", "shift")), earlier, "d0", F.struct("_d", "shift"))
    # Of the lines that the alignment pairs, those that differ cut the rest into stretches of equal lines.
    low, high = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("ls"), F.size("h0") - F.col("shift"))
    differ = F.filter(F.sequence(F.col("low"), F.col("high") - 1), lambda p: F.get(F.col("ls"), p)["h"] != F.get(F.col("h0"), p + F.col("shift")))
    cuts = both.withColumn("low", low).withColumn("high", high).where("high > low").withColumn("cut", F.concat(F.array(F.col("low") - 1), differ, F.array(F.col("high"))))
    runs = F.transform(F.sequence(F.lit(1), F.size("cut") - 1), lambda i: F.struct((F.get(F.col("cut"), i - 1) + 1).alias("first"), (F.get(F.col("cut"), i) - 1).alias("last")))
    words = F.aggregate(F.slice("ls", F.col("r.first") + 1, F.col("r.last") - F.col("r.first") + 1), F.lit(0).cast("long"), lambda n, x: n + x["nw"])
    return cuts.select("_d", "ls", F.explode(runs).alias("r")).where("r.last >= r.first").where(words >= GRAM).select("_d", "r.first", "r.last").distinct()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated runs taken out of ``text``, and _n_lines and _n_deleted added."""
    scratch = Scratch(docs.sparkSession)
    ranges = repeated_runs(docs, scratch).groupBy("_d").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    rows = _key(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    joined = rows.join(ranges, "_d", "left").select("row", "text", "ranges")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x, i: ~F.exists("ranges", lambda r: (r["first"] <= i) & (i <= r["last"])))
    made = joined.select(
        "row",
        F.when(F.col("ranges").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("left"),
        F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(lines)).cast("long").alias("lines"),
        F.when(F.col("ranges").isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long").alias("deleted"),
    )
    own = [F.col("left").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("_n_lines", "_n_deleted")]
    return made.select(*own, F.col("lines").alias("_n_lines"), F.col("deleted").alias("_n_deleted"))


def op8(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_deleted").alias("n_deleted"), F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id AS id, text, ('0x' || substr(md5(text), 1, 15))::BIGINT AS th FROM documents WHERE text <> ''),
s AS (SELECT *, string_split(text, chr(10)) AS ls, row_number() OVER (ORDER BY id NULLS FIRST, th) AS d FROM d),
e AS (SELECT d, unnest(range(0, len(ls)))::BIGINT AS pos, unnest(ls) AS line FROM s),
h AS (SELECT d, pos, ('0x' || substr(md5(line), 1, 15))::BIGINT AS h, len(regexp_extract_all(line, '{WORD}'))::BIGINT AS nw FROM e),
l AS (SELECT *, sum(nw) OVER (PARTITION BY d ORDER BY pos) - nw AS w0 FROM h),
k AS (SELECT d, pos, w0, array_to_string(list(h) OVER w, ',') AS hs, sum(nw) OVER w AS held FROM l WHERE nw > 0
  WINDOW w AS (PARTITION BY d ORDER BY w0 RANGE BETWEEN CURRENT ROW AND {GRAM - 1} FOLLOWING)),
g AS (SELECT d, pos, w0, ('0x' || substr(md5(hs), 1, 15))::BIGINT AS g FROM k WHERE held >= {GRAM}),
m AS (SELECT d, min((g, pos)) OVER (PARTITION BY d ORDER BY w0 RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS m FROM g),
p AS (SELECT *, lag(pos) OVER (PARTITION BY d, g ORDER BY pos) AS prev FROM (SELECT DISTINCT d, m[1] AS g, m[2] AS pos FROM m)),
f AS (SELECT g, min((d, pos)) AS f FROM p GROUP BY g),
a AS (SELECT DISTINCT d, f[1] AS d0, f[2] - pos AS shift FROM p JOIN f USING (g) WHERE prev IS NULL AND d <> f[1]
  UNION SELECT DISTINCT d, d, prev - pos FROM p WHERE prev IS NOT NULL),
q AS (SELECT a.d, a.d0, shift, x.pos, x.nw, x.pos - row_number() OVER (PARTITION BY a.d, a.d0, shift ORDER BY x.pos) AS run
  FROM a JOIN l x ON x.d = a.d JOIN l y ON y.d = a.d0 AND y.pos = x.pos + a.shift AND y.h = x.h),
r AS (SELECT d, min(pos) AS first, max(pos) AS last FROM q GROUP BY d, d0, shift, run HAVING sum(nw) >= {GRAM}),
gone AS (SELECT DISTINCT d, pos FROM r, l WHERE l.d = r.d AND pos BETWEEN first AND last),
o AS (SELECT e.d, count(*) AS n_lines, count(gone.pos) AS n_deleted, coalesce(string_agg(line, chr(10) ORDER BY e.pos) FILTER (WHERE gone.pos IS NULL), '') AS kept
  FROM e LEFT JOIN gone ON gone.d = e.d AND gone.pos = e.pos GROUP BY e.d)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted, length(coalesce(kept, x.text))::BIGINT AS kept_chars,
  md5(coalesce(kept, x.text)) AS kept_md5
FROM documents x LEFT JOIN s ON x.doc_id IS NOT DISTINCT FROM s.id AND x.text = s.text LEFT JOIN o USING (d)
"""
SQL = SQL.replace("SELECT DISTINCT d, pos FROM r, l WHERE l.d = r.d AND", "SELECT DISTINCT l.d, l.pos FROM r, l WHERE l.d = r.d AND")
