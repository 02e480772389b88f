"""Operator 11: spelling variants by a relational trie frontier.

Words of all texts are counted, and those that differ by one inserted, deleted or replaced code point found by walking
all words through a trie at once. The trie is a table of edges (node, label, child), with paths that do not branch in
one edge. A row of the frontier is a state: a word, its position (what is left of it, ``rest``), a node and the edits
made. States without an edit lie on the word's own path, which is known, so they enter together. Each level joins the
frontier with the edges: the first one replaces or deletes a code point (an insertion is the deletion seen from the
other word), the others are exact steps. A state with one edit that ends its word on the node of a word is a pair of
neighbours. Levels go on until the frontier is empty, at most as many as a path has branches.

Two words with one edit have a long common beginning or a long common end. There are two tries, of the words and of the
reversed words, and in each a word enters halfway down: above that no edit is made, so the crowded top is never branched
over. A replacement is joined on the code point after it as well, which an edge knows from its label or, if that is one
code point long, from the first code points under its child; so few states are made that die in the next level. Nodes
are hashes of prefixes; two that clash only add candidates, since each pair found is compared in the end.

A (node, code point) has one edge for exact steps, and for replacements one for each code point at most, so a hot node
is a skewed left side alone, which adaptive execution splits; a frontier of few rows is broadcast, so that late levels
shuffle nothing. Words are counted in partial aggregates. Chains of forms rise tenfold at each link, so following them
takes at most as many joins as the largest count has digits.

Defined cases: null and empty texts have no words; a null doc_id is written as the empty string for the noise; rows that
repeat count again; ties of form go to the least word in code-point order; very long texts are read whole, in one row
each; very long words take time in proportion to their length and are compared whole; an empty table gives none; other
columns of the documents are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.llm.common import Scratch, join_hot, save_lean, table

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOISE = 31

#: A frontier of so many rows at most is broadcast; its rows are as long as words are.
FEW = 50_000

#: Whether what is left of a word goes on with a label, or is it where the label ends a word.
FITS = "if(other is null, startswith({rest}, {label}), {rest} = {label})"


def noisy_words(docs: DataFrame, noise: int = NOISE) -> DataFrame:
    """word, n: every run of letters, some without one code point as their checksum with the doc_id says."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_doc"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("_run"))
    lower = runs.select("_doc", F.translate("_run", UPPER, LOWER).alias("_w"))
    summed = lower.select("_w", F.crc32(F.concat("_doc", F.lit(":"), "_w").cast("binary")).alias("_h"))
    at = F.expr("cast(_h % length(_w) as int)")
    less = F.concat(F.substring("_w", F.lit(1), at), F.substring("_w", at + 2, F.length("_w")))
    return summed.select(F.when(F.col("_h") % noise == 0, less).otherwise(F.col("_w")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def prefixes(words: DataFrame) -> DataFrame:
    """id, side, at, node, next: the lower half of each word's path in both tries, ``next`` being the code point after.

    The last row is the word's end; its ``next`` is 0. Side 0 is the trie of words, side 1 that of reversed words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("side", pa.int32()), ("at", pa.int32()), ("node", pa.int64()), ("next", pa.int32())])
        out = []

        def full() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            return b

        for b in batches:
            for i, word in zip(b["id"].to_pylist(), b["word"].to_pylist(), strict=True):
                m = len(word)
                for side, path, start in ((0, word, m // 2), (1, word[::-1], m - m // 2)):
                    digest = xxhash.xxh64(path[:start].encode(), seed=side)
                    for at, c in enumerate(path[start:], start):
                        out.append((i, side, at, digest.intdigest() - 2**63, ord(c)))
                        digest.update(c.encode())
                        if len(out) >= 50_000:
                            yield full()
                    out.append((i, side, m, digest.intdigest() - 2**63, 0))
        if out:
            yield full()

    return words.select("id", "word").mapInArrow(run, "id long, side int, at int, node long, next int")


def trie(words: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The edges of both tries, and the states of words on their own paths.

    edges: node, head (first code point of the label), label, child. An edge to a leaf has the leaf's word (``other``) in
    place of a child, and so has an edge without label of each other node that ends a word. states: word, node, rest (of
    the word, reversed in the second trie).
    """
    path = save_lean(scratch, prefixes(words))
    nodes = path.groupBy("node").agg(F.min("next").alias("low"), F.max("next").alias("high"), F.count("*").alias("uses"))
    nodes = save_lean(scratch, nodes.where("low <> high or low = 0").select("node", (F.col("high") == 0).alias("leaf"), "uses"))
    on_path = join_hot(path.select("id", "side", "at", "node"), nodes, "node")
    stops = on_path.groupBy("id", "side").agg(F.array_sort(F.collect_list(F.struct("at", "node", "leaf"))).alias("stops"))
    paths = save_lean(scratch, words.select("id", "word").join(stops, "id").select("word", "stops", F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")).alias("path")))
    scratch.drop(path)
    here = paths.select("word", "path", "stops", F.posexplode("stops").alias("k", "a")).withColumn("b", F.expr("get(stops, k + 1)"))
    label = F.expr("if(b is null, '', substring(path, a.at + 1, b.at - a.at))")
    each = here.where("not a.leaf").select(F.col("a.node").alias("node"), label.alias("label"), F.expr("if(b.leaf, null, b.node)").alias("child"), F.expr("if(b is null or b.leaf, word, null)").alias("other"))
    edges = each.distinct().withColumn("head", F.substring("label", 1, 1))
    states = here.where("b is not null").select("word", F.col("a.node").alias("node"), F.expr("substring(path, a.at + 1)").alias("rest"))
    return save_lean(scratch, edges), states


def neighbours(words: DataFrame, scratch: Scratch) -> DataFrame:
    """word, other: pairs of words with one edit between them, each once in one of its two directions."""
    edges, states = trie(words, scratch)
    # A replaced code point is followed by the second one of an edge, or by the head of one that its child has; a deleted
    # one by the head: both are looked up by the code point after the edit.
    long = edges.where("length(label) > 1").select("*", F.substring("label", 2, 1).alias("then"))
    leaf = edges.where("length(label) = 1 and child is null").select("*", F.lit("").alias("then"))
    short = edges.where("length(label) = 1").join(edges.select(F.col("node").alias("child"), F.col("head").alias("then")), "child").select(*edges.columns, "then")
    index = long.unionByName(leaf).unionByName(short).withColumn("edit", F.lit("replace")).unionByName(edges.withColumn("then", F.col("head")).withColumn("edit", F.lit("delete")))
    probes = states.withColumn("then", F.substring("rest", 2, 1)).join(index, ["node", "then"])
    first, size = F.substring("rest", 1, 1), F.length("label")
    replaced = (F.col("edit") == "replace") & (F.col("head") > first) & (F.expr(FITS.format(rest="substring(rest, 2)", label="substring(label, 2)")))
    deleted = (F.col("edit") == "delete") & (F.col("then") != first) & F.expr(FITS.format(rest="substring(rest, 2)", label="label"))
    begin = F.when(replaced, size + 1).otherwise(size + 2)
    frontier = save_lean(scratch, probes.where(replaced | deleted).select("word", F.col("child").alias("node"), F.substring("rest", begin, F.length("rest")).alias("rest"), "other"))
    found = []
    while True:
        found.append(frontier.where("other is not null").select("word", "other"))
        going = frontier.where("other is null").select("word", "node", "rest", F.substring("rest", 1, 1).alias("head"))
        n = going.count()
        if not n:
            break
        there = (F.broadcast(going) if n <= FEW else going).join(edges, ["node", "head"]).where(FITS.format(rest="rest", label="label"))
        frontier = save_lean(scratch, there.select("word", F.col("child").alias("node"), F.expr("substring(rest, length(label) + 1)").alias("rest"), "other"))
    return reduce(DataFrame.unionByName, found).where("levenshtein(word, other, 1) = 1").distinct()


def roots(formed: DataFrame, scratch: Scratch) -> DataFrame:
    """word and form to word and root: the last form of the chain, the word itself if it has none."""
    links = save_lean(scratch, formed.where("form is not null").select("word", "form"))
    forward = links.select(F.col("word").alias("form"), F.col("form").alias("onward"))
    now = links
    while True:
        # Doubling would not be shorter: a chain has as many links as counts have digits.
        after = save_lean(scratch, now.join(forward, "form", "left").select("word", F.coalesce("onward", "form").alias("form"), F.col("onward").isNotNull().alias("_moved")))
        moved = after.where("_moved").limit(1).count()
        now = after.drop("_moved")
        if not moved:
            return now.withColumnRenamed("form", "root")


def variants(docs: DataFrame, scratch: Scratch, least_length: int = 7, least_n: int = 2, times: int = 10, noise: int = NOISE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word with ``least_length`` code points and ``least_n`` occurrences.

    The form is the near word of the largest n if that is ``times`` the word's own.
    """
    words = noisy_words(docs, noise).where(F.length("word") >= least_length).where(F.col("n") >= least_n)
    words = save_lean(scratch, words.withColumn("id", F.monotonically_increasing_id()))
    pairs = save_lean(scratch, neighbours(words, scratch))
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))
    both = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.max("other_n").alias("most"), F.min(F.struct(-F.col("other_n"), "other")).alias("best"))
    good = F.col("most") >= times * F.col("n")
    formed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.other")).alias("form"), F.when(good, F.col("most")).alias("form_n"))
    formed = save_lean(scratch, formed)
    return formed.join(roots(formed, scratch), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"), Scratch(spark))
