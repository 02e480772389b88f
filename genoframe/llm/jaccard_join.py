"""Operator 6: n-gram Jaccard join with MinHash banding and exact verification.

1. Texts that are equal (MD5 of the whole text) are one *class*; copies are counted once and never paired.
2. Each class gets a MinHash signature of its shingles (runs of five words; a text of fewer words is one shingle).
   ``banding`` picks the bands and rows for a target recall at the threshold from a given number of hashes. Classes are shuffled on (band, hash of the band's rows); each is tied to the least of its bucket: a
   star, not all pairs. The connected components of these stars hold every candidate pair.
3. Each component is cut into blocks by a hash, as many as its shingles need, and each pair of blocks is one group
   of an ``applyInPandas``, of bounded size however large the component. In it the full sets of all pairs are
   compared by marking one set at a time in a table of the block's shingles. No pair is emitted: a class gets its
   number of links, and a spanning forest of the links goes on.
4. Components of the forests are the groups: class_id is the least doc_id of a group.

So every link between different texts of a candidate component is found and counted, also those that banding alone
would miss. Defined cases: null and blank texts have no shingles; they link to nothing and each row is a group by
itself (text_id and class_id its doc_id); a very long text is one set, taken whole, its signature in pieces, and may
make its block larger than ``block``; ties do not matter; rows with equal texts share class and number of links;
null doc_ids are never a class_id unless all ids of the group are null; an empty table gives none; other columns are
ignored by the join and passed through by ``keep_first``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from genoframe.llm.common import WORD, Scratch, components, join_hot, join_small, map_texts, table

PRIME = (1 << 61) - 1


def banding(threshold: float, recall: float, hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, whose bands reach the recall within ``hashes``."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = 1
        while bands * rows <= hashes and 1 - (1 - threshold**rows) ** bands < recall:
            bands += 1
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def word_numbers(words: list[str]) -> np.ndarray:
    """64-bit numbers of words, equal on every machine."""
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted set of a text's n-gram hashes."""
    import re

    words = re.findall(WORD, text or "")
    if not words:
        return np.zeros(0, np.uint64)
    x = word_numbers(words)
    k = min(n, len(x))
    out = np.full(len(x) - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ x[j : len(x) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of each hash function over the set, taken in pieces of bounded size."""
    low = (grams >> np.uint64(32)) ^ (grams & np.uint64(0xFFFFFFFF))
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(low), 512):
        out = np.minimum(out, (low[i : i + 512, None] * a + b).min(axis=0) if len(low) else out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> list[int]:
    out = np.arange(bands, dtype=np.uint64)
    for col in sig.reshape(bands, rows).T:
        out = (out ^ (col >> np.uint64(16))) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out.view(np.int64).tolist()


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, key (MD5 of the text), grams (number of shingles), bands (array; empty without shingles)."""
    rng = np.random.default_rng(20240601)
    a = rng.integers(1, 1 << 63, bands * rows, np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows, np.uint64)

    def run(texts: list) -> list[list]:
        with np.errstate(over="ignore"):
            sets = [shingles(t, n) for t in texts]
            return [[len(s) for s in sets], [band_keys(signature(s, a, b), bands, rows) if len(s) else [] for s in sets]]

    keyed = docs.select("doc_id", text_key().alias("key"), "text")
    return map_texts(keyed, ["text"], run, "grams int, bands array<bigint>", ["doc_id", "key"])


def text_key() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def links_within(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of each left and right set, and a spanning forest as (node, node), right ones numbered after left ones.

    ``right`` None: pairs within ``left``.
    """
    same = right is None
    right = left if same else right
    sizes_l, sizes_r = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    flat = np.concatenate([*left, *([] if same else right)])
    ids = np.unique(flat, return_inverse=True)[1]
    ids_l = ids[: sizes_l.sum()]
    ids_r = ids_l if same else ids[sizes_l.sum() :]
    start_l, start_r = np.cumsum(sizes_l) - sizes_l, np.cumsum(sizes_r) - sizes_r
    mark = np.zeros(ids.max() + 1, np.int32)
    n_l, n_r = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    parent = np.arange(len(left) + (0 if same else len(right)))
    shift = 0 if same else len(left)
    forest = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(left)):
        first = i + 1 if same else 0
        if first == len(right):
            break
        own = ids_l[start_l[i] : start_l[i] + sizes_l[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[ids_r[start_r[first] :]], start_r[first:] - start_r[first])
        mark[own] = 0
        hit = np.flatnonzero(common >= threshold * (sizes_l[i] + sizes_r[first:] - common)) + first
        n_l[i] += len(hit)
        n_r[hit] += 1
        for j in hit.tolist():
            x, y = root(i), root(j + shift)
            if x != y:
                parent[max(x, y)] = min(x, y)
                forest.append((i, j + shift))
    return (n_l + n_r if same else n_l), n_r, forest


def text_groups(docs: DataFrame, scratch: Scratch, n: int, threshold: float, recall: float = 0.9995, block: int = 300_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signatures, the classes, and of each class key, text_id, root (least key of its group) and n_links."""
    bands, rows = banding(threshold, recall)
    signed = scratch.save(signatures(docs, n, bands, rows))
    classes = scratch.save(signed.where("grams > 0").groupBy("key").agg(F.min("doc_id").alias("text_id"), F.first("grams").alias("grams"), F.first("bands").alias("bands"), F.count("*").alias("copies")))

    keyed = classes.select("key", F.posexplode("bands").alias("band", "hash"))
    bucket = keyed.groupBy("band", "hash").agg(F.min("key").alias("b"), F.count("*").alias("m")).where("m > 1")
    # A bucket's members meet its least key. Hot buckets are few: their rows find it in a broadcast, see join_hot.
    bucket = scratch.save(bucket.select(F.xxhash64("band", "hash").alias("bucket"), "b", F.col("m").alias("uses")))
    stars = join_hot(keyed.select(F.xxhash64("band", "hash").alias("bucket"), F.col("key").alias("a")), bucket, "bucket")
    component = scratch.save(components(stars.select("a", "b").where("a <> b"), scratch))
    members = component.unionByName(component.select(F.col("root").alias("node"), "root").distinct())

    sized = classes.join(members, F.col("key") == F.col("node")).select("key", "text_id", "root", "grams")
    need = sized.groupBy("root").agg(F.greatest(F.lit(1), F.ceil(F.sum("grams") / block)).cast("int").alias("blocks"), F.count("*").alias("uses"))
    need = scratch.save(need)
    placed = join_hot(sized, need, "root").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    placed = scratch.save(placed.select("key", "text_id", "root", "blocks", "block"))

    # The sets of the texts that have candidates: one document of each class carries its text.
    texts = docs.select("doc_id", "text", text_key().alias("key"))
    small = placed.limit(200_000).count() < 200_000
    carriers = F.broadcast(placed) if small else placed
    chosen = texts.join(carriers, (texts["key"] == placed["key"]) & texts["doc_id"].eqNullSafe(placed["text_id"]))

    def sets(texts: list) -> list[list]:
        with np.errstate(over="ignore"):
            return [[shingles(t, n).view(np.int64) for t in texts]]

    chosen = map_texts(chosen.select(placed["key"], "root", "blocks", "block", "text"), ["text"], sets, "grams array<bigint>", ["key", "root", "blocks", "block"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = chosen.withColumn("with", other).select("root", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "block", "key", "grams")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("key")
        x, y = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
        mine = pdf[pdf["block"] == x]
        left = [np.asarray(g, np.int64) for g in mine["grams"]]
        if x == y:
            keys, right = mine["key"].tolist(), None
        else:
            theirs = pdf[pdf["block"] == y]
            keys, right = mine["key"].tolist() + theirs["key"].tolist(), [np.asarray(g, np.int64) for g in theirs["grams"]]
        if not left or right == []:
            return pd.DataFrame({"key": [], "n": [], "other": []}).astype({"key": str, "n": "int64", "other": str})
        n_l, n_r, forest = links_within(left, right, threshold)
        counts = np.concatenate([n_l, [] if right is None else n_r]).astype(np.int64)
        out = [(k, int(c), None) for k, c in zip(keys, counts, strict=True) if c]
        out += [(keys[a], 0, keys[b]) for a, b in forest]
        return pd.DataFrame(out, columns=["key", "n", "other"])

    found = scratch.save(tasks.groupBy("root", "x", "y").applyInPandas(verify, "key string, n long, other string"))
    links = found.groupBy("key").agg(F.sum("n").alias("n_links"))
    groups = components(found.where("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b")), scratch)
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    named = classes.select("key", "text_id").join(groups, F.col("key") == F.col("node"), "left").join(links, "key", "left").select("key", "text_id", F.coalesce("root", "key").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return signed, classes, scratch.save(named)


def jaccard_groups(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, block: int = 300_000) -> DataFrame:
    """doc_id, text_id, class_id, n_links: a row a document. ``block``: shingles a block may hold, about."""
    scratch = Scratch(docs.sparkSession)
    signed, classes, named = text_groups(docs, scratch, n, threshold, recall, block)
    least = named.groupBy("root").agg(F.min("text_id").alias("class_id"))
    copies = classes.select("key", F.col("copies").alias("uses"))
    named = scratch.save(named.join(least, "root").join(copies, "key").select("key", "text_id", "class_id", "n_links", "uses"))
    known = join_hot(signed.where("grams > 0").select("doc_id", "key"), named, "key").select("doc_id", "text_id", "class_id", "n_links")
    alone = signed.where("grams = 0").select("doc_id", F.col("doc_id").alias("text_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return known.unionByName(alone)


def keep_first(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """One document of each group: the one with the least doc_id, then the least MD5. Columns as in ``docs``.

    Rows are known by doc_id and MD5 of the text, so groups whose ids are null or occur in other groups stay too. Of
    rows equal in both one stays. A text without words is a group by itself, and stays.
    """
    scratch = Scratch(docs.sparkSession)
    signed, _, named = text_groups(docs, scratch, n, threshold)
    best = named.groupBy("root").agg(F.min(F.struct(F.col("text_id").isNull().alias("none"), "text_id", "key")).alias("b"))
    best = best.select(F.col("b.text_id").alias("id"), F.col("b.key").alias("md5"))
    # Most rows stay, so those that go are looked for, and those of which one of several stays.
    several = signed.where("grams > 0").groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    marked = several.join(best, (F.col("key") == F.col("md5")) & F.col("doc_id").eqNullSafe(F.col("id")), "left").withColumn("stays", F.col("md5").isNotNull())
    marked = scratch.save(marked.where("n > 1 OR NOT stays").select(F.col("doc_id").alias("id"), F.col("key").alias("md5"), "stays"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", text_key().alias("key"))
    found = join_small(rows, marked, (F.col("key") == F.col("md5")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    kept = found.where("stays IS NULL").select("row.*")
    if not marked.where("stays").limit(1).count():
        return kept
    plain = [F.col("row")[f.name] for f in docs.schema if isinstance(f.dataType, AtomicType)]
    one = found.where("stays").groupBy("doc_id", "key").agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
    return kept.unionByName(one.select("row.*"))


def op6(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))
