"""Operator 11 against a dictionary of all deletions, over whole tables, odd rows and random words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

from genoframe.llm import spelling
from genoframe.llm.common import table
from genoframe.session import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, noise: int = 31) -> Counter:
    words = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % noise == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            words[word] += 1
    return words


def brute(rows, noise: int = 31) -> set:
    words = {w: n for w, n in counted(rows, noise).items() if len(w) >= 7 and n >= 2}
    near, holes = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            less = w[:k] + w[k + 1 :]
            holes[k, less].add(w)
            if less in words:
                near[w].add(less)
                near[less].add(w)
    for group in holes.values():
        for w in group if len(group) > 1 else ():
            near[w] |= group - {w}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 10 * words[w]:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def held(docs, want, spark, **settings) -> None:
    got = [tuple(r) for r in spelling.variants(docs, Scratch(spark), **settings).collect()]
    assert len(got) == len(want) and set(got) == want


def test_whole_table(spark, small):
    docs = table(spark, small, "documents")
    held(docs, brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]), spark)


def test_dense_random_words(spark):
    """Few letters, so that words have neighbours by runs, at both ends and through each other; no noise."""
    rng = random.Random(3)
    rows = [(n, " ".join("".join(rng.choice("abéÿ"[: rng.choice([2, 2, 4])]) for _ in range(rng.choice([7, 7, 8, 9]))) for _ in range(60))) for n in range(60)]
    rows += [(99, "aaaaaaa " * 40 + "aaaaaaaa " * 400 + "Aaaaaab " * 4)]
    held(spark.createDataFrame(rows, "doc_id long, text string"), brute(rows, 10**9 + 7), spark, noise=10**9 + 7)


def test_odd_rows(spark):
    long = "ab" * 20_000
    rows = [(None, None), (None, ""), (3, " 12 34 "), (None, "Letters letters lexters"), (5, "lexters LEXTERS"), (5, "lexters LEXTERS"), (6, f"{long} {long}x {long[:-1]} y{long} {long[1:]}"), (7, f"{long} {long}x {long[:-1]} y{long} {long[1:]}")]
    rows += [(8, "Ébauches ébauches ébauches ebauches ebauches"), (9, "chained " * 3 + "chaines " * 40 + "choines " * 500), (10, "tiesaaa " * 2 + "tiesaab " * 30 + "tiesaac " * 30), (11, "word " * 99_999 + "sevenss sevenss")]
    docs = spark.createDataFrame([(i, t, "c", "c", 1, "c") for i, t in rows], "doc_id long, text string, word string, `a.b` string, n int, node string")
    noise = next(n for n in range(31, 2000) if {"chaines", "tiesaab"} <= {w for w, c in counted(rows, n).items() if c > 20})
    want = brute(rows, noise)
    assert ("chained", "chaines", "choines") in {w[:3] for w in want} and any(w[1] == "tiesaab" for w in want) and any(len(w[0]) > 30_000 and w[4] for w in want)
    held(docs, want, spark, noise=noise)
    assert spelling.variants(docs.limit(0), Scratch(spark)).count() == 0
