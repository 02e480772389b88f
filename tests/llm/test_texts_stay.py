"""Stages of the corpus pipeline choose among documents without shuffling more texts than they must, and choose the same ones."""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pytest

import test_pipeline as plain
from genoframe.llm import jaccard_join, line_dedup, mixing
from genoframe.llm.common import Scratch

DDL = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture
def no_broadcasts(spark):
    """As for tables too large to be broadcast unasked."""
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    yield
    spark.conf.set(setting, before)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def some_docs(rng, n: int) -> list[tuple]:
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, int(k))) for k in rng.integers(0, 40, n)]
    return [(i, t, "en", "abcd"[min(3, int(rng.integers(0, 9)))], len(t)) for i, t in enumerate(texts)]


def test_mix_joins_texts_with_a_row_a_source(spark, no_broadcasts):
    docs = spark.createDataFrame(some_docs(np.random.default_rng(3), 300), DDL)
    assert "Exchange hashpartitioning" not in plan_of(mixing.mix(docs))


@pytest.mark.parametrize("seed", range(4))
def test_mix_with_copies_at_the_cut(spark, seed):
    """Most rows are copies, of one id, several or none, so the last place taken of a source is one of copies."""
    rng = np.random.default_rng(seed)
    base = some_docs(rng, 12)
    rows = [(None if k % 3 == 0 else i // 2, t, lang, None if s == "d" else s, n) for k, (i, t, lang, s, n) in enumerate(base) for _ in range(int(rng.integers(1, 30)))]
    docs = [dict(zip(plain.COLUMNS, r, strict=True)) for r in rows]
    got = mixing.mix(spark.createDataFrame(rows, DDL).repartition(4)).collect()
    assert plain.rows(got) == plain.rows(plain.mix(docs))


def test_mix_keeps_rows_that_differ_in_nested_columns(spark):
    docs = spark.createDataFrame([(1, "one two", "a", [x]) for x in range(5)], "doc_id long, text string, source string, more array<int>")
    assert sorted(r["more"][0] for r in mixing.mix(docs).collect()) == list(range(5))


def test_keep_first_joins_texts_with_the_rows_that_go(spark, no_broadcasts):
    docs = some_docs(np.random.default_rng(4), 200)
    docs += [(1000 + i, *d[1:]) for i, d in enumerate(docs[:20])]
    docs += [docs[5]] * 3 + [(None, *docs[6][1:])] * 2 + [(None, "only without an id", "en", "a", 18)] * 3
    frame = spark.createDataFrame(docs, DDL).repartition(3)
    got = jaccard_join.keep_first(frame)
    assert "SortMergeJoin" not in plan_of(got)
    assert plain.rows(got.collect()) == plain.rows(plain.near_duplicates([dict(zip(plain.COLUMNS, d, strict=True)) for d in docs]))
    alone = jaccard_join.keep_first(spark.createDataFrame(docs[:100] + docs[200:220], DDL))
    assert "Exchange hashpartitioning" not in plan_of(alone)
    assert Counter(r["doc_id"] for r in alone.collect()) == Counter(range(100))


def test_dedup_lines_leaves_only_the_tables_it_reads(spark):
    docs = spark.createDataFrame([(i, "\n".join(["same words in a line " * 6, f"own {i}"]), "en", "a", 9) for i in range(20)], DDL)
    scratch = Scratch(spark)
    runs = line_dedup.repeated_runs(docs, scratch)
    assert len(os.listdir(scratch.root.removeprefix("file://"))) == 3
    assert runs.count() == 19
