"""Queries against DuckDB, and the pipeline against planted truth."""

from __future__ import annotations

import os
import random
import subprocess
import sys
from dataclasses import replace

import numpy as np
import pytest

from genoframe.operators import cluster, correct, intervals, ploidy, qc, segment
from genoframe.params import Params
from genoframe.plans import catalog, pipeline


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(same, name):
    same(catalog.QUERIES[name], catalog.ORACLES[name])


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_overlap_edges(spark):
    """Bins are open at both ends against half-open reads; a read across an edge counts twice."""
    bins = spark.createDataFrame([(0, "chr1", 1, 10), (1, "chr1", 11, 20), (2, "chr1", 21, 25)], "bin_id int, chrom string, start long, end long")
    rows = [(s, s + n) for s in range(0, 27) for n in (1, 2, 3, 12)]
    reads = spark.createDataFrame([("a", "chr1", s, e) for s, e in rows], "cell string, chrom string, start long, end long")
    got = {r["bin_id"]: r["n"] for r in intervals.overlap_counts(reads, bins, 10).collect()}
    assert got == {b: sum(s < e0 and e > s0 for s, e in rows) for b, s0, e0 in ((0, 1, 10), (1, 11, 20), (2, 21, 25))}


def test_mask_both_ways(spark):
    reads = spark.createDataFrame([("a", "chr1", s, s + 5) for s in range(0, 60, 3)], "cell string, chrom string, start long, end long")
    mask = spark.createDataFrame([("chr1", 20, 22), ("chr1", 40, 49)], "chrom string, start long, end long")
    small, large = (sorted(r["start"] for r in intervals.drop_masked(reads, mask, width=16, limit=k).collect()) for k in (100, 0))
    assert small == large == [s for s in range(0, 60, 3) if not any(s < e and s + 5 > b for b, e in ((20, 22), (40, 49)))]


def test_long_lists_of_mask_intervals(spark):
    """Lists that take several halvings, with intervals inside others, without length, touching, and with nulls."""
    rng = random.Random(8)
    spans = [(rng.choice(["chr1", "chr2"]), s, s + rng.choice([0, 1, 1, 4, 30])) for s in (rng.randrange(4000) for _ in range(300))] + [("chr1", 5000, 5000)]
    rows = [(i, rng.choice(["chr1", "chr2", "chr3", None]), s, s + rng.choice([0, 1, 3, 12])) for i in range(3000) for s in [rng.randrange(5100)]]
    mask = spark.createDataFrame([*spans, (None, 1, 2), ("chr1", None, 3), ("chr1", 3, None)], "chrom string, start long, end long")
    reads = spark.createDataFrame(rows, "row long, chrom string, start long, end long")
    want = sorted(i for i, c, s, e in rows if not any(c == mc and s < me and e > ms for mc, ms, me in spans))
    for width, limit in ((None, 1000), (2000, 1000), (None, 0)):
        assert sorted(r["row"] for r in intervals.drop_masked(reads, mask, width, limit).collect()) == want
    assert intervals.drop_masked(reads, mask.limit(0)).count() == 3000


def test_merged_over_many_ranges(spark):
    """Against a sweep: intervals across ranges, islands over several of them, gaps, no chromosome."""
    rng = random.Random(2)
    rows = [(c, s, s + rng.choice([1, 2, 9, 9, 400 if s % 97 == 0 else 3])) for c in ("chr1", "chr2", None) for s in (rng.randrange(9000) for _ in range(900))]
    frame = spark.createDataFrame([*rows, ("chr1", None, 4), ("chr9", 3, None)], "chrom string, start long, end long")
    for gap in (-1, 0, 3):
        want = []
        for c, s, e in sorted(rows, key=lambda r: (r[0] or "", *r[1:])):
            if want and want[-1][0] == c and s <= want[-1][2] + gap:
                want[-1][2] = max(want[-1][2], e)
            else:
                want.append([c, s, e])
        for per in (20, 10**6):
            got = sorted((list(r) for r in intervals.merged(frame, gap, per).collect()), key=lambda r: (r[0] or "", *r[1:]))
            assert got == want
    assert intervals.merged(frame.limit(0)).count() == 0


def test_merged_where_sorts_spill():
    """Equal intervals that spilled sorts return in any order: the first of an island must not join the one before."""
    script = """
from genoframe.operators import intervals
from genoframe.session import local_session
spark = local_session(2, 2, "1g")
spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
place = "id div 7 * 7"
rows = spark.range(4000).repartition(7).selectExpr("'chr' || id % 3 AS chrom", f"{place} AS start", f"{place} + 2 AS end")
for per in (50, 10**6):
    assert intervals.merged(rows, 0, per).exceptAll(rows.distinct()).isEmpty()
"""
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--conf spark.shuffle.spill.numElementsForceSpillThreshold=100 pyspark-shell", "PYTHONPATH": os.pathsep.join(sys.path)}
    subprocess.run([sys.executable, "-c", script], env=env, check=True, timeout=300)


def test_gini_extremes(spark):
    rows = [("flat", i, 3) for i in range(10)] + [("hot", i, 7 if i == 4 else 0) for i in range(10)]
    got = {r["cell"]: r["gini"] for r in correct.gini(spark.createDataFrame(rows, "cell string, bin_id int, n long")).collect()}
    assert got["flat"] == 0 and abs(got["hot"] - 0.9) < 1e-9


def test_step_profile(spark):
    profile = spark.createDataFrame([(0, i, 1.0 + (i >= 20)) for i in range(40)] + [(1, i, 1.0) for i in range(40)], "cluster int, pos int, v double")
    diffs = segment.neighbour_difference(profile)
    found = segment.islands(diffs, segment.cutoffs(diffs, "h", fixed=0.5))
    assert [(r["cluster"], r["boundary"]) for r in segment.boundaries(found, profile).orderBy("cluster", "boundary").collect()] == [(0, 20), (0, 40), (1, 40)]


def test_size_factors_arithmetic_branch(spark):
    rows = [(c, b, 0 if (b % 2 and c == "z") else 4 * (1 + (c == "x"))) for c in "xyz" for b in range(12)]
    got = {r["cell"]: r["factor"] for r in qc.size_factors(spark.createDataFrame(rows, "cell string, bin_id int, n long")).collect()}
    assert got["x"] == pytest.approx(2 * got["y"])


def test_ward_against_definition():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(0, 0.1, (6, 4)), rng.normal(3, 0.1, (5, 4))])
    merges = cluster.ward_merges(points, np.ones(11))
    groups = {i: [i] for i in range(11)}
    for a, b, h in merges:
        x, y = points[groups[a]], points[groups[b]]
        assert h == pytest.approx(np.sqrt(2 * len(x) * len(y) / (len(x) + len(y))) * np.linalg.norm(x.mean(0) - y.mean(0)))
        groups[a] += groups.pop(b)
    assert cluster.cut(11, merges, k=2).tolist() == [0] * 6 + [1] * 5


def test_ward_of_equal_cells(spark, monkeypatch):
    """Copies of cells are merged by a join, not a pair a round, and count as cells in every cut."""
    rng = np.random.default_rng(6)
    points = rng.normal(0, 1, (9, 3))[rng.integers(0, 9, 120)]
    rows = [(c, b, float(x)) for c, p in enumerate(points) for b, x in enumerate(p)]
    prints, asked = spark.createDataFrame(rows, "cell long, bin_id int, f double").repartition(5), []
    nearest = cluster.nearest
    monkeypatch.setattr(cluster, "nearest", lambda *a: asked.append(1) or nearest(*a))
    merges = cluster.ward_merges(points, np.ones(120))
    got = cluster.ward_labels(prints, 1e-9, 4.0, max_cells=10).orderBy("cell").collect()
    assert len(asked) < 3
    assert [r["first"] for r in got] == cluster.cut(120, merges, 1e-9).tolist() and len({r["first"] for r in got}) == 9
    assert [r["second"] for r in got] == cluster.cut(120, merges, 4.0).tolist()
    assert cluster.ward_labels(prints, k=40, max_cells=10).select("label").distinct().count() == 40


def test_fingerprints_of_equal_cells(spark):
    """Cells with equal counts have equal fingerprints to the last bit, in whatever order their bins come."""
    rng = np.random.default_rng(7)
    values = rng.uniform(0, 9, 60)
    rows = [(c, int(b), float(values[b])) for c in range(40) for b in rng.permutation(60)]
    frame = spark.createDataFrame(rows, "cell long, bin_id int, value double")
    norm = correct.plus_one(frame, "value")
    prints = cluster.fingerprints(norm, norm.select("bin_id").distinct())
    assert norm.select("bin_id", "y").distinct().count() == prints.select("bin_id", "f").distinct().count() == 60


def test_first_component(spark):
    rng = np.random.default_rng(1)
    x = rng.poisson(20, (30, 8)) + np.outer(rng.normal(size=30), np.arange(8)).round().astype(int)
    rows = [(c, b, int(x[b, c])) for b in range(30) for c in range(8)]
    got = np.array([r["loading"] for r in correct.first_loadings(spark.createDataFrame(rows, "cell long, bin_id int, n long")).orderBy("bin_id").collect()])
    u, _, v = np.linalg.svd(x - x.mean(1, keepdims=True), full_matrices=False)
    want = u[:, 0] * (1 if v[0][abs(v[0]).argmax()] > 0 else -1)
    assert np.allclose(got, want, atol=1e-6)


def test_first_component_of_many_cells(spark):
    """Noise, whose first values lie close together: in one pass, and in a space that grows and starts again."""
    rng = np.random.default_rng(4)
    x = rng.poisson(9, (40, 400))
    x[7] = 5
    frame = spark.createDataFrame([(c, b, int(x[b, c])) for b in range(40) for c in range(400)], "cell long, bin_id int, n long")
    for scale in (False, True):
        y = x - x.mean(1, keepdims=True)
        y = y / np.where(y.any(1), x.std(1, ddof=1), 1)[:, None] if scale else y
        u, _, v = np.linalg.svd(y, full_matrices=False)
        want = u[:, 0] * (1 if v[0][abs(v[0]).argmax()] > 0 else -1)
        for sizes in ({}, {"block": 12, "most": 36}):
            got = correct.first_loadings(frame, scale, **sizes).orderBy("bin_id").collect()
            assert np.allclose([r["loading"] for r in got], want, atol=1e-8)
    flat = correct.first_loadings(frame.withColumn("n", frame.bin_id.cast("long"))).collect()
    assert len(flat) == 40 and not any(r["loading"] for r in flat)
    assert correct.first_loadings(frame.limit(0)).count() == 0


def test_planted_clones(spark):
    """Normal cells and a clone with 2, 4 and 3 copies. Profiles of even copies alone, as 2 and 4, fit 1 and 2 as well:
    the grid search cannot tell them apart, so the clone has an odd level."""
    rng = np.random.default_rng(3)
    n, size = 90, 100
    truth = {f"n{i:02d}": np.full(n, 2) for i in range(24)} | {f"t{i:02d}": np.repeat([2, 4, 3], n // 3) for i in range(8)}
    rows = []
    for cell, cn in truth.items():
        for b, c in enumerate(rng.poisson(60 * cn / 2)):
            rows += [(cell, "chr1", b * size + int(p), b * size + int(p) + 2, 60, 65, 2) for p in rng.integers(1, size - 4, c)]
    reads = spark.createDataFrame(rows, "cell string, chrom string, start long, end long, mapq int, flag int, query_length int")
    bins = spark.createDataFrame([(b, "chr1", b * size + 1, (b + 1) * size, 50.0, 1.0) for b in range(n)], "bin_id int, chrom string, start long, end long, gc double, mapp double")
    listed = spark.createDataFrame([(c,) for c in truth if c[0] == "n"], "cell string")
    p = replace(Params(), bin_size=size, ward_first=6.0, ward_second=6.0, mad_times=1000.0)
    got = pipeline.call_copy_numbers(reads, bins, p, listed_normal=listed).toPandas()
    right = [r.cn == truth[r.cell][r.bin_id] for r in got.itertuples()]
    assert len(got) == len(truth) * n and np.mean(right) > 0.95


def test_quality_control_goes_through_reads_once(spark, tmp_path):
    """What follows quality control reads what was saved, and neither the reads nor all counts again."""
    rows = [(f"c{i % 5}", "chr1", p, p + 4, 60, 65, 4) for i in range(400) for p in [i * 7 % 96]]
    spark.createDataFrame(rows, "cell string, chrom string, start long, end long, mapq int, flag int, query_length int").write.parquet(str(tmp_path / "reads"))
    reads = spark.read.parquet(str(tmp_path / "reads"))
    bins = spark.createDataFrame([(b, "chr1", b * 10 + 1, (b + 1) * 10, 50.0, 1.0) for b in range(10)], "bin_id int, chrom string, start long, end long, gc double, mapp double")
    p = replace(Params(), bin_size=10, min_mean=1.0)
    kept = pipeline.quality_controlled(pipeline.count_matrix(reads, bins, p), reads, bins, p)
    assert kept.count() and not [f for f in kept.inputFiles() if str(tmp_path) in f]


def test_calls_round_half_even(spark):
    values = spark.createDataFrame([(0, "a", 0, 0, 1.25), (0, "b", 0, 0, 1.25)], "cluster int, cell string, pos int, seg_id int, y double")
    by_cell = spark.createDataFrame([("a", 2.0), ("b", 2.8)], "cell string, ploidy double")
    assert {r["cell"]: r["cn"] for r in ploidy.calls(values, by_cell).collect()} == {"a": 2, "b": 4}


def test_bam_reader(spark, tmp_path):
    import gzip
    import struct

    from genoframe.sources.files import bam_reads

    name = b"q\0"
    body = b"".join(struct.pack("<iiiBBHHHiiii", 32 + len(name) + 4 + 4, 0, p, len(name), 60, 0, 1, 65, 5, -1, -1, 0) + name + struct.pack("<I", 5 << 4) + b"\x11" * 4 for p in (10, 20))
    raw = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000) + body
    (tmp_path / "cellA_1,x.bam").write_bytes(gzip.compress(raw))
    assert [tuple(r) for r in bam_reads(spark, str(tmp_path)).orderBy("start").collect()] == [("cellA", "chr1", 10, 15, 60, 65, 5), ("cellA", "chr1", 20, 25, 60, 65, 5)]


def test_bam_in_pieces():
    """Reads come before the file has been unpacked: what follows the first megabytes may even be broken."""
    import gzip
    import io
    import random
    import struct

    from genoframe.sources.files import parse_bam

    body = b"".join(struct.pack("<iiiBBHHHiiii", 32 + 2 + 4, -1, p, 2, 60, 0, 1, 65, 5, -1, -1, 0) + b"q\0" + struct.pack("<I", 5 << 4) for p in range(60_000))
    raw = b"BAM\1" + struct.pack("<ii", 0, 0) + body
    reads = parse_bam(io.BytesIO(gzip.compress(raw) + gzip.compress(random.Random(1).randbytes(2_000_000))[:-9]))
    assert next(reads) == (None, 0, 5, 60, 65, 5) and next(reads)[1] == 1
    assert [r[1] for r in parse_bam(io.BytesIO(gzip.compress(raw)))] == list(range(60_000))


def test_chrom_sizes(spark, tmp_path):
    """A row a sequence; line ends of both kinds, empty sequences, and a header with a > in it."""
    from genoframe.sources.files import chrom_sizes

    (tmp_path / "a.fa").write_bytes(b">chr1 first\nACGT\nAC\n>chr2 5->3\r\nACG\r\nA\r\n>chr3\n>chr4\n" + b"ACGTACGTAC\n" * 50_000)
    sizes = chrom_sizes(spark, str(tmp_path / "a.fa"))
    assert dict(map(tuple, sizes.collect())) == {"chr1": 6, "chr2": 4, "chr3": 0, "chr4": 500_000}
    assert sizes.schema.simpleString() == "struct<chrom:string,length:bigint>"


def test_streamed_counts(spark, tmp_path):
    from genoframe.streaming.counts import count_stream

    bins = spark.createDataFrame([(0, "chr1", 1, 10), (1, "chr1", 11, 20)], "bin_id int, chrom string, start long, end long")
    reads = spark.createDataFrame([("a", "chr1", s, s + 3) for s in range(0, 18)], "cell string, chrom string, start long, end long")
    reads.repartition(3).write.parquet(str(tmp_path / "in"))
    got = count_stream(spark, str(tmp_path / "in"), reads.schema, bins, 10, str(tmp_path / "cp"), "streamed")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, intervals.overlap_counts(reads, bins, 10).collect()))
