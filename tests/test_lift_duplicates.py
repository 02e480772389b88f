"""Lifted intervals against a walk over single bases, and marked copies against plain loops."""

from __future__ import annotations

import random

import pytest

from genoframe.operators import duplicates, lift

SPANS = "id long, chrom string, start long, end long"


@pytest.fixture(scope="module")
def chain_file(tmp_path_factory):
    """Chains with gaps on both sides, two on one chromosome, one against the strand, and the map of their bases."""
    rng, text, bases = random.Random(4), ["# made for this test\n"], {}
    for number, (chrom, t0, to_chrom, q0, strand) in enumerate([("chr1", 100, "chr1", 40, "+"), ("chr1", 2300, "chr9", 10, "-"), ("chr2", 0, "chr2", 0, "+"), ("chr2", 1500, "chr2", 3000, "-")]):
        blocks = [(rng.randint(1, 90), rng.choice([0, 0, rng.randint(1, 25)]), rng.choice([0, rng.randint(1, 25)])) for _ in range(25)]
        blocks[-1] = (blocks[-1][0], 0, 0)
        t, q, lines = t0, q0, []
        for i, (size, dt, dq) in enumerate(blocks):
            for k in range(size):
                bases.setdefault((chrom, t + k), []).append((number, to_chrom, q + k if strand == "+" else 9000 - 1 - q - k, strand == "-"))
            t, q = t + size + dt, q + size + dq
            lines.append(f"{size}\t{dt}\t{dq}" if i < 24 else str(size))
        text.append("\n".join([f"chain {1000 - number} {chrom} 5000 + {t0} {t} {to_chrom} 9000 {strand} {q0} {q} {number}", *lines]) + "\n\n")
    path = tmp_path_factory.mktemp("chains") / "a.chain"
    path.write_text(text[0] + "\n".join(t.strip("\n") + "\n" for t in text[1:]))
    return str(path), bases


def plain(spans, bases, least):
    out = {}
    for i, chrom, start, end in spans:
        by_chain = {}
        for t in range(start or 0, end or 0):
            for number, to_chrom, q, flip in bases.get((chrom, t), []):
                by_chain.setdefault((number, to_chrom, flip), []).append(q)
        length, total = (end or 0) - (start or 0), sum(map(len, by_chain.values()))
        best = min(by_chain.items(), key=lambda x: (-len(x[1]), x[0]), default=None)
        share = min(1.0, total / length) if length > 0 and total else 0.0
        if best and len(best[1]) >= least * length:
            out[i] = ("lifted", best[0][1], min(best[1]), max(best[1]) + 1, best[0][2], share)
        else:
            out[i] = ("deleted" if not best else "split" if total >= least * length else "partly deleted", None, None, None, None, share)
    return out


@pytest.mark.parametrize(("width", "limit"), [(1 << 16, 1000), (64, 0)])
def test_lifted_like_a_walk_over_bases(spark, chain_file, width, limit):
    path, bases = chain_file
    rng = random.Random(9)
    spans = [(i, rng.choice(["chr1", "chr1", "chr2", "chr3"]), s, s + rng.choice([1, 5, 30, 200, 1500])) for i in range(400) for s in [rng.randint(0, 4200)]]
    spans += [(900, "chr1", 50, 50), (901, None, 1, 5), (902, "chr2", None, 7), (903, "chr1", 150, 160), (904, "chr1", 150, 160)]
    rows = lift.lifted(spark.createDataFrame(spans, SPANS), lift.read_chains(spark, path), 0.7, width, limit).collect()
    got = {r["id"]: tuple(r)[4:] for r in rows}
    assert len(rows) == len(spans)
    want = plain([s for s in spans if None not in s], bases, 0.7) | {i: ("deleted", None, None, None, None, 0.0) for i in (901, 902)}
    assert got.keys() == want.keys()
    assert all(got[i][:5] == want[i][:5] and abs(got[i][5] - want[i][5]) < 1e-9 for i in want)
    assert {s for s, *_ in want.values()} >= {"lifted", "deleted", "partly deleted"} and {w[4] for w in want.values()} == {True, False, None}


def test_split_over_two_chains_and_odd_tables(spark, chain_file, tmp_path):
    blocks = spark.createDataFrame([("1", 5.0, "a", 0, 50, "x", 0, False), ("2", 9.0, "a", 50, 100, "y", 0, True)], "chain string, score double, chrom string, start long, end long, to_chrom string, to_start long, flip boolean")
    got = {r["id"]: tuple(r)[4:] for r in lift.lifted(spark.createDataFrame([(1, "a", 25, 75), (2, "a", 40, 50), (3, "a", 60, 70)], SPANS), blocks).collect()}
    assert got == {1: ("split", None, None, None, None, 1.0), 2: ("lifted", "x", 40, 50, False, 1.0), 3: ("lifted", "y", 30, 40, True, 1.0)}
    tie = lift.lifted(spark.createDataFrame([(1, "a", 25, 75)], SPANS), blocks, 0.5).first()
    assert (tie["to_chrom"], tie["to_start"], tie["to_end"]) == ("y", 25, 50)
    assert lift.lifted(spark.createDataFrame([], SPANS), blocks).count() == 0
    odd = spark.createDataFrame([("a", 40, 50, "old", 7)], "chrom string, start long, end long, status string, `a.b` long")
    assert lift.lifted(odd, blocks).first().asDict() == {"chrom": "a", "start": 40, "end": 50, "a.b": 7, "status": "lifted", "to_chrom": "x", "to_start": 40, "to_end": 50, "flip": False, "share": 1.0}
    assert lift.lifted(spark.createDataFrame([(1, "a", 25, 75)], SPANS), blocks.limit(0)).first()["status"] == "deleted"
    wrong = tmp_path / "wrong.chain"
    wrong.write_text("chain 1 a 90 + 0 50 b 90 + 0 40 7\n20 5 0\n20\n")
    with pytest.raises(Exception, match="span of chain 7"):
        lift.read_chains(spark, str(wrong)).collect()


READS = "row long, cell string, name string, chrom string, five long, reverse boolean, score int, flag int"


def test_copies_like_plain_loops(spark):
    rng = random.Random(3)
    rows = []
    for i in range(700):
        cell, name = rng.choice(["a", "a", "b", None]), f"r{i}" if i % 50 else None
        for mate in range(rng.choice([1, 2, 2])):
            placed = rng.random() > 0.1
            rows.append((cell, name, rng.choice(["chr1", "chr2"]) if placed else None, rng.randint(0, 3) if placed else None, rng.random() < 0.5, rng.randint(0, 3), 1 | (0 if placed else 4) | (64 << mate)))
            if rng.random() < 0.1:
                rows.append((cell, name, "chr2", 99, False, 50, 1 | 0x100))
    rows += [("hot", f"h{i:05}", "chr1", 7, False, 1, 0) for i in range(3000)]
    rows = [(i, *r) for i, r in enumerate(rows)]
    fragments = {}
    for _, cell, name, chrom, five, reverse, score, flag in rows:
        if name is not None and chrom is not None and not flag & (0x900 | 4):
            ends, total = fragments.get((cell, name), ((), 0))
            fragments[cell, name] = (tuple(sorted([*ends, (chrom, five, reverse)])), total + score)
    best, paired = {}, {(c, e) for (c, _), (ends, _) in fragments.items() if len(ends) > 1 for e in ends}
    for (cell, name), (ends, score) in fragments.items():
        best[cell, ends] = min(best.get((cell, ends), (1, "")), (-score, name))
    stay = {(c, n) for (c, n), (ends, _) in fragments.items() if best[c, ends][1] == n and not (len(ends) == 1 and (c, ends[0]) in paired)}
    want = {r[0]: (r[1], r[2]) in fragments and (r[1], r[2]) not in stay and r[3] is not None and not r[7] & 4 for r in rows}
    marks = duplicates.marked(spark.createDataFrame(rows, READS))
    assert {r["row"]: r["duplicate"] for r in marks.collect()} == want
    assert 0 < sum(want.values()) < len(rows)
    hot = {r["cell"]: (r["reads"], r["duplicates"]) for r in duplicates.metrics(marks).collect()}
    assert hot["hot"] == (3000, 2999)
    assert duplicates.marked(spark.createDataFrame([], READS)).count() == 0


def test_unclipped_ends(spark):
    rows = spark.createDataFrame([(10, 20, False, 3, 4), (10, 20, True, 3, 4)], "s long, e long, r boolean, a int, b int")
    assert [r[0] for r in rows.select(duplicates.five_prime(*[rows[c] for c in "serab"])).collect()] == [7, 23]
