"""The corpus pipeline against a restatement in plain Python: no Spark, no function of an operator."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest

from genoframe.llm import line_dedup, quality_rules, sentencepiece_bpe
from genoframe.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def number(text: str) -> int:
    return int(md5(text)[:15], 16)


# --- The stages, plainly: rows are dictionaries ----------------------------------------------------------------------


def features(text) -> dict:
    own = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(own[i : i + 8]) for i in range(len(own) - 7)]
    often = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    return {"n_words": len(own), "word_chars": sum(map(len, own)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines), "n_repeat_words": len(repeated)}


def values(f: dict) -> dict:
    return {"symbols": f["n_symbols"] / f["word_chars"] if f["word_chars"] else 0, "dup_lines": f["n_dup_lines"] / f["n_lines"] if f["n_lines"] else 0, "repeats": f["n_repeat_words"] / f["n_words"] if f["n_words"] else 0}


def keep_quality(docs: list[dict], labels: list[tuple], seen: dict) -> list[dict]:
    good = {}
    for i, q in labels:
        if i is not None and q is not None:
            good[i] = max(q, good.get(i, 0))
    made = [(r, features(r["text"])) for r in docs]
    passed = [(r, f) for r, f in made if f["n_words"] >= 20 and 100 * f["n_repeat_words"] <= 30 * f["n_words"]]
    stratum = lambda r: "" if r["lang"] is None else "=" + r["lang"]
    draws = defaultdict(list)
    for r, f in passed:
        if r["doc_id"] in good:
            draws[r["doc_id"]].append((stratum(r), *f.values(), good[r["doc_id"]]))
    by_stratum = defaultdict(list)
    for rows in draws.values():
        s, *counts, g = min(rows)
        by_stratum[s].append((values(dict(zip(features(""), counts, strict=True))), g))
    tests = len(by_stratum) * len(quality_rules.CUTOFFS)
    cut = {}
    for s, drawn in by_stratum.items():
        n = sum(g for _, g in drawn)
        for rule, cutoffs in quality_rules.CUTOFFS.items():
            fine = []
            for step, c in enumerate(cutoffs):
                k = sum(g for v, g in drawn if v[rule] > c)
                bad = sum(1 - g for v, g in drawn if v[rule] > c)
                tail = sum(comb(n, i) * quality_rules.RISK**i * (1 - quality_rules.RISK) ** (n - i) for i in range(k + 1))
                if n == 0 or k >= n * quality_rules.RISK or tail > quality_rules.DELTA / tests:
                    break
                if bad > k:
                    fine.append((bad - k, -step, c))
            if fine:
                cut[s, rule] = max(fine)[2]
    seen.update(cut)
    return [r for r, f in passed if all(v <= cut.get((stratum(r), rule), v) for rule, v in values(f).items())]


def dedup_lines(docs: list[dict]) -> list[dict]:
    gram, window = line_dedup.GRAM, line_dedup.WINDOW
    texts = {(r["doc_id"] is not None, r["doc_id"] or 0, number(r["text"])): r["text"] for r in docs if r["text"]}
    lines = {d: [(number(x), len(words(x))) for x in t.split("\n")] for d, t in texts.items()}
    prints = {}
    for d, ls in lines.items():
        at = list(itertools.accumulate((n for _, n in ls), initial=0))
        full = [p for p, (_, n) in enumerate(ls) if n]
        grams = []
        for i, p in enumerate(full):
            held = list(itertools.takewhile(lambda q: at[q] < at[p] + gram, full[i:]))
            if sum(ls[q][1] for q in held) >= gram:
                grams.append((number(",".join(str(ls[q][0]) for q in held)), p))
        prints[d] = sorted({min(itertools.takewhile(lambda x: at[x[1]] < at[p] + window, grams[i:])) for i, (_, p) in enumerate(grams)}, key=lambda x: x[1])
    first, aligned = {}, set()
    for d in sorted(prints):
        last = {}
        for g, p in prints[d]:
            if g in last:
                aligned.add((d, d, last[g] - p))
            else:
                d0, p0 = first.setdefault(g, (d, p))
                if d0 != d:
                    aligned.add((d, d0, p0 - p))
            last[g] = p
    gone = defaultdict(set)
    for d, d0, shift in aligned:
        run = []
        for p in range(len(lines[d]) + 1):
            q = p + shift
            if p < len(lines[d]) and 0 <= q < len(lines[d0]) and lines[d][p][0] == lines[d0][q][0]:
                run.append(p)
                continue
            if sum(lines[d][x][1] for x in run) >= gram:
                gone[d].update(run)
            run = []
    out = []
    for r in docs:
        deleted = gone.get((r["doc_id"] is not None, r["doc_id"] or 0, number(r["text"])), ())
        text = "\n".join(x for i, x in enumerate(r["text"].split("\n")) if i not in deleted)
        if not deleted or words(text):
            out.append(r | {"text": text, "n_chars": len(text)})
    return out


def near_duplicates(docs: list[dict]) -> list[dict]:
    least = {}
    for r in docs:
        i, t = r["doc_id"], r["text"]
        if words(t) and (t not in least or i is not None and (least[t] is None or i < least[t])):
            least[t] = i
    sets = {t: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for t in least for w in [words(t)]}
    group = {t: {t} for t in least}
    for a, b in itertools.combinations(least, 2):
        x, y = sets[a], sets[b]
        if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)) or group[a] is group[b]:
            continue
        common = len(x & y)
        if 5 * common >= 4 * (len(x) + len(y) - common):
            both = group[a] | group[b]
            group.update(dict.fromkeys(both, both))
    chosen = {min((least[t] is None, least[t] or 0, md5(t)) for t in g) for g in group.values()}
    out, done = [], set()
    for r in docs:
        key = (r["doc_id"] is None, r["doc_id"] or 0, md5(r["text"]))
        if not words(r["text"]) or key in chosen and key not in done:
            done.add(key)
            out.append(r)
    return out


def mix(docs: list[dict]) -> list[dict]:
    size = {id(r): len(words(r["text"])) for r in docs}
    sources = defaultdict(list)
    for r in docs:
        sources[r["source"] is None, r["source"] or ""].append(r)
    total = {s: sum(size[id(r)] for r in rows) for s, rows in sources.items()}
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(sorted(sources))}
    budget, target, free = sum(total.values()), {}, set(sources)
    while free:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > 3 * total[s]}
        target.update({s: 3 * total[s] if s in above else weight[s] * level for s in above or free})
        free -= above or free
    passes = []
    for s, rows in sources.items():
        done = 0
        for turn in range(3):
            for k, n, r in sorted(((md5("null" if r["doc_id"] is None else str(r["doc_id"])), size[id(r)], r) for r in rows), key=lambda x: x[:2]):
                if n and target[s] and done < target[s]:
                    passes.append(((done + n) / target[s], k, n, turn, r))
                done += n
    out, used = [], 0
    for *_, n, _, r in sorted(passes, key=lambda x: x[:4]):
        used += n
        if used > budget:
            break
        out.append(r)
    return out


# --- Given documents and planted ones ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def planted(spark, small, tmp_path_factory):
    """sf0.001 and copies, near copies, shared passages, odd rows, and a stratum that labels certify a cutoff for."""
    rng = np.random.default_rng(11)
    some = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    docs = [tuple(r) for r in table(spark, small, "documents").select(COLUMNS).collect()]
    labels = [tuple(r) for r in table(spark, small, "labels").select("doc_id", "quality").collect()]
    add = lambda i, t, lang="en", source="a": docs.append((i, t, lang, source, None if t is None else len(t)))
    for k in range(12):  # near copies of planted texts and exact copies of given ones
        base = some(120).split()
        for c in range(3):
            add(20_000 + 10 * k + c, " ".join(base[: 60 + c] + [f"x{c}"] + base[61 + c :]), source="abc"[c])
        add(21_000 + k, docs[k][1], docs[k][2], docs[k][3])
    add(None, docs[3][1], "en", "b")
    passage, inside = "\n".join(some(8) for _ in range(8)), some(60)
    add(22_000, "\n".join([some(30), passage, some(30)]))
    add(22_001, "\n".join([some(9), some(40), passage, some(30)]), source=None)
    add(22_002, "\n".join([some(30), passage, some(400), passage]), "qq", "z")  # again within the document
    add(22_003, passage)  # nothing is left of it
    add(None, "\n".join([some(33), passage]), "de", "b")  # null ids come first: this one keeps the passage
    add(None, some(41), None, None)
    add(22_004, f"{some(20)} {inside} {some(20)}")  # a passage inside lines, which whole lines do not show
    add(22_005, f"{some(25)} {inside} {some(15)}")
    for i, t in enumerate([None, "", " \n\t ", some(19), "again and " * 30, some(8000) + "\n" + some(9000)]):
        add(23_000 + i, t, ["en", None][i % 2], ["a", None][i % 2])
    for n in (22, 24, 26):  # one id, three texts, one of them in two equal rows
        add(24_000, some(n), "fr", "c")
    docs.append(docs[-1])
    for i in range(260):
        bad = i % 13 == 0
        add(30_000 + i, some(20 + i % 9) + (" #$%&*" * 12 if bad else " &" * (i % 3)), "xx", "abcdz"[i % 5])
        labels += [(30_000 + i, int(not bad))] + [(30_000 + i, None)] * (i % 7 == 0)
    labels += [(None, 1), (24_000, 1), (22_005, 0)]
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(docs, table(spark, small, "documents").select(COLUMNS).schema).repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, [dict(zip(COLUMNS, d, strict=True)) for d in docs], labels, set(passage.split("\n"))


def rows(docs) -> Counter:
    return Counter(tuple(r[c] for c in COLUMNS) for r in docs)


def test_stages_and_run_against_plain_python(spark, planted):
    import corpus_pipeline as cp

    folder, docs, labels, passage = planted
    cutoffs: dict = {}
    plain = [lambda d: keep_quality(d, labels, cutoffs), dedup_lines, near_duplicates, mix]
    schema = table(spark, folder, "documents").schema
    kept = [docs]
    for (name, stage), restated in zip(cp.STAGES[:-1], plain, strict=True):
        frame = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in kept[-1]], schema)
        got = stage(spark, frame, folder)
        kept.append(restated(kept[-1]))
        assert got.columns == COLUMNS
        assert rows(got.collect()) == rows(kept[-1]), name

    quality, lined, unique, mixed = ({r["doc_id"]: r["text"] for r in k} for k in kept[1:])
    assert ("=xx", "symbols") in cutoffs and not {30_000 + i for i in range(0, 260, 13)} & set(quality)
    assert {22_000, 22_001, 22_002} <= set(lined) and 22_003 not in lined
    assert not any(passage & set(lined[i].split("\n")) for i in (22_000, 22_001, 22_002))
    assert [i for i in range(20_000, 20_120) if i in unique] == list(range(20_000, 20_120, 10))
    assert max(Counter(r["doc_id"] for r in kept[-1] if r["doc_id"] not in (None, 24_000)).values()) <= 3 and set(mixed) <= set(unique)

    sp = sentencepiece_bpe.encoder(sentencepiece_bpe.model_path()).sp
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for r in kept[-1]:
        ids = sp.encode(r["text"], add_eos=True)
        want[r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))] += 1
    got = cp.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert Counter(tuple(r) for r in got.collect()) == want
