"""Values, not counts: ids, other columns, very long texts, repeats and empty tables; and plain restatements."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from genoframe.llm import jaccard_join, line_dedup, media, mixing, quality_rules, sentencepiece_bpe, subword
from genoframe.llm.common import WORD, table

BIG = 2**53 + 1
LONG = " ".join(f"w{i}" for i in range(50_000))
LINES = "\n".join(" ".join(f"l{i}x{j}" for j in range(9)) for i in range(9))
TEXTS = [(BIG, LINES), (None, "no id here " * 9), (BIG + 2, LONG), (BIG + 4, "own line\n" + LINES), (BIG + 6, None), (BIG + 8, ""), (BIG + 10, " \n "), (BIG + 12, LONG + " more"), (None, LINES + "\nend")]
CLASH = "_d _ranges ranges row _n _t _id h k size taken key root score ids kept in media text_id class_id stratum good none id md5 copies times word words lines _words _lines _w bucket a.b text.x".split()


def frame(spark, kind: str):
    """TEXTS with columns of all the names that operators use themselves; ids as numbers or as strings."""
    rows = [(i if kind == "long" or i is None else f"id{i}", t, "en", "ab"[n % 2], 7, *[f"{c}{n}" for c in CLASH]) for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, f"doc_id {kind}, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH))


@pytest.fixture(scope="module", params=["long", "string"])
def docs(spark, request):
    return frame(spark, request.param)


def ids(docs) -> list:
    return [r["doc_id"] for r in docs.collect()]


def by_key(rows) -> dict:
    return {r["k"]: r for r in rows}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(BIG, 1, 0), (BIG + 2, 0, 1)], "doc_id long, quality int, toxic int")


def sorted_rows(rows) -> list:
    return sorted((tuple(r) for r in rows), key=repr)


def test_tokens_and_media_keep_ids(docs):
    sp = sentencepiece_bpe.encoder(sentencepiece_bpe.model_path()).sp
    plain = list(zip(ids(docs), [t or "" for _, t in TEXTS], strict=True))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in plain:
        pieces = sp.encode(t, add_eos=True)
        want.append((i, len(pieces), sha(" ".join(map(str, pieces)).encode()), sha(sp.decode(pieces).encode())))
    assert sorted_rows(sentencepiece_bpe.digests(docs).collect()) == sorted_rows(want)
    encoded = sentencepiece_bpe.encode(docs)
    assert sorted_rows((r["doc_id"], list(r["ids"])) for r in encoded.collect()) == sorted_rows((i, sp.encode(t, add_eos=True)) for i, t in plain)
    assert sorted_rows(sentencepiece_bpe.decode(encoded).collect()) == sorted_rows((i, sp.decode(sp.encode(t))) for i, t in plain)
    stored = media.to_media(docs).collect()
    assert sorted_rows((r["doc_id"], media.decode_avi(r["media"])[1]) for r in stored) == sorted_rows((i, media.pad(t.encode())) for i, t in plain)
    assert {r["doc_id"] for r in media.clips(media.to_media(docs)).collect()} == set(ids(docs))
    assert sorted_rows((r["doc_id"], r["n_bytes"]) for r in media.digests(docs).collect()) == sorted_rows((i, len(t.encode())) for i, t in plain)


def test_scores_keep_ids(spark, labels):
    docs = frame(spark, "long")
    got = subword.scored(docs, labels, "toxic", subword.TOXICITY, 4, 2).collect()
    assert sorted_rows((r["doc_id"],) for r in got) == sorted_rows((i,) for i in ids(docs))
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2) for r in got)
    assert subword.scored(docs.limit(0), labels, "toxic", subword.TOXICITY, 4, 2).collect() == []


def test_join_keeps_ids(docs):
    a, b, c, d = (ids(docs)[i] for i in (0, 2, 3, 7))
    got = {(r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_groups(docs).collect()}
    own = {(i, i, 0) for i in (ids(docs)[n] for n in (4, 5, 6))} | {(None, None, 0)}
    assert got == own | {(a, a, 2), (c, a, 2), (None, a, 2), (b, b, 1), (d, b, 1)}
    kept = by_key(jaccard_join.keep_first(docs).collect())
    assert set(kept) == {f"k{n}" for n in (0, 1, 2, 4, 5, 6)} and jaccard_join.keep_first(docs).columns == docs.columns
    was = by_key(docs.collect())
    assert all(kept[k] == was[k] for k in kept)


def test_lines_keep_columns(docs):
    was, got = by_key(docs.collect()), by_key(line_dedup.dedup_lines(docs).collect())
    want = {k: r["text"] for k, r in was.items()} | {"k0": "", "k3": "own line"}
    first_is_null = {k: want[k] for k in want}  # the row without an id is the first of its kind and keeps its lines
    assert {k: r["text"] for k, r in got.items()} == first_is_null
    for k, r in got.items():
        assert {c: r[c] for c in docs.columns if c != "text"} == {c: was[k][c] for c in docs.columns if c != "text"}
    assert (got["k0"]["_n_lines"], got["k0"]["_n_deleted"], got["k4"]["_n_lines"]) == (9, 9, 0)


def test_rules_and_mix_keep_rows(spark, docs, labels):
    was = {tuple(r) for r in docs.collect()}
    named = labels.withColumn("doc_id", labels["doc_id"].cast(docs.schema["doc_id"].dataType))
    kept = quality_rules.keep_documents(docs, named)
    assert kept.columns == docs.columns and {r["k"] for r in kept.collect()} == {"k0", "k2", "k3", "k7", "k8"}
    mixed = mixing.mix(docs).collect()
    assert {tuple(r) for r in mixed} <= was and max(Counter(r["k"] for r in mixed).values()) <= 3
    assert len({r["doc_id"] for r in mixing.mix_plan(docs).collect()}) == len(set(ids(docs)))


@pytest.mark.parametrize("run", [mixing.mix, line_dedup.dedup_lines, jaccard_join.keep_first, jaccard_join.jaccard_groups, media.digests, media.clips, sentencepiece_bpe.digests, sentencepiece_bpe.encode])
def test_empty_tables(docs, run):
    empty = docs.limit(0)
    assert run(media.to_media(empty) if run is media.clips else empty).collect() == []


def test_mix_takes_a_part_at_the_cut(spark):
    """Sources of one or two documents come near their targets; the mix is as long as its budget."""
    words = lambda n: " ".join(["w"] * n)
    rows = [(1, words(10), "a"), (2, words(30), "b"), (3, words(50), "b"), (4, words(400), "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix_plan(docs, split_last=True).collect()}
    assert sum(r["taken"] for r in got.values()) == 490
    assert all(r["taken"] <= 3 * r["size"] for r in got.values())
    assert abs(got[4]["taken"] - got[4]["target"]) <= 1
    whole = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(docs).collect()}
    assert all(got[i]["taken"] - whole[i] in (0, 220) for i in got)


# --- Classifiers ---------------------------------------------------------------------------------------------------


def plain_buckets(word: str, s) -> list[int]:
    w = ("<" + ((word.strip(subword.STRIP) or word) if s.lower else word) + ">").encode()
    out = [zlib.crc32(w) % s.buckets]
    for n in (3, 4, 5):
        for i in range(len(w) - n + 1):
            number = int.from_bytes(w[i : i + n], "big") | n << 8 * n
            out.append(((number * 0x9E3779B97F4A7C15) % 2**64) >> (64 - s.buckets.bit_length() + 1))
    return out


def plain_words(text: str | None, s) -> list[str]:
    words = ((text or "").lower() if s.lower else text or "").split()
    return words + ["<again>" for a, b in zip(words, words[1:], strict=False) if s.again and a == b]


def plain_score(text: str | None, model) -> float:
    s, words = model.settings, plain_words(text, model.settings)
    share = lambda w: sum(float(model.weights[b]) for b in plain_buckets(w, s)) / len(plain_buckets(w, s))
    if not words:
        logit = 0.0
    elif not s.window:
        logit = sum(map(share, words)) / len(words)
    else:
        logit = max(sum(share(w) for w in set(words[i : i + s.window])) / s.window for i in range(0, len(words), s.window))
    return 1 / (1 + math.exp(-min(30, max(-30, logit + model.bias))))


@pytest.mark.parametrize(("op", "label", "s", "modulus", "held"), [(subword.op1, "toxic", subword.TOXICITY, 4, 2), (subword.op5, "quality", subword.QUALITY, 5, 0)])
def test_scores_against_plain_loops(spark, small, op, label, s, modulus, held):
    """Every document's score once more, by plain loops over words and n-grams, with the model fitted on the same rows."""
    docs = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect()}
    known = {r["doc_id"]: r[label] for r in table(spark, small, "labels").collect() if zlib.crc32(str(r["doc_id"]).encode()) % modulus != held}
    learned = [i for i in sorted(docs) if i in known]
    model = subword.fit([docs[i] for i in learned], [known[i] for i in learned], s)
    got = {r["doc_id"]: r for r in op(spark, small).collect()}
    assert set(got) == set(docs)
    for i in list(docs):
        want = plain_score(docs[i], model)
        assert got[i]["score"] == pytest.approx(want, abs=1e-9) and got[i]["predicted"] == (want >= 0.3)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % modulus == held)


@pytest.mark.parametrize("window", [0, 2, 3])
def test_training_against_plain_loops(window):
    """The trainer once more, a word and an n-gram at a time."""
    s = subword.Settings(lower=False, window=window, buckets=1 << 8, epochs=2, least_steps=1, batch=4, least_docs=2)
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["tree", "river", "stone", "cloud", "idiot", "idiots"], 9)) for _ in range(20)]
    labels = [int("idiot " in t) for t in texts]
    got = subword.fit(texts, labels, s)
    docs = [[list(dict.fromkeys(w[i : i + window])) for i in range(0, len(w), window)] if window else [w] for w in (t.split() for t in texts)]
    seen = Counter(b for d in docs for b in {b for part in d for w in part for b in plain_buckets(w, s)})
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1, 1, (s.buckets, s.size)) / s.size
    for b in range(s.buckets):
        if seen[b] < s.least_docs:
            vectors[b] = 0
    layer = rng.uniform(-1, 1, s.size)
    seen_v, seen_l, seen_b = np.full(s.buckets, 1e-8), np.full(s.size, 1e-8), 1e-8
    share = sum(labels) / len(labels)
    bias, order = math.log(share / (1 - share)), np.arange(len(docs))
    for _ in range(2):
        rng.shuffle(order)
        for at in range(0, len(order), s.batch):
            some = order[at : at + s.batch]
            grad, grad_layer, errors = np.zeros_like(vectors), np.zeros(s.size), []
            for i in some:
                mean = lambda w: np.mean([vectors[b] for b in plain_buckets(w, s)], axis=0)
                by = window or len(docs[i][0])
                logits = [sum(mean(w) @ layer for w in part) / by + bias for part in docs[i]]
                weights = [math.exp(x - max(logits)) for x in logits]
                errors.append(1 / (1 + math.exp(-max(logits))) - labels[i])
                for part, weight in zip(docs[i], weights, strict=True):
                    for w in part:
                        pull = errors[-1] * weight / sum(weights) / by / len(some)
                        grad_layer += pull * mean(w)
                        for b in plain_buckets(w, s):
                            grad[b] += pull / len(plain_buckets(w, s)) * layer * (seen[b] >= s.least_docs)
            touched = sorted({b for i in some for part in docs[i] for w in part for b in plain_buckets(w, s)})
            for b in touched:
                seen_v[b] += (grad[b] ** 2).mean()
                vectors[b] -= s.rate * grad[b] / math.sqrt(seen_v[b])
            seen_l += grad_layer**2
            layer -= s.rate * grad_layer / np.sqrt(seen_l)
            error = float(np.mean(errors))
            seen_b += error**2
            bias -= s.rate * error / math.sqrt(seen_b)
    assert got.bias == pytest.approx(bias, abs=1e-3) and np.allclose(got.weights, vectors @ layer, atol=1e-3)


def test_toxic_documents_held_out(spark, small):
    folder = small.replace("0.001", "0.1")
    got = subword.op1(spark, folder).join(table(spark, folder, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    toxic = got["toxic"] == 1
    assert (got["predicted"][toxic] == 1).mean() >= 0.9 and (got["predicted"][~toxic] == 0).mean() >= 0.99


def test_sample_bytes(spark):
    """Texts that no longer fit are left out, in an order that does not depend on the rows' order."""
    docs = spark.createDataFrame([(i, "x" * (i * 100)) for i in range(1, 11)] + [(3, "x" * 300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 11)], "doc_id long, toxic int")
    from dataclasses import replace

    from pyspark.sql import functions as F

    texts, y = subword.training_sample(docs, labels, "toxic", F.lit(True), replace(subword.TOXICITY, sample_bytes=2000))
    again, _ = subword.training_sample(docs.orderBy(F.desc("doc_id")), labels, "toxic", F.lit(True), replace(subword.TOXICITY, sample_bytes=2000))
    assert texts == again and 900 < sum(map(len, texts)) <= 2000 and len(set(map(len, texts))) == len(texts) == len(y)


# --- Media ---------------------------------------------------------------------------------------------------------


def riff(data: bytes, at: int, end: int):
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4], data[at + 8 : at + 8 + size], at
        at += 8 + size + (size & 1)


def plain_frame(jpeg: bytes) -> list[list[int]]:
    """A lossless JPEG by the standard: Huffman codes bit by bit, predictor 1, first column from above."""
    assert jpeg[:2] == b"\xff\xd8" and jpeg[-2:] == b"\xff\xd9"
    at, codes = 2, {}
    while True:
        marker, size = jpeg[at : at + 2], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body = jpeg[at + 4 : at + 2 + size]
        if marker == b"\xff\xc4":
            counts, symbols, code = body[1:17], list(body[17:]), 0
            for length, n in enumerate(counts, 1):
                for _ in range(n):
                    codes[format(code, f"0{length}b")] = symbols.pop(0)
                    code += 1
                code <<= 1
        elif marker == b"\xff\xc3":
            assert body[0] == 8 and body[5] == 1
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        at += 2 + size
        if marker == b"\xff\xda":
            assert body[3] == 1  # predictor
            break
    bits = "".join(format(b, "08b") for b in jpeg[at:-2].replace(b"\xff\x00", b"\xff"))
    at, rows = 0, []
    for y in range(height):
        row = []
        for x in range(width):
            end = at + 1
            while bits[at:end] not in codes:
                end += 1
            n = codes[bits[at:end]]
            value = bits[end : end + n]
            at = end + n
            d = 0 if not n else int(value, 2) if value[0] == "1" else int(value, 2) - (1 << n) + 1
            row.append(((row[-1] if x else rows[-1][0] if y else 128) + d) & 255)
        rows.append(row)
    return rows


def test_media_contract_by_a_plain_parser(spark, small):
    """All of op4's columns, from the stored files, read by another parser."""
    texts = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect() if len(r["text"]) < 6000}
    docs = table(spark, small, "documents")
    files = {r["doc_id"]: bytes(r["media"]) for r in media.to_media(docs).collect()}
    got = {r["doc_id"]: r for r in media.op4(spark, small).collect()}
    assert set(got) == {r["doc_id"] for r in docs.select("doc_id").collect()} and len(texts) > 150
    for i, text in texts.items():
        data, stored = text.encode(), files[i]
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        (name, body, _), *more = riff(stored, 0, len(stored))
        assert name == b"RIFF" and body[:4] == b"AVI " and not more
        parts = {b[:4] if n == b"LIST" else n: (b, at) for n, b, at in riff(stored, 12, len(stored))}
        movi, start = parts[b"movi"][0], parts[b"movi"][1] + 8
        frames = []
        for entry in range(0, len(parts[b"idx1"][0]), 16):
            kind, _, offset, size = struct.unpack("<4sIII", parts[b"idx1"][0][entry : entry + 16])
            assert kind == b"00dc" and stored[start + offset : start + offset + 4] == kind
            frames.append(plain_frame(stored[start + offset + 8 : start + offset + 8 + size]))
        assert len(frames) == sum(1 for n, _, _ in riff(movi, 4, len(movi)) if n == b"00dc")
        samples = bytes(v for f in frames for row in f for v in row)[: len(payload)]
        assert samples == payload
        hists = [Counter(v >> 4 for row in f for v in row) for f in frames]
        pixels = len(frames[0]) * 64
        diffs = [sum(abs(a[k] - b[k]) for k in range(16)) / pixels / 2 for a, b in zip(hists, hists[1:], strict=False)]
        starts = [0]
        for k, d in enumerate(diffs):
            near = diffs[max(0, k - 8) : k + 9]
            bar = np.mean(near) + 2 * np.std(near)
            if d > max(0.05, bar) and not math.isclose(d, bar):
                starts.append(k + 1)
        want = f"frames={len(frames)};clips={len(starts)};starts={','.join(f'{s * 0.04:.2f}' for s in starts)};mean={np.mean(frames):.3f}"
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stored), hashlib.sha256(stored).hexdigest(), want)


# --- Quality rules -------------------------------------------------------------------------------------------------


def test_certificates_against_sql(spark):
    """Planted strata: null and empty apart, a cutoff that fails and ends its sequence, too few labels, repeated ids."""
    import duckdb

    rng = np.random.default_rng(4)
    rows, marks = [], []

    def add(lang, n, symbols, good, repeat=1):
        for _ in range(n):
            i = len(rows)
            words = [f"w{x}" for x in rng.integers(0, 10**6, 40)]
            for at in range(symbols):
                words[at] += "#" * 10
            rows.extend([(i, " ".join(words), lang, "s", 0)] * repeat)
            marks.append((i, good, 0))

    add("en", 400, 0, 1)
    add("en", 60, 20, 0)  # far over all cutoffs: rejected
    add(None, 400, 0, 1)
    add(None, 50, 4, 0)
    add("", 300, 0, 1)
    add("", 40, 4, 1)  # good ones over the cutoffs: the sequence of "symbols" stops
    add("", 60, 4, 0)
    add("de", 50, 0, 1)  # too few labels
    add("de", 20, 20, 0)
    add("fr", 50, 0, 1, repeat=8)  # many rows, few draws
    add("fr", 20, 20, 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", labels.toPandas())
    got = quality_rules.quality_rules(docs, labels).select(*quality_rules.OUT).toPandas()
    want = con.execute(quality_rules.SQL).df()
    cols = sorted(got.columns)
    got, want = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert got.equals(want)
    whole = quality_rules.quality_rules(docs, labels).join(labels, "doc_id").groupBy("lang", "quality").agg({"kept": "min", "doc_id": "count"}).collect()
    kept = {(r["lang"], r["quality"]): r["min(kept)"] for r in whole}
    assert kept["en", 0] is kept[None, 0] is False and kept["", 0] is kept["de", 0] is kept["fr", 0] is True
    assert all(kept[lang, 1] for lang in ("en", None, "", "de", "fr"))


def test_mix_of_repeated_ids_is_the_plain_queue(spark):
    """A third of the rows without an id, others sharing one, equal rows among them."""
    rng = random.Random(12)
    rows = [(rng.choice([None, None, 1, 2, 7, i]), rng.choice(["a", "b", "b", None]), " ".join(["w"] * rng.choice([0, 1, 5, 5, 30]))) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix_plan(frame, split_last=True).collect()
    assert len(got) == len(rows)
    goal, taken = {r["source_size"]: r["target"] for r in got}, {}
    queue = []
    for source in ("a", "b", None):
        mine = sorted((hashlib.md5(str(i if i is not None else "null").encode()).hexdigest(), len(t.split()), i) for i, s, t in rows if s == source)
        whole, end = sum(n for _, n, _ in mine), 0
        for k, n, i in mine:
            end += n
            queue += [((turn * whole + end) / goal[whole], k, n, turn, whole, i) for turn in range(3) if n and turn * whole + end - n < goal[whole]]
    left = sum(goal_of for goal_of in goal)  # the words of all sources
    for _, _, n, _, whole, i in sorted(queue, key=lambda x: x[:4]):
        taken[whole, i, n] = taken.get((whole, i, n), 0) + min(n, left)
        left -= min(n, left)
    sums = {}
    for r in got:
        key = (r["source_size"], r["doc_id"], r["size"])
        sums[key] = sums.get(key, 0) + r["taken"]
    assert {k: v for k, v in sums.items() if v} == {k: v for k, v in taken.items() if v}
    assert len(mixing.mix(frame).collect()) > 0
