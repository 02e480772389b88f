"""The training-data operators: against DuckDB, brute force, round trips and held-out accuracy; and edge cases."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from genoframe.llm import catalog, html_extract, jaccard_join, line_dedup, media, mixing, quality_rules, sentencepiece_bpe, subword, warc
from genoframe.llm.common import WORD, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k string, _d string"
LONG = "word " * 60_000
ODD = [(1, None, None, None, None, "x", "y"), (2, "", "en", "a", 0, None, "y"), (3, " \n\t ", "en", "a", 4, "x", None), (None, "no id here", "de", None, 10, "x", "y"), (4, LONG, "en", "b", len(LONG), "x", "y"), (5, "same text " * 20, "en", "a", 200, "x", "y"), (5, "same text " * 20, "en", "a", 200, "x", "y"), (6, "same text " * 20, "fr", "c", 200, "x", "y")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (6, None, 1), (None, 0, 1), (2, 0, None), (2, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(same, name):
    same(catalog.QUERIES[name], catalog.ORACLES[name])


def test_odd_rows_and_empty_tables(odd, none, labels):
    """Every document operator: nulls, blanks, a very long text, repeats, clashing columns, and no rows at all."""
    runs = {
        "mix": mixing.mix_plan,
        "rules": lambda d: quality_rules.quality_rules(d, labels),
        "lines": line_dedup.dedup_lines,
        "join": jaccard_join.jaccard_groups,
        "ids": sentencepiece_bpe.digests,
        "media": media.to_media,
        "toxic": lambda d: subword.scored(d, labels, "toxic", subword.TOXICITY, 4, 2),
        "quality": lambda d: subword.scored(d, labels, "quality", subword.QUALITY, 5, 0),
    }
    for name, run in runs.items():
        assert run(odd).count() == len(ODD), name
        assert run(none).count() == 0, name
    assert mixing.mix(odd).columns == odd.columns
    assert quality_rules.keep_documents(odd, labels).columns == odd.columns
    assert sorted(r["doc_id"] or -1 for r in jaccard_join.keep_first(odd).collect()) == [-1, 1, 2, 3, 4, 5]


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://a/x", ""), (3, "nonsense", "<p>open <b>text<br>more &amp; more"), (None, "http://a/y", "<script>x</p>"), (4, "http://a/z", "<div>" * 300 + "deep"), (4, "http://a/z", "<div>" * 300 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.extract(pages).toPandas()
    assert sorted(got["text"]) == ["", "", "", "deep", "deep", "open text more & more"]
    assert html_extract.extract(pages.limit(0)).count() == 0
    assert warc.leaves(warc.to_records(pages)).count() == len(rows)
    assert warc.leaves(warc.to_records(pages.limit(0))).count() == 0


def test_mix_meets_targets(spark, small):
    got = mixing.mix_plan(table(spark, small.replace("0.001", "0.01"), "documents")).join(table(spark, small.replace("0.001", "0.01"), "documents").select("doc_id", "source"), "doc_id").toPandas()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), largest=("size", "max"), size=("source_size", "first"))
    assert ((by["taken"] - by["target"]).abs() <= by["largest"]).all()
    assert (got["taken"] <= 3 * got["size"]).all() and by["target"].sum() == pytest.approx(by["size"].sum())


def test_binomial_tail(spark):
    from math import comb

    from pyspark.sql import functions as F

    cases = [(100, 0), (400, 3), (1000, 2), (50, 10)]
    got = spark.createDataFrame(cases, "n long, k long").select(quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.02)).collect()
    for (n, k), (p,) in zip(cases, got, strict=True):
        exact = sum(comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(k + 1))
        assert p == pytest.approx(1.0 if k >= n * 0.02 else exact)


def test_passages_of_fifty_words(spark):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    lines = lambda k, n: [text(n) for _ in range(k)]
    passage, one = lines(9, 7), text(55)
    rows = [(1, "\n".join(lines(4, 8) + passage + lines(3, 9))), (2, "\n".join(lines(2, 5) + passage + [one])), (3, "\n".join([one] + lines(2, 30))), (4, "\n".join(lines(12, 6)))]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["_n_deleted"] for i in (1, 2, 3, 4)] == [0, 9, 1, 0]
    assert got[2]["text"].split("\n") == rows[1][1].split("\n")[:2] + [one]


def test_join_against_brute_force(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    rng = np.random.default_rng(2)
    for k in range(40):  # near copies with one to twelve replaced words
        words = docs[k % 20][1].split()
        for at in rng.integers(0, len(words), k % 12 + 1):
            words[at] = f"x{at}"
        docs.append((10_000 + k, " ".join(words)))
    docs.append((20_000, docs[0][1]))
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in docs for w in [re.findall(WORD, t)]}
    texts = dict(docs)
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    group, links = {i: i for i in texts}, dict.fromkeys(texts, 0)
    reps = sorted(first.values())
    for a, b in itertools.combinations(reps, 2):
        common = len(sets[a] & sets[b])
        if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
            links[a], links[b] = links[a] + 1, links[b] + 1
            low, high = sorted((group[a], group[b]))
            group = {i: low if g == high else g for i, g in group.items()}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (300_000, 500):  # one block, and many
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_groups(frame, block=block).collect()}
        assert got == {i: (group[first[t]], links[first[t]]) for i, t in texts.items()}


def test_null_and_repeated_ids(spark):
    """No group is lost and no source overshoots when ids are null or repeated."""
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [(None, text(i), "en", "a", i) for i in range(5)] + [(7, text(i), "en", "b", i) for i in range(5, 9)]
    rows += [(None, text(1), "en", "c", 1), (8, text(2) + " more", "en", "c", 2), (7, text(5), "en", "b", 5), (1, "", "en", "a", 0), (1, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = jaccard_join.keep_first(docs).collect()
    texts = [text(i) for i in range(9) if i != 2] + [text(2) + " more"]
    assert sorted(r["text"] for r in got if r["text"]) == sorted(texts)
    assert sorted(r["doc_id"] for r in got if r["doc_id"]) == [1, 1, 7, 7, 7, 7, 8]
    words = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [([None, 3][i % 2], words(i, 10 + i % 7), "en", "abc"[i % 3], i) for i in range(60)] + [(3, words(99, 12), "en", "a", 99)] * 4
    docs = spark.createDataFrame(rows, docs.schema)
    plan, mixed = mixing.mix_plan(docs).collect(), mixing.mix(docs).collect()
    assert len(mixed) == sum(r["taken"] // r["size"] for r in plan)
    assert sum(len(r["text"].split()) for r in mixed) == sum(r["taken"] for r in plan)
    assert max(len(list(g)) for _, g in itertools.groupby(sorted(r["n_chars"] for r in mixed if r["n_chars"] < 99))) <= 3


def test_banding_recall():
    bands, rows = jaccard_join.banding(0.8, 0.9995)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9995


def test_sentencepiece_equals_library(spark, small):
    enc = sentencepiece_bpe.encoder(sentencepiece_bpe.model_path())
    texts = [r["text"] for r in table(spark, small, "documents").select("text").collect()]
    rng = np.random.default_rng(0)
    parts = [" ", "  ", "\n", "\t", "▁", "a", "é", "the", "ing", "中", "😀", "\x00", "1", "00", "=====", "</s>", "<0x0A>", "   ", "ß"]
    texts += ["".join(rng.choice(parts, rng.integers(0, 16))) for _ in range(3000)] + ["", "x" * 5000, " " * 300]
    for t in texts:
        ids = enc.sp.encode(t, add_eos=True)
        assert enc.encode(t) == ids and enc.decode(ids) == enc.sp.decode(ids)


@pytest.mark.parametrize("data", [b"", b"a", b"\xff" * 200, bytes(range(256)) * 70, np.random.default_rng(0).bytes(30_000)])
def test_avi_round_trip(data):
    padded = media.pad(data)
    frames, payload, seconds = media.decode_avi(media.encode_avi(padded))
    assert payload == padded and seconds == 0.04 and frames.shape[2] == 64


def test_other_huffman_tables():
    """A table with other code lengths takes the code-by-code path."""
    body = bytes([0, 0, 0, 9] + [0] * 12) + bytes(range(9))
    bits = "0001" + "1" + "0010" + "01" + "0000"
    data = np.packbits([int(b) for b in bits.ljust(16, "1")]).tobytes()
    assert media.differences(data, body, 3).tolist() == [1, -2, 0]


def test_shots():
    frames = np.concatenate([np.full((9, 64, 64), v, np.uint8) for v in (10, 90, 200)])
    assert media.shot_starts(frames) == [0, 9, 18]
    clips = media.clip_rows(media.encode_avi(frames.tobytes()))
    assert [(c[1], c[2]) for c in clips] == [(0.0, pytest.approx(0.36)), (pytest.approx(0.36), pytest.approx(0.72)), (pytest.approx(0.72), pytest.approx(1.08))]
    assert media.clip_rows(b"junk") == media.clip_rows(None) == []


def test_wrapper_drops_template_without_semantic_tags(spark):
    page = "<html><body><div><div><p>Always the same words here</p></div><div><a href=x>Home</a> <a href=y>About us</a></div><div><h2>Title {0}</h2><p>Own text {0} of the page</p><p>And more {0}</p></div></div></body></html>"
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", page.format(i * 17)) for i in range(12)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got[3] == "Title 51 Own text 51 of the page And more 51"


def test_wrapper_of_a_host_made_of_copies(spark):
    """The share of pages that have a text is one of distinct pages, and exact."""
    page = "<div><p>Always the same words here</p></div><div>{1}</div><div><h2>Title {0}</h2><p>Own text {0}</p></div>"
    notes = lambda i: "Seen on most" if i % 5 else f"Other {i}"
    rows = [(i, f"http://h.example/{i}", page.format(i * 17, notes(i))) for i in range(500)]
    rows += [(1000 + k, f"http://h.example/c{k}", rows[3][2]) for k in range(4000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got[3] == got[1000] == got[4999] == "Title 51 Own text 51"
    assert all(got[i] == ("" if i % 5 else f"Other {i} ") + f"Title {i * 17} Own text {i * 17}" for i in range(500))


def test_deeply_nested_pages(spark):
    """Thousands of open blocks, with texts all the way down, as reference of a host and as its odd page."""
    deep = "".join(f"<{('div', 'center')[i % 2]}>t{i} " for i in range(6000))
    rows = [(i, f"http://a/{i}", deep + str(i)) for i in range(6)] + [(6, "http://a/6", "<p>plain"), (7, "http://b/0", "<p>plain")]
    rows += [(8 + i, f"http://b/{i}", f"<p>own {i}") for i in range(2)] + [(10, "http://b/9", "<div>" * 20_000 + "far down")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "t5999 3"  # six of seven pages of the host share the texts above it
    assert got[6] == got[7] == "plain" and got[8] == "own 0" and got[10] == "far down"
    tree = html_extract.parse("<div><p>a</p><p>b</p><ul><li>c</li></ul></div><div><p>d</p><ul><li>e</ul></div><h1>f</h1>")
    text = html_extract.written(html_extract.shape(tree))
    assert text == "html(div(p,ul(li)),h1)" == html_extract.written(html_extract.read_shape(text))
    assert [(at, t) for at, _, t, _ in html_extract.blocks(tree)] == [(2, "a"), (2, "b"), (4, "c"), (2, "d"), (4, "e"), (5, "f")]


def test_simple_tree_matching():
    a, b = html_extract.read_shape("d(a,b(x),c)"), html_extract.read_shape("d(a,e,b(x,y))")
    assert html_extract.match(a, b, {})[0] == 4


def test_classifier_holds_out_and_generalises(spark, small):
    folder = small.replace("0.001", "0.01")
    got = catalog.QUERIES["op5_quality_classifier"](spark, folder).join(table(spark, folder, "labels"), "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert ((held["score"] >= 0.5) == held["quality"]).mean() > 0.9
    rng = np.random.default_rng(0)
    plain = ["house", "tree", "river", "stone", "cloud", "green", "table", "window"]
    texts, y = [], []
    for i in range(400):
        words = rng.choice(plain, 40).tolist()
        if i % 4 == 0:
            words[int(rng.integers(40))] = "dreadful"
        texts.append(" ".join(words))
        y.append(int(i % 4 == 0))
    scores = subword.Scorer(subword.fit(texts, y, subword.TOXICITY)).scores(["house dreadfull tree", "river stone", "a dreadfuly day", ""])
    assert scores[0] > 0.5 > scores[1] and scores[2] > 0.5 > scores[3]


def test_warc_round_trip_and_audit(spark, small, tmp_path):
    pages = table(spark, small, "pages")
    records = warc.to_records(pages, per_file=20)
    warc.write_warc(records, str(tmp_path / "w"))
    back = {r["uri"]: (r["digest"], bytes(r["payload"])) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    want = {r["url"]: r["html"].encode() for r in pages.collect()}
    assert {u: p for u, (_, p) in back.items()} == want
    assert all(d == "sha256:" + hashlib.sha256(p).hexdigest() for d, p in back.values())
    leaf = warc.leaves(records)
    assert warc.audit(leaf, leaf).count() == 0
    gone = leaf.where("NOT (file = 1 AND idx = (SELECT 0))")
    assert {r["status"] for r in warc.audit(leaf, gone).collect()} == {"missing"}


def test_pipeline_against_brute_force(spark, small):
    """The five stages one by one, each against a plain restatement on what its predecessor kept."""
    import corpus_pipeline as cp

    docs = {r["doc_id"]: r for r in cp.keep_quality(spark, table(spark, small, "documents"), small).collect()}
    rules = catalog.QUERIES["op9_quality_rules"](spark, small).where("kept").collect()
    assert set(docs) == {r["doc_id"] for r in rules}
    frame = spark.createDataFrame(list(docs.values()), table(spark, small, "documents").schema)
    lined = cp.dedup_lines(spark, frame, small)
    assert lined.columns == frame.columns
    left = {r["doc_id"]: r["text"] for r in lined.collect()}
    assert all(set(t.split("\n")) <= set(docs[i]["text"].split("\n")) and re.search(WORD, t) for i, t in left.items())
    unique = cp.drop_near_duplicates(spark, lined, small)
    ids = {r["doc_id"] for r in unique.select("doc_id").collect()}
    assert ids == {r["class_id"] for r in jaccard_join.jaccard_groups(lined).collect()}
    mixed = cp.mix_sources(spark, unique, small)
    plan = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_plan(unique).collect() if r["taken"]}
    times: dict = {}
    for r in mixed.select("doc_id").collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert times == plan
    final = cp.run(spark, small).toPandas()
    enc = sentencepiece_bpe.encoder(sentencepiece_bpe.model_path())
    assert final["doc_id"].value_counts().to_dict() == times
    for r in final.itertuples():
        ids_ = enc.sp.encode(left[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids_) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids_)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(enc.sp.decode(ids_).encode()).hexdigest()
