"""Operator 12 against the library, and its lookahead against all continuations."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import struct
import unicodedata

import pytest

from genoframe.llm import word_bpe

SHA = lambda b: hashlib.sha256(b).hexdigest()
POOL = [*"abcdefghstmvlrdABCDEIS0123456789 '!?.,;-_#$%&<>|\n\t", "'s", "'re", "'LL", "<|endoftext|>", "<|startoftext|>", "<|", "Σ", "İ", "ß", "é", "́", "̣", "가", "ᄀ", "ᅡ", "ᆨ", "ꟋꟌ", "Ᲊ", "՘", "一", "語", "😀", "👍🏽", "\x85", "\xa0", "​", "\x1c", "\x00", "²", "Ⅷ", "٣", "क्ष", "ో", "ﬁ", "Å", "࢙", "఼", "𐐀"]


@pytest.fixture(scope="module")
def codec():
    return word_bpe.codec(word_bpe.vocabulary_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_bpe.vocabulary_path())


def plain_ids(library, text: str) -> list[int]:
    return library.encode(text, add_special_tokens=False).ids


def test_random_texts(codec, library):
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(POOL) for _ in range(rng.randint(0, 40)))
        ids = plain_ids(library, text)
        assert codec.encode(text) == ids, ascii(text)
        speller = word_bpe.Speller(codec)
        spelled = "".join(speller.push([i]) for i in ids) + speller.close()
        assert spelled == library.decode(ids, skip_special_tokens=False)
        assert codec.digest(text) == (len(ids), SHA(struct.pack(f"<{len(ids)}I", *ids)), SHA(spelled.encode()))
    for _ in range(4000):
        text = "".join(chr(rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x110000), rng.randrange(0x300, 0x370), rng.randrange(0x900, 0xE00)])) for _ in range(rng.randint(0, 12)))
        assert codec.encode(text) == plain_ids(library, text), ascii(text)


def test_every_character(codec, library):
    """Each character after a letter and after a symbol: kinds, case and normalization are the library's."""
    for start in range(0, 0x110000, 0x4000):
        chars = [chr(c) for c in range(start, start + 0x4000) if not 0xD800 <= c < 0xE000]
        for text in (" ".join("a" + c for c in chars), " ".join("!" + c for c in chars)):
            assert codec.encode(text) == plain_ids(library, text), hex(start)


def test_long_words_in_slices(codec, library, monkeypatch):
    monkeypatch.setattr(word_bpe, "SLICE", 50)
    rng = random.Random(6)
    for k in range(150):
        letters = ["abcdeéI", "!'.,-sdlrev", POOL][k % 3]
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 6000)))
        assert codec.encode(text) == plain_ids(library, text), ascii(text[:99])
    text = "exhilarating" * 3000 + " " + "ab'" * 3000 + "日本" * 3000
    assert codec.encode(text) == plain_ids(library, text)


def test_transducer_in_any_pieces_holds_little(codec):
    rng = random.Random(7)
    data = "".join(rng.choice(["exhilar", "ating", "the", "q", "é"]) for _ in range(6000)).encode()
    want = codec.merged([*(codec.inner[b] for b in data[:-1]), codec.final[data[-1]]])
    for size in (1, 700, 5000, len(data)):
        machine, got = word_bpe.Transducer(codec), []
        for at in range(0, len(data), size):
            got += machine.push(data[at : at + size])
            assert len(machine.held) <= codec.block + 1
        assert got + machine.close() == want


def plain_merge(merges, symbols):
    symbols = list(symbols)
    for u, v in merges:
        i = 0
        while i < len(symbols) - 1:
            if (symbols[i], symbols[i + 1]) == (u, v):
                symbols[i : i + 2] = [u + v]
            i += 1
    return symbols


def test_lookahead_is_sufficient_for_all_continuations():
    rng, reached = random.Random(8), []
    for _ in range(25):
        tokens, merges = ["a", "b"], []
        while len(merges) < 7:
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens and len(u + v) < 8:
                tokens.append(u + v)
                merges.append((u, v))
        bound, worst = word_bpe.lookahead(merges), 0
        for _ in range(40):
            start = "".join(rng.choice("ab") for _ in range(14))
            ends = []
            for tail in itertools.chain.from_iterable(itertools.product("ab", repeat=n) for n in range(6)):
                at = list(itertools.accumulate(map(len, plain_merge(merges, start + "".join(tail)))))
                ends.append({e for e in at if e <= 14})
            for e in range(15):  # a token's end that only some continuations have
                if any(e in x for x in ends) and not all(e in x for x in ends):
                    worst = max(worst, 14 - e)
                    break
        assert worst <= bound
        reached.append(worst > 1)
    assert any(reached)
    with pytest.raises(ValueError):
        word_bpe.lookahead([("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")])


def test_plain_text_of_ids(codec):
    text = "The naïve 😀 don't"
    speller = word_bpe.Speller(codec, plain=True)
    ids = codec.encode(text)
    assert "".join(speller.push([i]) for i in ids) + speller.close() == " ".join(re.findall(r"'t|[^\W\d_]+|[^\s\w]+", unicodedata.normalize("NFC", text).lower()))
    assert speller.push([None, -1, 10**6, ids[0]]) == "the"
    cut = codec.encode("😀")
    half = next(i for i in range(len(codec.tokens)) if codec.bytes[i] == "😀".encode()[:2])
    speller.close()
    assert speller.push([half]) == "" and speller.close() == "�" and cut


@pytest.mark.parametrize("kind", ["long", "string"])
def test_tables(spark, library, kind):
    texts = ["The cat's paw", None, "", " \n ", "x" * 9000 + " end", "word " * 70_000, "The cat's paw", "<|endoftext|>a"]
    ids = [None if n == 3 else n if kind == "long" else f"id{n}" for n in range(len(texts))]
    docs = spark.createDataFrame([(i, t, "z", 1, "c") for i, t in zip(ids, texts, strict=True)], f"doc_id {kind}, text string, ids string, `a.b` int, n_tokens string")
    want = []
    for i, t in zip(ids, texts, strict=True):
        got = plain_ids(library, t or "")
        want.append((i, len(got), SHA(struct.pack(f"<{len(got)}I", *got)), SHA(library.decode(got, skip_special_tokens=False).encode())))
    key = lambda r: (str(r[0]), r[2])
    assert sorted(map(tuple, word_bpe.digests(docs).collect()), key=key) == sorted(want, key=key)
    encoded = word_bpe.encode(docs)
    assert sorted((tuple(r) for r in encoded.collect()), key=str) == sorted(((i, plain_ids(library, t or "")) for i, t in zip(ids, texts, strict=True)), key=str)
    assert sorted((r["text"] for r in word_bpe.decode(encoded).collect())) == sorted(library.decode(plain_ids(library, t or ""), skip_special_tokens=False) for t in texts)
    assert word_bpe.digests(docs.limit(0)).count() == 0
