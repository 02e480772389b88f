"""Operator 12: BPE encoding and decoding as a streaming transducer with bounded lookahead.

A merge list decides how far a change at the end of a text can reach back. Take two texts that agree up to some place
and apply the merges in their order: the place up to which both have the same tokens moves back only if a merge
(u, v) takes the last common token u together with a v that just one of the texts has there, and then by len(u). The
token that stands there next begins with u or with uv, so a further move needs a later merge (u', v') whose v' begins
with u down its left side. The greatest sum of len(u) along such a chain of merges is a *sufficient lookahead*:
tokens that end so many bytes before the end of what was read are final, whatever follows. ``lookahead`` finds it in
one pass over the list.

``Transducer`` therefore takes a word in pieces of any size, merges blocks of a few lookaheads, emits the tokens that
are final and keeps the rest; its memory does not depend on the length of a word. ``Speller`` is the way back, a state
machine that takes ids one after the other and gives text as soon as its bytes are whole characters.

Before that, a text is cut where normalization cannot reach across and split into words in one pass. Words recur;
each worker remembers what it made of those of usual length and empties that memory when it is full.

Texts pass through ``mapInArrow`` without a shuffle. Defined cases: null and empty texts have no ids and decode to an
empty text; very long texts and words take time in proportion to their length and memory for one slice of them (a slice
ends where normalization allows it: a run of combining marks is not cut); equal merges go leftmost first, as in the
library; a special token's text in a text is that token, as in the library; repeated rows get equal results; ids of any
type come back as they are; an empty table gives none; other columns are ignored, whatever their names. Decoding skips
null ids and ids that the vocabulary lacks.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame

from genoframe.llm.common import map_texts, table
from genoframe.llm.sentencepiece_bpe import Memory

SLICE = 1 << 16
SHORT = 48

# The steps before the merges that the vocabulary file has to name.
NORMALIZER = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACES = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def lookahead(merges: list[tuple[str, str]], length=len) -> int:
    """The sufficient lookahead of a merge list, in units of ``length``.

    Every token has to come from one merge, and that merge after those of its parts (an error otherwise).
    """
    left, reach, most = {}, {}, 0
    for u, v in merges:
        begins, before = v, 0
        while True:
            before = max(before, reach.get(begins, 0))
            if begins not in left:
                break
            begins = left[begins]
        if u + v in left or u + v in reach:
            raise ValueError(f"two merges make {u + v}, or it is used before it is made")
        left[u + v] = u
        reach[u] = max(reach.get(u, 0), length(u) + before)
        most = max(most, length(u) + before)
    return most


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabularies: itself if it can be seen, else the next one from U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(others)) for b in range(256)]


def char_class(wanted, top: int) -> str:
    """The inside of a regular expression's class of all characters up to ``top`` that ``wanted`` accepts."""
    spans, start = [], None
    for c in range(top + 2):
        inside = c <= top and wanted(chr(c))
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            spans.append(f"\\U{start:08X}-\\U{c - 1:08X}")
            start = None
    return "".join(spans)


class Words:
    """The expressions that find words in texts without characters over ``top``; ``kind_of`` gives a character's category.

    A class of characters is looked up in one step as long as it ends at U+FFFF.
    """

    def __init__(self, kind_of, top: int):
        letter, number = (char_class(lambda c, k=k: kind_of(c)[0] == k, top) for k in "LN")
        symbol = f"[^{SPACES}{letter}{number}]"
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|{symbol}+")
        self.kinds = re.compile(f"[{letter}]*"), re.compile(f"{symbol}*")


@lru_cache(maxsize=1)
def joined_backwards() -> frozenset:
    """Characters that normalization may join to what is before them, though they are no combining marks."""
    second = {chr(c) for c in range(0x1160, 0x1200)}
    for c in range(0xA0, 0x30000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            second.add(chr(int(parts[1], 16)))
    return frozenset(second)


class Codec:
    """A vocabulary file with its merges, the words of a text, their ids and the way back."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, normalizer, splitter = spec["model"], spec["normalizer"], spec["pre_tokenizer"]
        known = [x["type"] for x in normalizer["normalizers"]] == NORMALIZER and splitter["pretokenizers"][0]["pattern"] == {"Regex": SPLIT}
        plain = not any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if not (known and plain and model["type"] == "BPE" and spec["decoder"] is None and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])):
            raise ValueError(f"{path} asks for steps that this encoder does not have")
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.mark, ids = model["end_of_word_suffix"], model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        letters = byte_letters()
        self.inner, self.final = [ids[c] for c in letters], [ids[c + self.mark] for c in letters]
        self.lookahead = lookahead(merges, lambda t: len(t.removesuffix(self.mark)))
        self.block = 4 * self.lookahead
        self.rank = {(ids[u], ids[v]): i for i, (u, v) in enumerate(merges)}
        self.made = [ids[u + v] for u, v in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        tokens = {i: t for t, i in (ids | self.special).items()}
        self.tokens = [tokens.get(i) for i in range(max(tokens) + 1)]
        self.spellings = [(t or "").encode() for t in self.tokens]
        self.width = [len(t.removesuffix(self.mark)) if t else 0 for t in self.tokens]
        value = {c: b for b, c in enumerate(letters)}
        self.bytes = [bytes(value[c] for c in t.removesuffix(self.mark)) if t and t not in self.special else (t or "").encode() for t in self.tokens]
        self.ends = [bool(t) and (t in self.special or t.endswith(self.mark)) for t in self.tokens]
        self.second = joined_backwards()
        self.wide = re.compile("[\U00010000-\U0010FFFF]")
        self.unknown = re.compile(f"[{char_class(lambda c: unicodedata.category(c) == 'Cn' or not self.orders(c), 0xFFFF)}]")
        self.known_words = Words(unicodedata.category, 0xFFFF)
        self.speller = Speller(self)
        self.outlines = Memory(self.outline)

    # Words of a text

    @cached_property
    def all_words(self) -> Words:
        """For texts with characters over U+FFFF or newer than the tables of one side: of those the library is asked."""
        new = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn"]
        starts = lambda before: {at[0] // 3: at[1] - at[0] for _, at in self.splitter.pre_tokenize_str("".join(f"{before}{c} " for c in new))}
        after_letter, after_symbol = starts("a"), starts("!")
        kind = {c: "L" if after_letter[n] == 2 else "Cn" if after_symbol[n] == 2 else "N" for n, c in enumerate(new)}
        return Words(lambda c: kind.get(c) or unicodedata.category(c), sys.maxunicode)

    def orders(self, c: str) -> bool:
        """Whether the library sorts a combining mark as Python does."""
        if not (rank := unicodedata.combining(c)):
            return True
        texts = ["q\u0301" + c, f"q{c}\u0323"] if rank <= 230 else [f"q{c}\u0301"]
        return all(self.normalizer.normalize_str(t) == unicodedata.normalize("NFC", t) for t in texts)

    def plain(self, text: str) -> bool:
        return text.isascii() or not (self.wide.search(text) or self.unknown.search(text))

    def normal(self, text: str, plain: bool) -> str:
        """NFC and lower case, letter by letter. Characters that Python may not know are left to the library."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower() if plain else self.normalizer.normalize_str(text)

    def slices(self, text: str) -> Iterator[tuple[str, bool]]:
        """Slices that are normalized apart as they are together, and whether each is the last one."""
        at = 0
        while len(text) - at > SLICE:
            cut = at + SLICE
            while cut < len(text) and (unicodedata.combining(text[cut]) or text[cut] in self.second):
                cut += 1
            if cut == len(text):
                break
            yield text[at:cut], False
            at = cut
        yield text[at:] if at else text, True

    def scan(self, text: str) -> Iterator[tuple[list[str], str | None, bool]]:
        """(words, part, ends): whole words, then perhaps a part of a word that fills a slice, and if that word ends there."""
        held, kind, plain = "", None, self.plain(text)
        find = self.known_words if plain else self.all_words
        for piece, last in self.slices(text):
            held += self.normal(piece, plain)
            if kind:
                at = kind.match(held).end()
                over = last or at < len(held)
                yield [], held[:at], over
                held = held[at:]
                if not over:
                    continue
                kind = None
            if last:
                yield find.words.findall(held), None, True
                return
            if (cut := held.rfind(" ")) >= 0:
                yield find.words.findall(held, 0, cut), None, True
                held = held[cut:]
            if len(held) > SLICE:  # no space in a slice: what ends three characters before its end is whole
                at, whole = 0, []
                for m in find.words.finditer(held):
                    if m.end() >= len(held) - 3:
                        break
                    whole.append(m.group())
                    at = m.end()
                m = find.words.search(held, at)
                held = held[m.start() :] if m else ""
                if len(held) > SLICE // 2:
                    kind = find.kinds[0] if find.kinds[0].match(held).end() else find.kinds[1]
                    yield whole, held, False
                    held = ""
                else:
                    yield whole, None, True

    def parts(self, text: str) -> Iterator[tuple[list[str], str | None, bool, int | None]]:
        """``scan`` between the special tokens, and these: (words, part, ends, special id)."""
        for n, part in enumerate(self.specials.split(text) if any(s in text for s in self.special) else [text]):
            if n % 2:
                yield [], None, True, self.special[part]
            else:
                for words, piece, ends in self.scan(part):
                    yield words, piece, ends, None

    # Ids of words

    def merged(self, ids: list[int]) -> list[int]:
        """The merges in their order, leftmost first."""
        rank, made, none = self.rank, self.made, len(self.made)
        if len(ids) <= SHORT:
            get = rank.get
            ranks = [get(pair, none) for pair in zip(ids, ids[1:])]  # noqa: B905
            while ranks and (best := min(ranks)) < none:
                at = ranks.index(best)
                ids[at : at + 2] = [made[best]]
                del ranks[at]
                if at:
                    ranks[at - 1] = get((ids[at - 1], ids[at]), none)
                if at < len(ranks):
                    ranks[at] = get((ids[at], ids[at + 1]), none)
            return ids
        after, before, alive = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)
        heap = [(r, i) for i, pair in enumerate(zip(ids, ids[1:])) if (r := rank.get(pair, none)) < none]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= len(ids) or rank.get((ids[i], ids[j])) != r:
                continue
            ids[i], alive[j], after[i] = made[r], False, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(ids) and (r := rank.get((ids[a], ids[b]), none)) < none:
                    heapq.heappush(heap, (r, a))
        return [x for x, stays in zip(ids, alive, strict=True) if stays]

    def word_ids(self, word: str) -> list[int]:
        data = word.encode("utf-8", "replace")
        if len(data) > self.block:
            t = Transducer(self)
            return [*t.push(data), *t.close()]
        return self.merged([*map(self.inner.__getitem__, data[:-1]), self.final[data[-1]]])

    def outline(self, word: str) -> tuple[int, bytes, bytes]:
        """A word's number of ids, the ids as bytes and how they are spelled."""
        ids = self.word_ids(word)
        return len(ids), packed(ids), self.spelled(ids)

    def spelled(self, ids: list[int]) -> bytes:
        """What a speller at its start makes of ids, as bytes."""
        return (self.speller.push(ids) + self.speller.close()).encode()

    # Texts

    def stream(self, text: str) -> Iterator[tuple[int, bytes, bytes]]:
        """(number of ids, ids as bytes, spelling) of a text, in pieces of bounded size."""
        open_word = None
        for words, part, ends, special in self.parts(text):
            for at in range(0, len(words), SLICE):
                counts, ids, spelled = zip(*map(self.outlines.__getitem__, words[at : at + SLICE]), strict=True)
                yield sum(counts), b"".join(ids), b" ".join(spelled)
            if special is not None:
                yield 1, packed([special]), self.spelled([special])
            if part is not None:
                open_word = open_word or Transducer(self)
                ids = open_word.push(part.encode("utf-8", "replace"))
                if ends:
                    ids += open_word.close()
                    open_word = None
                if ids:
                    yield len(ids), packed(ids), self.spelled(ids)

    def encode(self, text: str) -> list[int]:
        out = array("I")
        for _, ids, _ in self.stream(text):
            out.frombytes(ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tolist()

    def digest(self, text: str) -> tuple[int, str, str]:
        """n_tokens, sha256 of the ids as little-endian numbers, sha256 of the spelling."""
        total, sha_ids, sha_text = 0, hashlib.sha256(), hashlib.sha256()
        for n, ids, spelled in self.stream(text):
            sha_ids.update(ids)
            sha_text.update(b" " + spelled if total else spelled)
            total += n
        return total, sha_ids.hexdigest(), sha_text.hexdigest()


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Transducer:
    """Bytes of one word in, ids out, each as soon as it is final. Holds a few lookaheads of bytes at most."""

    def __init__(self, codec: Codec):
        self.codec, self.held = codec, bytearray()

    def push(self, data: bytes) -> list[int]:
        """The last byte read is held back, as the word may end with it."""
        out, codec = [], self.codec
        for at in range(0, len(data), codec.block):
            self.held += data[at : at + codec.block]
            if len(self.held) > codec.block:
                ids = codec.merged([codec.inner[b] for b in self.held[:-1]])
                final = len(self.held) - 1 - codec.lookahead
                done = 0
                for i in ids:
                    if done + codec.width[i] > final:
                        break
                    done += codec.width[i]
                    out.append(i)
                del self.held[:done]
        return out

    def close(self) -> list[int]:
        """The word is over."""
        if not self.held:
            return []
        ids = self.codec.merged([*map(self.codec.inner.__getitem__, self.held[:-1]), self.codec.final[self.held[-1]]])
        self.held.clear()
        return ids


class Speller:
    """Ids in, text out. Its state: whether a space is due, and up to three bytes of an unfinished character.

    By default the text is the library's: the tokens as the vocabulary writes them, with a space between two. With
    ``plain`` it is the text that they stand for: their bytes, and a space after each word.
    """

    def __init__(self, codec: Codec, plain: bool = False):
        self.codec, self.plain, self.due = codec, plain, False
        self.written = codec.bytes if plain else codec.spellings
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: list[int | None]) -> str:
        codec, out = self.codec, []
        for i in ids:
            if i is None or not 0 <= i < len(codec.tokens) or codec.tokens[i] is None:
                continue
            if self.due:
                out.append(b" ")
            out.append(self.written[i])
            self.due = not self.plain or codec.ends[i]
        return self.machine.decode(b"".join(out))

    def close(self) -> str:
        """What is left: an unfinished character becomes U+FFFD."""
        self.due = False
        return self.machine.decode(b"", True)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec a worker and vocabulary: it outlives tasks, as Spark reuses its workers."""
    return Codec(path)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the vocabulary lies on this machine; every machine has the package installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids: the token ids of every text."""
    return map_texts(docs, [text_col], lambda texts: [[codec(vocabulary or vocabulary_path()).encode(t or "") for t in texts]], "ids array<int>", [id_col])


def decode(encoded: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", plain: bool = False) -> DataFrame:
    """id_col, text: the library's text of every list of ids, or the plain one; null lists are empty."""

    def run(lists: list) -> list:
        out = []
        for ids in lists:
            speller = Speller(codec(vocabulary or vocabulary_path()), plain)
            out.append(speller.push(ids or []) + speller.close())
        return [out]

    return map_texts(encoded, ["ids"], run, "text string", [id_col])


def digests(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256."""

    def run(texts: list) -> list:
        c = codec(vocabulary or vocabulary_path())
        return list(zip(*[c.digest(t or "") for t in texts], strict=True)) or [[]] * 3

    return map_texts(docs, [text_col], run, "n_tokens long, ids_sha256 string, decoded_sha256 string", [id_col])


def op12(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
