"""Operator 7: SentencePiece (BPE) encoding and decoding through a table of last tokens.

BPE has a property: of all tokens that end a prefix of a text, exactly one ends the prefix's encoding. ``chunk_ids``
fills a table with that token for one prefix after the other. Candidates for a prefix are the vocabulary's words that
end there, which an Aho-Corasick automaton reports; a candidate is right if it is *compatible* with the last token of
the prefix before it: a pair is compatible if the pair's own text is encoded as just this pair. The ids are then
recovered backwards from the end. Time is linear in the length, where merging by priority is not.

No vocabulary word holds a space mark after another character, so texts fall into chunks (space marks and what
follows, up to the next one) that never merge with each other. Chunks recur; each worker remembers the ids of
those of usual length and the answers to pair tests, and empties both when they reach a fixed number of entries, so
its memory is bounded.

Texts pass through ``mapInArrow`` without a shuffle. Defined cases: null and empty texts have the end id only and
decode to an empty text; very long texts and chunks take time in proportion to their length; scores that tie merge
leftmost first, as in the library; repeated rows get equal results; ids of any type come back as they are; an empty
table gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from genoframe.llm.common import map_texts, table

MARK = "▁"
REMEMBERED = 600_000


LONGEST = 64


class Memory(dict):
    """What ``make`` gave for a key, but for strings over LONGEST; emptied when it is full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if isinstance(key, str) and len(key) > LONGEST:
            return self.make(key)
        if len(self) >= REMEMBERED:
            self.clear()
        got = self[key] = self.make(key)
        return got


class Encoder:
    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.score = {piece: sp.get_score(i) for piece, i in self.ids.items()}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = sp.eos_id()
        inner = [p for p in self.ids if MARK in p.lstrip(MARK)]
        assert not inner, "chunks need a vocabulary without space marks inside words"
        alone = "".join(re.escape(c) for c in "\n\t" if not any(c in p for p in self.ids))
        self.chunks = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if self.merged(piece) == [piece]:  # others never stand in an encoding
                self.automaton.add_word(piece, (self.ids[piece], len(piece)))
        self.automaton.make_automaton()
        self.size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(self.size)]
        self.lengths = list(map(len, self.pieces))
        self.numerals = list(map(str, range(self.size)))
        self.pairs = Memory(self.compatible)
        self.known = Memory(self.chunk_ids)
        self.outlines = Memory(self.outline)
        # What each id decodes to; bytes over 0x7F only mean something together and are looked at apart.
        self.written = ["" if sp.is_control(i) else " ⁇ " if sp.is_unknown(i) else sp.id_to_piece(i).replace(MARK, " ") for i in range(sp.get_piece_size())]
        for b in range(128):
            self.written[self.byte_ids[b]] = chr(b)
        self.high = frozenset(self.byte_ids[128:])

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: merge the neighbours with the best score, leftmost first, until none is a word."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, pair: int) -> bool:
        left, right = self.pieces[pair // self.size], self.pieces[pair % self.size]
        return self.merged(left + right) == [left, right]

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        """A chunk's ids. last[k]: the last id of the encoding of chunk[:k], -1 for a character outside the vocabulary."""
        n, size, pairs = len(chunk), self.size, self.pairs
        last = [-1] * (n + 1)
        for at, (i, length) in self.automaton.iter(chunk):
            start = at + 1 - length
            if start == 0 or (before := last[start]) < 0 or pairs[before * size + i]:
                last[at + 1] = i
        ids: list[int] = []
        while n:
            if (i := last[n]) >= 0:
                ids.append(i)
                n -= self.lengths[i]
            elif (c := chunk[n - 1]) in self.ids:  # scores that tie across words: the table has no entry here
                return self.spelled(self.merged(chunk))
            else:
                ids += [self.byte_ids[b] for b in reversed(c.encode("utf-8", "replace"))]
                n -= 1
        return tuple(reversed(ids))

    def spelled(self, pieces: list[str]) -> tuple[int, ...]:
        return tuple(i for p in pieces for i in ([self.ids[p]] if p in self.ids else [self.byte_ids[b] for b in p.encode("utf-8", "replace")]))

    def encode(self, text: str) -> list[int]:
        """All ids of a text, with the end id."""
        return [i for c in self.split(text) for i in self.known[c]] + [self.end]

    def split(self, text: str) -> list[str]:
        return self.chunks.findall(MARK + text.replace(" ", MARK)) if text else []

    def decode(self, ids: list[int]) -> str:
        """The text of ids: as the library's decode, a leading space mark is the encoder's own and goes."""
        if self.high.isdisjoint(ids):
            text = "".join(map(self.written.__getitem__, ids))
        else:
            return self.sp.decode(ids)
        return text[1:] if text[:1] == " " else text

    def outline(self, chunk: str) -> tuple[int, str, str]:
        """A chunk's number of ids, their numerals and what they decode to. A character's bytes never cross chunks."""
        ids = self.chunk_ids(chunk)
        written = self.sp.decode([self.byte_ids[0], *ids])[1:] if not self.high.isdisjoint(ids) else "".join(map(self.written.__getitem__, ids))
        return len(ids), " ".join(map(self.numerals.__getitem__, ids)), written

    def digest(self, text: str) -> tuple[int, str, str]:
        """n_tokens, sha256 of the ids and sha256 of the decoded text. Chunks recur, so it works by chunks, not by ids."""
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        counts, numerals, written = zip((1, self.numerals[self.end], ""), *map(self.outlines.__getitem__, self.split(text)), strict=True)
        decoded = "".join(written)
        return sum(counts), sha(" ".join((*numerals[1:], numerals[0]))), sha(decoded[1:] if decoded[:1] == " " else decoded)


@lru_cache(maxsize=2)
def encoder(model_file: str) -> Encoder:
    """One encoder a worker and model: it outlives tasks, as Spark reuses its workers."""
    return Encoder(model_file)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the vocabulary lies on this machine; every machine has the package installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids: the token ids of every text."""
    return map_texts(docs, [text_col], lambda texts: [[encoder(model_file or model_path()).encode(t or "") for t in texts]], "ids array<int>", [id_col])


def decode(encoded: DataFrame, model_file: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """id_col, text: the text of every list of ids; null ids are an empty list."""
    return map_texts(encoded, ["ids"], lambda lists: [[encoder(model_file or model_path()).decode(ids or []) for ids in lists]], "text string", [id_col])


def digests(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256."""

    def run(texts: list) -> list:
        enc = encoder(model_file or model_path())
        return list(zip(*[enc.digest(t or "") for t in texts], strict=True)) or [[]] * 3

    return map_texts(docs, [text_col], run, "n_tokens long, ids_sha256 string, decoded_sha256 string", [id_col])


def op7(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
