"""Operators 1 and 5: text classifiers on learned subword vectors, trained by numpy stochastic gradient descent.

A word's vector is the mean of hashed vectors: its own and those of its character n-grams, so that a misspelling or
an unseen ending shares most of a known word's vector. The mean of a text's word vectors goes through a linear layer
and a softmax over two classes, which for two classes is a sigmoid of one difference. Vectors and layer are trained
jointly.

* quality: the mean is taken over the whole document. A word that repeats the one before it adds the token
  ``<again>``, as bags of words cannot see repetition.
* toxicity: a document is a sequence of short windows, the mean is taken in each, and the document has the score of
  its worst window: a few toxic words in a long text must not be averaged away. In training each window of a document
  shares in its gradient by its softmax weight, so the windows that carry the label are found on the way.

Labels are learned from a bounded sample of the training fold, ``sample`` documents (about) of ``sample_bytes`` bytes
(at most), which is collected and fitted on the driver. The model is one float a hash bucket (the layer applied to the
vectors), which the executors get as a broadcast of fixed size (512 KB); every whole text is scored in ``mapInArrow``
without a shuffle.

Defined cases: null, empty and blank texts get the score of no words (the layer's bias); a very long text is scored
whole by its task, in time and memory in proportion to its length; of equal windows any is the worst; repeated rows
get equal scores, and rows that repeat a doc_id are learned from once; ids of any type come back as they are; rows
without a label are scored as well; null labels and null doc_ids are not learned from; of contradicting labels for an
id the larger counts; with no labelled row or one class only, every score is the share of label 1 (0 if none); an
empty table gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.llm.common import map_texts, table

STRIP = ".,;:!?\"'()[]{}"
CACHED = 500_000


@dataclass(frozen=True)
class Settings:
    lower: bool
    window: int  # words; 0: the whole document
    again: bool = False
    buckets: int = 1 << 17  # a power of two
    size: int = 4
    epochs: int = 3
    least_steps: int = 250
    rate: float = 0.3
    sample: int = 4000  # labelled documents to learn from, about
    sample_bytes: int = 64 << 20  # and bytes of their texts at most
    batch: int = 32
    seed: int = 7
    least_docs: int = 1  # n-grams of fewer training documents are not learned: they could only be learned by heart


QUALITY = Settings(lower=False, window=0, again=True)
TOXICITY = Settings(lower=True, window=2, least_docs=3)


def tokens(text: str | None, s: Settings) -> list[str]:
    words = (text.lower() if s.lower else text).split() if text else []
    if s.again:
        words += ["<again>"] * sum(map(str.__eq__, words, words[1:]))
    return words


def features(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of their n-grams of 3 to 5 bytes in UTF-8, word ends marked: (place of the word, bucket)."""
    marked = [f"<{(w.strip(STRIP) or w) if s.lower else w}>".encode("utf-8", "replace") for w in words]
    x = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    of = np.repeat(np.arange(len(marked)), list(map(len, marked)))
    places = [np.arange(len(marked))]
    buckets = [np.fromiter(map(zlib.crc32, marked), np.int64, len(marked)) & (s.buckets - 1)]
    shift = np.uint64(64 - (s.buckets - 1).bit_length())
    for n in (3, 4, 5):
        inside = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :]) if len(of) >= n else np.zeros(0, np.int64)
        gram = np.full(len(inside), n, np.uint64)
        for j in range(n):
            gram = (gram << np.uint64(8)) | x[inside + j]
        places.append(of[inside])
        buckets.append(((gram * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64))
    return np.concatenate(places), np.concatenate(buckets)


def bags(words: list, window: int) -> tuple[list, list[int], int]:
    """What is averaged: the distinct words of each window one after the other, how many each has, and the divisor.

    A window divides by its full length, so that neither a short text nor a word said over and over gains by it.
    Without windows: all words of the document, divided by their number.
    """
    if not window:
        return words, [len(words)], len(words)
    parts = [list(dict.fromkeys(words[i : i + window])) for i in range(0, len(words), window)]
    return [w for part in parts for w in part], list(map(len, parts)), window


@dataclass
class Model:
    settings: Settings
    weights: np.ndarray  # a float a bucket
    bias: float


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(texts: list[str | None], labels: list[int], s: Settings) -> Model:
    """Train on a list of texts. Deterministic."""
    y = np.asarray(labels, np.float64)
    share = float(y.mean()) if len(y) else 0.0
    flat = Model(s, np.zeros(s.buckets, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    if not 0 < share < 1:
        return flat
    # Words as numbers; ngrams[starts[w]:starts[w + 1]] are the buckets of word w.
    ids: dict[str, int] = {}
    made = [bags([ids.setdefault(w, len(ids)) for w in tokens(t, s)], s.window) for t in texts]
    docs = [(np.array(words, np.int32), np.array(sizes), divisor) for words, sizes, divisor in made]
    del made
    of, ngrams = features(list(ids), s)
    ngrams = ngrams[np.argsort(of, kind="stable")].astype(np.int32)
    counts = np.bincount(of, minlength=len(ids))
    starts = np.concatenate([[0], np.cumsum(counts)])
    seen_in = np.zeros(s.buckets, np.int64)
    for words, _, _ in docs:
        some = np.unique(words)
        seen_in[np.unique(ngrams[np.concatenate([np.arange(starts[w], starts[w + 1]) for w in some])]) if len(some) else []] += 1
    rare = seen_in < s.least_docs
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1, 1, (s.buckets, s.size)).astype(np.float32) / s.size
    vectors[rare] = 0
    layer = rng.uniform(-1, 1, s.size).astype(np.float32)
    seen_v, seen_l, seen_b = np.full(s.buckets, 1e-8, np.float32), np.full(s.size, 1e-8), 1e-8
    bias = flat.bias
    order = np.array([i for i, d in enumerate(docs) if len(d[0])])
    for _ in range(max(s.epochs, min(40, s.least_steps * s.batch // max(1, len(order))))):
        rng.shuffle(order)
        for at in range(0, len(order), s.batch):
            some = order[at : at + s.batch]
            words, place = np.unique(np.concatenate([docs[i][0] for i in some]), return_inverse=True)
            k = counts[words]
            where = np.repeat(starts[words] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
            rows = ngrams[where]
            mean = np.add.reduceat(vectors[rows], np.concatenate([[0], np.cumsum(k)[:-1]]), axis=0) / k[:, None]
            parts = np.array([len(docs[i][1]) for i in some])
            doc_of = np.repeat(np.arange(len(some)), parts)
            size = np.concatenate([docs[i][1] for i in some])
            by = np.array([docs[i][2] for i in some])[doc_of]
            first = np.cumsum(size) - size
            logit = np.add.reduceat((mean @ layer)[place], first) / by + bias
            heads = np.cumsum(parts) - parts
            top = np.maximum.reduceat(logit, heads)
            part = np.exp(logit - top[doc_of])
            part /= np.add.reduceat(part, heads)[doc_of]
            error = sigmoid(top) - y[some]
            pull = np.bincount(place, np.repeat(error[doc_of] * part / by, size), minlength=len(words)) / len(some)
            grad_layer = pull @ mean
            grad_words = (pull / k)[:, None] * layer
            by_row = np.argsort(rows, kind="stable")
            hit, heads = np.unique(rows[by_row], return_index=True)
            grad = np.add.reduceat(np.repeat(grad_words.astype(np.float32), k, axis=0)[by_row], heads, axis=0)
            grad[rare[hit]] = 0
            seen_v[hit] += (grad**2).mean(1)
            vectors[hit] -= s.rate * grad / np.sqrt(seen_v[hit])[:, None]
            seen_l += grad_layer**2
            layer -= (s.rate * grad_layer / np.sqrt(seen_l)).astype(np.float32)
            seen_b += error.mean() ** 2
            bias -= s.rate * error.mean() / np.sqrt(seen_b)
    return Model(s, (vectors @ layer).astype(np.float32), float(bias))


class Scorer:
    """Scores texts; remembers words' shares in the logit, and forgets all when full."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > CACHED:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        if new:
            of, at = features(new, self.model.settings)
            share = np.bincount(of, self.model.weights[at], len(new)) / np.bincount(of, minlength=len(new))
            self.known.update(zip(new, share.tolist(), strict=True))

    def scores(self, texts: list[str | None]) -> list[float]:
        out: list[float] = []
        for i in range(0, len(texts), 32):
            some = [tokens(t, self.model.settings) for t in texts[i : i + 32]]
            self.learn(set().union(*some))
            out += [self.logit(words) for words in some]
        return sigmoid(np.array(out, np.float64)).tolist()

    def logit(self, words: list[str]) -> float:
        share, window, bias = self.known.__getitem__, self.model.settings.window, self.model.bias
        if not words:
            return bias
        if not window:
            return sum(map(share, words)) / len(words) + bias
        if window == 2:  # the usual case at numpy's pace: a word said twice counts once
            shares = np.fromiter(map(share, words), np.float64, len(words))
            sums = shares[::2].copy()
            sums[: len(words) // 2] += shares[1::2] * ~np.fromiter(map(str.__eq__, words[::2], words[1::2]), bool, len(words) // 2)
            return float(sums.max()) / 2 + bias
        return max(sum(map(share, set(words[i : i + window]))) for i in range(0, len(words), window)) / window + bias


_scorers: dict[str, Scorer] = {}


def scorer(name: str, model: Model) -> Scorer:
    """One scorer a worker and model: its memory of words outlives tasks."""
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(model)
    return _scorers[name]


def training_sample(docs: DataFrame, labels: DataFrame, label: str, fold: Column, s: Settings) -> tuple[list[str | None], list[int]]:
    """About ``s.sample`` labelled texts of the training fold, chosen by a hash of doc_id, as far as they fit
    ``s.sample_bytes`` in that order; of rows that repeat a doc_id the least text. Only ids are broadcast, and only
    ids, lengths and the chosen texts leave the scan."""
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & fold).groupBy("doc_id").agg(F.max(label).alias("y"))
    n = usable.count()
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    drawn = usable.withColumn("spot", spot).where(F.col("spot") / F.lit(float(1 << 40)) < s.sample / max(n, 1))
    one = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "y", "spot").agg(F.min("text").alias("text"))
    sizes = one.select("doc_id", "spot", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).collect()
    left, fits = s.sample_bytes, []
    for r in sorted(sizes, key=lambda r: (r["spot"], str(r["doc_id"]))):
        if r["bytes"] <= left:
            left -= r["bytes"]
            fits.append(r["doc_id"])
    if len(fits) < len(sizes):
        one = one.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in fits], docs.select("doc_id").schema)), "doc_id", "left_semi")
    rows = sorted(one.select("doc_id", "text", "y").collect(), key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [int(r["y"]) for r in rows]


def crc_fold(modulus: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def train(docs: DataFrame, labels: DataFrame, label: str, fold: Column, s: Settings) -> Model:
    return fit(*training_sample(docs, labels, label, fold, s), s)


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` and ``score`` of its whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = f"{id(shared)}-{zlib.crc32(model.weights.tobytes())}"
    return map_texts(docs, [text_col], lambda texts: [scorer(name, shared.value).scores(texts)], "score double", keep)


def scored(docs: DataFrame, labels: DataFrame, label: str, s: Settings, modulus: int, held: int, bar: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; the fold ``held`` of crc32(doc_id) mod ``modulus`` is not learned from."""
    fold = crc_fold(modulus)
    out = score(docs, train(docs, labels, label, fold != held, s), ["doc_id"])
    return out.select("doc_id", (crc_fold(modulus) == held).alias("held_out"), "score", (F.col("score") >= bar).cast("int").alias("predicted"))


def op1(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", TOXICITY, 4, 2)


def op5(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", QUALITY, 5, 0)
