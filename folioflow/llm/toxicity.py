"""Toxicity by multiple-instance learning: a document is a bag of sentences, its probability the noisy-or of theirs.

A sentence's logit is a bias and the weights of its distinct words and word beginnings; p(document) = 1 - prod(1 - p(sentence)). Only documents are
labelled: the gradient of the noisy-or decides which sentences answer for a label. Weights are kept sparse by an L1 step, so that of
the features that stand in toxic documents only those remain that tell them apart. locate() gives the sentences that made a document toxic.

Training takes a bounded sample: at most `sample_rows` labelled rows of the training fold, lowest hash of doc_id first, none longer
than `sample_longest` characters, and at most `most_words` candidate features, those whose presence tells most. Scoring takes every text
whole. Words: runs of letters, lower-cased; beginnings: their first 3 to 8 letters. Sentences end at . ! ? or a line break. A null or empty text counts as one sentence
without words. Null labels aren't learned from; without labels of two kinds the score is the share of label 1 (0 without any). Repeated
rows score alike, a score that equals the threshold counts as toxic, and an empty table gives an empty result. Columns other than doc_id
and text are never read and may have any name. A labelled text longer than `sample_longest` isn't learned from, but is scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, columns, crc_mod, slices, small_batches, spans, tidy
from .quality import labelled_sample, sigmoid

THRESHOLD = 0.7
SAMPLE_ROWS, SAMPLE_LONGEST, MOST_WORDS = 5000, 20_000, 4000
#: Words that scoring remembers.
MOST_SEEN = 200_000

_SENTENCE = re.compile(r"[^.!?\n]*[^.!?\n\s][^.!?\n]*")
_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are features; each carries its mark, so that it differs from the whole word.
_BEGINNINGS = (3, 4, 5, 6, 7, 8)


def features(words: set[str]) -> set[str]:
    """Words and their beginnings."""
    return words.union(*({w[:n] + "+" for w in words if len(w) > n} for n in _BEGINNINGS))


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


class NoisyOr:
    def __init__(self):
        self.weights: dict[str, float] = {}
        #: First three letters of all features: other words needn't be looked at closely.
        self.starts: set[str] = set()
        self.bias = -9.0
        self.prior: float | None = None
        #: Words that were looked at, and those of them that have features with a weight, with these.
        self.seen: set[str] = set()
        self.marks: dict[str, set[str]] = {}

    def telling(self, text: str) -> set[str]:
        """Features with a weight; a word is looked at closely once, as long as there are no more than MOST_SEEN."""
        words = words_of(text)
        if new := words - self.seen:
            if len(self.seen) > MOST_SEEN:
                self.seen, self.marks, new = set(), {}, words
            self.seen |= new
            for w in new:
                if w[:3] in self.starts and (found := self.weights.keys() & features({w})):
                    self.marks[w] = found
        hits = self.marks.keys() & words
        return set().union(*map(self.marks.get, hits)) if hits else hits

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """Start, end and probability of each sentence."""
        out, plain = [], float(sigmoid(self.bias))
        for m in _SENTENCE.finditer(text or ""):
            found = self.telling(m[0])
            p = float(sigmoid(self.bias + math.fsum(map(self.weights.get, found)))) if found else plain
            out.append((*m.span(), p))
        return out

    def score(self, text: str | None) -> float:
        if self.prior is not None:
            return self.prior
        each = [p for _, _, p in self.sentences(text)] or [float(sigmoid(self.bias))]
        return -math.expm1(math.fsum(math.log1p(-min(p, 1 - 1e-12)) for p in each))

    def fit(self, texts: list[str | None], labels: list[int], *, steps: int = 500, rate: float = 0.06, l1: float = 3e-5, most_words: int = MOST_WORDS) -> NoisyOr:
        y = np.asarray(labels, dtype=float)
        if not len(y) or y.min() == y.max():
            self.prior = float(y.mean()) if len(y) else 0.0
            return self
        have, lack = Counter(), Counter()
        for t, label in zip(texts, y, strict=True):
            if label:
                have.update(features(words_of(t or "")))
        have = Counter({w: n for w, n in have.items() if n >= 3})
        for t, label in zip(texts, y, strict=True):
            if not label:
                lack.update(have.keys() & features(words_of(t or "")))
        tells = {w: n * (np.log((n + 0.5) / y.sum()) - np.log((lack[w] + 0.5) / (len(y) - y.sum()))) for w, n in have.items()}
        for w in sorted(tells):  # a beginning that says no more than a longer one, or than the only word that has it, goes
            for n in _BEGINNINGS:
                short = w[:n] + "+"
                if len(w) > n and short != w and have[short] == have[w] and lack[short] == lack[w]:
                    tells.pop(short, None)
        known = {w: i for i, w in enumerate(sorted(tells, key=lambda w: (-tells[w], w))[:most_words]) if tells[w] > 0}
        rows, owner, cells, cols = 0, [], [], []
        for d, t in enumerate(texts):
            for sentence in _SENTENCE.findall(t or "") or [""]:
                found = [known[w] for w in known.keys() & features(words_of(sentence))]
                cells += [rows] * len(found)
                cols += found
                owner.append(d)
                rows += 1
        owner, cells, cols = np.array(owner), np.array(cells, dtype=int), np.array(cols, dtype=int)
        starts = spans(np.bincount(owner, minlength=len(y)))[:-1]
        w, b = np.array([tells[x] / (have[x] + 10) for x in known]), self.bias
        m, v, t = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
        for t in range(1, steps + 1):
            s = sigmoid(b + np.bincount(cells, w[cols], rows))
            p = -np.expm1(np.add.reduceat(np.log1p(-np.minimum(s, 1 - 1e-12)), starts))
            pull = np.where(y == 1, (1 - p) / np.maximum(p, 1e-9), -1.0)
            each = pull[owner] * s / len(y)
            g = np.append(np.bincount(cols, each[cells], len(w)), each.sum())
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
            b = max(b + move[-1], -np.log(rows))
            w += move[:-1]
            w = np.sign(w) * np.maximum(np.abs(w) - rate * l1 / (np.sqrt(v[:-1] / (1 - 0.999**t)) + 1e-5), 0)
        self.bias = float(b)
        self.weights = {x: float(w[i]) for x, i in known.items() if w[i]}
        self.starts = {x.removesuffix("+")[:3] for x in self.weights}
        self.seen, self.marks = set(), {}
        return self


def train(docs: DataFrame, labels: DataFrame, *, fold=None, rows: int = SAMPLE_ROWS, longest: int = SAMPLE_LONGEST, **options) -> NoisyOr:
    texts, y = labelled_sample(docs, labels, "toxic", F.lit(True) if fold is None else fold, rows, longest)
    return NoisyOr().fit(texts, y, **options)


def scored(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """doc_id and score."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                ids, texts = columns(part, "doc_id", "text")
                yield batch(schema, ids, [sent.value.score(t) for t in texts])

    return docs.select("doc_id", "text").mapInArrow(tidy(task), "doc_id long, score double")


def locate(docs: DataFrame, model: NoisyOr, threshold: float = THRESHOLD) -> DataFrame:
    """Of documents with at least `threshold`, the sentences that are likelier toxic than not: place in characters, text, score."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("sentence", pa.string()), ("score", pa.float64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                out = [
                    (d, i, j, t[i:j], p)
                    for d, t in zip(*columns(part, "doc_id", "text"), strict=True)
                    if sent.value.prior is None and t and sent.value.score(t) >= threshold
                    for i, j, p in sent.value.sentences(t)
                    if p >= 0.5
                ]
                if out:
                    yield batch(schema, *zip(*out, strict=True))

    return docs.select("doc_id", "text").mapInArrow(tidy(task), "doc_id long, start long, end long, sentence string, score double")


def in_training():
    return crc_mod("doc_id", 3) != 1


def op8_toxicity_mil(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = scored(docs, train(docs, labels, fold=in_training()))
    return found.select("doc_id", (~in_training()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
