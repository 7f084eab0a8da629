"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in its words (and their first
letters); the document's is the noisy-or of its sentences, ``1 - prod(1 - p)``. Only documents have
labels; the gradient of the noisy-or shares a document's label among its sentences, so that training
finds the sentences that make it toxic. They are located with their offsets.

The weights are learned in numpy from a sample of labelled documents, ``sample_rows`` in all, as many
of either label, chosen by a hash of the id alone, whatever their length. The sample is bounded as a
whole: its texts together may have about ``sample_rows * max_chars`` characters. Up to that all are
learned whole; beyond, the longest give sentences spread evenly over the whole text, each of which
stands for as many as there are for it.

Defined cases: a null or empty text scores as a text without sentences, 0; documents without a label
or with a null one are scored only; an id labelled both ways counts as toxic; with no labelled
document, or one class, every score is 0; rows are judged one by one, so repeated rows give equal
results; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.llm.common import chosen_by_hash, columns_of, held_out, map_texts

BITS = 18
#: First letters of a word that make a feature of their own.
STEM = 4
_SENTENCE = re.compile(r"[^.!?\n|]*[^.!?\n|\s][^.!?\n|]*")
_TOKEN = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Begin and end of each sentence that is not blank."""
    return [m.span() for m in _SENTENCE.finditer(text)]


def spread(text: str, limit: int) -> tuple[str, float]:
    """A text of up to ``limit`` characters as it is; of a longer one, sentences at even steps over the
    whole of it, at most about twice ``limit`` characters, and how many sentences each stands for. Of a
    very long sentence, different words at even steps are taken."""
    if len(text) <= limit:
        return text, 1.0
    spans = sentences(text)
    if not spans:
        return "", 1.0
    n = len(spans)
    k = max(1, min(n, n * limit // len(text)))
    most = max(64, 2 * limit // k)
    out = []
    for j in range(k):
        begin, end = spans[(2 * j + 1) * n // (2 * k)]
        part = text[begin:end]
        if len(part) > most:
            words = sorted(set(_TOKEN.findall(part.lower())))
            size = sum(map(len, words)) + len(words)
            m = max(1, min(len(words), len(words) * most // max(size, 1)))
            part = " ".join(words[(2 * i + 1) * len(words) // (2 * m)][:most] for i in range(m)) if words else ""
        out.append(part)
    return "\n".join(out), n / k


def features(word: str) -> tuple[int, int]:
    """Places of the word and of its first letters among ``2**BITS`` weights."""
    return zlib.crc32(b"w" + word.encode()) >> (32 - BITS), zlib.crc32(b"s" + word[:STEM].encode()) >> (32 - BITS)


class NoisyOr:
    """Weights of hashed words and a bias."""

    def __init__(self):
        self.weights = np.zeros(1 << BITS)
        self.bias = -9.0

    def fit(self, texts: list[str], labels: list[int], rounds: int = 200, rate: float = 1.2, decay: float = 2e-5, stands_for: list[float] | None = None) -> NoisyOr:
        """Adagrad on the whole sample. ``stands_for`` has of each text how many sentences each of its
        sentences counts as (1 by default)."""
        places: list[int] = []
        words_in: list[int] = []  # of each sentence, features
        sentences_in: list[int] = []  # of each document
        known: dict[str, tuple[int, int]] = {}
        kept, times = [], []
        for text, label, many in zip(texts, labels, stands_for or [1.0] * len(texts), strict=True):
            n = 0
            for begin, end in sentences(text):
                found = set(_TOKEN.findall(text[begin:end].lower()))
                if found:
                    for w in sorted(found):
                        places += known[w] if w in known else known.setdefault(w, features(w))
                    words_in.append(2 * len(found))
                    n += 1
            if n:
                sentences_in.append(n)
                kept.append(label)
                times.append(many)
        y = np.array(kept, bool)
        if not len(y) or y.all() or not y.any():
            return self
        at, where = np.unique(np.array(places), return_inverse=True)
        sizes, bags = np.array(words_in), np.array(sentences_in)
        sentence = np.repeat(np.arange(len(sizes)), sizes)
        bag = np.repeat(np.arange(len(bags)), bags)
        firsts = np.cumsum(bags) - bags
        times = np.array(times)
        share = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum()) * len(y)  # both labels weigh the same
        w, past, bias, past_bias = np.zeros(len(at)), np.full(len(at), 1e-6), self.bias, 1e-6
        for _ in range(rounds):
            z = bias + np.bincount(sentence, w[where], len(sizes))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            clean = np.exp(times * np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), firsts))  # of the whole bag
            # d log-likelihood / dz: p * clean / (1 - clean) for a toxic bag, -p for a clean one
            pull = np.where(y, clean / np.maximum(1 - clean, 1e-9), -1.0) * share * times
            g = pull[bag] * p / len(y)
            step = np.bincount(where, g[sentence], len(at)) - decay * w
            past += step**2
            w += rate * step / np.sqrt(past)
            past_bias += g.sum() ** 2
            bias += rate * g.sum() / np.sqrt(past_bias)
        self.weights[at], self.bias = w, float(bias)
        return self


class Scorer:
    """Scores texts; keeps at most ``memo_size`` weights of words."""

    def __init__(self, model: NoisyOr, memo_size: int = 500_000):
        self.weights, self.bias, self.memo_size = model.weights, model.bias, memo_size
        self.memo: dict[str, float] = {}

    def weight(self, word: str) -> float:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= self.memo_size:
                self.memo.clear()
            a, b = features(word)
            found = self.memo[word] = float(self.weights[a] + self.weights[b])
        return found

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The text's probability, and each sentence's with its begin and end."""
        spans = sentences(text)
        lower = text if text.islower() else text.lower()
        if len(lower) != len(text):  # a letter that becomes two
            lower = "".join(c if len(d := c.lower()) != 1 else d for c in text)
        weight = self.weight
        z = np.fromiter((self.bias + sum(map(weight, set(_TOKEN.findall(lower, begin, end)))) for begin, end in spans), np.float64, len(spans))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        total = float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-9)).sum()))
        return min(1.0, max(0.0, total)), [(b, e, q) for (b, e), q in zip(spans, p.tolist(), strict=True)]


def training_sample(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str, parts: int, part: int, sample_rows: int, max_chars: int) -> list[tuple[str, int, float]]:
    """At most ``sample_rows`` ids, half of each label, as (text, label, sentences each sentence stands
    for). First ids are chosen, from labels alone; then the lengths of those texts are read, and the texts."""
    marks = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    marks = marks.where(~held_out(F.col("id"), parts, part))
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    chosen = chosen_by_hash(marks.join(docs.select("id"), "id", "left_semi"), "y", sample_rows // 2)
    y = {r["id"]: int(r["y"] > 0) for r in chosen.select("id", "y").collect()}
    if not y:
        return []
    found = docs.where(F.col("id").isin(list(y)))
    sizes = [r["n"] for r in found.select("id", F.length("text").alias("n")).orderBy("id", "n").limit(2 * sample_rows).collect()]
    limit = _limit(sizes, sample_rows * max_chars)

    def make():
        def work(ids, texts):
            parts_of = [spread(t, limit) for t in texts]
            return {"id": ids, "text": [t for t, _ in parts_of], "times": [n for _, n in parts_of]}

        return work

    schema = f"id {docs.schema['id'].dataType.simpleString()}, text string, times double"
    taken = map_texts(found, make, schema).orderBy("id", "text").limit(2 * sample_rows)
    return [(r["text"], y[r["id"]], r["times"]) for r in taken.collect()]


def _limit(sizes: list[int], total: int) -> int:
    """The greatest limit for which the sizes, none counted as more than it, sum up to at most ``total``."""
    left = total
    for i, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - i) > left:
            return left // (len(sizes) - i)
        left -= n
    return max(sizes, default=0)


def score_texts(df: DataFrame, model: NoisyOr | None, id_col: str = "doc_id", text_col: str = "text", locate: bool = False) -> DataFrame:
    """One row per input row: ``id``, ``score``, and with ``locate`` the sentences of probability 0.5
    or more as ``offending`` (begin, end, score). Narrow: no shuffle."""

    def make():
        scorer = Scorer(model) if model else None

        def work(ids, texts):
            found = [scorer.score(t) if scorer else (0.0, []) for t in texts]
            out = {"id": ids, "score": [s for s, _ in found]}
            if locate:
                out["offending"] = [[{"begin": b, "end": e, "score": p} for b, e, p in spans if p >= 0.5] for _, spans in found]
            return out

        return work

    schema = f"id {df.schema[id_col].dataType.simpleString()}, score double" + ", offending array<struct<begin:long,end:long,score:double>>" * locate
    return map_texts(columns_of(df, id_col, text_col), make, schema)


def predict_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", parts: int = 5, part: int = 0, sample_rows: int = 4000, max_chars: int = 8000, locate: bool = False) -> DataFrame:
    """Train on labelled rows outside a fold of the ids' crc32 and score all rows: ``id``,
    ``held_out``, ``score``, ``predicted`` (and ``offending``)."""
    sample = training_sample(df, labels, id_col, text_col, label_id, label_col, parts, part, sample_rows, max_chars)
    y = [label for _, label, _ in sample]
    model = NoisyOr().fit([t for t, _, _ in sample], y, stands_for=[n for _, _, n in sample]) if len(set(y)) == 2 else None
    out = score_texts(df, model, id_col, text_col, locate)
    return out.select("id", held_out(F.col("id"), parts, part).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *["offending"] * locate)
