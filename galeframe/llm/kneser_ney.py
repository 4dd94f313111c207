"""Toxicity: class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models of how words are spelt are trained, one on toxic and one on ordinary
texts: the next byte of a word given up to ORDER - 1 bytes before it (a mark stands for the word's start).
Orders below OWN_ORDER are shared: they come from the counts of both classes together, and whatever a class
has seen DISCOUNT times or less is left to them. So rare expressions, and the mix of languages, say nothing,
while stems that only one class uses do. A text is judged by the difference of the two log-likelihoods
divided by its number of words, turned into a probability by a logistic curve fitted on labelled texts that
the counts did not see.

Where neither class has seen a gram often enough, both likelihoods fall back alike and their quotient is the
quotient of the fall-back weights times that of the next lower order; so the broadcast model is two tables:
the log-quotient of the frequent grams, and that of the weights of frequent contexts. Both have at most one
entry per DISCOUNT training bytes and order.

Words are lower-cased (A-Z) runs of letters, digits and characters beyond ASCII; a text counts each of its
words once in training. fit() uses labelled rows outside the held-out fold only, at most SAMPLE_ROWS and
SAMPLE_BYTES of text a class (least hash of the id first), no text over a sixteenth of that, and of rows with one id
one text. Scores read the text alone. Null and empty texts
have no words and a difference of 0. Several labels of one id: the largest counts. If one class has no
labelled text, every score is the share of toxic labels (0.5 without any). The sample has as many texts of
either class, and the curve is moved back to the share among all labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeframe.llm.factorisation import fold
from galeframe.llm.sample import labelled_texts
from galeframe.llm.text import ALNUM, Words, slices, words

SAMPLE_ROWS = 2_500
SAMPLE_BYTES = 12 << 20
ORDER = 7       # symbols of a gram, the predicted one included; at most 7
OWN_ORDER = 3   # grams of fewer symbols are shared by the classes
DISCOUNT = 2.0
START, END = 1, 2


def spelt(w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """START, the bytes and END of each word, and the place of every symbol in its word."""
    n = (w.ends - w.starts)[which]
    begin = np.cumsum(n + 2) - (n + 2)
    place = np.arange(int((n + 2).sum())) - np.repeat(begin, n + 2)
    symbols = np.empty(len(place), np.uint8)
    inner = (place > 0) & (place <= np.repeat(n, n + 2))
    symbols[inner] = w.data[np.repeat(w.starts[which] - 1, n + 2)[inner] + place[inner]]
    symbols[place == 0] = START
    symbols[begin + n + 1] = END
    return symbols, place


def grams(symbols: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """The last so many symbols at each place as a number, its length in the top byte. Places with a shorter
    past get the gram that begins with START."""
    key = symbols.astype(np.uint64)
    size = np.ones(len(symbols), np.uint64)
    for k in range(1, length):
        more = np.flatnonzero(place >= k)
        key[more] |= symbols[more - k].astype(np.uint64) << np.uint64(8 * k)
        size[more] += np.uint64(1)
    return key | size << np.uint64(56)


def sizes(key: np.ndarray) -> np.ndarray:
    return key >> np.uint64(56)


def suffix(key: np.ndarray) -> np.ndarray:
    """The gram without its first symbol."""
    n = sizes(key) - np.uint64(1)
    return key & ((np.uint64(1) << np.uint64(8) * n) - np.uint64(1)) | n << np.uint64(56)


def context(key: np.ndarray) -> np.ndarray:
    """The gram without its last symbol."""
    n = sizes(key)
    return (key & np.uint64((1 << 56) - 1)) >> np.uint64(8) | (n - np.uint64(1)) << np.uint64(56)


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted number in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class SpellingCounts:
    """Kneser-Ney counts of one class, or of both together, order by order."""

    def __init__(self, symbols: np.ndarray, place: np.ndarray, weight: np.ndarray):
        """weight: in how many texts the word of each symbol occurs."""
        inside = place > 0
        self.keys: dict[int, np.ndarray] = {}
        self.counts: dict[int, np.ndarray] = {}
        lower_keys, which = np.unique(grams(symbols, place, ORDER)[inside], return_inverse=True)
        lower_counts = np.bincount(which, weights=weight[inside], minlength=len(lower_keys))
        for n in range(ORDER, 0, -1):
            own = sizes(lower_keys) == np.uint64(n)
            self.keys[n], self.counts[n] = lower_keys[own], lower_counts[own].astype(np.float64)
            # one order down: the kinds of symbols before; grams from the start of a word keep their counts
            shorter = ~own
            down = np.concatenate([suffix(self.keys[n]), lower_keys[shorter]])
            weight = np.concatenate([np.ones(len(self.keys[n])), lower_counts[shorter]])
            lower_keys, which = np.unique(down, return_inverse=True)
            lower_counts = np.bincount(which, weights=weight, minlength=len(lower_keys))
        self.contexts: dict[int, np.ndarray] = {}
        self.totals: dict[int, np.ndarray] = {}
        self.freed: dict[int, np.ndarray] = {}
        for n, key in self.keys.items():
            self.contexts[n], which = np.unique(context(key), return_inverse=True)
            self.totals[n] = np.bincount(which, weights=self.counts[n], minlength=len(self.contexts[n]))
            self.freed[n] = np.bincount(which, weights=np.minimum(self.counts[n], self.discount(n)),
                                        minlength=len(self.contexts[n]))

    @staticmethod
    def discount(n: int) -> float:
        return DISCOUNT if n >= OWN_ORDER else 0.75

    def weight(self, n: int, heads: np.ndarray) -> np.ndarray:
        """The share that a context leaves to the next lower order; 1 where it is unknown."""
        at = find(self.contexts[n], heads)
        return np.where(at >= 0, self.freed[n][at] / self.totals[n][at], 1.0) if len(self.totals[n]) else np.ones(len(heads))

    def above(self, n: int, keys: np.ndarray) -> np.ndarray:
        """What the discount leaves of a gram's share in its context."""
        at, head = find(self.keys[n], keys), find(self.contexts[n], context(keys))
        if not len(self.totals[n]):
            return np.zeros(len(keys))
        return np.where(at >= 0, np.maximum(self.counts[n][at] - self.discount(n), 0) / self.totals[n][head], 0.0)


@dataclass
class Contrast:
    """log P(toxic) - log P(ordinary) by gram and by context, and the logistic curve."""

    gram_keys: np.ndarray
    gram_values: np.ndarray
    context_keys: np.ndarray
    context_values: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def of_words(self, w: Words, which: np.ndarray) -> np.ndarray:
        """Difference of the log-likelihoods of the chosen words."""
        symbols, place = spelt(w, which)
        begin = np.flatnonzero(place == 0)
        key = grams(symbols, place, ORDER)
        total = np.zeros(len(key))
        left = np.flatnonzero((place > 0) & (sizes(key) >= np.uint64(OWN_ORDER)))
        key = key[left]
        while len(left):
            at = find(self.gram_keys, key)
            hit = at >= 0
            total[left[hit]] += self.gram_values[at[hit]]
            left, key = left[~hit], key[~hit]
            head = find(self.context_keys, context(key))
            known = head >= 0
            total[left[known]] += self.context_values[head[known]]
            more = sizes(key) > np.uint64(OWN_ORDER)  # below, both classes are alike
            left, key = left[more], suffix(key[more])
        return np.add.reduceat(total, begin) if len(begin) else np.zeros(0)

    def difference(self, texts: pa.Array) -> np.ndarray:
        """Difference of the log-likelihoods of each text by its number of words."""
        w = words(texts, ALNUM)
        _, which, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
        upto = np.concatenate([[0.0], np.cumsum(self.of_words(w, which)[inverse])])
        return np.diff(upto[w.first]) / np.maximum(np.diff(w.first), 1)

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(texts) + self.shift, -30, 30)))

    def calibrate(self, x: np.ndarray, label: np.ndarray) -> None:
        """Logistic regression on one number, by Newton steps with a little ridge."""
        if not len(x) or label.min() == label.max():
            return
        spread = max(float(x.std()), 1e-9)
        z, a, b = x / spread, 1.0, 0.0
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            h = p * (1 - p)
            slope = np.array([(p - label) @ z + 0.02 * a, (p - label).sum()])
            curve = np.array([[h @ (z * z) + 0.02, h @ z], [h @ z, h.sum() + 1e-6]])
            step = np.linalg.solve(curve, slope)
            a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        self.slope, self.shift = a / spread, b


def contrast(toxic: tuple[np.ndarray, ...], ordinary: tuple[np.ndarray, ...]) -> Contrast:
    """The tables of two classes, each given as symbols, places and weights of its words."""
    own = [SpellingCounts(*toxic), SpellingCounts(*ordinary)]
    both = SpellingCounts(*[np.concatenate(x) for x in zip(toxic, ordinary, strict=True)])
    keys = {n: np.unique(np.concatenate([c.keys[n] for c in own])) for n in range(OWN_ORDER, ORDER + 1)}
    # shared probabilities of all grams of the highest shared order, from the lowest order up
    top = both.keys[OWN_ORDER - 1]
    chain = [top]
    for _ in range(OWN_ORDER - 2):
        chain.append(suffix(chain[-1]) if len(chain[-1]) else chain[-1])
    probability = np.full(len(top), 1 / 256)
    for n in range(1, OWN_ORDER):
        key = chain[OWN_ORDER - 1 - n]
        probability = both.above(n, key) + both.weight(n, context(key)) * probability
    known, lower = top, np.stack([probability, probability], axis=1)
    gram_keys, gram_values, context_keys, context_values = [], [], [], []
    for n in range(OWN_ORDER, ORDER + 1):
        key = keys[n]
        at = find(known, suffix(key))
        start = (at < 0)  # a gram from the start of a word may have no shorter kin
        below = np.where(start[:, None], 1 / 256, lower[at]) if len(known) else np.full((len(key), 2), 1 / 256)
        heads = context(key)
        above = np.stack([c.above(n, key) for c in own], axis=1)
        share = np.stack([c.weight(n, heads) for c in own], axis=1)
        value = above + share * below
        often = (above > 0).any(axis=1)
        gram_keys.append(key[often])
        gram_values.append(np.log(value[often, 0] / value[often, 1]))
        some = np.unique(heads)
        weights = np.log(own[0].weight(n, some) / own[1].weight(n, some))
        context_keys.append(some[weights != 0])
        context_values.append(weights[weights != 0])
        known, lower = key, value
    g, c = np.concatenate(gram_keys), np.concatenate(context_keys)
    by_g, by_c = np.argsort(g), np.argsort(c)
    return Contrast(g[by_g], np.concatenate(gram_values)[by_g], c[by_c], np.concatenate(context_values)[by_c])


def counted_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols and places of the distinct words of all texts, and in how many texts each word occurs."""
    w = words(texts, ALNUM)
    _, which, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
    owner = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    own = np.unique(owner << 32 | inverse) & 0xFFFFFFFF
    symbols, place = spelt(w, which)
    many = np.bincount(own, minlength=len(which))
    return symbols, place, np.repeat(many, (w.ends - w.starts)[which] + 2)


def train(texts: pa.Array, label: np.ndarray, prior: float = 0.5) -> Contrast:
    """Counts from two thirds of the labelled texts, the curve from the rest, moved from the sample's share of
    toxic texts to the prior."""
    empty = np.zeros(0, np.uint64)
    kept = np.arange(len(label)) % 3 == 2
    counted, held = np.flatnonzero(~kept), np.flatnonzero(kept)
    sides = [counted_words(texts.take(pa.array(counted[label[counted] == value]))) for value in (1, 0)]
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    if not len(sides[0][0]) or not len(sides[1][0]):
        return Contrast(empty, np.zeros(0), empty, np.zeros(0), 1.0, float(np.log(prior / (1 - prior))))
    model = contrast(*sides)
    model.calibrate(model.difference(texts.take(pa.array(held))), label[held].astype(float))
    share = min(max(float(label[held].mean()), 1e-4), 1 - 1e-4)
    model.shift += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS,
        size: int = SAMPLE_BYTES) -> Contrast:
    """Trained on as many texts of each class: the rarer class gives the number, rows and size bound it."""
    known = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id") != 0))
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("label")))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    every = sum(totals.values())
    each = min(rows, *(totals.get(v, 0) for v in (0, 1)))
    prior = totals.get(1, 0) / every if every else 0.5
    chosen = None
    for value in (0, 1):
        part = known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
        chosen = part if chosen is None else chosen.union(part)
    sample = (
        labelled_texts(docs, chosen, size).withColumn("_at", F.xxhash64("doc_id", F.lit(7)))
        .toArrow().sort_by([("_at", "ascending"), ("doc_id", "ascending")]).combine_chunks())
    text = sample.column("text")
    return train(text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text,
                 sample.column("label").to_numpy().astype(int), prior)


def scored(docs: DataFrame, contrast: Contrast, threshold: float = 0.5) -> DataFrame:
    """docs with score and predicted (columns of these names are replaced)."""
    model = docs.sparkSession.sparkContext.broadcast(contrast)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        parts = [model.value.score(p.column(0)) for p in slices(pa.record_batch([texts], names=["text"]))]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")]
    return docs.select(*rest, score(F.col("text")).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
