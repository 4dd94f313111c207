"""Quality classifier: a factorisation machine over hashed words, structure statistics and the size of a text.

The score of a text with features x is the logistic of
    bias + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),
so all pairwise interactions cost one pass over the features. Words are lower-cased runs of non-space,
hashed into WORD_SPACE features with a common length of one; structure statistics (shares of kinds of
characters, words and lines, lengths) enter as their value and as the interval they fall into.

fit() uses labelled rows outside the held-out fold only, at most SAMPLE_ROWS of them (those with the least
hash of their id) with at most SAMPLE_BYTES of text a class and no text over a sixteenth of that, which bounds what
reaches the driver; of rows with one id one text is learnt. Scores read the text alone. Null and empty texts
have no words and all statistics 0 and get the score of these. Several labels of one id: the largest counts;
null labels don't count. Without any usable label every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeframe.llm.sample import labelled_texts
from galeframe.llm.text import LOWER, NOT_SPACE, Words, flat, slices, words

SAMPLE_ROWS = 8_000
SAMPLE_BYTES = 32 << 20  # a class
WORD_SPACE = 1 << 16
FACTORS = 8
BINS = 12
EPOCHS = 8
STEPS = 400        # of training at least, however few rows there are
_B = np.arange(256)
_UPPER = (_B >= 0x41) & (_B <= 0x5A)
_DIGIT = (_B >= 0x30) & (_B <= 0x39)
_ALPHA = _UPPER | ((_B >= 0x61) & (_B <= 0x7A)) | (_B >= 0x80)
_PLAIN_END = np.isin(_B, [ord(c) for c in ".,;:?)'\""])
_SIGN = NOT_SPACE & ~_DIGIT & ~_ALPHA & ~_PLAIN_END
STATISTICS = 12
FEATURES = WORD_SPACE + STATISTICS * (BINS + 1)


def fold(doc_id: Column | str, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(upto[off]).astype(np.float64)


def statistics(raw: np.ndarray, off: np.ndarray, w: Words, distinct: np.ndarray) -> np.ndarray:
    """One row of STATISTICS numbers between 0 and 1 for each text."""
    size = np.maximum(np.diff(off), 1)
    n_words = np.maximum(np.diff(w.first), 1)
    letters = np.maximum(_per_text(_ALPHA[raw], off), 1)
    last, first = raw[w.ends - 1], raw[w.starts]
    many = w.ends - w.starts > 1
    signs_only = np.concatenate([[0], np.cumsum(~_SIGN[raw], dtype=np.int64)])
    bare = signs_only[w.ends] == signs_only[w.starts]
    tail = np.zeros(len(last), bool)
    tail[many] = _SIGN[last[many]] & _SIGN[raw[w.ends[many] - 2]]
    shout = many & _UPPER[first]
    shout[many] &= _UPPER[raw[w.starts[many] + 1]]
    lines = _per_text(raw == 0x0A, off) + 1
    again = np.zeros(len(w.hashes), bool)
    again[1:] = w.hashes[1:] == w.hashes[:-1]

    def share(flags: np.ndarray) -> np.ndarray:
        return _per_text(flags, w.first) / n_words

    return np.stack([
        _per_text(_UPPER[raw], off) / letters,
        _per_text(_DIGIT[raw], off) / size,
        _per_text(_SIGN[raw], off) / size,
        share(bare), share(tail), share(shout), share(again),
        1 - distinct / n_words * (np.diff(w.first) > 0),
        np.minimum(1, np.log1p(np.diff(w.first)) / 12),
        np.minimum(1, _mean_length(w) / 16),
        np.minimum(1, np.log1p(n_words / lines) / 8),
        np.minimum(1, np.log1p(np.diff(off)) / 14),
    ], axis=1)


def _mean_length(w: Words) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(w.ends - w.starts)])
    return np.diff(upto[w.first]) / np.maximum(np.diff(w.first), 1)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, their values and the number of features of each text."""
    w = words(texts, NOT_SPACE)
    raw, off = flat(texts)
    n = len(off) - 1
    owner = np.repeat(np.arange(n), np.diff(w.first))
    keys = np.unique(owner << 16 | (w.hashes % np.uint64(WORD_SPACE)).astype(np.int64))
    distinct = np.bincount(keys >> 16, minlength=n).astype(np.float64)
    stats = statistics(raw, off, w, distinct)
    value = 1 / np.sqrt(np.maximum(distinct, 1))
    base = WORD_SPACE + np.arange(STATISTICS) * (BINS + 1)
    bins = base + 1 + np.minimum((np.sqrt(stats) * BINS).astype(np.int64), BINS - 1)
    counts = distinct.astype(np.int64) + 2 * STATISTICS
    upto = np.cumsum(counts)
    index, values = np.zeros(int(counts.sum()), np.int64), np.zeros(int(counts.sum()))
    at = np.arange(len(keys)) + (keys >> 16) * (2 * STATISTICS)  # the words of a text, then its statistics
    index[at], values[at] = keys & (WORD_SPACE - 1), value[keys >> 16]
    at = upto[:, None] - 2 * STATISTICS + np.arange(STATISTICS)
    index[at], values[at] = base, stats
    index[at + STATISTICS], values[at + STATISTICS] = bins, 0.5
    return index, values, counts


@dataclass
class Machine:
    bias: float
    weights: np.ndarray  # FEATURES
    factors: np.ndarray  # FEATURES x FACTORS

    def raw(self, index: np.ndarray, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Scores before the logistic; counts are 1 at least."""
        first = np.cumsum(counts) - counts
        linear = np.add.reduceat(self.weights[index] * values, first)
        own = self.factors[index] * values[:, None]
        total, squares = np.add.reduceat(own, first), np.add.reduceat((own * own).sum(1), first)
        return self.bias + linear + 0.5 * ((total * total).sum(1) - squares)

    def score(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(*features(texts)), -30, 30)))


def train(index: np.ndarray, values: np.ndarray, counts: np.ndarray, label: np.ndarray, epochs: int = EPOCHS,
          rate: float = 0.05, decay: float = 1e-5) -> Machine:
    """Adagrad on the logistic loss, in batches of a fixed order."""
    rng = np.random.default_rng(9)
    if not len(label):
        return Machine(0.0, np.zeros(FEATURES), np.zeros((FEATURES, FACTORS)))
    m = Machine(0.0, np.zeros(FEATURES), rng.normal(0, 0.01, (FEATURES, FACTORS)))
    mean = np.clip(label.mean(), 0.01, 0.99)
    m.bias = float(np.log(mean / (1 - mean)))
    grown_w, grown_v, grown_b = np.full(FEATURES, 1e-4), np.full((FEATURES, FACTORS), 1e-4), 1e-4
    start = np.cumsum(counts) - counts
    parts = max(1, len(label) // 128)
    for _ in range(max(epochs, -(-STEPS // parts))):
        for rows in np.array_split(rng.permutation(len(label)), parts):
            n = counts[rows]
            begin = np.cumsum(n) - n
            at = np.arange(int(n.sum())) + np.repeat(start[rows] - begin, n)
            i, x = index[at], values[at]
            own = m.factors[i] * x[:, None]
            total = np.add.reduceat(own, begin)
            z = m.bias + np.add.reduceat(m.weights[i] * x, begin) + 0.5 * (
                (total * total).sum(1) - np.add.reduceat((own * own).sum(1), begin))
            slope = np.repeat((1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]) / len(rows), n)
            used, inverse = np.unique(i, return_inverse=True)
            gw = np.bincount(inverse, weights=slope * x) + decay * m.weights[used]
            gv = np.zeros((len(used), FACTORS))
            for f in range(FACTORS):
                gv[:, f] = np.bincount(inverse, weights=slope * x * (np.repeat(total[:, f], n) - own[:, f]))
            gv += decay * m.factors[used]
            gb = slope[begin].sum()
            grown_w[used] += gw * gw
            grown_v[used] += gv * gv
            grown_b += gb * gb
            m.weights[used] -= rate * gw / np.sqrt(grown_w[used])
            m.factors[used] -= rate * gv / np.sqrt(grown_v[used])
            m.bias -= rate * gb / np.sqrt(grown_b)
    return m


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS,
                    size: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most so many labelled ids outside the held-out fold."""
    known = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id") != 0))
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("label")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return labelled_texts(docs, chosen, size)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS,
        size: int = SAMPLE_BYTES) -> Machine:
    def encoded(batches):
        for batch in batches:
            for part in slices(batch):
                index, values, counts = features(part.column("text"))
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                yield pa.record_batch([
                    part.column("doc_id"), part.column("label"), pa.ListArray.from_arrays(offsets, pa.array(index, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(values, pa.float32()))], names=["doc_id", "label", "i", "x"])

    sample = labelled_sample(docs, labels, label, rows, size).withColumn("doc_id", F.col("doc_id").cast("string"))
    got = sample.mapInArrow(encoded, "doc_id string, label int, i array<int>, x array<float>").toArrow().sort_by(
        "doc_id").combine_chunks()  # batches of training in an order that doesn't hang on the partitions
    index, values = (got.column(c).combine_chunks() for c in ("i", "x"))
    counts = np.diff(index.offsets.to_numpy()) if len(got) else np.zeros(0, np.int64)
    return train(index.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy().astype(np.float64), counts,
                 got.column("label").to_numpy().astype(np.float64))


def scored(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted (columns of these names are replaced)."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        parts = [model.value.score(p.column(0)) for p in slices(pa.record_batch([texts], names=["text"]))]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")]
    return docs.select(*rest, score(F.col("text")).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
