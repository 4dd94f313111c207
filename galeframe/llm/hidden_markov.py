"""LM scoring: a hidden Markov language model.

Words with at least a 1/OWN_CLASSES share of the training tokens are symbols of their own; all others share a
symbol by their spelling (first byte, last two bytes). A latent state chain emits symbols, and a spelling
symbol emits one of its words by the words' counts, half a count added to each and to one unknown word, so
the score is a log-probability over all texts. Baum-Welch runs over all training texts: partitions compute
expected counts by scaled forward and backward recursions, Spark adds them up, ROUNDS times at every size. The
score of a text is its exact likelihood by the scaled forward recursion over all its tokens; in training, texts are cut into
chains of CHAIN tokens, each with the last CONTEXT tokens of the one before, which lead its states in but are not
counted again. So every token and every transition counts once, and only texts' own beginnings count as starts.

Layout: a block holds about BLOCK_BYTES of text: the distinct words, their counts in training texts, and the
tokens as numbers into these words. Word counts are added up over blocks and joined back to the blocks; no
vocabulary is broadcast or collected. What is broadcast is bounded: OWN_CLASSES + SPELLINGS + 1 symbols.
Words are told apart by 64-bit hashes.

Null and empty texts are one end token. A null id counts as training. Repeated ids are scored row by row. An
empty table gives an empty table. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.factorisation import fold
from galeframe.llm.text import NOT_SPACE, lists, mix, slices, words
from galeframe.session import scratch_path

STATES = 8
OWN_CLASSES = 1 << 14
SPELLINGS = 1 << 11
BLOCK_BYTES = 20 << 20
CHAIN = 256
CONTEXT = 16         # tokens before a chain that its states are led in by
ROUNDS = 6
LOCKSTEP = 400_000   # training tokens worked on together
END_WORD = np.uint64(0x0123456789ABCDEF)  # stands for the end token; words hash elsewhere but for one in 2^64


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpack(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _spelling(w, where: np.ndarray) -> np.ndarray:
    """The spelling symbol of words, from their first byte and their last two."""
    last = w.data[w.ends[where] - 1].astype(np.uint64)
    before = w.data[np.maximum(w.ends[where] - 2, w.starts[where])].astype(np.uint64)
    first = w.data[w.starts[where]].astype(np.uint64)
    return (mix(first << np.uint64(16) | before << np.uint64(8) | last) % np.uint64(SPELLINGS)).astype(np.int64)


BLOCKS = ("block long, ids array<long>, held array<boolean>, lengths array<int>, tokens binary, "
          "words array<long>, train array<int>, spelling array<int>")


def blocks(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, held. One row per block."""
    def build(parts: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        hashes, where, lengths, spell = [], [], [], []
        for part in parts:
            w = words(part.column("text"), NOT_SPACE)
            own, first = np.unique(w.hashes, return_index=True)
            hashes.append(w.hashes)
            where.append(own)
            spell.append(_spelling(w, first))
            lengths.append(np.diff(w.first))
        keys = np.concatenate(where)
        vocabulary, at = np.unique(keys, return_index=True)
        spelling = np.concatenate(spell)[at]
        length = np.concatenate(lengths)
        held = np.concatenate([p.column("held").to_numpy(zero_copy_only=False) for p in parts]).astype(bool)
        vocabulary = np.append(vocabulary, END_WORD)
        spelling = np.append(spelling, 0)
        ends = np.cumsum(length + 1) - 1
        tokens = np.full(int((length + 1).sum()), len(vocabulary) - 1, np.int32)
        inner = np.ones(len(tokens), bool)
        inner[ends] = False
        tokens[inner] = np.searchsorted(vocabulary[:-1], np.concatenate(hashes))
        train = np.bincount(tokens[np.repeat(~held, length + 1)], minlength=len(vocabulary))
        # frequent words get small numbers, which pack well
        order = np.argsort(-np.bincount(tokens, minlength=len(vocabulary)), kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        one = np.array([len(order)])
        ids = pa.concat_arrays([p.column("doc_id") for p in parts])
        whole = pa.array([0, len(ids)], pa.int32())
        return pa.record_batch([
            pa.array([number]), pa.ListArray.from_arrays(whole, ids), pa.ListArray.from_arrays(whole, pa.array(held)),
            pa.ListArray.from_arrays(whole, pa.array(length + 1, pa.int32())), pa.array([_pack(place[tokens])], pa.binary()),
            lists(vocabulary[order].view(np.int64), one, pa.int64()), lists(train[order], one, pa.int32()),
            lists(spelling[order], one, pa.int32())],
            names=["block", "ids", "held", "lengths", "tokens", "words", "train", "spelling"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in slices(batch):
                parts.append(part)
                size += part.nbytes
                if size >= BLOCK_BYTES:
                    yield build(parts, number)
                    number, parts, size = number + 1, [], 0
        if parts:
            yield build(parts, number)

    return docs.mapInArrow(run, BLOCKS)


class Symbols:
    """Which symbol a word is, and its probability within the symbol. Numbers: own words, spellings, the end."""

    def __init__(self, own: np.ndarray, total: np.ndarray, kinds: np.ndarray):
        self.own = np.sort(own)
        self.total, self.kinds = total, kinds
        self.size = len(own) + SPELLINGS + 1

    def of(self, hashes: np.ndarray, spelling: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.own, hashes), max(0, len(self.own) - 1))
        frequent = self.own[at] == hashes if len(self.own) else np.zeros(len(hashes), bool)
        symbol = np.where(frequent, at, len(self.own) + spelling)
        end = hashes == END_WORD
        symbol[end] = self.size - 1
        within = np.log10((count + 0.5) / (self.total[spelling] + 0.5 * (self.kinds[spelling] + 1)))
        within[frequent | end] = 0.0
        return symbol, within


CODED = ("block long, ids array<long>, held array<boolean>, lengths array<int>, known array<int>, base array<double>, "
         "within array<double>, symbols binary")


def _coder(symbols):
    def run(counted: pa.Table, block: pa.Table) -> pa.Table:
        row = {c: block.column(c)[0] for c in block.column_names}
        tokens = _unpack(row["tokens"].as_py(), np.int32)
        hashes = row["words"].values.to_numpy().view(np.uint64)
        count = np.zeros(len(hashes))
        count[counted.column("at").to_numpy()] = counted.column("count").to_numpy()
        symbol, within = symbols.value.of(hashes, row["spelling"].values.to_numpy().astype(np.int64), count)
        length = row["lengths"].values.to_numpy().astype(np.int64)
        first = np.cumsum(length) - length
        base = np.add.reduceat(np.log10(count + 0.5)[tokens], first)
        known = np.add.reduceat((count > 0)[tokens].astype(np.int64), first)
        one = np.array([len(length)])
        return pa.table({
            "block": block.column("block"), "ids": block.column("ids"), "held": block.column("held"),
            "lengths": block.column("lengths"), "known": lists(known, one, pa.int32()),
            "base": lists(base, one, pa.float64()), "within": lists(np.add.reduceat(within[tokens], first), one, pa.float64()),
            "symbols": pa.array([_pack(symbol.astype(np.uint16)[tokens])], pa.binary())})

    return run


class Chain:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # K, K x K, symbols x K

    @staticmethod
    def random(size: int) -> Chain:
        rng = np.random.default_rng(8)
        move = np.full((STATES, STATES), 0.2 / STATES) + np.eye(STATES) * 0.8
        emit = rng.gamma(1.0, size=(size, STATES)) + 0.1
        return Chain(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Chain:
        """Expected counts made probabilities; a little of the overall frequencies goes to every state."""
        overall = emit.sum(1) + 0.5
        overall = overall / overall.sum()
        emit = emit + 5.0 * overall[:, None]
        move, start = move + 1.0 / STATES, start + 1.0 / STATES
        return Chain(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def log10(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Exact log10-likelihood of every sequence: all of them step by step, the longest first."""
        order = np.argsort(-lengths, kind="stable")
        n, first = lengths[order], (np.cumsum(lengths) - lengths)[order]
        out = np.zeros(len(n))
        live = len(n)
        alpha = self.emit[symbols[first]] * self.start
        for t in range(int(n[0]) if len(n) else 0):
            if t:
                while live and n[live - 1] <= t:
                    live -= 1
                alpha = (alpha[:live] @ self.move) * self.emit[symbols[first[:live] + t]]
            scale = alpha.sum(1)
            out[:live] += np.log10(scale)
            alpha /= scale[:, None]
        result = np.empty(len(n))
        result[order] = out
        return result

    def expect(self, symbols: np.ndarray, first: np.ndarray, n: np.ndarray, context: np.ndarray, counts: np.ndarray,
               moves: np.ndarray, starts: np.ndarray) -> None:
        """Adds the expected counts of chains, sorted by falling length; the first context tokens of a chain are not its own."""
        longest = int(n[0])
        lives = np.searchsorted(-n, -np.arange(1, longest + 1), "right")
        states, emitted, scales = [], [], []
        for t in range(longest):
            e = self.emit[symbols[first[:lives[t]] + t]]
            alpha = e * self.start if t == 0 else (states[-1][:lives[t]] @ self.move) * e
            scale = alpha.sum(1, keepdims=True)
            states.append(alpha / scale)
            emitted.append(e)
            scales.append(scale)
        beta = np.ones((lives[-1], STATES))
        gammas, order = [], []
        for t in range(longest - 1, -1, -1):
            if t < longest - 1:
                after = emitted[t + 1] * beta / scales[t + 1]
                entered = (context[:lives[t + 1]] <= t + 1)[:, None]
                moves += ((states[t][:lives[t + 1]] * entered).T @ after) * self.move
                beta = np.ones((lives[t], STATES))
                beta[:lives[t + 1]] = after @ self.move.T
            gammas.append(states[t] * beta * (context[:lives[t]] <= t)[:, None])
            order.append(symbols[first[:lives[t]] + t])
        starts += gammas[-1].sum(0)
        gamma, symbol = np.concatenate(gammas), np.concatenate(order)
        for k in range(STATES):
            counts[:, k] += np.bincount(symbol, weights=gamma[:, k], minlength=len(counts))


def _chains(lengths: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token, length and number of context tokens of the chains of training texts, longest first."""
    first = (np.cumsum(lengths) - lengths)[~held]
    length = lengths[~held]
    pieces = -(-length // CHAIN)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    context = np.where(nth > 0, CONTEXT, 0)
    start = np.repeat(first, pieces) + nth * CHAIN - context
    size = np.minimum(CHAIN, np.repeat(length, pieces) - nth * CHAIN) + context
    order = np.argsort(-size, kind="stable")
    return start[order], size[order], context[order]


def expected(coded: DataFrame, chain: Chain) -> Chain | None:
    """One round of Baum-Welch over the blocks of coded; None without training tokens."""
    model = coded.sparkSession.sparkContext.broadcast(chain)
    names = [f"s{k}" for k in range(STATES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        counts, moves, starts = np.zeros_like(own.emit), np.zeros_like(own.move), np.zeros_like(own.start)
        for batch in batches:
            for r in range(batch.num_rows):
                symbols = _unpack(batch.column("symbols")[r].as_py(), np.uint16)
                first, n, context = _chains(batch.column("lengths")[r].values.to_numpy().astype(np.int64),
                                            batch.column("held")[r].values.to_numpy(zero_copy_only=False))
                upto, begin = np.cumsum(n), 0
                while begin < len(n):
                    base = upto[begin - 1] if begin else 0
                    end = max(begin + 1, int(np.searchsorted(upto, base + LOCKSTEP, "right")))
                    own.expect(symbols, first[begin:end], n[begin:end], context[begin:end], counts, moves, starts)
                    begin = end
        used = np.flatnonzero(counts.any(axis=1))
        # rows of symbols, then those of states (-1 and below), then the start
        number = np.concatenate([used, -1 - np.arange(STATES), [-1 - STATES]])
        table = np.concatenate([counts[used], moves, starts[None]])
        yield pa.record_batch([pa.array(number), *[pa.array(table[:, k]) for k in range(STATES)]], names=["symbol", *names])

    sums = coded.select("lengths", "held", "symbols").mapInArrow(
        run, "symbol long, " + ", ".join(f"{c} double" for c in names)).groupBy("symbol").agg(
        *[F.sum(c).alias(c) for c in names]).toPandas()  # one row a symbol: bounded
    number, table = sums["symbol"].to_numpy(), sums[names].to_numpy()
    emit = np.zeros_like(chain.emit)
    emit[number[number >= 0]] = table[number >= 0]
    if not emit.any():
        return None
    move = np.zeros_like(chain.move)
    inner = (number < 0) & (number >= -STATES)
    move[-1 - number[inner]] = table[inner]
    return Chain.from_counts(table[number == -1 - STATES][0], move, emit)


def train(coded: DataFrame, size: int, rounds: int = ROUNDS) -> Chain:
    chain = Chain.random(size)
    for _ in range(rounds):
        chain = expected(coded, chain) or chain
    return chain


def score(docs: DataFrame, held_out: int = 1, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams) and score for every row."""
    spark = docs.sparkSession
    held = F.coalesce(fold("doc_id") == held_out, F.lit(False))
    stored_at = scratch_path(spark, "blocks")
    blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held"))).write.option(
        "compression", "zstd").parquet(stored_at)
    stored = spark.read.parquet(stored_at)
    each = stored.select("block", F.explode(F.arrays_zip(
        "words", "train", "spelling", F.sequence(F.lit(0), F.size("words") - 1).alias("at"))).alias("w")).select(
        "block", "w.words", "w.train", "w.spelling", "w.at")
    path = scratch_path(spark, "counts")
    each.groupBy("words").agg(F.sum("train").alias("count"), F.first("spelling").alias("spelling")).write.option(
        "compression", "zstd").parquet(path)
    counts = spark.read.parquet(path)
    whole = counts.agg(F.sum("count").alias("n"), F.sum((F.col("count") > 0).cast("long")).alias("v")).first()
    n, v = whole["n"] or 0, whole["v"] or 0
    frequent = (F.col("count") * OWN_CLASSES >= n) & (F.col("count") > 0) & (F.col("words") != int(END_WORD))
    own = counts.filter(frequent).select("words").toArrow().column(0).to_numpy()  # OWN_CLASSES rows at most
    spelt = counts.filter(~frequent & (F.col("count") > 0) & (F.col("words") != int(END_WORD))).groupBy("spelling").agg(
        F.sum("count").alias("c"), F.count("*").alias("k")).toPandas()
    total, kinds = np.zeros(SPELLINGS), np.zeros(SPELLINGS)
    total[spelt["spelling"]], kinds[spelt["spelling"]] = spelt["c"], spelt["k"]
    symbols = Symbols(own.view(np.uint64), total, kinds)
    shared = spark.sparkContext.broadcast(symbols)
    told = each.select("block", "words", "at").join(counts.select("words", "count"), "words").select("block", "at", "count")
    path = scratch_path(spark, "coded")
    again = spark.read.parquet(stored_at)  # read anew, so that its columns are not those of the words above
    told.groupBy("block").cogroup(again.select("block", "ids", "held", "lengths", "tokens", "words", "spelling").groupBy(
        "block")).applyInArrow(_coder(shared), CODED).write.option("compression", "zstd").parquet(path)
    coded = spark.read.parquet(path)
    chain = spark.sparkContext.broadcast(train(coded, symbols.size, rounds))
    per_token = float(np.log10(n + 0.5 * (v + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].values for c in ("ids", "held", "lengths", "known", "base", "within")}
                length = row["lengths"].to_numpy().astype(np.int64)
                got = chain.value.log10(_unpack(batch.column("symbols")[r].as_py(), np.uint16).astype(np.int64), length)
                yield pa.record_batch([
                    row["ids"], row["held"], pa.array(length), row["known"].cast(pa.int64()),
                    pa.array(np.full(len(length), n)), pa.array(row["base"].to_numpy() - length * per_token),
                    pa.array(got + row["within"].to_numpy())],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return coded.drop("block").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
