"""Benchmark decontamination: a distributed positional inverted index.

build_index() stores, block of documents by block, one posting list per benchmark term: documents and word
positions. Windows of the benchmark (so many words in a row, or a shorter item whole) are looked up by
intersecting offset-adjusted lists, the term that is rarest in the whole index first: a posting of the
rarest term proposes a place, and every further list drops the places where it has no posting at the
offset. With slop, a term may stand so many words from its offset (proximity matches).

Terms are words of letters, digits and characters beyond ASCII, A-Z lower-cased, as 64-bit hashes (a false
match of ten words takes ten collisions). A fixed-size bit table of the benchmark's terms keeps all other
words out of the index. Windows are broadcast in slices of at most WINDOWS; beyond it there are several
rounds over the index.

Null and empty texts have no words and no hits; items without words or without an id have no window. Every row of
documents gives one row, repeated or null ids too. Empty tables: no windows, no hits. Extra columns are left
out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.folding import fold
from galeframe.llm.text import ALNUM, lists, slices, words
from galeframe.session import scratch_path

WINDOWS = 200_000     # windows looked up at a time
FILTER_BITS = 22
PLACES = 1 << 21      # proposed places held at a time
BLOCK_BYTES = 4 << 20
INDEX = "block long, term long, docs array<int>, positions array<int>, ids array<long>"


def windows(items: DataFrame, size: int) -> DataFrame:
    """item_id and the terms (array<long>) of every window of its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"), ALNUM)
                n = np.diff(w.first)
                many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
                owner = np.repeat(np.arange(len(n)), many)
                start = w.first[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
                length = np.minimum(n[owner], size)
                at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
                yield pa.record_batch([
                    part.column("item_id").take(pa.array(owner)), lists(w.hashes[at].view(np.int64), length, pa.int64())],
                    names=["item_id", "terms"])

    return items.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(
        run, "item_id long, terms array<long>")


def term_filter(wanted: DataFrame) -> np.ndarray:
    """Bits of the leading FILTER_BITS bits of all terms: a table of fixed size."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            terms = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            bits[(terms >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        yield pa.record_batch([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    packed = fold(wanted.select("terms").mapInArrow(mark, "bits binary"), np.uint8, np.bitwise_or)
    return np.zeros(1 << FILTER_BITS, bool) if packed is None else np.unpackbits(packed).astype(bool)


def build_index(docs: DataFrame, wanted: DataFrame, path: str) -> DataFrame:
    """The stored index of docs for the terms of the windows. A block is about BLOCK_BYTES of text (a longer
    text is a block of its own); its row without a term holds ids and word counts of its documents."""
    bits = docs.sparkSession.sparkContext.broadcast(term_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block = bits.value, TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, size=BLOCK_BYTES):
                w = words(part.column("text"), ALNUM)
                n = np.diff(w.first)
                kept = np.flatnonzero(known[(w.hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                order = kept[np.argsort(w.hashes[kept].view(np.int64), kind="stable")]
                term = w.hashes[order].view(np.int64)
                doc = np.searchsorted(w.first, order, "right") - 1
                head = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
                many = np.diff(np.append(head, len(term)))
                rows = len(head) + 1
                yield pa.record_batch([
                    pa.array(np.full(rows, block)),
                    pa.concat_arrays([pa.array(term[head], pa.int64()), pa.nulls(1, pa.int64())]),
                    lists(np.concatenate([doc, np.arange(len(n))]), np.append(many, len(n)), pa.int32()),
                    lists(np.concatenate([order - w.first[doc], n]), np.append(many, len(n)), pa.int32()),
                    pa.concat_arrays([pa.nulls(rows - 1, pa.list_(pa.int64())),
                                      pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), _plain(part.column("doc_id")))]),
                ], names=["block", "term", "docs", "positions", "ids"])
                block += 1

    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _plain(column: pa.Array) -> pa.Array:
    return pa.concat_arrays([column]) if not isinstance(column, pa.ChunkedArray) else column.combine_chunks()


def rarest_first(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """item_id and terms as (frequency in the index, offset, term), rarest first, of the windows of which
    every term occurs."""
    frequency = index.filter("term is not null").groupBy("term").agg(F.sum(F.size("docs")).alias("often"))
    spread = wanted.withColumn("_w", F.monotonically_increasing_id()).select(
        "_w", "item_id", F.size("terms").alias("_n"), F.posexplode("terms").alias("at", "term"))
    # a window has few terms, so the collected lists are short
    return (spread.join(frequency, "term").groupBy("_w", "item_id", "_n")
            .agg(F.array_sort(F.collect_list(F.struct("often", "at", "term"))).alias("terms"))
            .filter(F.size("terms") == F.col("_n")).select("item_id", "terms"))


class Lookup:
    """A slice of windows, rarest terms first, as matrices."""

    def __init__(self, got: pa.Table):
        got = got.combine_chunks()
        self.items = got.column("item_id").to_numpy(zero_copy_only=False)
        column = got.column("terms")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        flat = column.flatten()
        self.length = np.diff(column.offsets.to_numpy()).astype(np.int64) if len(got) else np.zeros(0, np.int64)
        width = int(self.length.max()) if len(self.length) else 0
        cell = np.arange(width) < self.length[:, None]
        self.terms, self.at = np.zeros(cell.shape, np.int64), np.zeros(cell.shape, np.int64)
        self.terms[cell] = flat.field("term").to_numpy(zero_copy_only=False)
        self.at[cell] = flat.field("at").to_numpy(zero_copy_only=False)


def search(block: pa.Table, lookup: Lookup, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Matches in one block: window number and start (a place in the block's row of words), and where the
    documents of the block begin and how many words they have. Documents stand apart by more than a window."""
    block = block.combine_chunks()
    term = block.column("term").to_pylist()
    head = term.index(None)
    docs, places = (block.column(c).combine_chunks() if isinstance(block.column(c), pa.ChunkedArray) else block.column(c)
                    for c in ("docs", "positions"))
    off = docs.offsets.to_numpy()
    flat_docs, flat_places = docs.flatten().to_numpy(), places.flatten().to_numpy().astype(np.int64)
    n = flat_places[off[head]:off[head + 1]]
    width = lookup.terms.shape[1]
    base = np.cumsum(n + width + slop) - (n + width + slop) + width + slop
    keys = np.array([0 if t is None else t for t in term], np.int64)
    rows = np.argsort(keys, kind="stable")
    rows = rows[rows != head]
    keys = keys[rows]
    many = np.diff(off)[rows]
    at = np.repeat(off[:-1][rows] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    place = base[flat_docs[at]] + flat_places[at]
    codes = np.repeat(np.arange(len(rows)), many) << 40 | place  # sorted: by term, then place
    first = np.cumsum(many) - many
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), base, n)
    if not len(keys) or not len(lookup.length):
        return none
    t = np.minimum(np.searchsorted(keys, lookup.terms), len(keys) - 1)
    cell = np.arange(width) < lookup.length[:, None]
    alive = np.flatnonzero(((keys[t] == lookup.terms) | ~cell).all(axis=1))
    out_w, out_s = [], []
    upto, begin = np.cumsum(many[t[alive, 0]]), 0
    while begin < len(alive):
        done = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, done + PLACES, "right")))
        w = alive[begin:end]
        k = many[t[w, 0]]
        which = np.repeat(w, k)
        start = place[np.repeat(first[t[w, 0]] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))] - lookup.at[which, 0]
        for r in range(1, width):
            asked = lookup.length[which] > r
            want = t[which, r] << 40 | (start + lookup.at[which, r])
            near = np.minimum(np.searchsorted(codes, want - slop), len(codes) - 1)
            good = ~asked | ((codes[near] >= want - slop) & (codes[near] <= want + slop))
            which, start = which[good], start[good]
        out_w.append(which)
        out_s.append(start)
        begin = end
    if not out_w:
        return none
    return np.concatenate(out_w), np.concatenate(out_s), base, n


def _searcher(lookup: Broadcast, slop: int) -> Callable[[pa.Table], pa.Table]:
    def run(block: pa.Table) -> pa.Table:
        look = lookup.value
        which, start, base, n = search(block, look, slop)
        head = block.column("term").to_pylist().index(None)
        size = int(base[-1] + n[-1]) if len(n) else 0
        delta = np.zeros(size + 2, np.int64)
        left = np.maximum(start, 0)
        end = np.minimum(start + look.length[which] if len(start) else start, size)
        np.add.at(delta, left, 1)
        np.add.at(delta, end, -1)
        inside = np.cumsum(delta)[:-1] > 0
        turn = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        runs_a, runs_b = turn[::2], turn[1::2]
        doc = np.searchsorted(base, runs_a, "right") - 1
        spans = pa.StructArray.from_arrays(
            [pa.array(runs_a - base[doc], pa.int32()), pa.array(np.minimum(runs_b - base[doc], n[doc]), pa.int32())],
            names=["first", "end"])
        m_doc = np.searchsorted(base, start, "right") - 1
        pairs = np.unique(np.stack([m_doc, look.items[which] if len(which) else m_doc], axis=1), axis=0) \
            if len(which) else np.zeros((0, 2), np.int64)
        docs = len(n)
        return pa.table({
            "block": pa.array(np.full(docs, block.column("block")[0].as_py()), pa.int64()),
            "nth": pa.array(np.arange(docs), pa.int32()),
            "doc_id": pa.array(block.column("ids")[head].as_py(), pa.int64()),
            "n_words": pa.array(n, pa.int64()),
            "spans": lists_of(spans, np.bincount(doc, minlength=docs)),
            "items": lists(pairs[:, 1], np.bincount(pairs[:, 0], minlength=docs), pa.int64()),
        })

    return run


def hits(index: DataFrame, wanted: DataFrame, slop: int = 0) -> DataFrame:
    """For every indexed document: block, nth (its place in the block), doc_id, n_words, spans (the merged
    runs of words inside matches, as first word and end) and items (sorted item ids with a match)."""
    spark = index.sparkSession
    path = scratch_path(spark, "windows")
    rarest_first(index, wanted).write.parquet(path)
    ordered = spark.read.parquet(path)
    rounds = max(1, -(-ordered.count() // WINDOWS))
    result: DataFrame | None = None
    for k in range(rounds):
        lookup = spark.sparkContext.broadcast(Lookup(
            ordered.filter(F.pmod(F.xxhash64("terms"), F.lit(rounds)) == k).toArrow()))

        part = index.groupBy("block").applyInArrow(
            _searcher(lookup, slop), "block long, nth int, doc_id long, n_words long, spans array<struct<first:int,end:int>>, items array<long>")
        result = part if result is None else result.unionAll(part)
    if rounds == 1:
        return result
    flat = F.flatten(F.collect_list("spans"))
    together = result.groupBy("block", "nth").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(flat).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    kind = "array<struct<first:int,end:int>>"
    touches = lambda acc, x: F.element_at(acc, -1)["end"] >= x["first"]
    merged = F.aggregate("s", F.array().cast(kind), lambda acc, x: F.when(
        (F.size(acc) > 0) & touches(acc, x),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["first"].alias("first"),
            F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))
    ).otherwise(F.concat(acc, F.array(x))).cast(kind))
    return together.select("block", "nth", "doc_id", "n_words", merged.alias("spans"), "items")


def lists_of(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 0) -> DataFrame:
    """One row per row of docs: doc_id, n_words, spans, items (see hits)."""
    wanted = windows(items, size)
    index = build_index(docs, wanted, scratch_path(docs.sparkSession, "positional-index"))
    return hits(index, wanted, slop).drop("block", "nth")
