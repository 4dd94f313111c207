"""N-gram Jaccard join with set-relation skipping.

The set of a document is its distinct word shingles (64-bit hashes: two sets of n and m shingles meet a false
common one with chance n m / 2^64). Two sets link when 100 * intersection >= percent * union, so both hold a
common shingle among their first n - ceil(percent n / 100) + 1 in one global order, rare before frequent. The
order comes from a count sketch of all shingles of all documents; it steers the work, never the result.

* Index lists, one per prefix shingle, know the place of the shingle in each set. Block skipping: sets of a
  list are put in blocks by size and place, and a pair of blocks is left out as a whole when its sizes or the
  shingles that follow the places can't reach the threshold; then pairs by the same bound.
* Answers from a similar set: each list is first held against its leader only, the set where the shingle comes
  earliest. A set that is verified to link with its leader takes part in all that the leader's answer holds:
  it is in the leader's class, and pairs inside one class are never made. Lists whose sets have fallen into
  one class are done; others get a new leader, and what then remains small is compared block by block.

Equal sets are one set with members. Verified links are contracted to classes (galeframe.llm.graph). No list
is gathered in a task: leaders come from partial minima, pairs from joins that can be split.

Null and empty texts, and texts of blanks only, have an empty set and link with nothing; fewer words than a
shingle make one shingle of all words. A null id keeps its row, alone, with a null class. Rows with one id
share a class. Extra columns are left out. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.llm.folding import fold
from galeframe.llm.graph import components
from galeframe.llm.scratch import Scratch
from galeframe.llm.text import NOT_SPACE, lists, mix, runs, slices, words

SKETCH_BITS = 19
ID_BITS = 23
PAIRS_A_POSTING = 8  # left at most, of all postings of shared shingles: then block by block


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = words(texts, NOT_SPACE)
    every = runs(w.hashes, size) if len(w.hashes) >= size else w.hashes[:0]
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(every[a:b - size + 1])
        elif b > a:
            yield runs(w.hashes[a:b], b - a)
        else:
            yield w.hashes[:0]


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sketch(docs: DataFrame, size: int) -> np.ndarray:
    """Sets per hash bucket, over all documents: a table of fixed size, added up tree-wise."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for part in slices(batch):
                sets = list(shingle_sets(part.column(0), size))
                total += np.bincount(_bucket(np.concatenate(sets)), minlength=len(total))
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    total = fold(docs.select("text").mapInArrow(count, "counts binary"), np.int64, np.add)
    return np.zeros(1 << SKETCH_BITS, np.int64) if total is None else total


def prefixes(docs: DataFrame, size: int, percent: int, order: np.ndarray) -> DataFrame:
    """doc_id, n, two fingerprints of the set, the prefix shingles in the global order, and the histogram."""
    # only what stands out of the sketch's noise tells a shingle's rank; the rest go by their hash
    rank = np.maximum(order - 2 * int(order.mean()) - 16, 0)
    shared = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for batch in batches:
            for part in slices(batch):
                n, a, b, kept, lengths, parts = [], [], [], [], [], []
                for own in shingle_sets(part.column("text"), size):
                    n.append(len(own))
                    a.append(int(own.sum(dtype=np.uint64)))
                    b.append(int(mix(own).sum(dtype=np.uint64)))
                    k = len(own) - -(-percent * len(own) // 100) + 1 if len(own) else 0
                    r = ranks[_bucket(own)]
                    kept.append(own[np.argsort(r, kind="stable")[:k]] if r.any() else own[:k])
                    lengths.append(k)
                    parts.append(_histogram(own))
                flat = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
                yield pa.record_batch([
                    part.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.array(a, np.uint64).view(np.int64)),
                    pa.array(np.array(b, np.uint64).view(np.int64)),
                    lists(flat.view(np.int64), np.array(lengths, np.int64), pa.int64()),
                    pa.array(parts, pa.binary())],
                    names=["doc_id", "n", "fa", "fb", "prefix", "parts"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n long, fa long, fb long, prefix array<long>, parts binary")


def _histogram(own: np.ndarray) -> bytes:
    """How many hashes of a set fall into each of equal parts of the hash space, two to four on average."""
    bits = max(0, len(own).bit_length() - 2)
    return np.minimum(np.bincount((own >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(own), np.int64),
                                  minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _may_link(a: bytes, b: bytes, percent: int) -> bool:
    """The parts' smaller counts bound the intersection from above, so what they rule out can't link."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    if x.max() == 255 or y.max() == 255:
        return True
    if len(x) > len(y):
        x = x.reshape(len(y), -1).sum(1)
    elif len(y) > len(x):
        y = y.reshape(len(x), -1).sum(1)
    common = int(np.minimum(x, y).sum())
    return 100 * common >= percent * (int(x.sum()) + int(y.sum()) - common)


def filtered(base: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the histograms of their sets don't rule out."""
    told = base.filter("n > 0").select("doc_id", "parts")
    both = pairs.join(told.select(F.col("doc_id").alias("a"), F.col("parts").alias("x")), "a").join(
        told.select(F.col("doc_id").alias("b"), F.col("parts").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [_may_link(x.as_py(), y.as_py(), percent) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def id_filter(pairs: DataFrame) -> np.ndarray:
    """Bits of the hashes of the ids in pairs: a table of fixed size, joined tree-wise."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << ID_BITS, bool)
        for batch in batches:
            for c in ("a", "b"):
                bits[_id_place(batch.column(c))] = True
        yield pa.record_batch([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    packed = fold(pairs.select("a", "b").mapInArrow(mark, "bits binary"), np.uint8, np.bitwise_or)
    return np.zeros(1 << ID_BITS, bool) if packed is None else np.unpackbits(packed).astype(bool)


def _id_place(ids: pa.Array) -> np.ndarray:
    return (mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> np.uint64(64 - ID_BITS)).astype(np.int64)


def verified(docs: DataFrame, base: DataFrame, pairs: DataFrame, size: int, percent: int, tables: Scratch) -> DataFrame:
    """The pairs (a, b) whose whole sets link: first by their histograms, then by their texts. Texts that no
    pair names stay where they are (a bit table of fixed size keeps most of them from the join)."""
    pairs = tables.written(filtered(base, pairs, percent))
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(pairs))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bits.value[_id_place(batch.column("doc_id"))]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "x"):
                x, y = (shingle_sets(part.column(c), size) for c in ("x", "y"))
                good = []
                for one, other in zip(x, y, strict=True):
                    common = len(np.intersect1d(one, other, assume_unique=True))
                    good.append(100 * common >= percent * (len(one) + len(other) - common))
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    some = docs.filter("doc_id is not null").mapInArrow(asked, "doc_id long, text string")
    both = pairs.join(some.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a").join(
        some.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _reachable(percent: int, n1: str, p1: str, n2: str, p2: str) -> Column:
    """Whether two sets that have their first common shingle at these places can link."""
    sizes = (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2))
    rest = F.least(F.col(n1) - F.col(p1), F.col(n2) - F.col(p2))
    return sizes & ((100 + percent) * rest >= percent * (F.col(n1) + F.col(n2)))


def block_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of sets of one list but different classes that can link, through blocks.
    postings: token, id, n, pos, class."""
    ratio = float(np.log(100 / percent)) if percent < 100 else 1.0
    placed = postings.withColumn("_block", F.struct(
        F.floor(F.log("n") / ratio).alias("s"), F.floor(8 * F.col("pos") / F.col("n") * 100 / max(1, 100 - percent)).alias("p")))
    blocks = placed.groupBy("token", "_block").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("rest"),
        F.min("class").alias("c0"), F.max("class").alias("c1"))
    left = blocks.select("token", *[F.col(c).alias(f"{c}_a") for c in ("_block", "lo", "hi", "rest", "c0", "c1")])
    right = blocks.select("token", *[F.col(c).alias(f"{c}_b") for c in ("_block", "lo", "hi", "rest", "c0", "c1")])
    able = left.join(right, "token").filter(
        (F.col("_block_a") <= F.col("_block_b"))
        & (100 * F.col("hi_a") >= percent * F.col("lo_b")) & (100 * F.col("hi_b") >= percent * F.col("lo_a"))
        & ((100 + percent) * F.least("rest_a", "rest_b") >= percent * (F.col("lo_a") + F.col("lo_b")))
        & ((F.col("c0_a") != F.col("c1_b")) | (F.col("c1_a") != F.col("c0_b")))).select("token", "_block_a", "_block_b")
    cols = ("id", "n", "pos", "class")
    a = placed.select("token", F.col("_block").alias("_block_a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    b = placed.select("token", F.col("_block").alias("_block_b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    first = a.join(able, ["token", "_block_a"])
    # the filters stand in the join's condition, so that no pair leaves it that is not to be verified
    joined = first.alias("x").join(b.alias("y"), (
        (F.col("x.token") == F.col("y.token")) & (F.col("x._block_b") == F.col("y._block_b"))
        & (F.col("class_a") != F.col("class_b"))
        & (~(F.col("x._block_a") == F.col("x._block_b")) | (F.col("id_a") < F.col("id_b")))
        & _reachable(percent, "n_a", "pos_a", "n_b", "pos_b")))
    return joined.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def links(docs: DataFrame, base: DataFrame, size: int, percent: int, tables: Scratch) -> DataFrame:
    """id and component of every set that links or is equal to another one."""
    some = base.filter("n > 0 and doc_id is not null").select("doc_id", "n", "fa", "fb", "prefix")
    # written, so that the join below deals both sides anew and can split a set with very many members
    first = tables.written(some.groupBy("fa", "fb", "n").agg(F.min("doc_id").alias("head")))
    named = some.join(first, ["fa", "fb", "n"])
    found = tables.written(named.filter("doc_id <> head").select(
        F.col("doc_id").alias("u"), F.col("head").alias("v")).distinct())
    postings = named.filter("doc_id = head").select(
        F.col("doc_id").alias("id"), F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    heads = postings.groupBy("token").agg(
        F.count("*").alias("m"), F.min(F.struct("pos", "id", "n")).alias("lead")).filter("m > 1")
    lists_ = tables.written(postings.join(heads.drop("m"), "token"))
    every = lists_.count()
    left_over = None
    while True:
        near = lists_.select("*", F.col("lead.n").alias("n_lead"), F.col("lead.pos").alias("pos_lead")).filter(
            (F.col("id") != F.col("lead.id")) & _reachable(percent, "n", "pos", "n_lead", "pos_lead"))
        if left_over is not None:
            near = near.filter(F.col("class") != F.col("lead.class"))
        pairs = near.select(F.col("id").alias("a"), F.col("lead.id").alias("b")).distinct()
        new = verified(docs, base, pairs, size, percent, tables)
        found = tables.written(found.unionAll(new.select(F.col("a").alias("u"), F.col("b").alias("v"))))
        classes = components(found)
        placed = lists_.filter(F.col("id") != F.col("lead.id")).select("token", "id", "n", "pos").join(
            classes, "id", "left").select("token", "id", "n", "pos", F.coalesce("component", "id").alias("class"))
        mixed = tables.written(placed.groupBy("token").agg(
            F.count("*").alias("m"), F.min("class").alias("c0"), F.max("class").alias("c1"),
            F.min(F.struct("pos", "id", "n", "class")).alias("lead")).filter("c0 <> c1"))
        size_of = mixed.agg(F.sum("m").alias("rows"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("pairs")).first()
        if not size_of["rows"]:
            return classes
        placed = tables.written(placed.join(mixed.select("token", "lead"), "token"))
        if size_of["pairs"] <= PAIRS_A_POSTING * every or (
                left_over is not None and size_of["pairs"] > 0.8 * left_over):
            rest = block_pairs(placed.drop("lead"), percent)
            new = verified(docs, base, rest, size, percent, tables)
            return components(tables.written(found.unionAll(new.select(F.col("a").alias("u"), F.col("b").alias("v")))))
        left_over = size_of["pairs"]
        lists_ = placed


def link_classes(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles (long) and component_id, the smallest id reachable by links, for every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Scratch(docs.sparkSession) as tables:
        base = tables.written(prefixes(docs, size, percent, sketch(docs, size)), stays=True)
        classes = links(docs, base, size, percent, tables)
    return base.select("doc_id", F.col("n").alias("n_shingles")).join(
        classes.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
