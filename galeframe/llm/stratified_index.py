"""Ranked lexical search: an inverted index whose documents are grouped by their length normaliser.

All documents of one normaliser m form a stratum. A posting list holds, inside a stratum, the documents of a
term in runs of equal term frequency, highest first; as m is the same for all of them, the impact of a run is
computed once, from its frequency. The highest frequency of a term in a stratum bounds what the term can add
there, and the sum over a query's terms bounds every score of the stratum.

search() visits strata in the order of these bounds, in two rounds: first those that stand highest until they hold k
documents with a term of the query, which gives each query a score to beat; then all strata whose bound reaches it.
Inside a visited stratum a block is passed over by the queries whose bound, taken anew from the block's own
frequencies, stays below. Nothing that could be among the k best is skipped, so the ranking is exact.

A stratum is stored in blocks of bounded size (BLOCK_DOCS, BLOCK_WORDS; a longer text is a block of its own), one row a
term and one row without a term for the ids, so that a length held by a third of all documents is many tasks.
Queries are broadcast in slices of at most ENTRIES terms; beyond it there are several searches.

Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased, as 64-bit hashes. A null or empty
text has no terms and is not indexed; a query without terms has no results. Every row of either table stands for itself:
repeated ids are ranked each, a missing document id comes last among equal scores. Empty tables give an empty
ranking. Extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeframe.llm.scratch import Scratch
from galeframe.llm.text import ALNUM, flat, lists, slices, words

BLOCK_DOCS = 4096
BLOCK_WORDS = 1 << 20
ENTRIES = 200_000       # terms of queries searched at a time
CELLS = 1 << 20         # scores held at a time
POSTINGS = 1 << 21      # postings met at a time
SALTS = 64              # parts of a query's candidates that are cut to the k best on their own
INDEX = ("m long, block int, term long, df int, top int, tfs array<int>, sizes array<int>, docs array<int>, "
         "ids array<long>")


def count_terms(texts: pa.Array) -> np.ndarray:
    """Number of terms of every text."""
    raw, off = flat(texts)
    inside = ALNUM[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = off[:-1][np.diff(off) > 0]
    begins[heads] = inside[heads]
    upto = np.concatenate([[0], np.cumsum(begins)])
    return upto[off[1:]] - upto[off[:-1]]


def term_count(text: Column) -> Column:
    @F.arrow_udf(T.LongType())
    def run(texts: pa.Array) -> pa.Array:
        out = [pa.array(count_terms(part.column(0)), pa.int64()) for part in slices(pa.record_batch([texts], names=["text"]))]
        return pa.concat_arrays(out) if out else pa.array([], pa.int64())

    return run(text)


def frequencies(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """term, text and how often, of every pair of a text and one of its terms, by term and text."""
    w = words(texts, ALNUM)
    terms = w.hashes.view(np.int64)
    order = np.argsort(terms, kind="stable")
    term = terms[order]
    text = np.searchsorted(w.first, order, "right") - 1
    if not len(term):
        return term, text, np.zeros(0, np.int64)
    head = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (text[1:] != text[:-1])))
    return term[head], text[head], np.diff(np.append(head, len(term)))


def invert(part: pa.Table) -> pa.Table:
    """The index rows of one block: doc_id, text, m, block in; documents are numbered by ascending id, null last."""
    ids = part.column("doc_id").combine_chunks()
    order = pc.array_sort_indices(ids, order="ascending", null_placement="at_end")
    ids, batch = ids.take(order), part.select(["text"]).take(order).combine_chunks()
    found, base = [], 0
    for own in batch.to_batches():
        for piece in slices(own):
            term, doc, tf = frequencies(piece.column("text"))
            found.append((term, doc + base, tf))
            base += piece.num_rows
    term, doc, tf = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((doc, -tf, term))
    term, doc, tf = term[order], doc[order], tf[order]
    new_term = np.append(True, term[1:] != term[:-1])
    head = np.flatnonzero(new_term)
    run = np.flatnonzero(new_term | np.append(True, tf[1:] != tf[:-1]))
    df = np.diff(np.append(head, len(term)))
    runs = np.diff(np.append(np.searchsorted(run, head), len(run)))
    rows = len(head)

    def column(values: np.ndarray) -> pa.Array:
        return pa.concat_arrays([pa.array(values, pa.int32()), pa.nulls(1, pa.int32())])

    def nested(values: np.ndarray, counts: np.ndarray) -> pa.Array:
        return pa.concat_arrays([lists(values, counts, pa.int32()), pa.nulls(1, pa.list_(pa.int32()))])

    return pa.table({
        "m": pa.array(np.full(rows + 1, part.column("m")[0].as_py()), pa.int64()),
        "block": pa.array(np.full(rows + 1, part.column("block")[0].as_py()), pa.int32()),
        "term": pa.concat_arrays([pa.array(term[head], pa.int64()), pa.nulls(1, pa.int64())]),
        "df": pa.array(np.append(df, len(ids)), pa.int32()),
        "top": column(tf[head]),
        "tfs": nested(tf[run], runs),
        "sizes": nested(np.diff(np.append(run, len(term))), runs),
        "docs": nested(doc, df),
        "ids": pa.concat_arrays([pa.nulls(rows, pa.list_(pa.int64())),
                                 pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]),
    })


@dataclass
class Index:
    """A stored index: its rows (see INDEX) and N, the number of documents with a term."""

    rows: DataFrame
    documents: int


def build_index(docs: DataFrame, path: str) -> Index:
    """Writes the index of docs (doc_id, text) to path. The number of strata is that of the distinct normalisers; as their
    documents differ in length, it is below the root of 50 times the number of documents."""
    spark = docs.sparkSession
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn(
        "n", term_count(F.col("text"))).filter("n > 0")
    with Scratch(spark) as tables:
        lengths = tables.written(counted.groupBy("n").agg(F.count("*").alias("many")))
        documents, terms = lengths.agg(F.coalesce(F.sum("many"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("many")), F.lit(0))).first()
        m = F.expr(f"100L - 25L + (25L * n * {documents}L) div {max(terms, 1)}L")
        strata = tables.written(lengths.groupBy(m.alias("m")).agg(
            F.sum("many").alias("docs"), F.sum(F.col("n") * F.col("many")).alias("words")).select("m", F.greatest(
                F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("words") / BLOCK_WORDS)).alias("blocks")))
        placed = counted.withColumn("m", m).withColumn("nth", F.monotonically_increasing_id()).join(F.broadcast(strata), "m").select(
            "m", F.pmod(F.xxhash64("doc_id", "nth"), F.col("blocks")).cast("int").alias("block"), "doc_id", "text")
        placed.groupBy("m", "block").applyInArrow(invert, INDEX).write.parquet(path)
    return open_index(spark, path)


def open_index(spark, path: str) -> Index:
    rows = spark.read.parquet(path)
    return Index(rows, rows.filter("term is null").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0])


def query_terms(items: DataFrame) -> DataFrame:
    """q, term and times (repeats) of items (q, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                term, text, times = frequencies(part.column("text"))
                yield pa.record_batch([part.column("q").take(pa.array(text, pa.int64())), pa.array(term, pa.int64()),
                                       pa.array(times, pa.int64())], names=["q", "term", "times"])

    return items.select("q", "text").mapInArrow(run, "q long, term long, times long")


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Queries:
    """A slice of queries: for every term, in ascending order, the queries that hold it with weight times repeats."""

    def __init__(self, q: np.ndarray, term: np.ndarray, coefficient: np.ndarray, k: int):
        order = np.argsort(term, kind="stable")
        self.names, own = np.unique(q, return_inverse=True)
        self.terms, self.first = np.unique(term[order], return_index=True)
        self.first = np.append(self.first, len(term))
        self.q, self.coefficient, self.k = own[order], coefficient[order], k
        self.least = np.ones(len(self.names), np.int64)     # score that a result must reach
        self.visits: dict[int, np.ndarray] | None = None    # queries that visit a stratum; None: by their bounds


def _ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of many numbers each, one after the other."""
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


def scores(part: pa.Table, asked: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, document and score of the k best documents of a block for each query that visits it."""
    m = part.column("m")[0].as_py()
    term = part.column("term").to_numpy()
    df = part.column("df").to_numpy().astype(np.int64)
    top = part.column("top").to_numpy().astype(np.int64)
    tfs, sizes, docs = (part.column(c).combine_chunks() for c in ("tfs", "sizes", "docs"))
    tfs, sizes, docs = (x.flatten().to_numpy().astype(np.int64) for x in (tfs, sizes, docs))
    begin = np.cumsum(df) - df
    kinds, which = np.unique(tfs, return_inverse=True)
    gain = np.repeat(impact(kinds, m)[which], sizes)        # once a frequency, then spread over its run
    t = np.searchsorted(asked.terms, term)
    many = asked.first[t + 1] - asked.first[t]
    entry = _ranges(asked.first[t], many)                   # a term of the block in a query
    row, q, weight = np.repeat(np.arange(len(term)), many), asked.q[entry], asked.coefficient[entry]
    bound = np.zeros(len(asked.names), np.int64)
    np.add.at(bound, q, weight * impact(top, m)[row])
    alive = bound >= asked.least
    if asked.visits is not None:
        chosen = np.zeros(len(alive), bool)
        chosen[asked.visits.get(m, np.zeros(0, np.int64))] = True
        alive &= chosen
    order = np.argsort(q, kind="stable")
    order = order[alive[q[order]]]
    row, q, weight = row[order], q[order], weight[order]
    size = int(docs.max()) + 1 if len(docs) else 0
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    live, step = np.flatnonzero(alive), max(1, CELLS // max(size, 1))
    for at in range(0, len(live), step):
        own = live[at:at + step]
        total = np.zeros(len(own) * size, np.int64)
        a, b = np.searchsorted(q, own[0]), np.searchsorted(q, own[-1], "right")
        upto = np.cumsum(df[row[a:b]])
        i = 0
        while i < b - a:
            base = upto[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(upto, base + POSTINGS, "right")))
            r = row[a + i:a + j]
            place = _ranges(begin[r], df[r])
            cell = np.repeat(np.searchsorted(own, q[a + i:a + j]) * size, df[r]) + docs[place]
            np.add.at(total, cell, np.repeat(weight[a + i:a + j], df[r]) * gain[place])
            i = j
        good = np.flatnonzero(total >= np.repeat(asked.least[own], size))
        who, doc, value = good // size, good % size, total[good]
        best = np.lexsort((doc, -value, who))
        who, doc, value = who[best], doc[best], value[best]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        kept = rank < asked.k
        out.append((own[who[kept]], doc[kept], value[kept]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _visitor(shared: Broadcast) -> Callable[[pa.Table], pa.Table]:
    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        head = pc.is_null(part.column("term"))
        ids = part.filter(head).column("ids").combine_chunks().flatten()
        q, doc, value = scores(part.filter(pc.invert(head)), shared.value)
        return pa.table({"q": pa.array(shared.value.names[q], pa.int64()), "doc_id": ids.take(pa.array(doc, pa.int64())),
                         "score": pa.array(value, pa.int64())})

    return run


def _visit(rows: DataFrame, terms: DataFrame, strata: DataFrame, asked: Queries) -> DataFrame:
    """q, doc_id, score of the k best of every visited block, then of every query."""
    # strata are fewer than the root of 50 times the documents; a shuffled join would deal whole strata to single tasks
    near = rows.join(F.broadcast(strata), "m", "left_semi").join(
        F.broadcast(terms.withColumn("asked", F.lit(True))), "term", "left").filter("term is null or asked")
    told = near.drop("asked").groupBy("m", "block").applyInArrow(
        _visitor(rows.sparkSession.sparkContext.broadcast(asked)), "q long, doc_id long, score long")
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))
    for keys in (["q", part], ["q"]):  # the k best of a part first, so that no window meets all candidates of a query
        told = told.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).filter(F.col("rank") <= asked.k)
    return told


def _search(index: Index, entries: DataFrame, k: int, tables: Scratch) -> DataFrame:
    """q, rank, doc_id, score for one slice of queries."""
    spark = entries.sparkSession
    got = entries.toArrow().combine_chunks()  # at most ENTRIES rows, or one query
    q, term, times = (got.column(c).to_numpy() for c in ("q", "term", "times"))
    terms = spark.createDataFrame(pa.table({"term": np.unique(term)}))
    held = index.rows.join(F.broadcast(terms), "term").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = dict(zip(held.column("term").to_pylist(), held.column("df").to_pylist(), strict=True))
    n = index.documents
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in term.tolist()], np.int64)
    asked = Queries(q, term, weight * times, k)

    wanted = spark.createDataFrame(pa.table({"q": q, "term": term, "coefficient": weight * times}))
    tops = index.rows.join(F.broadcast(terms), "term").groupBy("m", "term").agg(F.max("top").alias("top"), F.sum("df").alias("df"))
    gain = F.expr("coefficient * ((1000000000L * top) div (1000L * top + 12L * m))")
    bounds = tables.written(tops.join(F.broadcast(wanted), "term").groupBy("q", "m").agg(
        F.sum(gain).alias("bound"), F.max("df").alias("held")).filter("bound > 0"))

    before = Window.partitionBy("q").orderBy(F.desc("bound"), "m").rowsBetween(Window.unboundedPreceding, -1)
    highest = bounds.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0))).filter(
        F.col("before") < k).select("q", "m").toArrow()  # k strata a query at most
    m, own = highest.column("m").to_numpy(), np.searchsorted(asked.names, highest.column("q").to_numpy())
    asked.visits = {int(x): np.unique(own[m == x]) for x in np.unique(m)}
    first = spark.createDataFrame(pa.table({"m": np.unique(m)}))
    least = _visit(index.rows, terms, first, asked).filter(F.col("rank") == k).select("q", "score").toArrow()
    asked.least[np.searchsorted(asked.names, least.column("q").to_numpy())] = least.column("score").to_numpy()

    asked.visits = None
    reach = spark.createDataFrame(pa.table({"q": asked.names, "least": asked.least}))
    strata = bounds.join(F.broadcast(reach), "q").filter(F.col("bound") >= F.col("least")).select("m").distinct()
    return _visit(index.rows, terms, strata, asked)


def search(index: Index, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents above 0 of every row of items (item_id, text), equal
    scores by ascending doc_id. Written to the shared folder."""
    spark = items.sparkSession
    with Scratch(spark) as tables:
        rows = tables.written(items.select(F.monotonically_increasing_id().alias("q"), "item_id", "text"))
        entries = tables.written(query_terms(rows))
        rounds = max(1, -(-entries.count() // ENTRIES))
        found = None
        for r in range(rounds):
            part = _search(index, entries.filter(F.pmod(F.xxhash64("q"), F.lit(rounds)) == r), k, tables)
            part = tables.written(part)
            found = part if found is None else found.unionAll(part)
        return tables.written(rows.select("q", "item_id").join(found, "q").select("item_id", "rank", "doc_id", "score"), stays=True)


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """search() over an index of docs that is removed afterwards."""
    with Scratch(docs.sparkSession) as tables:
        return search(build_index(docs, tables.place()), items, k)
