"""Embedding near-dedup: a random-projection tree forest.

Vectors of one label are split again and again by a random direction (one per tree and level) at the median
of their projections. The halves overlap: rows within SPILL of the median rank go to both sides, so near
vectors seldom part, and several trees make up for those that do. In a leaf all vectors are compared by
cosine in double precision; links are united to classes (galeframe.llm.graph). The links of every vector are
then counted exactly inside its class, in blocks of bounded size.

Equal vectors of one label are one vector with a number of copies. Splits work on rank shares, which come from
partial sketches, so a group of any size is halved without being gathered. A leaf that cannot be halved
(equal projections on every level) is compared block against block, too.

A vector links with nothing if it is null, of length zero, of norm zero, or holds a null or non-finite
number, or if its label or id is null. Vectors of different lengths don't link. Every row gives one row;
extra columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.llm.graph import components
from galeframe.llm.scratch import Scratch
from galeframe.llm.text import lists

TREES = 5
LEVELS = 40     # of splits at most
LEAF = 512      # vectors of a leaf that is not split further
SPILL = 0.1     # share of ranks on each side of the median that goes to both halves
BLOCK = 256     # vectors compared with another block at a time
SALTS = 64      # parts of a group that meet its number of blocks on their own


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    largest = np.abs(rows).max(axis=1, keepdims=True)  # squares of very large or small numbers would not fit
    rows = rows / largest
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable() -> Column:
    v = F.col("embedding")
    return (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)
            & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
            & F.exists(v, lambda x: x != 0))


def projections(vectors: DataFrame, trees: int, seed: int) -> DataFrame:
    """key, group (label and length) and the projections of each tree's levels, one row per tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("embedding")]) if batch.num_rows else np.zeros(0, int)
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                part = batch.take(pa.array(own))
                rng = np.random.default_rng([seed, dim])
                direction = rng.normal(size=(trees * LEVELS, dim))
                got = _unit(_matrix(part.column("embedding"))) @ direction.T
                n = len(own)
                yield pa.record_batch([
                    pa.array(np.repeat(part.column("key").to_numpy(), trees)),
                    pa.array(np.repeat(part.column("label").to_numpy(), trees)),
                    pa.array(np.full(n * trees, dim, np.int32)), pa.array(np.tile(np.arange(trees, dtype=np.int32), n)),
                    lists(got.ravel(), np.full(n * trees, LEVELS), pa.float32())],
                    names=["key", "label", "dim", "tree", "p"])

    return vectors.select("key", F.col("label").cast("long").alias("label"), "embedding").mapInArrow(
        run, "key long, label long, dim int, tree int, p array<float>")


def leaves(vectors: DataFrame, tables: Scratch, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> DataFrame:
    """key and its leaves: label, dim, tree, node."""
    node = ["label", "dim", "tree", "node"]
    now = tables.written(projections(vectors, trees, seed).withColumn("node", F.lit(1).cast("long")))
    done: DataFrame | None = None
    for level in range(LEVELS):
        p = F.element_at("p", level + 1)
        cuts = now.groupBy(*node).agg(
            F.count("*").alias("n"), F.min(p).alias("least"), F.max(p).alias("most"),
            F.percentile_approx(p, [0.5 - SPILL, 0.5 + SPILL], 2000).alias("q"))
        large = (F.col("n") > leaf) & (F.col("least") < F.col("most"))
        placed = tables.written(now.join(cuts, node).withColumn("large", large))
        ended = placed.filter("not large").select("key", *node)
        done = ended if done is None else done.unionAll(ended)
        # the most frequent projection may fill both marks; then the cut lies beside it
        low, high = F.col("q")[0], F.col("q")[1]
        left = F.when(high < F.col("most"), p <= high).otherwise(p < F.col("most"))
        right = F.when(low > F.col("least"), p >= low).otherwise(p > F.col("least"))
        sides = F.filter(F.array(F.when(left, F.lit(0)), F.when(right, F.lit(1))), lambda x: x.isNotNull())
        now = placed.filter("large").withColumn("_side", F.explode(sides)).select(
            "key", "label", "dim", "tree", (F.xxhash64("node", "_side", F.lit(level))).alias("node"), "p")
        if placed.filter("large").isEmpty():
            return done
    return done.unionAll(now.select("key", *node))


def _blocks(rows: DataFrame, group: list[str], block: int) -> DataFrame:
    """Every row once for each pair of blocks of its group that its block is in: columns i, j. Groups of one block
    need no number; those of more meet it under a salt as well, so that no task has the rows of a whole group."""
    size = rows.groupBy(*group).agg(F.count("*").alias("_n")).filter(F.col("_n") > block)
    number = size.select(*group, F.ceil(F.col("_n") / block).cast("long").alias("_k"),
                         F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("key", F.lit("salt")), F.lit(SALTS)).cast("int"))
    return (
        salted.join(number, [*group, "_salt"], "left").withColumn("_k", F.coalesce("_k", F.lit(1).cast("long")))
        .withColumn("_own", F.pmod(F.xxhash64("key"), F.col("_k")))
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
        .withColumn("i", F.least("_own", "_other")).withColumn("j", F.greatest("_own", "_other"))
        .drop("_salt", "_k", "_other")
    )


def _close(part: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows of block i and of block j of a group, and the links between them as a matrix of flags."""
    own = part.column("_own").to_numpy()
    i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
    unit = _unit(_matrix(part.column("embedding")))
    a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
    near = unit[a] @ unit[b].T >= cosine
    if i == j:
        np.fill_diagonal(near, False)
    return a, b, near


def _leaf_edges(cosine: float):
    def run(part: pa.Table) -> pa.Table:
        a, b, near = _close(part, cosine)
        key = part.column("key").to_numpy()
        same = len(a) == len(b) and np.array_equal(a, b)
        u, v = [], []
        for x in range(len(a)):
            hit = np.flatnonzero(near[x])
            if len(hit):
                u.append(np.full(len(hit), key[a[x]]))
                v.append(key[b[hit]])
                if same:
                    near[np.ix_(hit, hit)] = False  # united through x; not told again
                else:
                    near[x + 1:, hit[1:]] &= ~near[x + 1:, hit[:1]]  # a row near the first is united with all
        return pa.table({"u": pa.array(np.concatenate(u) if u else np.zeros(0, np.int64)),
                         "v": pa.array(np.concatenate(v) if v else np.zeros(0, np.int64))})

    return run


def _counts(cosine: float):
    def run(part: pa.Table) -> pa.Table:
        a, b, near = _close(part, cosine)
        key, copies = part.column("key").to_numpy(), part.column("copies").to_numpy()
        same = len(a) == len(b) and np.array_equal(a, b)
        keys = key[a] if same else np.concatenate([key[a], key[b]])
        sums = near @ copies[b] if same else np.concatenate([near @ copies[b], near.T @ copies[a]])
        return pa.table({"key": pa.array(keys), "links": pa.array(sums.astype(np.int64))})

    return run


def near_vectors(rows: DataFrame, cosine: float = 0.98, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest id reachable by links), kept."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    # a vector is known by the 64-bit hash of label and numbers
    keyed = rows.withColumn("key", F.when(usable(), F.xxhash64("label", "embedding")))
    with Scratch(rows.sparkSession) as tables:
        vectors = tables.written(keyed.filter("key is not null").groupBy("key").agg(
            F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("label").alias("label"),
            F.first("embedding").alias("embedding")))
        in_leaves = leaves(vectors, tables, trees, leaf).join(vectors.select("key", "embedding"), "key")
        group = ["label", "dim", "tree", "node"]
        edges = _blocks(in_leaves, group, max(leaf, BLOCK)).groupBy(*group, "i", "j").applyInArrow(
            _leaf_edges(cosine), "u long, v long")
        classes = components(edges).withColumnRenamed("id", "key")
        members = vectors.join(classes, "key")
        counted = _blocks(members.select("key", "component", "copies", "embedding"), ["component"], BLOCK).groupBy(
            "component", "i", "j").applyInArrow(_counts(cosine), "key long, links long").groupBy("key").agg(
            F.sum("links").alias("links"))
        first = members.groupBy("component").agg(F.min("least").alias("first"))
        told = vectors.select("key", "copies", "least").join(classes, "key", "left").join(
            first, "component", "left").join(counted, "key", "left").select(
            "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("first", "least").alias("component_id"))
        told = tables.written(told, stays=True)
    return keyed.select("vec_id", "key").join(told, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
