import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from galeframe.llm import graph, ngram_join, positional_index, projection_forest
from galeframe.llm.queries import QUERIES
from helpers import lower, sha


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[k:k + size]) for k in range(len(w) - size + 1)}


class Union(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def brute_classes(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    u, holders = Union(), defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    pairs = {(a, b) for own in holders.values() for a in own for b in own if a < b}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            u.join(a, b)
    return {i: (len(s), u.root(i)) for i, s in sets.items()}


def near_copies(seed, n=160):
    """Families of texts with single words changed, a passage in many texts, and equal texts."""
    r = random.Random(seed)
    word = lambda: "w%d" % r.randint(0, 3000)
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(8):
        base = [word() for _ in range(r.randint(4, 140))]
        for _ in range(n // 8):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                own[r.randrange(len(own))] = word()
            if r.random() < 0.4:
                own[r.randrange(len(own)):0] = passage
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_classes_against_brute_force(documents, awkward, size, percent):
    texts = near_copies(size) + awkward
    got = ngram_join.link_classes(documents(texts), size, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_classes(
        list(enumerate(texts)), size, percent)


def test_block_path_and_more_leaders(documents, monkeypatch):
    texts = near_copies(3)
    want = brute_classes(list(enumerate(texts)), 4, 85)
    for limit in (0, 10 ** 9):  # leaders again and again, or block pairs at once
        monkeypatch.setattr(ngram_join, "PAIRS_A_POSTING", limit)
        got = ngram_join.link_classes(documents(texts), 4, 85).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_classes_of_odd_tables(documents):
    assert ngram_join.link_classes(documents([])).collect() == []
    text = "one two three four five six"
    rows = ngram_join.link_classes(documents([(None, text), (7, text), (3, text), (7, "other words stand in here now"), (9, None)])
                                   .withColumn("component", F.lit("x"))).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in rows) == [(-1, -1), (3, 3), (7, 3), (7, 3), (9, 9)]


def test_op2_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op2_ngram_join"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_classes(
        [(r["doc_id"], r["text"]) for r in docs], 4, 85)


def test_components_of_path_star_and_nothing(spark):
    r = random.Random(5)
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 101 + k) for k in range(50)] + [(7, 7)]
    r.shuffle(edges)
    got = graph.components(spark.createDataFrame(edges, "u long, v long"))
    assert {x["id"]: x["component"] for x in got.collect()} == {
        **{k: 1 for k in range(1, 61)}, **{k: 100 for k in range(100, 151)}}
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute_hits(docs, items, size=10):
    known = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1)) if w else []:
            known[tuple(w[k:k + size])].add(i)
    sizes = sorted({len(k) for k in known})
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := known.get(tuple(w[k:k + n])):
                    found |= own
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def told(rows):
    return sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["first"] for s in r["spans"]), tuple(r["items"]))
                   for r in rows), key=str)


def test_hits_against_brute_force(spark, documents, awkward, monkeypatch):
    r = random.Random(4)
    word = lambda: "v%d" % r.randint(0, 60)
    items = [(k, " ".join(word() for _ in range(r.choice([0, 1, 3, 10, 11, 25])))) for k in range(30)] + [(31, None), (32, "a a a")]
    texts = list(awkward)
    for _ in range(60):
        own = [word() for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 2)):
            own[r.randint(0, len(own)):0] = (r.choice(items)[1] or "").split() if r.random() < 0.9 else ["A", "a,", "(a)"]
        texts.append(", ".join(own).upper() if r.random() < 0.3 else " ".join(own))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(list(enumerate(texts)), [(i, t) for i, t in items])
    assert told(positional_index.contamination(documents(texts), bench).collect()) == want
    monkeypatch.setattr(positional_index, "WINDOWS", 40)  # several rounds over the index
    monkeypatch.setattr(positional_index, "BLOCK_BYTES", 2000)
    assert told(positional_index.contamination(documents(texts), bench).collect()) == want


def test_hits_of_odd_tables(spark, documents):
    bench = spark.createDataFrame([(1, "to be or not"), (None, "lost item text")], "item_id long, text string")
    empty = bench.limit(0)
    rows = [(None, "x To be, or NOT y"), (5, "a"), (5, "a"), (6, None)]
    assert told(positional_index.contamination(documents(rows), bench).collect()) == sorted(
        [(None, 6, 4, (1,)), (5, 1, 0, ()), (5, 1, 0, ()), (6, 0, 0, ())], key=str)
    assert [r["spans"] for r in positional_index.contamination(documents(rows), empty).collect()] == [[]] * 4
    assert positional_index.contamination(documents([]), bench).collect() == []


def test_proximity(spark, documents):
    bench = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    docs = documents(["red green blue", "red x green blue", "red x x x green blue"])
    near = {r["doc_id"]: r["items"] for r in positional_index.contamination(docs, bench, slop=1).collect()}
    assert near == {0: [1], 1: [1], 2: []}


def test_op3_against_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = [(i, n, h, len(f), sha(",".join(sorted(map(str, f)))), h > 0) for i, n, h, f in brute_hits(docs, items)]
    got = QUERIES["op3_decontamination"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def brute_vectors(rows, cosine=0.98):
    """rows: (id, vector or None, label or None)."""
    ids = [r[0] for r in rows]
    usable = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1])
              and any(r[1]) for r in rows]
    u, n = Union(), [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if usable[a] and usable[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y >= cosine * np.linalg.norm(x) * np.linalg.norm(y):
                    n[a] += 1
                    n[b] += 1
                    u.join(ids[a], ids[b])
    return sorted((i, k, u.root(i), u.root(i) == i) for i, k in zip(ids, n, strict=True))


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        for _ in range(5):
            base = rng.normal(size=16)
            for _ in range(40):
                rows.append([*(base + rng.normal(size=16) * rng.choice([0, 0.01, 0.03, 2]))])
                rows[-1] = ([float(np.float32(x)) for x in rows[-1]], label)
    rows += [(None, 0), ([], 0), ([0.0] * 16, 0), ([float("nan")] + [1.0] * 15, 0), ([None] + [1.0] * 15, 0),
             ([float("inf")] + [1.0] * 15, 0), (rows[0][0], None), (rows[0][0], 0), (rows[0][0], 1), ([1.0, 2.0], 0), ([2.0, 4.0], 0),
             ([1e-30] * 16, 1), ([1e30] * 16, 1)]
    order = rng.permutation(len(rows)).tolist()
    rows = [(i, *rows[k]) for i, k in enumerate(order)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = projection_forest.near_vectors(df.withColumn("key", F.lit(0)), trees=6, leaf=24)
    assert sorted(map(tuple, got.collect())) == brute_vectors(rows)
    assert projection_forest.near_vectors(df.limit(0)).collect() == []


def test_op7_against_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op7_near_vectors"](spark, sf_dir).collect())) == brute_vectors(rows)


def test_forest_that_splits_finds_all_links(spark):
    """The query's own parameters on one label of 3,000 vectors, which its trees split several times."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(1500, 64))
    near = base + rng.normal(size=base.shape) * rng.uniform(0.05, 0.19, (1500, 1))
    rows = np.concatenate([base, near]).astype(np.float32)
    unit = rows.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.98
    np.fill_diagonal(links, False)
    table = spark.createDataFrame([(k, [float(x) for x in v], 1) for k, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in projection_forest.near_vectors(table).collect()}
    found = sum(got.values())
    assert links.sum() > 1500 and all(got[k] <= n for k, n in enumerate(links.sum(1))) and found >= 0.99 * links.sum()


def test_a_class_of_several_blocks(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=16)
    rows = [(k, (middle + 0.07 * rng.normal(size=16)).tolist(), 1) for k in range(700)] + [
        (700 + k, rng.normal(size=16).tolist(), 1 + k % 3) for k in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    assert sorted(map(tuple, projection_forest.near_vectors(table).collect())) == brute_vectors(rows)
