import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from galeframe.llm import id_files, jacobi_davidson, stratified_index
from galeframe.llm.queries import BYTE_MODEL, END_ID, QUERIES, tokenizer_path
from helpers import lower

# ---- ranked search ----


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def brute_ranking(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    big_n, big_l = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, b, n in bags:
            m = 75 + (25 * n * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * b[t]) // (1000 * b[t] + 12 * m))
                    for t in terms(text) if b[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(stratified_index, "BLOCK_DOCS", 16)
    monkeypatch.setattr(stratified_index, "BLOCK_WORDS", 400)
    monkeypatch.setattr(stratified_index, "CELLS", 50)
    monkeypatch.setattr(stratified_index, "POSTINGS", 30)


def collected(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=lambda r: (str(r[0]), r[1]))


def random_texts(seed, n):
    r = random.Random(seed)
    word = lambda: "w%d" % int(r.paretovariate(0.6))
    texts = [" ".join(word() for _ in range(r.choice([1, 3, 8, 8, 8, 20, 60, 200]))) for _ in range(n)]
    return texts + texts[:n // 4]


@pytest.mark.parametrize("entries", [200_000, 20])
def test_ranking_against_brute_force(spark, documents, small_blocks, monkeypatch, entries):
    monkeypatch.setattr(stratified_index, "ENTRIES", entries)
    docs = list(enumerate(random_texts(1, 300)))
    items = [(k, t) for k, t in enumerate(random_texts(2, 12))]
    got = stratified_index.ranked(documents(docs), spark.createDataFrame(items, "item_id long, text string"), 7)
    assert collected(got) == sorted(brute_ranking(docs, items, 7), key=lambda r: (str(r[0]), r[1]))


def test_ranking_odd_tables(spark, documents, small_blocks, awkward):
    docs = [(k % 7 if k % 5 else None, t) for k, t in enumerate(awkward + ["Straße a1", "a", "A a word", "the same"] * 30)]
    items = [(1, "a word"), (1, "a word"), (None, "Same SAME tab"), (2, None), (3, ""), (4, "- -"), (5, "unknown term"), (6, "STRAßE 日本語")]
    table = documents(docs).withColumn("Block", F.lit(1)).withColumn("m", F.lit(2))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(0))
    assert collected(stratified_index.ranked(table, asked, 5)) == sorted(
        brute_ranking(docs, items, 5), key=lambda r: (str(r[0]), r[1]))
    assert stratified_index.ranked(table.limit(0), asked, 5).collect() == []
    assert stratified_index.ranked(table, asked.limit(0), 5).collect() == []


def test_low_strata_are_not_read(spark, documents, monkeypatch):
    """Once the short texts fill the ranking, strata whose bound is lower are left alone."""
    docs = [(k, "rare") for k in range(10)] + [(100 + k, "rare " + "other " * 500) for k in range(10)]
    met = []
    told = stratified_index._visit
    monkeypatch.setattr(stratified_index, "_visit", lambda rows, terms, strata, asked: (
        met.append(sorted(r["m"] for r in strata.collect())), told(rows, terms, strata, asked))[1])
    items = spark.createDataFrame([(1, "rare")], "item_id long, text string")
    rows = stratified_index.ranked(documents(docs), items, 5).collect()
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["rank"])] == [0, 1, 2, 3, 4]
    assert len(met[0]) == len(met[1]) == 1


def test_stored_index_is_opened_again(spark, documents, tmp_path):
    docs = [(1, "one two"), (2, "two three"), (3, "")]
    index = stratified_index.build_index(documents(docs), str(tmp_path / "index"))
    again = stratified_index.open_index(spark, str(tmp_path / "index"))
    assert index.documents == again.documents == 2
    items = [(1, "three")]
    got = stratified_index.search(again, spark.createDataFrame(items, "item_id long, text string"), 3)
    assert collected(got) == brute_ranking(docs, items, 3)


# ---- id files ----

@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2 ** 64 - 1), st.integers(0, 10 ** 6)), max_size=400))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    code = id_files.Boundaries.of(np.array(values, np.uint64))
    again = id_files.Boundaries(code.code)
    assert again.all().tolist() == values
    assert [again.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        again.select(len(values))


def test_boundaries_are_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 800, 20_000))
    assert len(id_files.Boundaries.of(ends).code) * 8 < 20_000 * (2.1 + math.log2(ends[-1] / 20_000) + 32 / id_files.SAMPLE) + 400


def brute_ids(texts):
    library = Tokenizer.from_file(tokenizer_path(BYTE_MODEL))
    return [library.encode(t or "", add_special_tokens=False).ids + [END_ID] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("segment", [1 << 18, 50])
def test_ids_against_the_library(spark, documents, awkward, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(id_files, "SEGMENT", segment)
    texts = awkward + ["it's 12 o'clock\n\n \tnow  ", "  a", "<|endoftext|>", "a<|endoftext|> b\n", "<|endof", "text|> c", "\x1c \x85x　 y"] * 3
    ids = [(None, -5, 3, 3, 2 ** 62, 8)[k % 6] if k % 4 == 0 else 100 - k for k in range(len(texts))]
    docs = documents(list(zip(ids, texts, strict=True))).withColumn("Shard", F.lit(7)).withColumn("nth", F.lit(7))
    files = id_files.write_ids(docs, str(tmp_path / "files"), tokenizer_path(BYTE_MODEL), END_ID)
    got = sorted(id_files.read_ids(files).collect(), key=lambda r: r["start"])
    want = brute_ids(texts)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted((str(i), w) for i, w in zip(ids, want, strict=True))
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([len(r["ids"]) for r in got])[:-1]]).tolist()
    sums = sorted(id_files.checksums(files).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in sums] == [(r["doc_id"], len(r["ids"]), crc(r["ids"])) for r in got]
    places = files.segments.select("shard", "segment", F.explode(F.sequence(F.lit(0).cast("long"), F.col("documents") - 1)).alias("nth"))
    found = id_files.tokens_at(files, places).collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in found) == sorted((str(r["doc_id"]), r["ids"]) for r in got)


def test_empty_id_files(spark, documents, tmp_path):
    files = id_files.write_ids(documents([]), str(tmp_path / "files"), tokenizer_path(BYTE_MODEL), END_ID)
    assert id_files.checksums(files).collect() == []


def test_op13_on_the_table(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r["doc_id"])
    want, start = [], 0
    for r, ids in zip(docs, brute_ids([r["text"] for r in docs]), strict=True):
        want.append((r["doc_id"], start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op13_id_files"](spark, sf_dir).collect()) == want


# ---- whitening ----

def brute_whitening(rows, k=8):
    """rows: (vec_id, list of numbers) of one length."""
    x = np.array([[math.floor(1024 * float(np.float64(c))) + 100_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    z = (n * x - s).astype(np.float64) / n
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), z @ u / np.sqrt(e), e / (z * z).sum() * n


def check_whitening(rows, got, k=8):
    n, deviation, white, explained = brute_whitening(rows, k)
    place = {i: p for p, (i, _) in enumerate(rows)}
    assert len(got) == len(rows) * white.shape[1]
    mine = np.zeros_like(white)
    for r in got:
        p = place[r["vec_id"]]
        assert r["n"] == n and r["deviation"] == deviation[p] and r["identity_error"] <= 1e-4
        assert math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-9)
        mine[p, r["component"] - 1] = r["whitened"]
    for c in range(white.shape[1]):
        sign = 1 if mine[:, c] @ white[:, c] > 0 else -1
        assert np.abs(sign * mine[:, c] - white[:, c]).max() < 1e-6


def test_op12_on_the_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    check_whitening(rows, QUERIES["op12_whitening"](spark, sf_dir).collect())


def test_whitening_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(jacobi_davidson, "BLOCK_BYTES", 8 * 3 * 10)
    rng = np.random.default_rng(3)
    good = [(k, [float(x) for x in rng.normal(size=3) * (1, 50, 1e4)]) for k in range(60)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, math.nan, 2.0]), (104, [1.0, math.inf, 2.0]), (105, [1.0, 2.0])]
    table = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumn("Width", F.lit("w")).repartition(4)
    got = jacobi_davidson.whitened(table).collect()
    check_whitening(good, got, 3)
    same = spark.createDataFrame([(1, [1.0, 2.0])] * 5, "vec_id long, embedding array<double>")
    assert jacobi_davidson.whitened(same).collect() == [] and jacobi_davidson.whitened(table.limit(0)).collect() == []
    repeated = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.0, 5.0])], "vec_id long, embedding array<double>")
    rows = jacobi_davidson.whitened(repeated).collect()
    assert sorted(str(r["vec_id"]) for r in rows) == ["1", "1", "None"]
    with pytest.raises(Exception, match="too large"):
        jacobi_davidson.whitened(spark.createDataFrame([(1, [1e300]), (2, [1.0])], "vec_id long, embedding array<double>")).collect()


@pytest.mark.parametrize("size", [2500, 7400])
def test_op12_deviations_around_64_bits(spark, tmp_path, size):
    """64 squares of the largest entry would be beyond 64 bits; at 7400 some deviations are, at 2500 none."""
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(np.random.default_rng(9).normal(size=(50, 64)) * size)]
    exact = brute_whitening(rows)[1]
    assert (0 < sum(d >= 1 << 63 for d in exact) < 50) if size == 7400 else max(exact) < 1 << 63
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op12_whitening"](spark, str(tmp_path))
    assert dict(got.dtypes)["deviation"] == "bigint"
    got = got.collect()
    assert len(got) == 50 * 8 and all(r["deviation_exact"] == exact[r["vec_id"]] for r in got)
    assert all(r["deviation"] == (exact[r["vec_id"]] if exact[r["vec_id"]] < 1 << 63 else None) for r in got)
    check_whitening(rows, jacobi_davidson.whitened(table).collect())


def test_square_sums_are_exact():
    rng = np.random.default_rng(4)
    for bits in (3, 28, 29, 31, 45, 59):
        whole = rng.integers(-(1 << bits), 1 << bits, size=(50, 64))
        whole[3] = -(1 << bits)
        want = (whole.astype(object) ** 2).sum(axis=1).tolist()
        assert [int(s) for s in jacobi_davidson.square_sums(whole).to_pylist()] == want
    with pytest.raises(OverflowError, match="38 digits"):
        jacobi_davidson.square_sums(np.full((1, 64), 1 << 62))


@pytest.mark.parametrize(("dim", "k", "spread"), [(1, 8, 0), (5, 8, 1), (64, 8, 0), (64, 8, 3), (250, 8, 1), (400, 3, 0)])
def test_leading_pairs_against_eigh(dim, k, spread):
    rng = np.random.default_rng(dim + spread)
    x = rng.normal(size=(3 * dim + 50, dim)) * np.linspace(1 + spread, 1, dim)
    v = x.T @ x / len(x)
    values, vectors = jacobi_davidson.leading_pairs(lambda q: v @ q, dim, k)
    want = np.linalg.eigvalsh(v)[::-1][:k]
    assert np.abs(values - want).max() <= 1e-13 * want[0]
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() <= 1e-12 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_minres_solves_an_indefinite_system():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(20, 20))
    a = a + a.T
    b = rng.normal(size=(20, 3))
    x = jacobi_davidson.minres(lambda v: a @ v, b, 60)
    assert np.abs(a @ x - b).max() < 1e-6
    assert np.abs(jacobi_davidson.minres(lambda v: 2 * v, b, 5) - b / 2).max() < 1e-12
    assert not jacobi_davidson.minres(lambda v: a @ v, 0 * b, 5).any()
