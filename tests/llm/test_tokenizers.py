import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from galeframe.llm import sentencepiece_bpe, token_counts
from galeframe.llm.queries import BYTE_MODEL, PIECE_MODEL, QUERIES, tokenizer_path
from helpers import sha

LETTERS = "abcdefghij ▁tion=-_<>\n\t0123éü日🙂à's　"


def noise(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(1, 90))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_MODEL))


@pytest.fixture(scope="module")
def byte_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(BYTE_MODEL))


def test_encode_is_the_librarys(library, awkward):
    texts = [t for t in awkward + noise(600) if t is None or "\x00" not in t] + ["nul\x00char"]
    m = sentencepiece_bpe.model(tokenizer_path(PIECE_MODEL))
    ids, counts = m.encode(pa.array(texts, pa.string()))
    decoded = m.decode(ids, counts).to_pylist()
    for text, own, back in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), decoded, strict=True):
        want = library.encode(text or "")
        assert own.tolist() == want, repr((text or "")[:50])
        assert back == library.decode(want)


def test_remerging_decides(library):
    m = sentencepiece_bpe.model(tokenizer_path(PIECE_MODEL))
    th, e = m.ids["▁th"], m.ids["e"]
    assert not m.fits(np.array([th]), np.array([e]))[0]      # they merge to one piece
    assert m.fits(np.array([m.size + 10]), np.array([e]))[0]  # a character without a piece merges with nothing


def test_encode_documents_keeps_columns(spark, documents, awkward):
    got = sentencepiece_bpe.encode_documents(documents(awkward).withColumn("ids", F.lit(1)), tokenizer_path(PIECE_MODEL))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "decoded"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == len(awkward) and rows[0]["ids"] == [] and rows[1]["decoded"] == ""
    back = got.select("doc_id", sentencepiece_bpe.decode(F.col("ids"), tokenizer_path(PIECE_MODEL)).alias("d")).collect()
    assert all(r["d"] == rows[r["doc_id"]]["decoded"] for r in back)
    assert sentencepiece_bpe.encode_documents(documents([]), tokenizer_path(PIECE_MODEL)).collect() == []


def test_op5_against_library(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op5_sentencepiece"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_counts_are_the_librarys(byte_library, awkward):
    texts = awkward + noise(600, 2)
    got = token_counts.table(tokenizer_path(BYTE_MODEL)).count(pa.array(texts, pa.string()))
    for text, n in zip(texts, got.tolist(), strict=True):
        assert n == len(byte_library.encode(text or "", add_special_tokens=False).ids), repr((text or "")[:50])


def test_op6_against_library(spark, sf_dir, byte_library, documents, awkward):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op6_token_counts"](spark, sf_dir).collect():
        n = len(byte_library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((texts[r["doc_id"]] or "").encode()), n > 1024)
    got = token_counts.with_token_counts(documents(awkward).withColumn("n_tokens", F.lit("old")), tokenizer_path(BYTE_MODEL))
    assert got.count() == len(awkward) and dict(got.dtypes)["n_tokens"] == "bigint"


def test_runs_of_units_do_not_change_ids(awkward, monkeypatch):
    m, texts = sentencepiece_bpe.model(tokenizer_path(PIECE_MODEL)), pa.array(awkward, pa.string())
    ids, counts = m.encode(texts)
    whole = m.decode(ids, counts)
    monkeypatch.setattr(sentencepiece_bpe, "RUN_CHARS", 40)
    monkeypatch.setattr(sentencepiece_bpe, "RUN_ITEMS", 7)
    again, same = m.encode(texts)
    assert np.array_equal(ids, again) and np.array_equal(counts, same) and m.decode(again, same).equals(whole)


def test_a_slice_of_distinct_words_needs_bounded_memory():
    m, rng = sentencepiece_bpe.model(tokenizer_path(PIECE_MODEL)), random.Random(5)
    texts = pa.array([" ".join("".join(rng.choices("aeinorst", k=7)) for _ in range(2_600)) for _ in range(100)])  # 2 MB
    m.encode(texts)  # verdicts on pairs are kept
    tracemalloc.start()
    try:
        m.decode(*m.encode(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 110 << 20
