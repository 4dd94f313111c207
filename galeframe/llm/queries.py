"""Registered queries of the corpus operators, with their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.llm import (
    block_labeller,
    factorisation,
    hidden_markov,
    id_files,
    jacobi_davidson,
    kneser_ney,
    ngram_join,
    pii,
    positional_index,
    projection_forest,
    sentencepiece_bpe,
    stratified_index,
    token_counts,
)
from galeframe.llm.scratch import Scratch

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"
TEST_KEY = b"galeframe test key"
END_ID = 2


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; it is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined_ids(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of the test queries is public; a real run brings its own."""
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), TEST_KEY)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_classes(table(spark, sf_dir, "documents"), size=4, percent=85)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional_index.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["first"]))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = kneser_ney.fit(docs, table(spark, sf_dir, "labels"))
    return kneser_ney.scored(docs, model).select(
        "doc_id", (factorisation.fold("doc_id") == 0).alias("held_out"), "score", "predicted")


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_forest.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = factorisation.fit(docs, table(spark, sf_dir, "labels"))
    return factorisation.scored(docs, model).select(
        "doc_id", (factorisation.fold("doc_id") == 0).alias("held_out"), "score", "predicted")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sentencepiece_bpe.encode_documents(
        table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(PIECE_MODEL))
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined_ids(F.col("ids")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_token_counts(docs, tokenizer_path(BYTE_MODEL)).drop("text")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return block_labeller.extract(pages, block_labeller.fit(pages)).withColumn("n_chars", F.length("text").cast("long"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_index.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that 64 bits cannot hold (unit vectors: from about 2.8 million on) is null as a long, deviation_exact has it whole."""
    done = jacobi_davidson.whitened(table(spark, sf_dir, "embeddings"), components=8)
    return done.select(
        "vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained",
        "identity_error", F.col("deviation").alias("deviation_exact"))


def op13_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as tables:  # the files go, what was read back from them stays
        files = id_files.write_ids(table(spark, sf_dir, "documents"), tables.place(), tokenizer_path(BYTE_MODEL), END_ID)
        return tables.written(id_files.checksums(files), stays=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_ngram_join": op2_ngram_join,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_token_counts": op6_token_counts,
    "op7_near_vectors": op7_near_vectors,
    "op8_lm_score": op8_lm_score,
    "op9_quality": op9_quality,
    "op10_html_text": op10_html_text,
    "op11_ranked_search": op11_ranked_search,
    "op12_whitening": op12_whitening,
    "op13_id_files": op13_id_files,
}

ORACLES: dict[str, str] = {
    "op11_ranked_search": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        k AS (SELECT doc_id, w, len(w) AS n FROM d WHERE len(w) > 0),
        total AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM k),
        p AS (SELECT doc_id, any_value(n) AS n, term, count(*) AS tf
              FROM (SELECT doc_id, n, unnest(w) AS term FROM k) GROUP BY doc_id, term),
        f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        q AS (SELECT item_id, term, count(*) AS times FROM (
                SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
        s AS (SELECT item_id, doc_id, sum(times * floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT
                * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
              FROM q JOIN p USING (term) JOIN f USING (term), total GROUP BY item_id, doc_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""",
}
