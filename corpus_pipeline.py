"""From raw documents to token ids: quality, near duplicates, benchmark passages, personal data, encoding.

Each stage takes the documents its predecessor kept, all of them, and returns them with the same columns
(the last one adds ids and n_tokens). Rows that a stage removes are gone for the next:

* quality: texts that the factorisation machine rejects (score below 0.3) go;
* near_duplicates: of each class of 5-word shingle sets linked at a Jaccard similarity of 0.8 or more the
  document with the smallest id stays, one without an id only if none has one. Rows are compared by their texts:
  rows that repeat an id or have none are rows of their own;
* decontamination: documents that hold ten words in a row of a benchmark item, or two or more shorter items
  whole, go. Each row is judged by its text, whatever its id;
* pii: validated personal numbers, dates and mail addresses become keyed pseudonyms, n_chars follows;
* sentencepiece: the token ids of each text.

Nulls, empty texts and empty tables are handled as the operators state it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.llm import factorisation, ngram_join, pii, positional_index, sentencepiece_bpe
from galeframe.llm.queries import PIECE_MODEL, TEST_KEY, table, tokenizer_path
from galeframe.operators.scale import saved
from galeframe.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = factorisation.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return factorisation.scored(docs, machine, threshold=0.3).filter("predicted = 1").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "numbered")
    docs.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    numbered = spark.read.parquet(path)
    classes = ngram_join.link_classes(numbered.select(F.col("_row").alias("doc_id"), "text"), size=5, percent=80)
    linked = saved(classes.filter("doc_id <> component_id").select(F.col("doc_id").alias("_row"), "component_id").distinct())
    members = linked.unionAll(linked.select(F.col("component_id").alias("_row"), "component_id").distinct())
    named = saved(members.join(numbered.select("_row", "doc_id"), "_row"))
    first = named.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")).select("first._row")
    gone = named.select("_row").join(first, "_row", "left_anti")
    return numbered.join(gone, "_row", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a match depends on the text alone, so the text's hash stands for the row; an id may be missing or repeated
    own = F.xxhash64("text")
    found = positional_index.contamination(
        docs.select(own.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), size=10)
    enough = F.exists("spans", lambda s: s["end"] - s["first"] >= 10) | (F.size("items") > 1)
    hit = saved(found.filter(enough).select(F.col("doc_id").alias("_hit")).distinct())
    return docs.join(hit, own == F.col("_hit"), "left_anti").select(docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs, TEST_KEY).withColumn(
        "n_chars", F.length("text").cast("long")).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_documents(docs, tokenizer_path(PIECE_MODEL)).withColumn(
        "n_tokens", F.size("ids").cast("long")).drop("decoded")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pseudonyms),
    ("sentencepiece", encoded),
]

#: trained scores and the tokenizer are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = scratch_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
