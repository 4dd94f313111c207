"""Labelled texts of bounded size, for models that are trained in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def labelled_texts(docs: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """doc_id, text and label of the chosen ids (doc_id, label; one row an id, a bounded number).

    Of rows with one id the text with the least hash stands for all, so an id with very many rows is one text.
    Texts over a sixteenth of size bytes are left out, and of every label those in the order of the ids' hashes
    that together stay within size: first the sizes alone decide, then the texts of these are read. A null text
    has no bytes. Ids without a document are left out.
    """
    docs = docs.select("doc_id", "text").withColumn("_text_hash", F.xxhash64("text"))
    least = (
        docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id")
        .agg(F.first("label").alias("label"),
             F.min(F.struct("_text_hash", F.coalesce(F.octet_length("text"), F.lit(0)).alias("_size"))).alias("_least"))
        .select("doc_id", "label", "_least.*").filter(F.col("_size") <= size // 16))
    # a window over the chosen ids and their sizes only
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    kept = least.withColumn("_upto", F.sum("_size").over(order)).filter(F.col("_upto") <= size)
    return (
        docs.join(F.broadcast(kept.select("doc_id", "label", "_text_hash")), ["doc_id", "_text_hash"])
        .groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text")))
