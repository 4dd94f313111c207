import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    def make(texts, first=0):
        """texts: a list of texts (ids count up), or of (id, text)."""
        rows = [t if isinstance(t, tuple) else (first + k, t) for k, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Null, empty, blank, repeated, odd characters and a very long text."""
    return [None, "", "   \n\t ", "a", "a", "Ümläut ß 日本語 🙂", "x" * 70_000, "word " * 30_000, "tab\tand nbsp　wide",
            "nul\x00char", "▁ low ▁▁ line", "<|endoftext|> twice <|endoftext|>", "  two  blanks  "]
