import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

ODD_TEXTS = [None, "", " ", "a", "two words", "two words", "ends in space ", "\t\n", "Ωμέγα Σ", "x" * 3000, "word " * 4000, "<|endoftext|> a"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with the operators' own names."""
    rows = [(k, t, "src") for k, t in enumerate(ODD_TEXTS)]
    rows += [(None, "null id", "a"), (None, None, "b"), (4, "two words", "again"), (4, "two words", "again"), (99, None, None)]
    schema = "doc_id long, text string, row string"
    docs = spark.createDataFrame(rows, schema)
    for name in ("key", "kept", "id", "rows", "uid", "bin", "length", "score", "held_out", "shard"):
        docs = docs.withColumn(name, docs["row"])
    return docs.repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
