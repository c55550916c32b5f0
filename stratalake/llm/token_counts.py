"""Token counts of whole texts: the library encodes inside Arrow functions that return lengths only.

Cases: null counts as empty, an empty text has 0 tokens; repeated rows are counted each; long texts are
cut at safe boundaries (see tokens.py), so memory follows the longest single word, not the text.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F, types as T

from stratalake.llm.store import whole
from stratalake.llm.tokens import counts


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit per row. path names a word BPE file every executor has."""
    rows = docs.select(F.col(id_col), whole(text_col).alias("_text"))
    out = T.StructType([rows.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def count(batches):
        for batch in batches:
            texts = batch.column(1)
            n = counts(path, texts)
            size = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())], names=out.names)

    return rows.mapInArrow(count, out)
