"""Token counts of whole texts by compiled transducers (see bpe.py).

Defined results: a null text counts as empty (0 tokens); a null doc_id stays null; repeated rows each get a
row; an empty table gives an empty result; further columns are ignored. Texts of any length are counted whole:
chunk maps compose over the buffer however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lattica.llm.bpe import machine
from lattica.llm.common import as_bytes, slices, table


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. A narrow map over the scan: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = machine(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = as_bytes(part.column("text"))
                n = bpe.counts_of(texts)
                size = np.array([len(t) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op2_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
