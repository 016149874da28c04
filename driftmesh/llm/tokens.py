"""Token counts of documents from prefix tables, without running an encoder."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from driftmesh.llm.arrow import id_and_text, map_batches
from driftmesh.llm.bpe import PrefixCounter


@lru_cache(maxsize=2)
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit, n_fit.

    ``path`` is a byte-level BPE file that every executor can open. n_fit is the
    length in characters of the longest prefix of at most ``limit`` tokens. Null
    texts count as empty (all zero, never over); null ids and repeated rows are
    kept as they are. Work and memory are per document, there is no shuffle.
    """

    def count(batch: pa.RecordBatch) -> dict:
        counter = _counter(path)
        texts = [t or "" for t in batch.column("text").to_pylist()]
        totals, fits = zip(*[counter.measure(t, limit) for t in texts], strict=True) if texts else ((), ())
        return {
            "id": batch.column("id"),
            "n_bytes": [len(t.encode()) for t in texts],
            "n_tokens": totals,
            "over_limit": [n > limit for n in totals],
            "n_fit": fits,
        }

    made = id_and_text(docs, id_col, text_col)
    kind = made.schema["id"].dataType.simpleString()
    counted = map_batches(made, count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, n_fit long")
    return counted.withColumnRenamed("id", id_col)

