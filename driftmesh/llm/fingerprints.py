"""SimHash fingerprints of texts: 64 bits by majority over hashed word shingles."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from xxhash import xxh64_intdigest

from driftmesh.llm.arrow import id_and_text, map_batches

SEED = 42
_SMALL = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """Hashes of the shingles of one UTF-8 text in order, repeats included; a shorter text is one shingle."""
    words = (text or b"").translate(_SMALL).split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, SEED)], "<u8")
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return np.array([xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have set; 0 for none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: bytes | None, size: int = 4) -> int:
    """The fingerprint of one UTF-8 text; 0 for null and for texts without words."""
    return majority(shingle_hashes(text, size))


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint (a signed 64-bit number) of every row.

    Null and empty texts have fingerprint 0; null ids and repeated rows stay.
    """

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        made = np.array([simhash(t, size) for t in texts], np.uint64)
        return {"id": batch.column("id"), "fingerprint": made.view(np.int64)}

    plain = id_and_text(docs, id_col, text_col)
    kind = plain.schema["id"].dataType.simpleString()
    return map_batches(plain, run, f"id {kind}, fingerprint long").withColumnRenamed("id", id_col)
