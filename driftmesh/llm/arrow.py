"""Running a per-document Python function over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Texts handed to a per-batch function at once hold about this many bytes.
CHUNK_BYTES = 4_000_000


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about ``size`` bytes of text, or one row."""
    for batch in batches:
        if text not in batch.schema.names:
            yield batch
            continue
        start, held = 0, 0
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        for row, n in enumerate(lengths):
            if held and held + n > size:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += n
        if start < len(lengths):
            yield batch.slice(start)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], dict | None], schema: str, size: int = CHUNK_BYTES) -> DataFrame:
    """``function`` gets record batches of about ``size`` bytes of text and returns columns by name."""
    arrow = to_arrow_schema(_struct(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, size=size):
            made = function(batch)
            if made is not None:
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _struct(schema: str) -> StructType:
    return _parse_datatype_string(schema)


def id_and_text(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """The columns id and text under fixed names, and ``more`` under their own."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c) for c in more])
