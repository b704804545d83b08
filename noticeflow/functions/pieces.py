"""Rows of large texts in pieces: what a Python worker holds at once is bounded by bytes, not by rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text that are worked on at once.
PIECE_BYTES = 1 << 20


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most that many bytes in all, or one row."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if i > start and size + (n or 0) > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if batch.num_rows:
        yield batch.slice(start)


def reading(df: DataFrame, column: str, f: Callable[[str | None], tuple], made: str) -> DataFrame:
    """df with the columns of f (made: their names and types) in place of a text column."""
    kept = [c for c in df.columns if c != column]
    new = T.DataType.fromDDL(made).fields
    bools = [x.dataType == T.BooleanType() for x in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.schema.field(column).type
            for part in pieces(batch, column):
                rows = [f(x) for x in part.column(column).to_pylist()]
                columns = [pa.array([r[i] for r in rows], pa.bool_() if b else text) for i, b in enumerate(bools)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], [*kept, *(x.name for x in new)])

    return df.mapInArrow(run, T.StructType([*df.select(*kept).schema.fields, *new]))
