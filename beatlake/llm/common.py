"""Small helpers that several operators share.

An input may have any extra columns. Where an operator adds columns to its
input's, it holds the input's row in one struct beside its own columns, so no
name inside can clash; of an output name that the input has too, the
operator's own column stays and the input's goes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows, and about as many bytes, whose Python objects are alive at once in a task (a single longer text is whole).
SLICE, SLICE_BYTES = 256, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require(df: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def boxed(df: DataFrame, *more: Column) -> DataFrame:
    """The input's row as the struct `row`, and columns beside it."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *more)


def unboxed(names: list[str], own: tuple[str, ...] = ()) -> list[Column]:
    """The columns of `row` that aren't named like one of `own`."""
    return [F.col(f"row.`{c}`").alias(c) for c in names if c not in own]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of at most `SLICE` rows and about `SLICE_BYTES` of text."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            size += np.diff(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1])
    total, at = np.cumsum(size), 0
    while at < batch.num_rows:
        fits = int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_BYTES, side="right"))
        end = min(at + SLICE, max(at + 1, fits), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def map_rows(df: DataFrame, columns: list[str], schema: T.StructType, make: Callable[[], Callable[..., Iterator[tuple]]]) -> DataFrame:
    """One pass over `columns` in Python: `make()` runs once a task and gives a function from one row's values to output tuples.

    Batches are cut to `slices`, so memory follows the longest texts and not the batch size.
    """
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for batch in batches:
            for part in slices(batch):
                rows = [out for row in zip(*(part.column(i).to_pylist() for i in range(part.num_columns))) for out in call(*row)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), target.types)], schema=target)

    return df.select(*columns).mapInArrow(run, schema)


def keep_rows(df: DataFrame, column: str, make: Callable[[], Callable[[object], bool]]) -> DataFrame:
    """The rows of `df` whose value of `column` passes; the others' columns never become Python objects."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = make()
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([passes(v) for v in part.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
