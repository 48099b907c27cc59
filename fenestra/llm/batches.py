"""Row-wise work in Arrow batches, for the operators that need Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Results are handed to Spark after so many rows, or so many bytes of texts read.
ROWS, BYTES = 1_000, 2_000_000


#: Bytes of an Arrow batch that a task is handed, about; Spark's own bound is 10,000 rows of any length.
BATCH = 4 << 20


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(run, schema), with batches of bounded size; what a task has used goes back to the system when it ends, as workers live on.

    The bound is a setting of the session, which stays unless the user has chosen one.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name).rstrip("b") == str(64 << 20):  # Spark's own
        conf.set(name, str(BATCH))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(tidy, schema)


def map_rows(df: DataFrame, work: Callable[[], Callable[..., Iterator[tuple]]], schema: str) -> DataFrame:
    """Call, for every row of `df`, what `work()` returns with the row's values; it yields rows of `schema`.

    `work` runs once for each task, in the Python worker, and makes what its rows share. Binary values come as bytes.
    """
    arrow = to_arrow_schema(_schema(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, out, held = work(), [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # Python values of a few rows at a time
                for values in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns)):
                    out.extend(each(*values))
                    held += sum(len(v) for v in values if isinstance(v, (bytes, str)))
                    if len(out) >= ROWS or held >= BYTES:
                        if out:
                            yield _batch(out, arrow)
                        out, held = [], 0
        if out:
            yield _batch(out, arrow)

    return map_batches(df, run, schema)


def _schema(text: str) -> StructType:
    return _parse_datatype_string(text)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
