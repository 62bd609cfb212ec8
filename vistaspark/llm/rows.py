"""Row-wise operators in Arrow batches: new columns from the text, all other columns passed through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes stripped and split at: U+0020, U+0009 to U+000D (what bytes.split() splits at).
BLANKS = b" \t\n\x0b\x0c\r"


def with_columns_from_text(
    df: DataFrame,
    text: str,
    fields: list[tuple[str, T.DataType]],
    start: Callable[[], Callable[[str | None], tuple]],
) -> DataFrame:
    """df with ``fields`` appended.

    ``start()`` runs once a task and gives the function from a text (None for
    null) to the values.  An input column named like a new one gives way.
    """
    names = [n for n, _ in fields]
    taken = {n.lower() for n in names}
    df = df.select(*[df[c] for c in df.columns if c.lower() not in taken])
    schema = T.StructType(list(df.schema.fields) + [T.StructField(n, t) for n, t in fields])
    at = df.columns.index(text)
    kinds = [{"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}[t.simpleString()] if not isinstance(t, T.ArrayType) else pa.list_(pa.int32()) for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = start()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                rows = [of(x) for x in part.column(at).to_pylist()]
                cols = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, *names])

    return df.mapInArrow(run, schema)
