"""Row-wise and table-valued Python over content columns, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_function(df: DataFrame, key: str, content: str, make: Callable[[bytes], list[tuple]], columns: str) -> DataFrame:
    """(key, ``columns``): the rows ``make`` gives for each content's bytes; null content counts as empty."""
    fields = T.StructType.fromDDL(columns).fields
    schema = T.StructType([df.schema[key], *fields])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                keys, rows = [], []
                for k, x in zip(some.column(0).to_pylist(), some.column(1)):
                    got = make(x.as_py() or b"")
                    keys += [k] * len(got)
                    rows += got
                yield pa.RecordBatch.from_arrays([pa.array(keys, some.column(0).type), *[pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]], names=schema.names)

    return df.select(key, F.col(content).cast("binary")).mapInArrow(run, schema)
