"""Rules whose next state depends on the rows taken so far: a fold over each key's rows, in order, as they stream by."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold_sorted(df: DataFrame, key: str, order: list[str], columns: list[str | Column], step: Callable, schema: str) -> DataFrame:
    """Per key a new step() takes the rows' columns in order: `take(*row)` and, after the last, `close()` list rows of the
    output without the key, which leads the schema. One shuffle and Spark's sort, which spills; a task holds one key's state
    and a batch of rows, never all rows of a key. Rows of a null key are a key.
    """
    rows = df.repartition(key).sortWithinPartitions(key, *order).select(key, *columns)
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(kind)], schema=kind)
        for batch in batches:
            out = []
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or k != now:
                    out += [(now, *r) for r in state.close()] if state else []
                    now, state = k, step()
                out += [(k, *r) for r in state.take(*row)]
            yield pack(out)
        if state:
            yield pack([(now, *r) for r in state.close()])

    return rows.mapInArrow(run, schema)
