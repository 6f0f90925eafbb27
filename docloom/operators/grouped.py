"""Folds over groups of rows, without a frame for each group."""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold_groups(rows: DataFrame, keys: list[str], order: list, run, schema: StructType) -> DataFrame:
    """``run`` (an iterator of a group's rows as tuples, in order) gives result tuples.
    Rows are shuffled by the keys and sorted by Spark, which spills; a task streams
    them and holds what ``run`` keeps of one group. Null keys are a group."""
    at = [rows.columns.index(k) for k in keys]

    def task(arrow_batches):
        arrow = to_arrow_schema(schema)
        stream = (row for batch in arrow_batches for row in zip(*(_values(c) for c in batch.columns)))
        out = []
        for _, group in itertools.groupby(stream, key=lambda row: tuple(row[i] for i in at)):
            out.extend(run(group))
            if len(out) >= 10_000:
                yield _batch(out, arrow)
                out = []
        yield _batch(out, arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(task, schema)


def _values(column: pa.Array) -> list:
    kind = column.type
    plain = pa.types.is_string(kind) or ((pa.types.is_integer(kind) or pa.types.is_floating(kind)) and column.null_count == 0)
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


def _batch(out: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = zip(*out) if out else [[]] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
