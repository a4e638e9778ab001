"""Ordered walks over small groups of rows, for what no Spark expression can say."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from reportmill.shipping import ship

#: Rows put out at once.
ROWS = 2048


def walk_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[list[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """``fn`` of the rows of each group in order; the keys are added to what it gives.

    Rows are dealt by key and sorted, and a task reads them as one stream, holding one group
    at a time. That costs a group nothing but its rows, unlike a call per group.
    """
    ship(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema))
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        for key, rows in _groups(batches, keys):
            made += [dict(zip(keys, key, strict=True)) | r for r in fn(rows)]
            if len(made) >= ROWS:
                yield pa.RecordBatch.from_pylist(made, out)
                made = []
        if made:
            yield pa.RecordBatch.from_pylist(made, out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _dicts(names: Sequence[str], columns: Sequence[pa.Array]) -> list[dict]:
    return [dict(zip(names, row, strict=True)) for row in zip(*map(_values, columns), strict=True)]


def _values(column: pa.Array) -> list:
    """The same as ``to_pylist``, by whole columns also inside of lists and structs."""
    kind = column.type
    if pa.types.is_list(kind) and not column.null_count:
        inner, ends = _values(column.flatten()), column.offsets.to_numpy().tolist()
        return [inner[a - ends[0] : b - ends[0]] for a, b in zip(ends, ends[1:], strict=False)]
    if pa.types.is_struct(kind) and kind.num_fields and not column.null_count:
        return _dicts([f.name for f in kind], column.flatten())
    if pa.types.is_string(kind) or (not column.null_count and (pa.types.is_integer(kind) or pa.types.is_floating(kind))):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    now, rows = None, []
    for batch in batches:
        for row in _dicts(batch.schema.names, batch.columns):
            key = tuple(row[c] for c in keys)
            if rows and key != now:
                yield now, rows
                rows = []
            now = key
            rows.append(row)
    if rows:
        yield now, rows
