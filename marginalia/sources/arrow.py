"""Python functions of one value as columns, a few values at a time."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, _parse_datatype_string

#: Bytes of a batch's Arrow values that are Python objects at once, about, and their number at most.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 256


def sliced(column: pa.Array, function: Callable[[Any], Any], kind: pa.DataType) -> pa.Array:
    """function of each value of a column, null for null. Values are objects slice by slice, so that memory follows Arrow's
    bytes and not ten times as many; a value larger than a slice is one by itself."""
    rows = max(1, min(SLICE_ROWS, len(column) * SLICE_BYTES // max(1, column.nbytes)))
    parts = [pa.array([None if x is None else function(x) for x in column.slice(at, rows).to_pylist()], kind) for at in range(0, len(column), rows)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def each(function: Callable[[Any], Any], schema: str) -> Callable[[Column], Column]:
    """A function of one value as one of columns; structs are dicts."""

    def run(column: pa.Array) -> pa.Array:
        return sliced(column, function, to_arrow_type(kind, prefers_large_types=False))

    kind: DataType = _parse_datatype_string(schema)
    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)
