"""Output columns of operators that add to a table."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def free_name(docs: DataFrame, wish: str) -> str:
    """``wish``, with underscores added until no column has that name (in any case)."""
    taken = {c.lower() for c in docs.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


class Added:
    """``docs`` plus new columns; as with ``withColumn``, a new column replaces one of the same name.

    ``kept`` are the indices of the columns that stay, ``schema`` the result's schema.
    """

    def __init__(self, docs: DataFrame, fields: Sequence[T.StructField]):
        new = {f.name.lower() for f in fields}
        self.kept = [i for i, f in enumerate(docs.schema.fields) if f.name.lower() not in new]
        self.schema = T.StructType([*(docs.schema.fields[i] for i in self.kept), *fields])

    def batch(self, part: pa.RecordBatch, arrays: Sequence[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(part.column(i) for i in self.kept), *arrays], self.schema.names)
