"""Bounded samples drawn from the whole of a table."""

from __future__ import annotations

from math import sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BITS = 40


def share(docs: DataFrame, part: float) -> DataFrame:
    """About this part of the rows, by a hash of a row's values and place, so that equal rows are drawn one by one."""
    if part >= 1:
        return docs
    plain = [f"`{f.name}`" for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType)]
    draw = F.pmod(F.xxhash64(*plain, F.monotonically_increasing_id()), F.lit(1 << _BITS))
    return docs.filter(draw < int(part * (1 << _BITS)))


def spread(docs: DataFrame, rows: int) -> DataFrame:
    """At most about ``rows`` rows: all of them, or a little less by :func:`share`."""
    total = docs.count()
    return docs if total <= rows else share(docs, max(rows - 3 * sqrt(rows), 1) / total)


def even(size: int, most: int) -> list[int]:
    """At most ``most`` indices, evenly over ``range(size)``."""
    return list(range(size)) if size <= most else np.linspace(0, size - 1, most).astype(int).tolist()
