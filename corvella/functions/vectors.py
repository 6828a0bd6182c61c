"""Vector functions on array<float> columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v scaled to length 1; the length counts as 1e-9 at least."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-9))
    return F.transform(v, lambda x: x.cast("double") / norm)
