"""Array expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def features_of(*cols: Column | str) -> Column:
    """Dense double vector from numeric columns, in the given order; NULL when any input is NULL."""
    parts = [_col(c).cast("double") for c in cols]
    missing = F.lit(False)
    for part in parts:
        missing = missing | part.isNull()
    return F.when(~missing, F.array(*parts))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance, summed left to right in double precision."""
    diffs = F.zip_with(
        _col(a).cast("array<double>"), _col(b).cast("array<double>"), lambda x, y: (x - y) * (x - y)
    )
    return F.aggregate(diffs, F.lit(0.0), lambda s, v: s + v)


def array_sum(a: Column | str, dtype: str = "double") -> Column:
    return F.aggregate(_col(a).cast(f"array<{dtype}>"), F.lit(0).cast(dtype), lambda s, v: s + v)


def _same_length(a: Column, b: Column, result: Column) -> Column:
    return F.when(F.size(a) == F.size(b), result).otherwise(
        F.raise_error(F.lit("arrays differ in length")).cast("array<double>")
    )


def array_add(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a).cast("array<double>"), _col(b).cast("array<double>")
    return _same_length(a, b, F.zip_with(a, b, lambda x, y: x + y))


def array_sub(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a).cast("array<double>"), _col(b).cast("array<double>")
    return _same_length(a, b, F.zip_with(a, b, lambda x, y: x - y))


def argmax_index(a: Column | str, tie_seed: int | None = None, tie_key: Column | str | None = None) -> Column:
    """0-based index of the largest element, -1 when none is >= 0.

    The lowest index wins a tie; with ``tie_seed`` one of the tied indices is drawn from a hash of ``tie_key``.
    """
    a = _col(a).cast("array<double>")
    top = F.array_max(a)
    index = F.array_position(a, top) - 1
    if tie_seed is not None:
        tied = F.filter(
            F.transform(a, lambda x, i: F.when(x == top, i.cast("bigint"))), lambda i: i.isNotNull()
        )
        index = F.element_at(tied, (F.pmod(draw(tie_seed, tie_key), F.size(tied)) + 1).cast("int"))
    return F.when(top >= 0, index).otherwise(F.lit(-1)).cast("int")


def draw(seed: int, key: Column | str) -> Column:
    """Repeatable 60-bit draw in [0, 2**60) from a seed and a key: the same on every retry and in any engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), _col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
