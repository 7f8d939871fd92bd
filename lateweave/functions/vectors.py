"""Vector arithmetic as Spark expressions over ``ARRAY<DOUBLE>``, and parameter arrays as literals."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it is known to stay below this; else Spark shuffles both.
BROADCAST_BYTES = 64 << 20


def literal(values: np.ndarray | Sequence, kind: str = "double") -> Column:
    """Nested lists of numbers as one constant: parsed in a single call and folded by the optimizer."""
    suffix = {"double": "D", "bigint": "L", "int": ""}[kind]

    def depth(x) -> int:
        return 1 + max(map(depth, x), default=0) if isinstance(x, list) else 0

    def text(x, levels: int) -> str:
        if levels == 0:
            return f"{x!r}{suffix}"
        if not x:
            return f"cast(array() as {'array<' * levels + kind + '>' * levels})"
        return f"array({','.join(text(y, levels - 1) for y in x)})"

    nested = np.asarray(values).tolist() if isinstance(values, np.ndarray) else list(values)
    return F.expr(text(nested, depth(nested)))


def doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def sign_bits(vec: Column, planes: Column, at_zero: int = 0) -> Column:
    """The signs of ``vec`` against each plane, first plane first, as one integer; a product of 0 gives ``at_zero``."""
    one = (lambda s: s >= 0) if at_zero else (lambda s: s > 0)
    return F.aggregate(planes, F.lit(0).cast("long"), lambda acc, hv: F.shiftleft(acc, 1) + one(dot(vec, hv)).cast("long"))


def parities(code: Column, bits: int = 32) -> Column:
    """Each bit xor all bits above it: the partition that Gray-appending the bits one by one leads to."""
    step = 1
    while step < bits:
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
        step *= 2
    return code


def with_bit(code: Column, bits: int, bit: int, value: int) -> Column:
    """``code`` with bit number ``bit`` (0 is the most significant of ``bits``) set to ``value``."""
    mask = 1 << (bits - 1 - bit)
    return code.bitwiseOR(F.lit(mask)) if value else code.bitwiseAND(F.lit(~mask))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def nearest(vec: Column, centers: Column) -> Column:
    """The index (from 0) of the closest of an array of vectors; the first of equals."""
    d = F.transform(centers, lambda c: squared_distance(vec, c))
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def elementwise(how: str, column: str, width: int) -> Column:
    """An aggregate of equally long arrays, value by value: one buffer per value, combined before the shuffle like any
    other sum, so a group of any size takes bounded memory and no array is exploded."""
    return F.expr(f"array({','.join(f'{how}({column}[{k}])' for k in range(width))})")


def broadcast_if(df: DataFrame, rows: int, bytes_per_row: int) -> DataFrame:
    """A broadcast hint if ``rows`` rows are sure to be small enough."""
    return F.broadcast(df) if rows * bytes_per_row <= BROADCAST_BYTES else df


def checked_local(df: DataFrame, bytes_per_row: int) -> tuple[DataFrame, bool]:
    """``df`` computed once, and True, if it turns out to be small enough; else as it was, and False."""
    most = BROADCAST_BYTES // bytes_per_row
    rows = df.limit(most + 1).toArrow()
    return (df.sparkSession.createDataFrame(rows, df.schema), True) if rows.num_rows <= most else (df, False)


def checked_broadcast(df: DataFrame, bytes_per_row: int) -> DataFrame:
    """``df`` for broadcasting if it turns out to be small enough: then it has been computed, once; else as it was."""
    found, small = checked_local(df, bytes_per_row)
    return F.broadcast(found) if small else found


def checked_rows(df: DataFrame, bytes_per_row: int) -> pa.Table:
    """The rows of a stated small set on the driver; more than fit is an error, not a risk."""
    most = BROADCAST_BYTES // bytes_per_row
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"more than {most} rows on the query side; split the query set")
    return rows


def ranges_below(value: Column, splits: Sequence, kind: str = "double") -> Column:
    """How many of the ascending ``splits`` are below ``value``: first whole stretches of them, then within one, so a
    row costs about twice the root of their number."""
    if not splits:
        return F.lit(0)
    step = math.isqrt(len(splits))
    below = lambda some: F.size(F.filter(some, lambda s: s < value))
    whole = below(literal(splits[step - 1 :: step], kind)) * step
    return whole + below(F.slice(literal(splits, kind), whole + 1, F.lit(step)))
