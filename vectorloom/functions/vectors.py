"""Column expressions over vectors (arrays of floats). All distances are squared L2 in DOUBLE."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to here an unrolled sum is the faster form; the code of a longer one gets too large for the JVM to compile.
UNROLL = 8


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def l2sq(a, b, dims: int, start: int = 0) -> Column:
    """Squared L2 over the coordinates [start, dims): with start > 0 the residual of a prefix distance."""
    a, b = as_col(a), as_col(b)
    if dims - start <= UNROLL:
        squares = [(a[i].cast("double") - b[i].cast("double")) * (a[i].cast("double") - b[i].cast("double")) for i in range(start, dims)]
        return reduce(lambda x, y: x + y, squares, F.lit(0.0))
    part = lambda v: F.slice(v, start + 1, dims - start)
    diff = F.zip_with(part(a), part(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(diff, F.lit(0.0), lambda acc, x: acc + x * x)


def prefix(v, d: int) -> Column:
    """The first d coordinates."""
    return F.slice(as_col(v), 1, d)


def checked(v, d: int) -> Column:
    """The vector, or an error where its length is not d."""
    v = as_col(v)
    return F.when(F.size(v) == d, v).otherwise(F.raise_error(F.concat(F.lit(f"vector length is not {d}: "), F.size(v).cast("string"))))


def at_least(v, d: int) -> Column:
    """The vector, or an error where it has fewer than d coordinates."""
    v = as_col(v)
    return F.when(F.size(v) >= d, v).otherwise(F.raise_error(F.concat(F.lit(f"vector length is under {d}: "), F.size(v).cast("string"))))


def portable_hash(c, seed: int = 0) -> Column:
    """A pseudo-random order that any SQL engine can repeat: the first 32 bits of the MD5 of "id:seed"."""
    text = F.concat(as_col(c).cast("string"), F.lit(f":{seed}")).cast("binary")
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def ef_bucket(ef: int, widths=(16, 32, 48, 64, 96, 128, 192, 256, 384, 512, 1024, 2048)) -> int:
    """ef rounded up to one of the fixed beam widths; an error above the last."""
    found = [w for w in widths if w >= ef]
    if not found:
        raise ValueError(f"ef must be at most {widths[-1]}")
    return found[0]
