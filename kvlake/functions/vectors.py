"""Vector scalar functions as columns: rotation, scales, codes, bit packing. Vectors are arrays of one fixed length.

They define the semantics and serve single expressions; `kvlake.operators.schemes` does the same to whole Arrow batches,
which takes a third of the time or less where every vector of a table is packed.
A null vector gives null; a vector of another length than `dim` gives an error or nulls inside, so callers filter first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlake.functions.codebook import FLOOR, LEVELS16, midpoints


def f16(x: Column) -> Column:
    """A double rounded to half precision (to even, with subnormals; from 65,520 on infinite)."""
    big = F.when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return (
        F.when(F.abs(x) >= 65520.0, big)
        .when(F.abs(x) < 2.0**-14, F.rint(x * 16777216.0) / 16777216.0)
        .otherwise(x * 4398046511105.0 - (x * 4398046511105.0 - x))
    )


def halves(x: Column) -> Column:
    """Every value of an array, rounded to half precision, as doubles."""
    return F.transform(x, lambda v: f16(v.cast("double")))


def sign(i: Column, head: Column) -> Column:
    """1.0 where index and head have the same parity, else -1.0."""
    return F.when(F.pmod(i + head, F.lit(2)) == 0, 1.0).otherwise(-1.0)


def flip(x: Column, head: Column) -> Column:
    """The values multiplied by their signs; with head 0, the same for all heads."""
    return F.transform(x, lambda v, i: v * sign(i, head))


def hadamard(x: Column, dim: int) -> Column:
    """The Walsh-Hadamard transform (natural order, not normalised). Vectorised over Arrow batches, as one product with
    a matrix: measured three times as fast as butterflies of higher-order functions, which Spark interprets."""
    if dim < 1 or dim & (dim - 1):
        raise ValueError("dim must be a power of two")
    h = np.ones((1, 1))
    while len(h) < dim:
        h = np.block([[h, h], [h, -h]])

    @F.pandas_udf("array<double>")
    def product(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(vectors.to_numpy()) @ h) if len(vectors) else [])

    return product(x)


def rotate(df: DataFrame, column: str, head: str | None, dim: int, out: str) -> DataFrame:
    """Adds `out`: the vector with its signs flipped, transformed, and scaled to the same length. Vectors are not null."""
    turned = hadamard(flip(F.col(column), F.col(head) if head else F.lit(0)), dim)
    return df.withColumn(out, turned).withColumn(out, F.transform(out, lambda v: v / dim**0.5))


def unrotate(df: DataFrame, column: str, head: str | None, dim: int, out: str) -> DataFrame:
    """Adds `out`: the inverse of `rotate`."""
    df = df.withColumn(out, hadamard(F.col(column), dim)).withColumn(out, F.transform(out, lambda v: v / dim**0.5))
    return df.withColumn(out, flip(F.col(out), F.col(head) if head else F.lit(0)))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def rms(x: Column) -> Column:
    """Root of the mean square, at least FLOOR."""
    return F.greatest(F.sqrt(total(F.transform(x, lambda v: v * v)) / F.size(x)), F.lit(FLOOR))


def absmax_scale(x: Column) -> Column:
    """A seventh of the largest magnitude, at least FLOOR."""
    return F.greatest(F.array_max(F.transform(x, lambda v: F.abs(v))) / 7, F.lit(FLOOR))


def clamp(x: Column, limit: float) -> Column:
    return F.greatest(F.least(x, F.lit(limit)), F.lit(-limit))


def code(z: Column, levels: tuple[float, ...] = LEVELS16) -> Column:
    """The number of thresholds below a value; a value on one gets the lower code."""
    n = F.lit(0)
    for m in midpoints(levels):
        n = n + (z > m).cast("int")
    return n


def level(c: Column, levels: tuple[float, ...] = LEVELS16) -> Column:
    return F.get(F.array(*map(F.lit, levels)), c)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def pack(codes: Column, bits: int) -> Column:
    """Codes of 1, 2 or 4 bits as binary, the first code in the lowest bits of the first byte."""
    each = 8 // bits
    code_at = lambda b, k: F.coalesce(F.get(codes, b * each + k), F.lit(0)).cast("int")
    byte = lambda b: sum((code_at(b, k) * (1 << bits * k) for k in range(1, each)), code_at(b, 0))
    n = F.ceil(F.size(codes) / F.lit(each)).cast("int")
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.unhex(F.array_join(F.transform(numbers, lambda b: F.lpad(F.hex(byte(b)), 2, "0")), ""))


def unpack(packed: Column, bits: int, n: Column) -> Column:
    """The first n codes of a packed binary."""
    each = 8 // bits
    byte = lambda i: F.conv(F.substring(F.hex(packed), F.floor(i / each).cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int")
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda i: F.pmod(F.floor(byte(i) / F.pow(F.lit(2.0), F.pmod(i, F.lit(each)) * bits)).cast("int"), F.lit(1 << bits)))


def signed4(nibble: Column) -> Column:
    """The signed value of a two's complement nibble."""
    return F.when(nibble >= 8, nibble - 16).otherwise(nibble)


def nibble(value: Column) -> Column:
    """The two's complement nibble of a value from -8 to 7."""
    return F.pmod(value, F.lit(16))


def absmax_codes(x: Column) -> Column:
    """Nibbles of the values over their scale, rounded to even."""
    scale = absmax_scale(x)
    return F.transform(x, lambda v: nibble(clamp_int(F.rint(v / scale))))


def clamp_int(v: Column) -> Column:
    return F.greatest(F.least(v, F.lit(7.0)), F.lit(-8.0)).cast("int")
