"""Dense vectors as arrays: products, norms, hashed embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Length of the vector, 1 for a zero one."""
    n = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(n == 0, 1.0).otherwise(n)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def hash_bucket(token: Column) -> Column:
    """md5 modulo 256 as the last byte of the digest."""
    return F.conv(F.right(F.md5(token.cast("binary")), F.lit(2)), 16, 10).cast("int")
