"""Vector functions as Column expressions over array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKET_BITS = 10


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products, from the left; null where the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalized(v: Column) -> Column:
    """Unit vector; a vector without length becomes zeros."""
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n <= 0, F.lit(0.0)).otherwise(x / n)))[0]  # binds the norm once


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def bucket_key(v: Column, bits: int = BUCKET_BITS) -> Column:
    """Sign code: bit i, from the highest, says whether element i * (length // bits) is not negative. 0 for an empty vector or bits <= 0."""
    if bits <= 0:
        return F.lit(0)
    used = F.least(F.lit(bits), F.size(v))
    step = F.floor(F.size(v) / F.greatest(used, F.lit(1))).cast("int")
    code = F.aggregate(F.sequence(F.lit(0), F.greatest(used - 1, F.lit(0))), F.lit(0), lambda a, i: a * 2 + F.when(F.get(v, i * step) >= 0, 1).otherwise(0))
    return F.when(F.size(v) > 0, code).otherwise(F.lit(0)).cast("int")


def neighbour_keys(key: Column, bits: int = BUCKET_BITS) -> Column:
    """The key and those that differ from it in one bit."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: key.bitwiseXOR(F.pow(F.lit(2), i).cast("int")))
    return F.concat(F.array(key), flips)


def parsed(text: Column) -> Column:
    """A vector from its JSON; null for what is none."""
    return F.from_json(text, "array<double>")


def dumped(vector: Column) -> Column:
    """A vector as JSON."""
    return F.to_json(vector)
