"""Vectors as arrays: products, norms, means, parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """v at length 1; a zero vector stays."""
    # the norm as a variable: inside the inner function it would be computed for each component
    length = F.array(F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0)))
    return F.when(v.isNotNull(), F.transform(length, lambda n: F.transform(doubles(v), lambda x: x / n))[0])


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return dot(a, b) / F.when(n == 0, 1.0).otherwise(n)


def half_l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / 2


def hybrid_distance(a: Column, b: Column, hist_a: Column, hist_b: Column) -> Column:
    """0.7 of the cosine distance and 0.3 of the histograms' half L1 distance."""
    return 0.7 * (1 - cosine(a, b)) + 0.3 * half_l1(hist_a, hist_b)


def first_half(v: Column) -> Column:
    return F.slice(v, F.lit(1), F.floor(F.size(v) / 2).cast("int"))


def second_half(v: Column) -> Column:
    half = F.floor(F.size(v) / 2).cast("int")
    return F.slice(v, half + 1, half)


def half_precision(v: Column) -> Column:
    """Each component rounded to a 16-bit float and back."""

    @pandas_udf("array<float>")
    def rounded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: None if v is None else np.asarray(v, np.float32).astype(np.float16).astype(np.float32))

    return rounded(v)
