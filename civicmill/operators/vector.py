"""Exact cosine search of one vector over a table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_top_k(vectors: DataFrame, key: str, column: str, wanted: list[float], k: int) -> DataFrame:
    """(key, score): the ``k`` nearest, ties to the smaller key. One pass; each task keeps ``k`` rows."""
    q = F.array(*[F.lit(float(x)) for x in wanted])
    v = F.col(column)
    size = F.sqrt(dot(v, v)) * F.lit(sum(float(x) ** 2 for x in wanted) ** 0.5)
    return vectors.where(v.isNotNull()).select(key, F.round(dot(v, q) / F.greatest(size, F.lit(1e-8)), 4).alias("score")).orderBy(F.desc("score"), key).limit(k)


@F.pandas_udf(BinaryType())
def packed(vectors: pd.Series) -> pd.Series:
    """A vector as little-endian 32-bit floats, as stores without arrays keep it; null stays null."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def unpacked(blobs: pd.Series) -> pd.Series:
    """The vector of such bytes; bytes past the last whole float are dropped."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4", len(b) // 4))
