"""Vector arithmetic on ARRAY<DOUBLE> columns, JVM-side."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import as_col

# Guard added to a norm before dividing (fixed value).
NORM_EPS = 1e-9


def as_double(v: str | Column) -> Column:
    return as_col(v).cast("array<double>")


def dot(a: str | Column, b: str | Column) -> Column:
    prods = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / ((norm(a) + NORM_EPS) * (norm(b) + NORM_EPS))


def unit(a: str | Column) -> Column:
    """The vector scaled to length 1."""
    size = norm(a) + NORM_EPS
    return F.transform(as_double(a), lambda x: x / size)


def neg_l2(a: str | Column, b: str | Column) -> Column:
    sq = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return -F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x))


def hist_intersection(a: str | Column, b: str | Column) -> Column:
    """Sum of element-wise minima of two histograms, each first scaled to sum 1."""
    total = lambda v: F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x)
    pa, pb = total(a), total(b)
    mins = F.zip_with(as_double(a), as_double(b), lambda x, y: F.least(F.try_divide(x, pa), F.try_divide(y, pb)))
    return F.aggregate(mins, F.lit(0.0), lambda acc, x: acc + x)


def mean_vector(df: DataFrame, by: list[str], vec: str, out: str = "vec") -> DataFrame:
    """Mean vector per group: one vector aggregate with a partial result per map task, so a hot group is harmless."""
    means = df.groupBy(*by).agg(Summarizer.mean(array_to_vector(as_double(vec))).alias("_m"))
    return means.select(*by, vector_to_array("_m").alias(out))
