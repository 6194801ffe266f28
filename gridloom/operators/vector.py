"""Vectors (idx, v): elementwise operations are joins by index, products are sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matrix import Gram, SparseMatrix


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """(idx, a, b)"""
    return a.select("idx", F.col("v").alias("a")).join(b.select("idx", F.col("v").alias("b")), "idx")


def _each(a: DataFrame, b: DataFrame, value: Column) -> DataFrame:
    return both(a, b).select("idx", value.alias("v"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return _each(a, b, F.col("a") + F.col("b"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return _each(a, b, F.col("a") - F.col("b"))


def axpy(a: DataFrame, s: float, b: DataFrame) -> DataFrame:
    """a + s b"""
    return _each(a, b, F.col("a") + F.lit(float(s)) * F.col("b"))


def scale(a: DataFrame, s: float) -> DataFrame:
    return a.select("idx", (F.col("v") * F.lit(float(s))).alias("v"))


def zeros(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("idx"), F.lit(0.0).alias("v"))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: dot."""
    return both(a, b).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0.0)).alias("dot"))


def compare(a: DataFrame, b: DataFrame, tolerance: float = 0.1, most: int = 10) -> DataFrame:
    """(idx, a, b): the first places, ``most`` of them, where the vectors differ by more than the tolerance."""
    return both(a, b).where(F.abs(F.col("a") - F.col("b")) > tolerance).orderBy("idx").limit(most)


def equal(a: DataFrame, b: DataFrame, tolerance: float = 0.1) -> bool:
    return both(a, b).where(F.abs(F.col("a") - F.col("b")) > tolerance).isEmpty()


def scatter(v: DataFrame, order: DataFrame) -> DataFrame:
    """out[new_idx] = v[idx]"""
    return v.join(order, "idx").select(F.col("new_idx").alias("idx"), "v")


def gather(v: DataFrame, order: DataFrame) -> DataFrame:
    """out[idx] = v[new_idx], the inverse of ``scatter``"""
    return v.withColumnRenamed("idx", "new_idx").join(order, "new_idx").select("idx", "v")


def diagonal(m: SparseMatrix) -> DataFrame:
    if isinstance(m, Gram):
        squares = m.factor.combine().entries.groupBy(F.col("j").alias("idx")).agg(F.sum(F.col("val") * F.col("val")).alias("d"))
        return m.rows("idx").join(squares, "idx", "left").select("idx", (F.coalesce("d", F.lit(0.0)) + F.lit(m.shift)).alias("d"))
    return m.entries.where("i = j").groupBy(F.col("i").alias("idx")).agg(F.sum("val").alias("d"))


def jacobi(m: SparseMatrix, b: DataFrame) -> DataFrame:
    """b_i / a_ii, or b_i where the diagonal has nothing or 0."""
    return b.join(diagonal(m), "idx", "left").select("idx", (F.col("v") / F.coalesce(F.nullif("d", F.lit(0.0)), F.lit(1.0))).alias("v"))
