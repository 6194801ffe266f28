"""The driver's tables as matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import Gram, SparseMatrix


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, sf_dir: str, name: str) -> int:
    return _read(spark, sf_dir, name).count()


def ps(spark: SparkSession, sf_dir: str, at: DataFrame | None = None) -> SparseMatrix:
    """Part x supplier: the quantity of each pair; given points (i, j), only of those, and the rest isn't summed."""
    lines = _read(spark, sf_dir, "lineitem")
    if at is not None:
        lines = lines.join(at.select(F.col("i").alias("l_partkey"), F.col("j").alias("l_suppkey")).hint("shuffle_hash"), ["l_partkey", "l_suppkey"], "left_semi")
    e = lines.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("val"))
    return SparseMatrix.of(e, _rows(spark, sf_dir, "part"), _rows(spark, sf_dir, "supplier"), "l_partkey", "l_suppkey")


def op(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Order x part: each line's quantity, pairs that come up twice included; some orders have no line."""
    return SparseMatrix.of(_read(spark, sf_dir, "lineitem"), _rows(spark, sf_dir, "orders"), _rows(spark, sf_dir, "part"), "l_orderkey", "l_partkey", "l_quantity")


def cn(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Customer x nation, a pattern."""
    return SparseMatrix.of(_read(spark, sf_dir, "customer"), _rows(spark, sf_dir, "customer"), _rows(spark, sf_dir, "nation"), "c_custkey", "c_nationkey", None)


def ss(spark: SparkSession, sf_dir: str) -> Gram:
    """Supplier x supplier: transposed ``ps`` times ``ps`` plus the identity, symmetric positive definite."""
    return Gram.of_factor(ps(spark, sf_dir), 1.0)


def lower(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """The lower triangle of the leading square of ``ps``."""
    m = ps(spark, sf_dir)
    return SparseMatrix(m.entries.where((F.col("j") <= F.col("i")) & (F.col("i") < m.n_cols)), m.n_cols, m.n_cols)
