"""Statistics of the distribution of entries; empty rows and columns count as 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import formats
from .matrix import SparseMatrix


def _spread(counts: DataFrame, tag: str, value: str = "nnz") -> DataFrame:
    return counts.agg(F.min(value).alias(f"min{tag}"), F.avg(value).alias(f"avg{tag}"), F.max(value).alias(f"max{tag}"))


def nnz_stats(m: SparseMatrix) -> DataFrame:
    """One row: minr, avgr, maxr, minc, avgc, maxc."""
    return _spread(formats.row_nnz(m), "r").join(_spread(formats.col_nnz(m), "c"), F.lit(True))


def matrix_info(m: SparseMatrix, cache_kb: int) -> DataFrame:
    """The statistics with dimensions, sizes in KB (compressed rows; with both vectors) and parts for a cache."""
    size = (F.col("nnz") * 12 + 4 * (m.n_rows + 1)) / 1024
    counted = m.entries.agg(F.count("*").alias("nnz")).select(F.lit(m.n_rows).cast("long").alias("n_rows"), F.lit(m.n_cols).cast("long").alias("n_cols"), "nnz", size.alias("size_kb"))
    counted = counted.withColumn("op_kb", F.col("size_kb") + 8.0 * (m.n_rows + m.n_cols) / 1024).withColumn("parts", (F.floor(F.col("op_kb") / cache_kb) + 1).cast("long"))
    return counted.join(nnz_stats(m), F.lit(True))


def jds_block_stats(m: SparseMatrix, parts: DataFrame) -> DataFrame:
    """(part, n_rows, nnz, minr, avgr, maxr, minc, avgc, maxc): row lengths and diagonal lengths of each part."""
    rows = formats.jds_permutation(m, parts).groupBy("part").agg(F.count("*").alias("n_rows"), F.sum("nnz").alias("nnz"), F.min("nnz").alias("minr"), F.avg("nnz").alias("avgr"), F.max("nnz").alias("maxr"))
    diagonals = formats.jds_idiag(m, parts).groupBy("part").agg(F.min("len").alias("minc"), F.avg("len").alias("avgc"), F.max("len").alias("maxc"))
    return rows.join(diagonals, "part", "left").na.fill(0, ["minc", "maxc"]).na.fill(0.0, ["avgc"])


def block_means(stats: DataFrame, parts_of_block: int) -> DataFrame:
    """Means over the parts of each block, then over the blocks: (minr, avgr, maxr, minc, avgc, maxc)."""
    names = ["minr", "avgr", "maxr", "minc", "avgc", "maxc"]
    block = stats.groupBy(F.floor(F.col("part") / parts_of_block).alias("block")).agg(*[F.avg(c).alias(c) for c in names])
    return block.agg(*[F.avg(c).alias(c) for c in names])
