"""Conjugate-gradient solvers for A x = b with a symmetric positive definite A.

All vectors of an iteration are columns of one DataFrame by index, so that an iteration costs the product
and one pass for its scalars; each is checkpointed, which bounds the plan and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint
from .blocks import row_blocks
from .kernels import BROADCAST, spmv
from .matrix import Gram, SparseMatrix
from .vector import diagonal


@dataclass
class Solution:
    x: DataFrame  # (idx, v)
    iterations: int
    residual: float  # <r, r> for cg, |r| / |b| for pcg


def start_vectors(m: SparseMatrix) -> tuple[DataFrame, DataFrame]:
    """x0 = idx mod 10, and b = 5, 4, 3, 2, 1, 0, 0, ..."""
    base = m.spark.range(m.n_rows).withColumnRenamed("id", "idx")
    return base.select("idx", (F.col("idx") % 10).cast("double").alias("v")), base.select("idx", F.greatest(5 - F.col("idx"), F.lit(0)).cast("double").alias("v"))


@contextmanager
def _kept(m: SparseMatrix) -> Iterator[SparseMatrix]:
    """The matrix with what its products read kept in place: its entries, or its factor's."""
    if not isinstance(m, Gram):
        kept = m.entries.persist()
        yield m.with_entries(kept)
    elif m.n_cols > BROADCAST:
        kept = m.factor.entries.persist()
        yield replace(m, factor=m.factor.with_entries(kept))
    else:
        kept = row_blocks(m.factor).persist()
        yield replace(m, blocks=kept)
    kept.unpersist()


def _times(m: SparseMatrix, state: DataFrame, of: str, out: str) -> DataFrame:
    """``state`` with ``out`` = A times its column ``of``."""
    y = spmv(m, state.select("idx", F.col(of).alias("v"))).select(F.col("i").alias("idx"), F.col("y").alias(out))
    return state.join(y, "idx")


def _scalar(state: DataFrame, a: str, b: str) -> float:
    return state.agg(F.sum(F.col(a) * F.col(b))).first()[0] or 0.0


def cg(m: SparseMatrix, b: DataFrame, x0: DataFrame, stop: float = 0.01, most: int = 10_000) -> Solution:
    """Conjugate gradients until <r, r> <= stop."""
    with _kept(m) as m:
        state = x0.select("idx", F.col("v").alias("x")).join(b.select("idx", F.col("v").alias("b")), "idx")
        state = checkpoint(_times(m, state, "x", "q").select("idx", "x", (F.col("b") - F.col("q")).alias("r"), (F.col("b") - F.col("q")).alias("p")))
        ro, n = _scalar(state, "r", "r"), 0
        while ro > stop and n < most:
            state = checkpoint(_times(m, state, "p", "q"))
            pq = _scalar(state, "p", "q")
            if pq == 0:
                break
            alpha = F.lit(ro / pq)
            state = state.select("idx", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("q")).alias("r"), "p")
            new = _scalar(state, "r", "r")
            state, ro, n = state.select("idx", "x", "r", (F.col("r") + F.lit(new / ro) * F.col("p")).alias("p")), new, n + 1
    return Solution(state.select("idx", F.col("x").alias("v")), n, ro)


def pcg(m: SparseMatrix, b: DataFrame, x0: DataFrame, stop: float = 0.01, most: int = 10_000) -> Solution:
    """Conjugate gradients with Jacobi preconditioning until |r| / |b| <= stop.

    For a symmetric matrix the two coupled sequences of the biconjugate form coincide, so one is kept.
    """
    with _kept(m) as m:
        inverse = F.lit(1.0) / F.coalesce(F.nullif("d", F.lit(0.0)), F.lit(1.0))
        state = x0.select("idx", F.col("v").alias("x")).join(b.select("idx", F.col("v").alias("b")), "idx").join(diagonal(m), "idx", "left").withColumn("w", inverse)
        norm = _scalar(state, "b", "b") ** 0.5 or 1.0
        state = _times(m, state, "x", "q").withColumn("r", F.col("b") - F.col("q"))
        state = checkpoint(state.select("idx", "x", "r", "w", (F.col("w") * F.col("r")).alias("p")))
        rz, n, error = state.agg(F.sum(F.col("r") * F.col("r") * F.col("w"))).first()[0] or 0.0, 0, _scalar(state, "r", "r") ** 0.5 / norm
        while error > stop and n < most:
            state = checkpoint(_times(m, state, "p", "q"))
            pq = _scalar(state, "p", "q")
            if pq == 0:
                break
            alpha = F.lit(rz / pq)
            state = state.select("idx", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("q")).alias("r"), "w", "p")
            new, rr = state.agg(F.sum(F.col("r") * F.col("r") * F.col("w")), F.sum(F.col("r") * F.col("r"))).first()
            state = state.select("idx", "x", "r", "w", (F.col("w") * F.col("r") + F.lit(new / rz) * F.col("p")).alias("p"))
            rz, n, error = new, n + 1, rr**0.5 / norm
    return Solution(state.select("idx", F.col("x").alias("v")), n, error)


def residual(m: SparseMatrix, b: DataFrame, x: DataFrame) -> float:
    """|b - A x|"""
    y = spmv(m, x).select(F.col("i").alias("idx"), "y").join(b, "idx")
    return (y.agg(F.sum(F.pow(F.col("v") - F.col("y"), 2))).first()[0] or 0.0) ** 0.5
