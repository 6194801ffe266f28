"""y = A x: a join with the vector and a sum by row.

Each form gives every row, 0.0 for empty ones, in the original order. The vector is (idx, v). It is
broadcast if it has at most ``BROADCAST`` elements; a longer one is shuffled by index, where adaptive
execution splits columns that hold too many entries. Sums are partial before the shuffle by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import formats
from .blocks import dense, opened, passes, row_blocks, sent, sums
from .matrix import Gram, SparseMatrix

#: Elements of a vector that is broadcast (16 bytes each).
BROADCAST = 500_000
#: Rows and columns of a packed block.
BLOCK = 1024


def ramp(m: SparseMatrix, n: int | None = None) -> DataFrame:
    """x_j = j mod 10."""
    return m.spark.range(m.n_cols if n is None else n).select(F.col("id").alias("idx"), (F.col("id") % 10).cast("double").alias("v"))


def with_x(entries: DataFrame, x: DataFrame, n: int) -> DataFrame:
    """Entries with ``v``, the vector's element of their column."""
    x = x.select(F.col("idx").alias("j"), "v")
    return entries.join(F.broadcast(x) if n <= BROADCAST else x, "j")


def _all_rows(m: SparseMatrix, sums: DataFrame) -> DataFrame:
    return m.rows().join(sums, "i", "left").select("i", F.coalesce("y", F.lit(0.0)).alias("y"))


def _sum(m: SparseMatrix, entries: DataFrame, x: DataFrame) -> DataFrame:
    return with_x(entries, x, m.n_cols).groupBy("i").agg(F.sum(F.col("val") * F.col("v")).alias("y"))


def spmv(m: SparseMatrix, x: DataFrame) -> DataFrame:
    """(i, y), from entries in any order."""
    if isinstance(m, Gram):
        return _through_factor(m, x)
    return _all_rows(m, _sum(m, m.entries, x))


def _through_factor(m: Gram, x: DataFrame) -> DataFrame:
    """(i, y): each row of the factor times x, times the row, and ``shift`` x; one pass if x is short enough to broadcast."""
    n = m.n_cols
    if n > BROADCAST:
        ahead = spmv(m.factor, x).select(F.col("i").alias("idx"), F.col("y").alias("v"))
        back = spmv(m.factor.transpose(), ahead)
    else:
        held = sent(m.spark, dense(x, n))

        def run(batches):
            v, q, met = held.value, np.zeros(n), np.zeros(n, bool)
            for _, _, _, at, lens, j, val in opened(batches, n):
                np.add.at(q, j, val * np.repeat(np.add.reduceat(val * v[j], at), lens))
                met[j] = True
            here = np.flatnonzero(met)
            yield sums(["i", "y"], here, q[here])

        blocks = m.blocks if m.blocks is not None else row_blocks(m.factor)
        back = _all_rows(m, passes(blocks).mapInArrow(run, "i long, y double").groupBy("i").agg(F.sum("y").alias("y")))
    own = x.select(F.col("idx").alias("i"), "v")
    return back.join(own, "i", "left").select("i", (F.col("y") + F.lit(m.shift) * F.coalesce("v", F.lit(0.0))).alias("y"))


def spmv_add(m: SparseMatrix, x: DataFrame, y0: DataFrame) -> DataFrame:
    """y0 + A x."""
    return spmv(m, x).join(y0.select(F.col("idx").alias("i"), "v"), "i").select("i", (F.col("y") + F.col("v")).alias("y"))


def spmv_csc(m: SparseMatrix, x: DataFrame) -> DataFrame:
    """Driven by columns: those with x = 0 give nothing and are left out."""
    return _all_rows(m, _sum(m, m.entries, x.where("v <> 0")))


def spmv_t(m: SparseMatrix, x: DataFrame) -> DataFrame:
    return spmv(m.transpose(), x)


def spmv_icsr(m: SparseMatrix, x: DataFrame) -> DataFrame:
    """By way of the delta encoding and its decoding."""
    return spmv(formats.icsr_decode(*formats.icsr_encode(m), m.n_rows, m.n_cols), x)


def spmv_jds(m: SparseMatrix, parts: DataFrame, x: DataFrame) -> DataFrame:
    """Sums by permuted row, gathered to the original order."""
    y = with_x(formats.jds_entries(m, parts), x, m.n_cols).groupBy("part", "r").agg(F.sum(F.col("val") * F.col("v")).alias("y"))
    back = formats.jds_permutation(m, parts).select("part", "r", "i")
    return _all_rows(m, y.join(back, ["part", "r"]).select("i", "y"))


def spmv_hybrid(m: SparseMatrix, regions: DataFrame, x: DataFrame) -> DataFrame:
    """The regions' sums added; ``regions`` is a hybrid relation with i, j, val and region."""
    y = with_x(regions, x, m.n_cols).groupBy("i").agg(*[F.sum(F.when(F.col("region") == r, F.col("val") * F.col("v"))).alias(r) for r in ("JDS", "CSR")])
    return _all_rows(m, y.select("i", (F.coalesce("JDS", F.lit(0.0)) + F.coalesce("CSR", F.lit(0.0))).alias("y")))


# --- packed blocks


def pack(m: SparseMatrix, block: int = BLOCK) -> DataFrame:
    """(rb, cb, part, r, c, v): arrays of the entries of square blocks, at most about a million in one row."""
    e = m.entries.select(F.floor(F.col("i") / block).alias("rb"), F.floor(F.col("j") / block).alias("cb"), F.pmod(F.col("i"), F.lit(16)).alias("part"), (F.col("i") % block).cast("int").alias("r"), (F.col("j") % block).cast("int").alias("c"), "val")
    return e.groupBy("rb", "cb", "part").agg(F.collect_list(F.struct("r", "c", "val")).alias("e")).select("rb", "cb", "part", F.col("e.r").alias("r"), F.col("e.c").alias("c"), F.col("e.val").alias("v"))


def spmv_packed(m: SparseMatrix, packed: DataFrame, x: DataFrame, block: int = BLOCK) -> DataFrame:
    """The product by numpy over packed blocks that meet their piece of the vector; nothing is broadcast by hand."""
    pieces = x.groupBy(F.floor(F.col("idx") / block).alias("cb")).agg(F.collect_list(F.struct((F.col("idx") % block).cast("int").alias("c"), "v")).alias("x"))
    met = packed.join(pieces, "cb").select("rb", "r", "c", "v", F.col("x.c").alias("xc"), F.col("x.v").alias("xv"))

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                rb, r, c, v, xc, xv = (b.column(n)[k] for n in range(6))
                r, c, v, xc, xv = (a.values.to_numpy(zero_copy_only=False) for a in (r, c, v, xc, xv))
                dense = np.zeros(block)
                dense[xc] = xv
                y = np.bincount(r, v * dense[c], block)
                at = np.unique(r)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64) + rb.as_py() * block), pa.array(y[at])], ["i", "y"])

    return _all_rows(m, met.mapInArrow(run, "i long, y double").groupBy("i").agg(F.sum("y").alias("y")))
