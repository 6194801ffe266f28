"""A sparse matrix: a DataFrame of entries (i, j, val), 0-based, with its dimensions.

Absent entries are zero. Entries of equal coordinates are summed by every product; ``get`` takes the least
value of them, as a table has no first row. Row and column operators keep empty rows and columns.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SparseMatrix:
    entries: DataFrame
    n_rows: int
    n_cols: int

    @classmethod
    def of(cls, df: DataFrame, n_rows: int, n_cols: int, i: str = "i", j: str = "j", val: str | None = "val") -> SparseMatrix:
        value = F.lit(1.0) if val is None else F.col(val).cast("double")
        return cls(df.select(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j"), value.alias("val")), n_rows, n_cols)

    @property
    def spark(self) -> SparkSession:
        return self.entries.sparkSession

    def rows(self, name: str = "i") -> DataFrame:
        return self.spark.range(self.n_rows).withColumnRenamed("id", name)

    def cols(self, name: str = "j") -> DataFrame:
        return self.spark.range(self.n_cols).withColumnRenamed("id", name)

    def with_entries(self, entries: DataFrame) -> SparseMatrix:
        return replace(self, entries=entries)

    # --- projections, filters, lookups

    def transpose(self) -> SparseMatrix:
        return SparseMatrix(self.entries.select(F.col("j").alias("i"), F.col("i").alias("j"), "val"), self.n_cols, self.n_rows)

    def mirror(self, sign: int = 1) -> SparseMatrix:
        """The full matrix of a triangle: entries off the diagonal stand at both places (``sign`` -1: skew-symmetric)."""
        other = self.entries.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("val") * sign).alias("val"))
        return self.with_entries(self.entries.unionByName(other))

    def combine(self) -> SparseMatrix:
        """Entries of equal coordinates summed."""
        return self.with_entries(self.entries.groupBy("i", "j").agg(F.sum("val").alias("val")))

    def sub(self, row_start: int, col_start: int, row_len: int, col_len: int, local: bool = False) -> SparseMatrix:
        """The entries of a rectangle, with their own indices, or as a matrix of its size with ``local`` ones."""
        inside = F.col("i").between(row_start, row_start + row_len - 1) & F.col("j").between(col_start, col_start + col_len - 1)
        found = self.with_entries(self.entries.where(inside))
        if not local:
            return found
        rows, cols = max(0, min(row_len, self.n_rows - row_start)), max(0, min(col_len, self.n_cols - col_start))
        return SparseMatrix(found.entries.withColumns({"i": F.col("i") - row_start, "j": F.col("j") - col_start}), rows, cols)

    def sub_nnz(self, row_start: int, col_start: int, row_len: int, col_len: int) -> int:
        return self.sub(row_start, col_start, row_len, col_len).entries.count() if row_len > 0 and col_len > 0 else 0

    def sub_empty(self, row_start: int, col_start: int, row_len: int, col_len: int) -> bool:
        return row_len <= 0 or col_len <= 0 or self.sub(row_start, col_start, row_len, col_len).entries.isEmpty()

    def tiles(self, row_len: int, col_len: int) -> DataFrame:
        """(ti, tj, nnz) of each tile that isn't empty."""
        return self.entries.groupBy(F.floor(F.col("i") / row_len).alias("ti"), F.floor(F.col("j") / col_len).alias("tj")).agg(F.count("*").alias("nnz"))

    def get(self, points: DataFrame) -> DataFrame:
        """(i, j, val) at each of ``points`` (i, j); 0.0 where there is no entry."""
        # tasks hold the points and stream the entries, which a merge join would sort
        asked = self.entries.join(points.select("i", "j").hint("shuffle_hash"), ["i", "j"], "left_semi")
        found = asked.groupBy("i", "j").agg(F.min("val").alias("val"))
        return points.join(found, ["i", "j"], "left").select("i", "j", F.coalesce("val", F.lit(0.0)).alias("val"))

    def pattern_coefficients(self) -> SparseMatrix:
        """Each entry becomes 1 / nnz of its row, in single precision."""
        sizes = self.entries.groupBy("i").agg(F.count("*").alias("n"))
        share = F.lit(1.0) / F.col("n")
        return self.with_entries(self.entries.join(sizes, "i").select("i", "j", share.cast("float").cast("double").alias("val")))

    def pattern_coefficients_by_run(self, order: Column) -> SparseMatrix:
        """The same by runs of equal rows in file order; ``order`` numbers the entries 0, 1, 2, ..."""
        from ..functions.scan import lag, prefix_sum

        rows = lag(self.entries.withColumn("at", order.cast("long")), "at", {"i": "before"})
        rows = prefix_sum(rows.withColumn("new", (~F.col("i").eqNullSafe(F.col("before"))).cast("long")), "at", "new", "run")
        sizes = rows.groupBy("run").agg(F.count("*").alias("n"))
        share = (F.lit(1.0) / F.col("n")).cast("float").cast("double")
        return self.with_entries(rows.join(sizes, "run").select("i", "j", share.alias("val")))

    # --- orderings; a lookup is (idx, new_idx)

    def apply_order(self, rows: DataFrame | None = None, cols: DataFrame | None = None) -> DataFrame:
        """(i, j, i_ord, j_ord, val); an index without lookup keeps its place."""
        out = self.entries.withColumns({"i_ord": F.col("i"), "j_ord": F.col("j")})
        for axis, lookup in (("i", rows), ("j", cols)):
            if lookup is not None:
                out = out.drop(f"{axis}_ord").join(lookup.select(F.col("idx").alias(axis), F.col("new_idx").alias(f"{axis}_ord")), axis)
        return out.select("i", "j", "i_ord", "j_ord", "val")

    def reorder(self, rows: DataFrame | None = None, cols: DataFrame | None = None) -> SparseMatrix:
        """The ordering applied, and ordered indices made the indices."""
        return self.with_entries(self.apply_order(rows, cols).select(F.col("i_ord").alias("i"), F.col("j_ord").alias("j"), "val"))

    def sorted(self, *by: str) -> DataFrame:
        """Entries in a global order: by row (default), by column, or by any of the columns."""
        return self.entries.orderBy(*(by or ("i", "j")))


@dataclass(frozen=True)
class Gram(SparseMatrix):
    """Transposed ``factor`` times ``factor``, plus ``shift`` times the identity.

    Products go through the factor: the matrix itself has an entry for each pair of columns that meet in a row.
    ``entries`` are its plan, for what needs them; what is made of them is a plain matrix.
    """

    factor: SparseMatrix
    shift: float = 0.0
    #: The factor's ``row_blocks``, if they are kept.
    blocks: DataFrame | None = None

    @classmethod
    def of_factor(cls, m: SparseMatrix, shift: float = 0.0) -> Gram:
        a = m.entries.select(F.col("i").alias("k"), F.col("j").alias("i"), F.col("val").alias("a"))
        b = m.entries.select(F.col("i").alias("k"), "j", F.col("val").alias("b"))
        product = a.join(b, "k").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("val"))
        one = m.spark.range(m.n_cols).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(float(shift)).alias("val"))
        return cls(SparseMatrix(product.unionByName(one), m.n_cols, m.n_cols).combine().entries, m.n_cols, m.n_cols, m, float(shift))

    def with_entries(self, entries: DataFrame) -> SparseMatrix:
        return SparseMatrix(entries, self.n_rows, self.n_cols)


def compose(first: DataFrame, then: DataFrame) -> DataFrame:
    """The ordering ``first`` and after it ``then``."""
    return first.join(then.select(F.col("idx").alias("new_idx"), F.col("new_idx").alias("n")), "new_idx").select("idx", F.col("n").alias("new_idx"))
