"""Prefix sums, lags, numbering and ranges over a whole table without a window over all of its rows.

A window without ``PARTITION BY`` runs in one task. Here the rows' index cuts them into blocks; the window
runs within blocks, and what a block needs from those before it is one row a block. Those rows are scanned
the same way, by blocks of blocks, until the index is used up: no task sorts more than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Index values of one block, and those that a scan can have (from 0 on) unless it is told.
BLOCK, MOST = 1 << 16, 1 << 48


def _block(index: str, size: int) -> Column:
    return F.floor(F.col(index) / F.lit(size)).cast("long")


def prefix_sum(df: DataFrame, index: str, value: str, name: str, block: int = BLOCK, most: int = MOST, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows with a smaller or equal ``index``.

    The index is unique, not null, and from 0 to below ``most``. With ``by`` each group has a scan of its own.
    """
    rows = df.withColumn("__b", _block(index, block))
    inside = F.sum(value).over(Window.partitionBy(*by, "__b").orderBy(index).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn(name, inside)
    if most <= block:
        return rows.drop("__b")
    sums = df.groupBy(*by, _block(index, block).alias("__i")).agg(F.sum(value).alias("__s"))
    before = prefix_sum(sums, "__i", "__s", "__u", block, -(-most // block), by).select(*by, F.col("__i").alias("__b"), (F.col("__u") - F.col("__s")).alias("__o"))
    return rows.join(before, [*by, "__b"]).withColumn(name, F.col(name) + F.col("__o")).select(*df.columns, name)


def lag(df: DataFrame, index: str, columns: dict[str, str], block: int = BLOCK, most: int = MOST) -> DataFrame:
    """``df`` with each of ``columns`` (source -> name) of the row before in the order of ``index`` (as in ``prefix_sum``, may have gaps)."""
    rows = df.withColumn("__b", _block(index, block))
    keep = F.struct(F.col(index).alias("__i"), *[F.col(c) for c in columns])
    rows = rows.withColumn("__p", F.lag(keep).over(Window.partitionBy("__b").orderBy(index)))
    if most > block:
        last = df.groupBy(_block(index, block).alias("__x")).agg(F.max_by(keep, index).alias("__l"))
        carried = lag(last, "__x", {"__l": "__c"}, block, -(-most // block)).select(F.col("__x").alias("__b"), "__c")
        rows = rows.join(carried, "__b").withColumn("__p", F.coalesce("__p", "__c"))
    return rows.select(*df.columns, *[F.col("__p")[c].alias(name) for c, name in columns.items()])


def number_within(df: DataFrame, group: str, index: str, order: tuple[str, ...], name: str, most: int, block: int = BLOCK) -> DataFrame:
    """``df`` with ``name``: the 0-based number of each row in its group, by ``index`` and then ``order``.

    A group whose index may have more than a block's values is numbered by blocks of it, so that a group of
    very many rows is no task of its own.
    """
    if most <= block:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(index, *order)).cast("long") - 1)
    rows = df.withColumn("__b", _block(index, block))
    counts = rows.groupBy(group, "__b").agg(F.count("*").alias("__n"))
    before = prefix_sum(counts.withColumnRenamed("__b", "__x"), "__x", "__n", "__v", block, -(-most // block), (group,))
    before = before.select(group, F.col("__x").alias("__b"), (F.col("__v") - F.col("__n")).alias("__o"))
    inside = F.row_number().over(Window.partitionBy(group, "__b").orderBy(index, *order)).cast("long") - 1
    return rows.withColumn(name, inside).join(before, [group, "__b"]).withColumn(name, F.col(name) + F.col("__o")).select(*df.columns, name)


def explode_ranges(df: DataFrame, start: str, end: str, name: str, block: int = BLOCK) -> DataFrame:
    """One row for each number from ``start`` to below ``end``, as ``name``; none for an empty range.

    Ranges are cut into blocks, which are dealt out anew: a long range is neither one array nor one task.
    """
    blocks = df.where(F.col(end) > F.col(start)).withColumn("__b", F.explode(F.sequence(_block(start, block), F.floor((F.col(end) - 1) / block).cast("long"))))
    low, high = F.greatest(start, F.col("__b") * block), F.least(end, (F.col("__b") + 1) * block)
    return blocks.repartition("__b", start).withColumn(name, F.explode(F.sequence(low, high - 1))).drop("__b")


def number_lines(lines: DataFrame, name: str = "idx") -> DataFrame:
    """``lines`` of ``spark.read.text`` (rows may be filtered) with their 0-based number, by file path and place.

    A file may be read in pieces and pieces of several files in one partition; each piece's rows have
    consecutive ids. One row a piece comes to the driver, which lists the pieces to plan the scan anyway.
    """
    rows = lines.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__s")).withColumn("__m", F.monotonically_increasing_id())
    pieces = rows.groupBy("__f", "__s").agg(F.count("*").alias("n"), F.min("__m").alias("m")).collect()
    starts, total = [], 0
    for f, s, n, m in sorted(pieces, key=lambda p: (p[0], p[1])):
        starts.append((f, s, total - m))
        total += n
    of = lines.sparkSession.createDataFrame(starts, "__f string, __s long, __o long")
    return rows.join(F.broadcast(of) if len(starts) <= 100_000 else of, ["__f", "__s"]).select(*lines.columns, (F.col("__m") + F.col("__o")).alias(name))
