"""Shared helpers of the text operators: table access, Arrow chunks, samples, tables in between."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint, delete, scratch  # noqa: F401

#: Bytes of text that one numpy step handles at a time (a longer text is a step of its own).
CHUNK_BYTES = 1 << 20
#: Values of a column whose rates are broadcast, and narrow rows of a table that is.
VALUES, ROWS = 10_000, 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Give freed memory back, at the end of a task: a worker lives on, and other stages need the room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def chunks(batches, size: int = CHUNK_BYTES, column: int = 1, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches of at most ``rows`` rows whose text column holds about ``size`` bytes, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(_lengths(batch.column(column)))
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + size, side="right"))))
            yield batch.slice(at, to - at)
            at = to
    trim()


def _lengths(column: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one after another, and the rows' n+1 offsets (null: empty)."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def held_out(doc_id: str, modulus: int, remainder: int):
    """crc32 of the id's decimal text leaves ``remainder`` (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def bounded_sample(df: DataFrame, key: str, by: str, most: int, text: str | None = None, total: int | None = None) -> DataFrame:
    """About ``most`` rows of ``df`` for each value of ``by``; rows of one key and text count as one.

    The rows are picked by a hash of ``key`` (and of ``text``), evenly from all values of ``by``; only these
    columns are read to find the rates. At most 1.2 times as many rows as asked for come out, and at most ``total``.
    """
    sizes = df.groupBy(by).count().select(F.col(by).alias("__by"), F.least(F.lit(1.0), F.lit(most) / F.col("count")).alias("__rate"))
    found = sizes.limit(VALUES + 1).collect()
    values = len(found)
    if values > VALUES:
        values = sizes.count()
    else:
        sizes = F.broadcast(df.sparkSession.createDataFrame(found, sizes.schema))
    draw = F.pmod(F.xxhash64(F.col(key), F.xxhash64(text) if text else F.lit(0), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = df.withColumn("__draw", draw).join(sizes, F.col(by).eqNullSafe(F.col("__by"))).where("__draw < __rate")
    # equal rows have equal draws and may be very many; the limit goes by the place in the value's own quota
    some = some.dropDuplicates([by, "__draw"]).withColumn("__place", F.col("__draw") / F.col("__rate"))
    return some.orderBy("__place", by, "__draw").limit(min(total or 1 << 30, int(1.2 * most * values) + 1)).drop("__by", "__rate", "__draw", "__place")


def broadcast_if_few(rows: DataFrame, most: int = ROWS) -> DataFrame:
    """For a join: ``rows``, which are narrow, broadcast if they are at most ``most``, so that the other side stays where it is."""
    return F.broadcast(rows) if rows.count() <= most else rows


_scopes: list[list[str]] = []


@contextmanager
def tables_until_done(spark: SparkSession):
    """Tables that ``written`` makes inside go at the end, except where its caller takes them from the list."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder and read again, so that nothing computes it twice.

    It goes at the end of ``tables_until_done``, or with the driver's program.
    """
    path = scratch(df.sparkSession)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
