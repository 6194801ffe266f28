"""Work assignment: which worker gets which item. Items are numbered 0, 1, 2, ...; workers too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decompose(pos: Column, n: int, workers: int) -> Column:
    """Contiguous lists; the first n mod workers get one item more."""
    q, extra = divmod(n, workers)
    head = extra * (q + 1)
    rest = F.floor((pos - head) / max(q, 1)) + extra
    return F.when(pos < head, F.floor(pos / (q + 1))).otherwise(rest).cast("int")


def scatter(pos: Column, workers: int) -> Column:
    """Round robin."""
    return F.pmod(pos, F.lit(workers)).cast("int")


def split_sizes(n: int, workers: int) -> list[int]:
    """List lengths when items and workers are halved again and again, the left side getting the larger half."""
    if workers < 1:
        return []
    if workers == 1:
        return [n]
    left = workers - workers // 2
    return split_sizes(n - n // 2, left) + split_sizes(n // 2, workers // 2)


def split(pos: Column, n: int, workers: int) -> Column:
    """Recursive halving; one bound for each worker goes into the expression."""
    ends, total = [], 0
    for size in split_sizes(n, workers):
        total += size
        ends.append(F.lit(total))
    return F.size(F.filter(F.array(*ends), lambda e: e <= pos)).cast("int")


def tree(nodes: DataFrame, workers: int) -> DataFrame:
    """(worker, node_id, row_start, row_end): a subtree for each worker, the left side getting more; a leaf met early leaves workers idle."""
    at = nodes.where("node_id = 0").select("node_id", F.lit(0).alias("start"), F.lit(workers).alias("count"))
    done, edge = [], nodes.select("node_id", "is_leaf")
    for _ in range(max(1, workers).bit_length() + 1):
        here = at.join(edge, "node_id")
        stop = F.col("is_leaf") | (F.col("count") <= 1)
        done.append(here.where(stop).select("node_id", F.col("start").alias("worker")))
        more, left = here.where(~stop), F.ceil(F.col("count") / 2).cast("int")
        at = more.select((2 * F.col("node_id") + 1).alias("node_id"), "start", left.alias("count")).union(more.select(2 * F.col("node_id") + 2, F.col("start") + left, F.col("count") - left))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.join(nodes, "node_id").select("worker", "node_id", "row_start", "row_end")


def merge_adjacent(blocks: DataFrame) -> DataFrame:
    """(kind, row_start, row_end, merged): neighbours of one kind that touch become one block."""
    w = Window.partitionBy("kind").orderBy("row_start")
    new = F.coalesce(F.lag("row_end").over(w) != F.col("row_start"), F.lit(True)).cast("int")
    run = blocks.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("kind", "run").agg(F.min("row_start").alias("row_start"), F.max("row_end").alias("row_end"), F.count("*").alias("merged")).drop("run")
