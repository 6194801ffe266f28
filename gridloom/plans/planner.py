"""Options of a run, and the plan of a product for them."""

from __future__ import annotations

import statistics
import time
from dataclasses import dataclass, fields
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assign, formats, kernels, partition, stats, vector
from ..operators.matrix import SparseMatrix
from ..sources.mtx import read_mtx


@dataclass
class Options:
    """``key=value`` options; those without default are required."""

    matrix: str
    num_blocks: int
    threads_per_block: int
    targeted_cache_size_kb: int
    storage_format: str = "CSR"
    partition_type: str = "1D_row_wise"
    partition_method: str = "recursive_bipartition"
    ordering_type: str = "none"
    steal_treshold: int = 1
    run_count_warm_up: int = 10
    run_count_measure: int = 100
    simd_length: int = 8

    CHOICES: ClassVar[dict[str, tuple[str, ...]]] = {
        "storage_format": ("CSR", "JDS", "HYBRID_JDS_CSR"),
        "partition_type": ("1D_row_wise", "1D_column_wise", "2D_checker_board"),
        "partition_method": ("regular", "recursive_bipartition"),
        "ordering_type": ("none", "column_net", "row_net"),
    }

    @classmethod
    def parse(cls, words: list[str]) -> Options:
        kinds = {f.name: f.type for f in fields(cls)}
        given: dict[str, object] = {}
        for word in words:
            key, eq, value = word.partition("=")
            if not eq or key not in kinds:
                raise ValueError(f"unknown option {word!r}; options: {', '.join(kinds)}")
            if key in cls.CHOICES and value not in cls.CHOICES[key]:
                raise ValueError(f"{key} is one of {', '.join(cls.CHOICES[key])}")
            given[key] = int(float(value)) if kinds[key] == "int" else value
        if missing := [k for k in ("matrix", "num_blocks", "threads_per_block", "targeted_cache_size_kb") if not given.get(k)]:
            raise ValueError(f"required: {', '.join(missing)}")
        out = cls(**given)  # type: ignore[arg-type]
        if min(out.num_blocks, out.threads_per_block, out.targeted_cache_size_kb, out.simd_length) < 1:
            raise ValueError("counts and sizes are above 0")
        if out.partition_type != "1D_row_wise":
            raise ValueError(f"no product for partition_type={out.partition_type}")
        return out

    @property
    def workers(self) -> int:
        return self.num_blocks * self.threads_per_block


@dataclass
class Prepared:
    """A matrix with its parts, ready for products; orders lead from old to new rows and columns if it was reordered."""

    matrix: SparseMatrix
    partition: DataFrame
    parts: DataFrame
    options: Options
    order: DataFrame | None = None
    regions: DataFrame | None = None
    col_order: DataFrame | None = None

    def product(self, x: DataFrame) -> DataFrame:
        """(i, y) in the rows' original order; ``x`` is in the columns' original order."""
        if self.col_order is not None:
            x = vector.scatter(x, self.col_order)
        if self.options.storage_format == "HYBRID_JDS_CSR":
            y = kernels.spmv_hybrid(self.matrix, self.regions, x)
        elif self.options.storage_format == "JDS":
            y = kernels.spmv_jds(self.matrix, self.parts, x)
        else:
            y = kernels.spmv(self.matrix, x)
        if self.order is not None:
            y = y.join(self.order.select(F.col("new_idx").alias("i"), "idx"), "i").select(F.col("idx").alias("i"), "y")
        return y


def cut(m: SparseMatrix, o: Options) -> DataFrame:
    """The partition by the method of the options."""
    if o.partition_method == "regular":
        return partition.linear(m, o.targeted_cache_size_kb, o.simd_length)
    return partition.leaves(partition.bipartition(m, o.targeted_cache_size_kb))


def prepare(m: SparseMatrix, o: Options) -> Prepared:
    """Order by a hypergraph model if asked to, cut into parts, and keep the entries where products find them."""
    order = col_order = None
    if o.ordering_type != "none":
        k = max(2, o.workers)
        if o.ordering_type == "column_net":
            order = partition.order_from_part_vector(partition.hypergraph(m, k), k, max(1, m.n_rows)).persist()
        else:
            col_order = partition.order_from_part_vector(partition.hypergraph(m.transpose(), k), k, max(1, m.n_cols)).persist()
        m = m.reorder(order, col_order)
    m = m.with_entries(m.entries.persist())
    found = cut(m, o).persist()
    parts = partition.part_of_rows(m, found).persist()
    regions = formats.hybrid_jds(m, parts).persist() if o.storage_format == "HYBRID_JDS_CSR" else None
    return Prepared(m, found, parts, o, order, regions, col_order)


#: Ways to deal parts to workers.
WAYS = ("block", "scatter", "split", "tree", "tree_scatter", "power_of_2")


def assign_parts(found: DataFrame, workers: int, how: str = "block", tree: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """A partition (part, row_start, row_end) with ``worker``, by one of ``WAYS``.

    ``block``: contiguous; ``scatter``: round robin; ``split``: by halves. ``tree``: the parts are the leaves of
    ``tree``, and each worker gets a subtree; ``tree_scatter``: the subtrees' leaves, each subtree's dealt round
    robin from its own worker on. ``power_of_2``: ``blocks`` groups of workers get counts of parts by halving,
    and deal theirs round robin inside of the group.
    """
    if how in ("tree", "tree_scatter"):
        top = sorted((r.row_start, r.worker) for r in assign.tree(tree, workers).collect())  # one row a worker
        k = F.size(F.filter(F.array(*[F.lit(s) for s, _ in top]), lambda s: s <= F.col("row_start")))
        at = found.withColumn("worker", F.get(F.array(*[F.lit(w) for _, w in top]), k - 1))
        if how == "tree":
            return at
        first = at.groupBy("worker").agg(F.min("part").alias("p"))
        return at.join(F.broadcast(first), "worker").withColumn("worker", F.pmod(F.col("worker") + F.col("part") - F.col("p"), F.lit(workers)).cast("int")).select(*found.columns, "worker")
    pos, n = F.col("part"), found.count()
    if how == "power_of_2":
        blocks = blocks or workers
        each, counts = max(1, workers // blocks), partition.part_counts_power_of_2(blocks, n)
        ends = [sum(counts[: k + 1]) for k in range(blocks)]
        block = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= pos))
        start = F.get(F.array(*map(F.lit, [0, *ends])), block)
        return found.withColumn("worker", (block * each + F.pmod(pos - start, F.lit(each))).cast("int"))
    worker = {"block": lambda: assign.decompose(pos, n, workers), "scatter": lambda: assign.scatter(pos, workers), "split": lambda: assign.split(pos, n, workers)}[how]()
    return found.withColumn("worker", worker)


def run_by_worker(m: SparseMatrix, assigned: DataFrame, x: DataFrame, workers: int) -> DataFrame:
    """(worker, i, y) of all rows that are not empty, each computed in its worker's own partition.

    Spark's scheduler balances tasks as they run, so this is for plans that pin parts: entries go to the
    partition of their worker once, and are summed there without another shuffle.
    """
    rows = partition.part_of_rows(m, assigned).join(assigned.select("part", "worker"), "part").select("i", "worker")
    pinned = m.entries.join(rows, "i").repartition(workers, "worker")
    return kernels.with_x(pinned, x, m.n_cols).groupBy("worker", "i").agg(F.sum(F.col("val") * F.col("v")).alias("y"))


def measure(p: Prepared, x: DataFrame) -> list[float]:
    """Seconds of each measured run, after the warm-up runs."""
    took = []
    for _ in range(p.options.run_count_warm_up + p.options.run_count_measure):
        began = time.perf_counter()
        p.product(x).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return took[p.options.run_count_warm_up :]


def report(spark: SparkSession, o: Options) -> str:
    """One line: name;rows;columns;nnz;minr;avgr;maxr;minc;avgc;maxc;cache_size_KB;parts;parts_ordered;seconds."""
    m, _ = read_mtx(spark, o.matrix, coefficients="row")
    plain = cut(m, o).count()
    p = prepare(m, o)
    s = stats.nnz_stats(m).first()
    seconds = statistics.median(measure(p, kernels.ramp(m))) if o.run_count_measure else 0.0
    name = o.matrix.rstrip("/").rpartition("/")[2].removesuffix(".mtx")
    return ";".join(map(str, [name, m.n_rows, m.n_cols, m.entries.count(), s.minr, round(s.avgr, 3), s.maxr, s.minc, round(s.avgc, 3), s.maxc, o.targeted_cache_size_kb, plain, p.partition.count(), round(seconds, 6)]))
