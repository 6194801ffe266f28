"""Queries that go over whole matrices give as many rows as these have, by plans without a task for all of them."""

import re
from dataclasses import replace

import numpy as np
import pytest
from helpers import DATA, skewed
from pyspark.sql import functions as F

from gridloom.functions import scan
from gridloom.operators import blocks, formats, kernels, partition, solvers
from gridloom.operators.matrix import Gram, SparseMatrix
from gridloom.plans import catalog, tables


def test_queries_have_all_entries(spark):
    n = tables.ps(spark, DATA).entries.count()
    for name in ("icsr_encode", "icsr_decode", "jds_entries", "hybrid_regions_jds", "hybrid_regions_csr"):
        assert catalog.QUERIES[name](spark, DATA).count() == n


def test_dense_rows_has_all_rows(spark):
    m = tables.cn(spark, DATA)
    rows = catalog.QUERIES["dense_rows"](spark, DATA).collect()
    assert len(rows) == m.n_rows and all(r.line.count("1") == 1 and len(r.line.split()) == m.n_cols for r in rows)


def test_both_regions_of_a_skewed_matrix(spark):
    m = skewed(spark)
    parts = m.rows().select("i", F.floor(F.col("i") / 100).alias("part"))
    for regions in (formats.hybrid_jds(m, parts), formats.hybrid_csr(m, parts)):
        assert {r.region for r in regions.select("region").distinct().collect()} == {"JDS", "CSR"}
        assert sorted(map(tuple, kernels.spmv_hybrid(m, regions, kernels.ramp(m)).collect())) == sorted(map(tuple, kernels.spmv(m, kernels.ramp(m)).collect()))


@pytest.mark.parametrize("name", ["csr_rowptr", "csr_entries", "jds_idiag", "icsr_encode", "icsr_decode", "tree_leaves", "order_blocks", "part_from_vector", "order_from_vector", "pattern_coefficients", "part_rows", "part_linear"])
def test_no_window_or_nested_loop_over_all_rows(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    # a window lists its partition first; one without has an order only
    for spec in re.findall(r"windowspecdefinition\(([^,]*),", plan):
        assert "ASC" not in spec and "DESC" not in spec and "specifiedwindowframe" not in spec
    if name != "part_linear":
        assert "SinglePartition" not in plan


def test_ranges_give_their_numbers(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 0, 5), (3, 5, 5), (4, 5, 23), (5, 23, 24)], "k int, s long, e long")
    got = sorted((r.x, r.k) for r in scan.explode_ranges(df, "s", "e", "x", block=4).collect())
    assert got == [(x, 2) for x in range(5)] + [(x, 4) for x in range(5, 23)] + [(23, 5)]


def test_numbers_within_groups_by_blocks(spark):
    rows = [(i % 3, j, float(k)) for i in range(3) for j in range(0, 50, i + 1) for k in range(2)]
    df = spark.createDataFrame(rows, "i long, j long, val double").repartition(4)
    for block in (7, 100):
        got = sorted((r.i, r.k, r.j, r.val) for r in scan.number_within(df, "i", "j", ("val",), "k", 50, block).collect())
        want = [(i, k, j, v) for i in range(3) for k, (j, v) in enumerate(sorted((j, v) for a, j, v in rows if a == i))]
        assert got == want


@pytest.mark.parametrize("block", [5, 16, 1 << 16])
def test_trees_of_long_ranges(spark, block):
    m = skewed(spark)
    want = sorted(map(tuple, partition.bipartition(m, 0.2).select("node_id", "level", "row_start", "row_end", "is_leaf").collect()))
    got = partition.bipartition(m, 0.2, block=block).select("node_id", "level", "row_start", "row_end", "is_leaf")
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


@pytest.mark.parametrize("solve", [solvers.cg, solvers.pcg])
@pytest.mark.parametrize("broadcast", [kernels.BROADCAST, 1])
def test_solvers_go_through_the_factor(spark, monkeypatch, solve, broadcast):
    # the product itself, an entry for each pair that meets in a row, is never formed
    monkeypatch.setattr(kernels, "BROADCAST", broadcast)
    monkeypatch.setattr(solvers, "BROADCAST", broadcast)
    m = tables.ss(spark, DATA)
    x0, b = solvers.start_vectors(m)
    plain = SparseMatrix(m.entries, m.n_rows, m.n_cols)
    want = {r.idx: r.v for r in solve(plain, b, x0, stop=0.0, most=2).x.collect()}
    never = m.entries.withColumn("val", F.raise_error(F.concat(F.lit("formed "), F.col("i"))).cast("double"))
    assert isinstance(m, Gram)
    got = {r.idx: r.v for r in solve(replace(m, entries=never), b, x0, stop=0.0, most=2).x.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("turned", [False, True])
def test_nets_are_as_by_joins(spark, monkeypatch, turned):
    m = skewed(spark).transpose() if turned else skewed(spark)
    now = m.rows().select("i", F.pmod(F.xxhash64("i"), F.lit(3)).cast("int").alias("part")).join(formats.row_nnz(m).withColumnRenamed("nnz", "w"), "i")
    found = []
    for bound in (partition.DENSE, 3 * m.n_rows, 0):
        monkeypatch.setattr(partition, "DENSE", bound)
        nets = partition.Nets(m, 3)
        assert nets.packed == bool(bound)
        cutsize, held = nets.held(now)
        want = nets.wants(now, held)
        found.append((cutsize, sorted(map(tuple, want.select("i", "w", "own", "to", "gain").collect())), sorted(map(tuple, nets.weights().collect()))))
        nets.close()
    assert found[0] == found[1] == found[2] and found[0][1] and found[0][0] == partition.cut_metrics(m, now.select("i", "part")).first().cutsize


def test_blocks_hold_all_entries_whatever_their_lengths(spark, monkeypatch):
    m = skewed(spark)
    for long in (blocks.LONG, 7):
        monkeypatch.setattr(blocks, "LONG", long)
        rows = blocks.row_blocks(m).collect()
        got = [(int(i), int(j), float(v)) for r in rows for i, a, z in _lines(r) for j, v in zip(np.frombuffer(r.j, np.int32)[a:z], np.frombuffer(r.val)[a:z])]
        assert sorted(got) == sorted(map(tuple, m.entries.collect())) and all(r.b == i // blocks.ROWS for r in rows for i, _, _ in _lines(r))
        assert len({i for r in rows for i, _, _ in _lines(r)}) == sum(len(_lines(r)) for r in rows)


def _lines(r):
    at = np.frombuffer(r["at"], np.int64).tolist()
    return list(zip(np.frombuffer(r["i"], np.int64).tolist(), at, [*at[1:], len(r["val"]) // 8]))


def test_lookups_drop_entries_before_they_are_summed_or_sorted(spark):
    plan = catalog.QUERIES["coo_get"](spark, DATA)._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    lines = plan.splitlines()
    semi = [k for k, x in enumerate(lines) if "ShuffledHashJoin" in x and "LeftSemi" in x]
    # a plan's deeper lines are below
    assert len(semi) == 2 and semi[-1] > max(k for k, x in enumerate(lines) if "sum(l_quantity" in x)
    below = lines[semi[-1] :]
    assert not any(re.search(r"\bSort ", x) for x in below)


@pytest.mark.parametrize("block", [10, formats.BLOCK])
def test_encoding_of_long_and_short_rows(spark, block):
    m = skewed(spark)
    cols, rows = formats.icsr_encode_parts(m, block=block)
    got = formats.icsr_decode(cols, rows, m.n_rows, m.n_cols).entries
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, m.entries.collect()))
    assert sorted(r.t for r in cols.collect()) == list(range(m.entries.count()))


def test_encoding_shuffles_entries_once(spark):
    m = tables.op(spark, DATA)
    # more columns than a block has
    cols, _ = formats.icsr_encode(SparseMatrix(m.entries, m.n_rows, 1 << 20))
    plan = cols._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("l_orderkey") and plan.count("lineitem.parquet") == 1
