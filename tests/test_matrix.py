"""Small cases: files, formats, cuts, partitions and scans against plain models."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import scan
from gridloom.operators import assign, formats, kernels, partition, vector
from gridloom.operators.matrix import SparseMatrix
from gridloom.sources import mtx


def matrix(spark, entries, n_rows, n_cols):
    return SparseMatrix(spark.createDataFrame(entries, "i long, j long, val double"), n_rows, n_cols)


def rows_of(spark, lengths, n_cols):
    return matrix(spark, [(i, j, float(1 + (i + j) % 5)) for i, n in enumerate(lengths) for j in range(n)], len(lengths), n_cols)


def one_part(m):
    return m.rows().select("i", F.lit(0).alias("part"))


CUTS = [
    ([7, 6, 4, 4, 4, 3, 2, 0], 118, (4, 2, 25, 5), (4, 2, 13)),
    ([5, 5, 5, 4, 4, 3, 3], 118, (5, 0, 29, 0), (5, 0, 0)),
    ([10, 9, 8, 7, 6, 5, 4, 3, 2, 1], 10, (10, 0, 55, 0), (0, 10, 55)),
    ([3, 2, 2, 2, 2, 1, 1, 1, 1, 0], 10, (3, 0, 15, 0), (2, 1, 3)),
    ([9, 7, 1, 0, 0, 0, 0, 0, 0, 0], 10, (1, 2, 3, 14), (0, 3, 17)),
    ([9, 6, 3, 0, 0, 0, 0, 0, 0, 0], 10, (0, 3, 0, 18), (0, 3, 18)),
    ([8, 5, 0, 0, 0, 0, 0, 0, 0, 0], 10, (0, 2, 0, 13), (0, 2, 13)),
    ([2, 2, 2, 2, 1, 1, 1, 1, 1, 1], 10, (2, 0, 14, 0), (2, 0, 0)),
    ([8, 5, 3, 2, 2, 2, 1, 1, 1, 0], 10, (3, 2, 18, 7), (2, 3, 16)),
]


@pytest.mark.parametrize("lengths, n_cols, jds, csr", CUTS)
def test_hybrid_cuts(spark, lengths, n_cols, jds, csr):
    m = rows_of(spark, lengths, n_cols)
    parts = one_part(m)
    r = formats.cut_jds(m, parts).first()
    regions = {x.region: x["count"] for x in formats.hybrid_jds(m, parts).groupBy("region").count().collect()}
    assert (r.opt_col, r.opt_row, regions.get("JDS", 0), regions.get("CSR", 0)) == jds
    r = formats.cut_csr(m, parts).first()
    regions = {x.region: x["count"] for x in formats.hybrid_csr(m, parts).groupBy("region").count().collect()}
    assert (r.opt_col, r.opt_row, regions.get("CSR", 0)) == csr


def test_all_products_agree_with_empty_rows_and_repeated_entries(spark):
    rng = random.Random(3)
    e = [(rng.choice([0, 1, 1, 4, 6]), rng.randrange(5), float(rng.randrange(-3, 9))) for _ in range(40)]
    m = matrix(spark, e, 9, 5)
    x, parts = kernels.ramp(m), m.rows().select("i", F.floor(F.col("i") / 4).alias("part"))
    want = [(i, float(sum(v * (j % 10) for a, j, v in e if a == i))) for i in range(9)]
    forms = [kernels.spmv(m, x), kernels.spmv_csc(m, x), kernels.spmv_icsr(m, x), kernels.spmv_jds(m, parts, x), kernels.spmv_hybrid(m, formats.hybrid_jds(m, parts), x), kernels.spmv_hybrid(m, formats.hybrid_csr(m, parts), x), kernels.spmv_packed(m, kernels.pack(m, 2), x, 2), kernels.spmv_t(m.transpose(), x)]
    for y in forms:
        assert sorted(map(tuple, y.collect())) == want


def test_products_of_an_empty_matrix(spark):
    m = matrix(spark, [], 3, 4)
    for y in (kernels.spmv(m, kernels.ramp(m)), kernels.spmv_icsr(m, kernels.ramp(m)), kernels.spmv_packed(m, kernels.pack(m), kernels.ramp(m))):
        assert sorted(map(tuple, y.collect())) == [(0, 0.0), (1, 0.0), (2, 0.0)]


def test_scans_over_small_blocks(spark):
    values = [random.Random(1).randrange(9) for _ in range(50)]
    df = spark.createDataFrame([(i * 3, v) for i, v in enumerate(values)], "at long, v long").repartition(5)
    got = sorted(map(tuple, scan.prefix_sum(df, "at", "v", "s", block=7).collect()))
    assert got == [(i * 3, v, sum(values[: i + 1])) for i, v in enumerate(values)]
    got = sorted((r.at, r.p) for r in scan.lag(df, "at", {"v": "p"}, block=7).collect())
    assert got == [(i * 3, values[i - 1] if i else None) for i in range(50)]


def linear_model(nnz, target, step, threshold):
    ptr = [0]
    for n in nnz:
        ptr.append(ptr[-1] + n)
    n, prev, cur, parts = len(nnz), 0, 0, []
    while cur < n - step:
        if 12 * (ptr[cur] - ptr[prev] + cur - prev) / 1024 > target:
            if cur - prev > threshold:
                cur -= step
            parts.append([prev, cur])
            prev = cur
        cur += step
    cur -= step
    if cur < n:
        if cur >= threshold or not parts:
            parts.append([prev, n])
        else:
            parts[-1][1] = n
    return [tuple(p) for p in parts]


def bipartition_model(nnz, target, s, e):
    w = lambda a, b: 12 * (sum(nnz[a:b]) + b - a)
    if w(s, e) <= target * 1024 or e - s < 2:
        return [(s, e)]
    mid, low, high = s, 0, w(s, e)
    before = (low, high)
    while high > low and e - mid > 1:
        before = (low, high)
        mid += 1
        low, high = w(s, mid), w(mid, e)
    if abs(before[0] - before[1]) < abs(low - high):
        mid -= 1
    return bipartition_model(nnz, target, s, mid) + bipartition_model(nnz, target, mid, e)


@pytest.mark.parametrize("seed", [1, 2])
def test_partitions_equal_plain_models(spark, seed):
    rng = random.Random(seed)
    nnz = [rng.choice([0, 1, 2, 5, 30]) for _ in range(97)]
    m = rows_of(spark, nnz, 40)
    for target, step in ((0.7, 4), (2.0, 8), (50.0, 8), (0.05, 4)):
        got = [(r.row_start, r.row_end) for r in partition.linear(m, target, step).orderBy("row_start", "row_end").collect()]
        assert got == linear_model(nnz, target, step, step)
    got = sorted((r.row_start, r.row_end) for r in partition.leaves(partition.bipartition(m, 1.0)).collect())
    assert got == bipartition_model(nnz, 1.0, 0, len(nnz))


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 60), st.integers(1, 9))
def test_split_halves_items_and_workers(n, workers):
    def model(items, k):
        if k == 1:
            return [items]
        half = len(items) - len(items) // 2
        return model(items[:half], k - k // 2) + model(items[half:], k // 2)

    assert assign.split_sizes(n, workers) == [len(x) for x in model(list(range(n)), workers)]
    assert sum(partition.part_counts_power_of_2(workers, n)) == n


def write(path, text):
    path.write_text(text)
    return f"file://{path}"


@pytest.mark.parametrize(
    "banner, body, entries",
    [
        ("real general", "2 3 2\n1 1 1.5\n2 3 -2\n", [(0, 0, 1.5), (1, 2, -2.0)]),
        ("REAL Symmetric", "3 3 3\n1 1 4\n2 1 5\n3 2 6\n", [(0, 0, 4.0), (0, 1, 5.0), (1, 0, 5.0), (1, 2, 6.0), (2, 1, 6.0)]),
        ("integer skew-symmetric", "2 2 1\n2 1 3\n", [(0, 1, -3.0), (1, 0, 3.0)]),
        ("pattern general", "% note\n\n2 2 3\n1 1\n1 2\n2 2\n", [(0, 0, 1.0), (0, 1, 1.0), (1, 1, 1.0)]),
        ("real general", "3 3 1\n3 3 1\n", [(2, 2, 1.0)]),
        ("real general", "2 2 0\n", []),
    ],
)
def test_matrix_market_files(spark, tmp_path, banner, body, entries):
    m, head = mtx.read_mtx(spark, write(tmp_path / "a.mtx", f"%%MatrixMarket matrix coordinate {banner}\n% comment\n{body}"))
    assert sorted((r.i, r.j, r.val) for r in m.entries.collect()) == entries
    mtx.write_mtx(m, f"file://{tmp_path}/out")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    again, _ = mtx.read_mtx(spark, write(tmp_path / "b.mtx", lines))
    assert sorted(map(tuple, again.entries.collect())) == entries and (again.n_rows, again.n_cols) == (m.n_rows, m.n_cols)


def test_complex_and_weighted_patterns(spark, tmp_path):
    m, _ = mtx.read_mtx(spark, write(tmp_path / "c.mtx", "%%MatrixMarket matrix coordinate complex hermitian\n2 2 1\n2 1 1 2\n"))
    assert sorted(map(tuple, m.entries.select("i", "j", "val", "im").collect())) == [(0, 1, 1.0, -2.0), (1, 0, 1.0, 2.0)]
    m, _ = mtx.read_mtx(spark, write(tmp_path / "p.mtx", "%%MatrixMarket matrix coordinate pattern general\n1 2 2\n1 1\n1 2\n"), coefficients="row")
    assert sorted(r.val for r in m.entries.collect()) == [0.5, 0.5]


@pytest.mark.parametrize("text", ["", "%%MatrixMarket matrix array real general\n2 2\n", "%%MatrixMarket matrix coordinate real hermitian\n1 1 0\n", "hello\n", "%%MatrixMarket matrix coordinate real general\n2 2\n"])
def test_bad_files_are_refused(spark, tmp_path, text):
    with pytest.raises(ValueError):
        mtx.read_mtx(spark, write(tmp_path / "bad.mtx", text))


def test_vectors_orders_and_parts_in_files(spark, tmp_path):
    v = mtx.read_vector(spark, write(tmp_path / "v", "3\n1.5\n2\n-1\n"))
    assert sorted(map(tuple, v.collect())) == [(0, 1.5), (1, 2.0), (2, -1.0)]
    mtx.write_vector(v, f"file://{tmp_path}/w")
    assert "".join(p.read_text() for p in sorted((tmp_path / "w").glob("part-*"))) == "3\n1.50\n2.00\n-1.00\n"
    rows, cols = mtx.read_order_lookup(spark, write(tmp_path / "o", "1\n0\n2\n0\n1\n"), 3)
    assert sorted(map(tuple, rows.collect())) == [(0, 1), (1, 0), (2, 2)] and cols.count() == 2
    assert sorted(map(tuple, mtx.read_dimensions(spark, write(tmp_path / "d", "2\n4\n3\n")).collect())) == [(0, 0, 4), (1, 4, 7)]
    write(tmp_path / "m.stats", "2\n")
    write(tmp_path / "m.partVector", "1\n0\n1\n")
    m, parts = mtx.load_power_of_2_order(spark, matrix(spark, [(0, 0, 1.0), (1, 0, 2.0), (2, 0, 3.0)], 3, 1), f"file://{tmp_path}/m")
    assert sorted((r.i, r.val) for r in m.entries.collect()) == [(0, 2.0), (1, 1.0), (2, 3.0)]
    mtx.write_parts(m, parts, f"file://{tmp_path}/parts")
    assert sorted(p.name for p in (tmp_path / "parts").glob("part=*")) == ["part=0", "part=1"]
    one, head = mtx.read_mtx(spark, f"file://{tmp_path}/parts/part=1")
    assert sorted(map(tuple, one.entries.collect())) == [(0, 0, 1.0), (1, 0, 3.0)] and (head.n_rows, head.n_cols, head.nnz) == (2, 1, 2)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_folders_of_parts_are_read_in_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    values = [round(rng.uniform(-9, 9), 2) for _ in range(300)]
    lines, folder = [str(len(values)), *map(str, values)], tmp_path / "v"
    folder.mkdir()
    # parts of unequal size, the larger ones not first, some empty
    cuts = sorted(rng.randrange(len(lines)) for _ in range(7))
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(lines)])):
        (folder / f"part-{k:05}.txt").write_text("".join(x + "\n" for x in lines[a:b]))
    assert [r.v for r in mtx.read_vector(spark, f"file://{folder}").orderBy("idx").collect()] == values
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        assert [r.v for r in mtx.read_vector(spark, f"file://{folder}").orderBy("idx").collect()] == values
        mtx.write_vector(spark.createDataFrame(list(enumerate(values)), "idx long, v double").repartition(5), f"file://{tmp_path}/w")
        assert [r.v for r in mtx.read_vector(spark, f"file://{tmp_path}/w").orderBy("idx").collect()] == values
        entries = [(rng.randrange(40), rng.randrange(30), round(rng.uniform(0, 5), 3)) for _ in range(200)]
        mtx.write_mtx(matrix(spark, entries, 40, 30), f"file://{tmp_path}/m")
        again, head = mtx.read_mtx(spark, f"file://{tmp_path}/m")
        assert sorted(map(tuple, again.entries.collect())) == sorted(entries) and head.nnz == 200
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_dense_files(spark, tmp_path):
    m, head = mtx.read_dense(spark, write(tmp_path / "d.mtx", "%%MatrixMarket matrix array real general\n% note\n2 3\n1\n0\n3\n4\n0\n6.5\n"))
    assert sorted(map(tuple, m.entries.collect())) == [(0, 0, 1.0), (0, 1, 3.0), (1, 1, 4.0), (1, 2, 6.5)] and (m.n_rows, m.n_cols) == (2, 3)


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_of_parts_with_empty_ones(spark, seed):
    rng = random.Random(seed)
    bounds = sorted([0, 50, *(rng.choice([0, 7, 7, 20, 33, 50]) for _ in range(6))])
    parts = [(k, a, b) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    m = matrix(spark, [(0, 0, 1.0)], 50, 1)
    got = sorted((r.i, r.part) for r in partition.part_of_rows(m, spark.createDataFrame(parts, "part int, row_start long, row_end long")).collect())
    assert got == [(i, k) for k, a, b in parts for i in range(a, b)]


def test_kway_files(spark, tmp_path):
    for what, text in (("vertexOrder", "3\n2\n0\n1\n"), ("netOrder", "2\n1\n0\n"), ("vertexDimension", "2\n1\n2\n"), ("netDimension", "2\n1\n1\n")):
        write(tmp_path / f"m_{what}_4K", text)
    m, rows, cols = mtx.load_kway_order(spark, matrix(spark, [(0, 0, 5.0), (2, 1, 7.0)], 3, 2), f"file://{tmp_path}", "m", 4)
    assert sorted(map(tuple, m.entries.collect())) == [(1, 0, 7.0), (2, 1, 5.0)]
    assert sorted(map(tuple, rows.collect())) == [(0, 0, 1), (1, 1, 3)] and sorted(map(tuple, cols.collect())) == [(0, 0, 1), (1, 1, 2)]


def test_orderings_invert(spark):
    m = matrix(spark, [(0, 0, 1.0)], 7, 1)
    v = m.rows("idx").select("idx", (F.col("idx") * 2.0).alias("v"))
    order = partition.order_from_part_vector(m.rows().select("i", (F.col("i") % 3).cast("int").alias("part")), 3)
    assert sorted(map(tuple, vector.gather(vector.scatter(v, order), order).collect())) == sorted(map(tuple, v.collect()))


@pytest.mark.parametrize("form", ["CSR", "JDS", "HYBRID_JDS_CSR"])
@pytest.mark.parametrize("order, method", [("none", "regular"), ("column_net", "recursive_bipartition"), ("row_net", "recursive_bipartition")])
def test_planned_products_agree(spark, tmp_path, form, order, method):
    from gridloom.plans.planner import Options, prepare, report

    rng = random.Random(8)
    m = rows_of(spark, [rng.choice([0, 1, 3, 12]) for _ in range(60)], 12)
    o = Options.parse(["matrix=m", "num_blocks=2", "threads_per_block=1", "targeted_cache_size_kb=1", f"storage_format={form}", f"ordering_type={order}", f"partition_method={method}", "run_count_warm_up=0", "run_count_measure=1"])
    want = sorted(map(tuple, kernels.spmv(m, kernels.ramp(m)).collect()))
    assert sorted(map(tuple, prepare(m, o).product(kernels.ramp(m)).collect())) == want
    if form == "CSR" and order == "none":
        o.matrix = write(tmp_path / "m.mtx", "%%MatrixMarket matrix coordinate real general\n2 2 2\n1 1 1\n2 2 1\n")
        assert report(spark, o).startswith("m;2;2;2;1;1.0;1;1;1.0;1;1;1;1;")


@pytest.mark.parametrize("words", [[], ["matrix=a"], ["matrix=a", "num_blocks=1", "threads_per_block=1", "targeted_cache_size_kb=64", "storage_format=CSC"], ["what=1"], ["matrix=a", "num_blocks=1", "threads_per_block=1", "targeted_cache_size_kb=64", "partition_type=2D_checker_board"]])
def test_wrong_options_are_refused(words):
    from gridloom.plans.planner import Options

    with pytest.raises(ValueError):
        Options.parse(words)
