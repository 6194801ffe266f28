"""Queries over the driver's tables, and SQL that gives the same rows.

Matrices are those of ``tables``. Values are integral, so that sums are exact in any order; quotients are
rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint, scratch
from ..operators import assign, formats, kernels, partition, solvers, stats, vector
from ..operators.matrix import SparseMatrix, compose
from ..sources import mtx
from . import planner, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Rows of a part in queries over parts; KB of a part in those that cut by size; workers; rows of a step.
SLICE, TARGET_KB, WORKERS, STEP = 100, 4.0, 7, 8

_N = "(select count(*) from part)"

_WITH = {
    "ps": "ps as (select l_partkey as i, l_suppkey as j, sum(l_quantity)::double as val from lineitem group by 1, 2)",
    "psr": "psr as (select p_partkey as i from part)",
    "op": "op as (select l_orderkey as i, l_partkey as j, l_quantity::double as val from lineitem)",
    "opr": "opr as (select o_orderkey as i from orders)",
    "cn": "cn as (select c_custkey as i, c_nationkey::bigint as j, 1.0::double as val from customer)",
    "ss": "ss as (select i, j, sum(val)::double as val from (select a.j as i, b.j as j, a.val * b.val as val from ps a join ps b on a.i = b.i union all select s_suppkey, s_suppkey, 1.0 from supplier) group by 1, 2)",
    "low": "low as (select * from ps where j <= i and i < (select count(*) from supplier))",
    # rows of the matrix with their entries, and what follows from the jagged order in parts
    "nz": f"nz as (select r.i, r.i // {SLICE} as part, count(e.j) as nnz from psr r left join ps e on e.i = r.i group by r.i)",
    "perm": "perm as (select part, row_number() over (partition by part order by nnz desc, i) - 1 as r, i, nnz from nz)",
    "jds": "jds as (select p.part, row_number() over (partition by e.i order by e.j) - 1 as k, p.r, e.i, e.j, e.val from ps e join perm p on p.i = e.i)",
    "diag": "diag as (select part, k, count(*) as len from jds group by part, k)",
    "cutj": "cutj as (select part, k as opt_col, len as opt_row from (select *, row_number() over (partition by part order by k + len, k desc) as n from (select * from diag union all select part, max(k) + 1, 0 from diag group by part)) where n = 1)",
    "cutc": "cutc as (select part, nnz as opt_col, r as opt_row from (select *, row_number() over (partition by part order by r + nnz, r desc) as n from (select part, r, nnz from perm union all select part, max(r) + 1, 0 from perm group by part)) where n = 1)",
    "vec": "vec as (select p_partkey as idx, (p_partkey % 10)::double as a, (p_partkey % 7)::double as b from part)",
    "pv": "pv as (select p_partkey as i, (p_partkey * 7 + p_partkey // 3) % 5 as part from part)",
}
_NEEDS = {"ss": "ps", "low": "ps", "nz": "psr ps", "perm": "nz", "jds": "ps perm", "diag": "jds", "cutj": "diag", "cutc": "perm"}


def _sql(names: str, body: str, recursive: bool = False) -> str:
    order: list[str] = []

    def need(name: str) -> None:
        for n in _NEEDS.get(name, "").split():
            need(n)
        if name not in order:
            order.append(name)

    for n in names.split():
        need(n)
    return ("with recursive " if recursive else "with ") + ", ".join(_WITH[n] for n in order) + " " + body


def query(oracle: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def _parts(m: SparseMatrix) -> DataFrame:
    return m.rows().select("i", F.floor(F.col("i") / SLICE).alias("part"))


def _vector_parts(m: SparseMatrix) -> DataFrame:
    return m.rows().select("i", F.pmod(F.col("i") * 7 + F.floor(F.col("i") / 3), F.lit(5)).cast("int").alias("part"))


def _vec(m: SparseMatrix, k: int) -> DataFrame:
    return m.rows("idx").select("idx", (F.col("idx") % k).cast("double").alias("v"))


# --- entries


@query(_sql("ps", "select i, j, val from ps"))
def coo_load(spark, d):
    return tables.ps(spark, d).entries


@query(_sql("ps", "select j as i, i as j, val from ps"))
def coo_transpose(spark, d):
    return tables.ps(spark, d).transpose().entries


@query(_sql("low", "select i, j, val from low union all select j, i, val from low where i <> j"))
def coo_mirror_symmetric(spark, d):
    return tables.lower(spark, d).mirror().entries


@query(_sql("op", "select i, j, sum(val) as val from op group by i, j"))
def coo_combine(spark, d):
    return tables.op(spark, d).combine().entries


@query(_sql("ps psr", "select r.i, r.i % 10 as j, coalesce(e.val, 0.0)::double as val from psr r left join ps e on e.i = r.i and e.j = r.i % 10"))
def coo_get(spark, d):
    m = tables.ps(spark, d)
    points = m.rows().select("i", (F.col("i") % 10).alias("j"))
    return tables.ps(spark, d, points).get(points)


@query(_sql("ps", "select count(*) as nnz, count(*) = 0 as is_empty from ps where i >= 20 and i < 170 and j >= 2 and j < 9"))
def coo_submatrix_nnz(spark, d):
    return tables.ps(spark, d).sub(20, 2, 150, 7).entries.agg(F.count("*").alias("nnz")).withColumn("is_empty", F.col("nnz") == 0)


@query(_sql("ps", "select i // 64 as ti, j // 8 as tj, count(*) as nnz from ps group by 1, 2"))
def coo_tiles(spark, d):
    return tables.ps(spark, d).tiles(64, 8)


@query(_sql("cn", "select j as i, i as j, ((1.0::double / count(*) over (partition by j))::float)::double as val from cn"))
def pattern_coefficients(spark, d):
    return tables.cn(spark, d).transpose().pattern_coefficients().entries


@query(_sql("cn", "select i, j, ((1.0::double / count(*) over (partition by run))::float)::double as val from (select *, sum(new) over (order by j) as run from (select j as i, i as j, case when j = lag(j) over (order by i) then 0 else 1 end as new from cn))"))
def pattern_coefficients_by_run(spark, d):
    return tables.cn(spark, d).transpose().pattern_coefficients_by_run(F.col("j")).entries


@query(_sql("ps", "select i, j, (i + j) as k, val from ps order by i, j"))
def coo_sort(spark, d):
    return tables.ps(spark, d).sorted().select("i", "j", (F.col("i") + F.col("j")).alias("k"), "val")


# --- products


def _product(matrix: str, rows: str) -> str:
    return _sql(f"{matrix} {rows}", f"select r.i, coalesce(sum(e.val * (e.j % 10)), 0.0)::double as y from {rows} r left join {matrix} e on e.i = r.i group by r.i")


@query(_product("op", "opr"))
def spmv_coo(spark, d):
    m = tables.op(spark, d)
    return kernels.spmv(m, kernels.ramp(m))


@query(_product("ps", "psr"))
def spmv_csr(spark, d):
    m = tables.ps(spark, d)
    return kernels.spmv(m, kernels.ramp(m))


@query(_sql("ps psr", "select r.i, r.i % 7 + coalesce(sum(e.val * (e.j % 10)), 0.0)::double as y from psr r left join ps e on e.i = r.i group by r.i"))
def spmv_csr_add(spark, d):
    m = tables.ps(spark, d)
    return kernels.spmv_add(m, kernels.ramp(m), _vec(m, 7))


@query(_product("ps", "psr"))
def spmv_csc(spark, d):
    m = tables.ps(spark, d)
    return kernels.spmv_csc(m, kernels.ramp(m))


@query(_product("op", "opr"))
def spmv_icsr(spark, d):
    m = tables.op(spark, d)
    return kernels.spmv_icsr(m, kernels.ramp(m))


@query(_product("ps", "psr"))
def spmv_jds(spark, d):
    m = tables.ps(spark, d)
    return kernels.spmv_jds(m, _parts(m), kernels.ramp(m))


@query(_product("ps", "psr"))
def spmv_hybrid_jds(spark, d):
    m = tables.ps(spark, d)
    return kernels.spmv_hybrid(m, formats.hybrid_jds(m, _parts(m)), kernels.ramp(m))


@query(_product("ps", "psr"))
def spmv_hybrid_csr(spark, d):
    m = tables.ps(spark, d)
    return kernels.spmv_hybrid(m, formats.hybrid_csr(m, _parts(m)), kernels.ramp(m))


@query(_product("ps", "psr"))
def spmv_packed(spark, d):
    m = tables.ps(spark, d)
    return kernels.spmv_packed(m, kernels.pack(m), kernels.ramp(m))


@query(_sql("ps", "select s.s_suppkey as i, coalesce(sum(e.val * (e.i % 10)), 0.0)::double as y from supplier s left join ps e on e.j = s.s_suppkey group by 1"))
def spmtv(spark, d):
    m = tables.ps(spark, d)
    return kernels.spmv_t(m, kernels.ramp(m, m.n_rows))


@query(_sql("ps", "select r.i, coalesce(sum(e.val * ((e.j - 2) % 10)), 0.0)::double as y from (select unnest(range(150)) as i) r left join ps e on e.i = r.i + 20 and e.j >= 2 and e.j < 9 group by r.i"))
def spmv_submatrix(spark, d):
    m = tables.ps(spark, d).sub(20, 2, 150, 7, local=True)
    return kernels.spmv(m, kernels.ramp(m))


def _planned(spark, d, *options: str) -> DataFrame:
    m = tables.ps(spark, d)
    o = planner.Options.parse(["matrix=ps", "num_blocks=2", "threads_per_block=2", f"targeted_cache_size_kb={int(TARGET_KB)}", *options])
    return planner.prepare(m, o).product(kernels.ramp(m))


@query(_product("ps", "psr"))
def spmv_row_net(spark, d):
    return _planned(spark, d, "ordering_type=row_net", "storage_format=JDS")


@query(_product("ps", "psr"))
def spmv_column_net(spark, d):
    return _planned(spark, d, "ordering_type=column_net", "storage_format=HYBRID_JDS_CSR")


# --- files


@query(_sql("ps", "select i, j, val from ps"))
def mtx_roundtrip(spark, d):
    path = scratch(spark)
    mtx.write_mtx(tables.ps(spark, d), path)
    return mtx.read_mtx(spark, path)[0].entries


@query(_sql("vec", "select idx, a + b as v from vec"))
def vector_roundtrip(spark, d):
    path = scratch(spark)
    mtx.write_vector(vector.add(*_two(spark, d)[1:]), path)
    return mtx.read_vector(spark, path)


@query("select p_partkey as idx, row_number() over (order by (p_partkey * 7 + p_partkey // 3) % 5, p_partkey) - 1 as new_idx from part")
def order_roundtrip(spark, d):
    path = scratch(spark)
    order = partition.order_from_part_vector(_vector_parts(tables.ps(spark, d)), 5)
    mtx.write_vector(order.select("idx", F.col("new_idx").alias("v")), path, None)
    return mtx.read_order(spark, path)


@query(_sql("ps", f"select (i * 4 // {_N})::integer as part, i - ((i * 4 // {_N}) * {_N} + 3) // 4 as i, j, val from ps"))
def parts_roundtrip(spark, d):
    m, path = tables.ps(spark, d), scratch(spark)
    bounds = [-(-k * m.n_rows // 4) for k in range(5)]
    mtx.write_parts(m, spark.createDataFrame([(k, bounds[k], bounds[k + 1]) for k in range(4)], "part int, row_start long, row_end long"), path)
    out = None
    for k in range(4):
        rows = mtx.read_mtx(spark, f"{path}/part={k}")[0].entries.select(F.lit(k).alias("part"), "i", "j", "val")
        out = rows if out is None else out.unionByName(rows)
    return out


# --- formats


@query(_sql("op opr", "select r.i, coalesce(sum(count(e.j)) over (order by r.i rows between unbounded preceding and 1 preceding), 0)::bigint as ptr from opr r left join op e on e.i = r.i group by r.i"))
def csr_rowptr(spark, d):
    return formats.row_ptr(tables.op(spark, d))


@query(_sql("op", "select p.p_partkey as j, coalesce(sum(count(e.j)) over (order by p.p_partkey rows between unbounded preceding and 1 preceding), 0)::bigint as ptr from part p left join op e on e.j = p.p_partkey group by 1"))
def csc_colptr(spark, d):
    return formats.col_ptr(tables.op(spark, d))


@query(_sql("ps", "select row_number() over (order by i, j) - 1 as t, i, j, val from ps"))
def csr_entries(spark, d):
    return formats.csr(tables.ps(spark, d))


@query(_sql("ps", "select row_number() over (order by j, i) - 1 as t, i, j, val from ps"))
def csc_entries(spark, d):
    return formats.csc(tables.ps(spark, d))


@query(_sql("ps", "select i, j // 65536 as segment, string_agg(j::varchar, ',' order by j) as cols, string_agg(val::bigint::varchar, ',' order by j) as vals from ps group by 1, 2"))
def csr_packed(spark, d):
    rows = formats.csr_packed(tables.ps(spark, d))
    return rows.select("i", "segment", F.array_join(F.col("cols").cast("array<string>"), ",").alias("cols"), F.array_join(F.col("vals").cast("array<bigint>").cast("array<string>"), ",").alias("vals"))


@query(_sql("ps", "select row_number() over w - 1 as t, case when lag(i) over w is null then j when lag(i) over w = i then j - lag(j) over w else (select count(*) from supplier) + j - lag(j) over w end as delta, val from ps window w as (order by i, j)"))
def icsr_encode(spark, d):
    return formats.icsr_encode(tables.ps(spark, d))[0]


@query(_sql("ps", "select row_number() over w - 1 as ord, i - coalesce(lag(i) over w, 0) as delta from (select distinct i from ps) window w as (order by i)"))
def icsr_rows(spark, d):
    return formats.icsr_encode(tables.ps(spark, d))[1]


@query(_sql("ps", f"select i // {SLICE} as part, row_number() over w - 1 as t, case when lag(i) over w is null then j when lag(i) over w = i then j - lag(j) over w else (select count(*) from supplier) + j - lag(j) over w end as delta, val from ps window w as (partition by i // {SLICE} order by i, j)"))
def icsr_encode_parts(spark, d):
    m = tables.ps(spark, d)
    return formats.icsr_encode_parts(m, _parts(m))[0]


@query(_sql("ps", "select i, j, val from ps"))
def icsr_decode(spark, d):
    m = tables.ps(spark, d)
    return formats.icsr_decode(*formats.icsr_encode(m), m.n_rows, m.n_cols).entries


@query(_sql("perm", "select part, r, i, nnz from perm"))
def jds_permutation(spark, d):
    m = tables.ps(spark, d)
    return formats.jds_permutation(m, _parts(m))


@query(_sql("jds", "select part, k, r, i, j, val from jds"))
def jds_entries(spark, d):
    m = tables.ps(spark, d)
    return formats.jds_entries(m, _parts(m))


@query(_sql("diag", "select part, k, len, coalesce(sum(len) over (partition by part order by k rows between unbounded preceding and 1 preceding), 0)::bigint as ptr from diag"))
def jds_idiag(spark, d):
    m = tables.ps(spark, d)
    return formats.jds_idiag(m, _parts(m))


@query(_sql("cutj", "select part, opt_col, opt_row from cutj"))
def hybrid_cut_jds(spark, d):
    m = tables.ps(spark, d)
    return formats.cut_jds(m, _parts(m))


@query(_sql("cutc", "select part, opt_col, opt_row from cutc"))
def hybrid_cut_csr(spark, d):
    m = tables.ps(spark, d)
    return formats.cut_csr(m, _parts(m))


@query(_sql("jds cutj", "select part, k, r, i, j, val, case when k < opt_col then 'JDS' else 'CSR' end as region from jds join cutj using (part)"))
def hybrid_regions_jds(spark, d):
    m = tables.ps(spark, d)
    return formats.hybrid_jds(m, _parts(m))


@query(_sql("jds cutc", "select part, k, r, i, j, val, case when r < opt_row then 'CSR' else 'JDS' end as region from jds join cutc using (part)"))
def hybrid_regions_csr(spark, d):
    m = tables.ps(spark, d)
    return formats.hybrid_csr(m, _parts(m))


# --- statistics


@query(_sql("op opr", "select r.i, count(e.j) as nnz from opr r left join op e on e.i = r.i group by r.i"))
def nnz_per_row(spark, d):
    return formats.row_nnz(tables.op(spark, d))


@query(_sql("op", "select p.p_partkey as j, count(e.j) as nnz from part p left join op e on e.j = p.p_partkey group by 1"))
def nnz_per_col(spark, d):
    return formats.col_nnz(tables.op(spark, d))


_STATS = "rn as (select count(e.j) as n from opr r left join op e on e.i = r.i group by r.i), cn2 as (select count(e.j) as n from part p left join op e on e.j = p.p_partkey group by p.p_partkey), st as (select (select min(n) from rn) as minr, (select round(avg(n), 6) from rn) as avgr, (select max(n) from rn) as maxr, (select min(n) from cn2) as minc, (select round(avg(n), 6) from cn2) as avgc, (select max(n) from cn2) as maxc)"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(_sql("op opr", "").rstrip() + ", " + _STATS + " select * from st")
def nnz_stats(spark, d):
    return _rounded(stats.nnz_stats(tables.op(spark, d)), "avgr", "avgc")


@query(
    _sql("op opr", "").rstrip() + ", " + _STATS + ", n as (select (select count(*) from orders) as n_rows, (select count(*) from part) as n_cols, (select count(*) from op) as nnz)"
    " select n_rows, n_cols, nnz, round((12 * nnz + 4 * (n_rows + 1)) / 1024, 6) as size_kb, round((12 * nnz + 4 * (n_rows + 1)) / 1024 + 8 * (n_rows + n_cols) / 1024, 6) as op_kb,"
    " floor(((12 * nnz + 4 * (n_rows + 1)) / 1024 + 8 * (n_rows + n_cols) / 1024) / 64)::bigint + 1 as parts, st.* from n, st"
)
def matrix_info(spark, d):
    return _rounded(stats.matrix_info(tables.op(spark, d), 64), "size_kb", "op_kb", "avgr", "avgc")


_BLOCKS = "bs as (select p.part, p.n_rows, p.nnz, p.minr, p.avgr, p.maxr, coalesce(g.minc, 0) as minc, coalesce(g.avgc, 0) as avgc, coalesce(g.maxc, 0) as maxc from (select part, count(*) as n_rows, sum(nnz)::bigint as nnz, min(nnz) as minr, avg(nnz) as avgr, max(nnz) as maxr from perm group by part) p left join (select part, min(len) as minc, avg(len) as avgc, max(len) as maxc from diag group by part) g using (part))"


@query(_sql("perm diag", "").rstrip() + ", " + _BLOCKS + " select part, n_rows, nnz, minr, round(avgr, 6) as avgr, maxr, minc, round(avgc, 6) as avgc, maxc from bs")
def jds_block_stats(spark, d):
    m = tables.ps(spark, d)
    return _rounded(stats.jds_block_stats(m, _parts(m)), "avgr", "avgc")


@query(_sql("perm diag", "").rstrip() + ", " + _BLOCKS + " select " + ", ".join(f"round(avg({c}), 6) as {c}" for c in "minr avgr maxr minc avgc maxc".split()) + " from (select part // 3 as block, " + ", ".join(f"avg({c}) as {c}" for c in "minr avgr maxr minc avgc maxc".split()) + " from bs group by 1)")
def block_stats_mean(spark, d):
    m = tables.ps(spark, d)
    return _rounded(stats.block_means(stats.jds_block_stats(m, _parts(m)), 3), "minr", "avgr", "maxr", "minc", "avgc", "maxc")


# --- partitions and orderings

@query(f"select k::integer as part, k * {SLICE} as row_start, least((k + 1) * {SLICE}, {_N}) as row_end from (select unnest(range((({_N} + {SLICE} - 1) // {SLICE})::bigint)) as k)")
def part_static_slices(spark, d):
    return partition.static_slices(tables.ps(spark, d), SLICE)


_W = "w as (select r.i + 1 as m, sum(count(e.j)) over (order by r.i)::bigint as ptr from psr r left join ps e on e.i = r.i group by r.i), arr as (select list(ptr order by m) as p, count(*)::bigint as n from w)"
#: p[m] is the number of entries in the first m rows.
_AT = "coalesce(case when {0} = 0 then 0 else p[{0}] end, 0)"


@query(
    _sql("psr ps", "", True).rstrip() + ", " + _W + f""",
step(cur, prev, emitted_start, emitted_end) as (
  select 0::bigint, 0::bigint, null::bigint, null::bigint
  union all
  select case when big and cur - prev > {STEP} then cur else cur + {STEP} end, case when big then (case when cur - prev > {STEP} then cur - {STEP} else cur end) else prev end,
    case when big then prev end, case when big then (case when cur - prev > {STEP} then cur - {STEP} else cur end) end
  from (select s.cur, s.prev, (12 * ({_AT.format('s.cur')} - {_AT.format('s.prev')}) + 12 * (s.cur - s.prev)) / 1024 > {TARGET_KB} as big, n from step s, arr where s.cur < n - {STEP})
),
cut as (select distinct emitted_start as s, emitted_end as e from step where emitted_start is not null),
last as (select max(cur) - {STEP} as cur, (select coalesce(max(e), 0) from cut) as prev, (select count(*) from cut) as c from step),
every as (
  select s, case when e = l.prev and not (l.cur >= {STEP}) then n else e end as e from cut, last l, arr
  union all select l.prev, n from last l, arr where l.cur >= {STEP} or l.c = 0
)
select (row_number() over (order by s) - 1)::integer as part, s as row_start, e as row_end from every"""
)
def part_linear(spark, d):
    return partition.linear(tables.ps(spark, d), TARGET_KB, STEP)


_TREE = _sql("psr ps", "", True).rstrip() + ", " + _W + f""",
tree(node_id, level, s, e) as (
  select 0::bigint, 0, 0::bigint, n from arr
  union all
  select 2 * node_id + k, level + 1, case when k = 1 then s else c end, case when k = 1 then c else e end
  from (
    select *, case when hi is null then e - 1 when hi > s + 1 and abs(2 * (12 * ({_AT.format('(hi - 1)')} + hi - 1) - ws) - (we - ws)) < abs(2 * (12 * ({_AT.format('hi')} + hi) - ws) - (we - ws)) then hi - 1 else hi end as c
    from (
      select *, [m for m in range(s + 1, e) if 2 * (12 * ({_AT.format('m')} + m) - ws) >= we - ws][1] as hi
      from (select t.*, p, 12 * ({_AT.format('t.s')} + t.s) as ws, 12 * ({_AT.format('t.e')} + t.e) as we from tree t, arr)
      where we - ws > {TARGET_KB} * 1024 and e - s > 1
    )
  ), (values (1), (2)) side(k)
)"""
_IS_LEAF = "not exists (select 1 from tree c where c.node_id = 2 * t.node_id + 1)"


@query(_TREE + f" select node_id, case when node_id > 0 then (node_id - 1) // 2 end as parent_id, level, s as row_start, e as row_end, {_IS_LEAF} as is_leaf from tree t")
def part_bipartition(spark, d):
    return partition.bipartition(tables.ps(spark, d), TARGET_KB)


@query(_TREE + f" select (row_number() over (order by s) - 1)::integer as part, s as row_start, e as row_end from tree t where {_IS_LEAF}")
def tree_leaves(spark, d):
    return partition.leaves(partition.bipartition(tables.ps(spark, d), TARGET_KB))


@query(_TREE + f" select count(*) as nodes, count(*) filter ({_IS_LEAF}) as leaves, count(*) filter (not {_IS_LEAF}) as parents from tree t")
def tree_counts(spark, d):
    return partition.tree_counts(partition.bipartition(tables.ps(spark, d), TARGET_KB))


@query(_sql("low", "select (row_number() over (order by k) - 1)::integer as part, k * 5 as row_start, least((k + 1) * 5, (select count(*) from supplier)) as row_end from (select distinct i // 5 as k from (select i, j from low where i % 15 < 5))"))
def tree_leaves_nonempty(spark, d):
    # a matrix with empty bands of rows, and a tree whose leaves are its bands
    low = tables.lower(spark, d)
    banded = low.with_entries(low.entries.where("i % 15 < 5"))
    bands = partition.static_slices(low, 5).select("row_start", "row_end", F.lit(True).alias("is_leaf"))
    return partition.leaves(bands, banded)


@query(f"select p_partkey as i, (case when 2 * p_partkey < {_N} then 1 else 3 end)::integer as part from part")
def part_rows(spark, d):
    # empty parts in between, as part vectors make them
    m = tables.ps(spark, d)
    half = -(-m.n_rows // 2)
    bounds = [(0, 0, 0), (1, 0, half), (2, half, half), (3, half, m.n_rows), (4, m.n_rows, m.n_rows)]
    return partition.part_of_rows(m, spark.createDataFrame(bounds, "part int, row_start long, row_end long"))


@query(_sql("pv", "select k::integer as part, coalesce(sum(n) over (order by k rows between unbounded preceding and 1 preceding), 0)::bigint as row_start, sum(n) over (order by k)::bigint as row_end from (select r.k, count(pv.i) as n from (select unnest(range(5)) as k) r left join pv on pv.part = r.k group by r.k)"))
def part_from_vector(spark, d):
    return partition.from_part_vector(_vector_parts(tables.ps(spark, d)), 5)


_ORD = "ord as (select i as idx, row_number() over (order by part, i) - 1 as new_idx from pv)"


@query(_sql("pv", "").rstrip() + f", {_ORD} select idx, new_idx from ord")
def order_from_vector(spark, d):
    return partition.order_from_part_vector(_vector_parts(tables.ps(spark, d)), 5)


@query(_sql("pv ps", "").rstrip() + f", {_ORD} select p.i, p.j, o.new_idx as i_ord, p.j as j_ord, p.val from ps p join ord o on o.idx = p.i")
def apply_ordering(spark, d):
    m = tables.ps(spark, d)
    return m.apply_order(partition.order_from_part_vector(_vector_parts(m), 5))


@query(_sql("pv ps", "").rstrip() + f", {_ORD} select b.new_idx as i, p.j, p.val from ps p join ord a on a.idx = p.i join ord b on b.idx = a.new_idx")
def compose_ordering(spark, d):
    m = tables.ps(spark, d)
    o = partition.order_from_part_vector(_vector_parts(m), 5)
    return m.reorder(compose(o, o)).entries


@query(_sql("pv", "").rstrip() + f", {_ORD} select new_idx as idx, (idx % 10)::double as v from ord")
def order_vector(spark, d):
    m = tables.ps(spark, d)
    return vector.scatter(_vec(m, 10), partition.order_from_part_vector(_vector_parts(m), 5))


@query(_sql("pv", "").rstrip() + f", {_ORD} select idx, (new_idx % 10)::double as v from ord")
def reorder_vector(spark, d):
    m = tables.ps(spark, d)
    return vector.gather(_vec(m, 10), partition.order_from_part_vector(_vector_parts(m), 5))


@query(_sql("nz", f"select i as idx, i - part * {SLICE} + start as new_idx from nz join (select part, coalesce(sum(n) over (order by top desc, part rows between unbounded preceding and 1 preceding), 0)::bigint as start from (select part, max(nnz) as top, count(*) as n from nz group by part)) using (part)"))
def order_blocks(spark, d):
    m = tables.ps(spark, d)
    return partition.order_blocks(m, partition.static_slices(m, SLICE))


_PINS = "pins as (select distinct e.j, pv.part from ps e join pv on pv.i = e.i)"


@query(_sql("ps pv", "").rstrip() + f", {_PINS} select s.s_suppkey as j, (case when count(p.part) = 0 then 0 when count(p.part) = 1 then min(p.part) else 5 end)::integer as part from supplier s left join pins p on p.j = s.s_suppkey group by 1")
def net_part(spark, d):
    m = tables.ps(spark, d)
    return partition.net_parts(m, _vector_parts(m), 5)


_CUT = "select count(*) filter (n > 1) as cut_nets, coalesce(sum(n - 1), 0)::bigint as cutsize from (select j, count(*) as n from pins group by j)"


@query(_sql("ps pv", "").rstrip() + f", {_PINS} select cut_nets from ({_CUT})")
def cut_nets(spark, d):
    m = tables.ps(spark, d)
    return partition.cut_metrics(m, _vector_parts(m)).select("cut_nets")


@query(_sql("ps pv", "").rstrip() + f", {_PINS} select cutsize from ({_CUT})")
def connectivity_cutsize(spark, d):
    m = tables.ps(spark, d)
    return partition.cut_metrics(m, _vector_parts(m)).select("cutsize")


@query(_sql("ps pv", "select max(w)::bigint as max_weight, round((max(w) / (sum(w) / 5) - 1) * 100, 6)::double as imbalance_pct from (select pv.part, sum(n) as w from (select i, count(*) as n from ps group by i) e join pv on pv.i = e.i group by pv.part)"))
def imbalance(spark, d):
    m = tables.ps(spark, d)
    return _rounded(partition.imbalance(m, _vector_parts(m), 5), "imbalance_pct")


@query()
def hypergraph_partition(spark, d):
    return partition.hypergraph(tables.ps(spark, d), 4)


@query("select count(*) as n_rows, true as balanced, true as no_worse from part")
def hypergraph_quality(spark, d):
    """All rows have a part, no part is over 10 % above the mean, and the cut is no worse than that of contiguous parts."""
    m = tables.ps(spark, d)
    nets = partition.Nets(m, 4)
    found, start = partition.hypergraph(m, 4, nets=nets), partition.hypergraph(m, 4, rounds=0, nets=nets)
    no_worse = nets.held(found)[0] <= nets.held(start)[0]
    rows = found.where(F.col("part").between(0, 3)).agg(F.count_distinct("i").alias("n_rows"))
    fair = checkpoint(partition.imbalance(m, found, 4, nets.weights()).select((F.col("imbalance_pct") <= 10).alias("balanced")))
    nets.close()
    return rows.crossJoin(fair).select("n_rows", "balanced", F.lit(no_worse).alias("no_worse"))


@query(_sql("", f"select * from (values {', '.join(f'({k}::bigint, {n}::bigint)' for k, n in enumerate([2, 3, 3, 3]))}) t(block, parts)").replace("with  ", ""))
def part_counts_power_of_2(spark, d):
    return spark.createDataFrame(list(enumerate(partition.part_counts_power_of_2(4, 11))), "block long, parts long")


# --- work assignment


def _positions(spark, d) -> tuple[DataFrame, int]:
    m = tables.ps(spark, d)
    return m.rows("pos"), m.n_rows


@query(f"select p_partkey as pos, (ntile({WORKERS}) over (order by p_partkey) - 1)::integer as worker from part")
def assign_decompose(spark, d):
    rows, n = _positions(spark, d)
    return rows.select("pos", assign.decompose(F.col("pos"), n, WORKERS).alias("worker"))


@query(f"select p_partkey as pos, (p_partkey % {WORKERS})::integer as worker from part")
def assign_scatter(spark, d):
    rows, _ = _positions(spark, d)
    return rows.select("pos", assign.scatter(F.col("pos"), WORKERS).alias("worker"))


@query(
    f"""with recursive h(start, n, first, p) as (
  select 0::bigint, count(*), 0, {WORKERS} from part
  union all
  select case when k = 0 then start else start + (n + 1) // 2 end, case when k = 0 then (n + 1) // 2 else n // 2 end, case when k = 0 then first else first + (p + 1) // 2 end, case when k = 0 then (p + 1) // 2 else p // 2 end
  from h, (values (0), (1)) side(k) where p > 1
) select p_partkey as pos, h.first::integer as worker from part join h on h.p = 1 and p_partkey >= h.start and p_partkey < h.start + h.n"""
)
def assign_split(spark, d):
    rows, n = _positions(spark, d)
    return rows.select("pos", assign.split(F.col("pos"), n, WORKERS).alias("worker"))


@query(
    f"""with p as (select k::integer as part, k * {SLICE} as row_start, least((k + 1) * {SLICE}, {_N}) as row_end from (select unnest(range((({_N} + {SLICE} - 1) // {SLICE})::bigint)) as k))
select part, row_start, row_end, (part % {WORKERS})::integer as worker from p"""
)
def assign_parts(spark, d):
    return planner.assign_parts(partition.static_slices(tables.ps(spark, d), SLICE), WORKERS, "scatter")


_SUBTREES = f""",
sub(node_id, first, n) as (
  select 0::bigint, 0, {WORKERS}
  union all
  select 2 * sub.node_id + k, case when k = 1 then first else first + (n + 1) // 2 end, case when k = 1 then (n + 1) // 2 else n // 2 end
  from sub, (values (1), (2)) side(k) where n > 1 and exists (select 1 from tree c where c.node_id = 2 * sub.node_id + 1)
),
top as (select sub.first::integer as worker, t.node_id, t.s as row_start, t.e as row_end from sub join tree t using (node_id) where n <= 1 or {_IS_LEAF})"""
_LEAVES = f", leaf as (select (row_number() over (order by s) - 1)::integer as part, s as row_start, e as row_end from tree t where {_IS_LEAF})"


@query(_TREE + _SUBTREES + " select worker, node_id, row_start, row_end from top")
def assign_tree(spark, d):
    return assign.tree(partition.bipartition(tables.ps(spark, d), TARGET_KB), WORKERS)


def _tree_parts(spark, d, how: str) -> DataFrame:
    tree = partition.bipartition(tables.ps(spark, d), TARGET_KB)
    return planner.assign_parts(partition.leaves(tree), WORKERS, how, tree)


_OF_TOP = "select l.part, l.row_start, l.row_end, {0} as worker from leaf l join top on l.row_start >= top.row_start and l.row_start < top.row_end"


@query(_TREE + _SUBTREES + _LEAVES + " " + _OF_TOP.format("worker"))
def assign_parts_tree(spark, d):
    return _tree_parts(spark, d, "tree")


@query(_TREE + _SUBTREES + _LEAVES + " " + _OF_TOP.format(f"((worker + part - min(part) over (partition by worker)) % {WORKERS})::integer"))
def assign_parts_tree_scatter(spark, d):
    return _tree_parts(spark, d, "tree_scatter")


_SLICES = f"p as (select k::integer as part, k * {SLICE} as row_start, least((k + 1) * {SLICE}, {_N}) as row_end from (select unnest(range((({_N} + {SLICE} - 1) // {SLICE})::bigint)) as k))"


@query(f"with {_SLICES} select part, row_start, row_end, (ntile({WORKERS}) over (order by part) - 1)::integer as worker from p")
def assign_parts_block(spark, d):
    return planner.assign_parts(partition.static_slices(tables.ps(spark, d), SLICE), WORKERS, "block")


@query(
    f"""with recursive {_SLICES},
h(start, n, first, p) as (
  select 0::bigint, count(*), 0, 4 from p
  union all
  select case when k = 0 then start else start + n // 2 end, case when k = 0 then n // 2 else n - n // 2 end, case when k = 0 then first else first + p // 2 end, case when k = 0 then p // 2 else p - p // 2 end
  from h, (values (0), (1)) side(k) where p > 1
)
select p.part, p.row_start, p.row_end, (2 * h.first + (p.part - h.start) % 2)::integer as worker from p join h on h.p = 1 and p.part >= h.start and p.part < h.start + h.n"""
)
def assign_parts_power_of_2(spark, d):
    return planner.assign_parts(partition.static_slices(tables.ps(spark, d), SLICE), 8, "power_of_2", blocks=4)


@query(_sql("ps", f"select ((i // {SLICE}) % {WORKERS})::integer as worker, i, sum(val * (j % 10))::double as y from ps group by i"))
def spmv_by_worker(spark, d):
    m = tables.ps(spark, d)
    parts = planner.assign_parts(partition.static_slices(m, SLICE), WORKERS, "scatter")
    return planner.run_by_worker(m, parts, kernels.ramp(m), WORKERS)


def _blocks(m: SparseMatrix) -> DataFrame:
    return partition.static_slices(m, 10).where("part % 4 <> 3").select(F.when(F.col("part") % 8 < 5, "JDS").otherwise("CSR").alias("kind"), "row_start", "row_end")


@query(
    f"""with b as (select case when k % 8 < 5 then 'JDS' else 'CSR' end as kind, k * 10 as row_start, least((k + 1) * 10, {_N}) as row_end from (select unnest(range((({_N} + 9) // 10)::bigint)) as k) where k % 4 <> 3),
m as (select *, case when lag(row_end) over (partition by kind order by row_start) = row_start then 0 else 1 end as new from b),
g as (select *, sum(new) over (partition by kind order by row_start) as run from m)
select kind, min(row_start) as row_start, max(row_end) as row_end, count(*) as merged from g group by kind, run"""
)
def merge_adjacent(spark, d):
    return assign.merge_adjacent(_blocks(tables.ps(spark, d)))


@query("select c_custkey as i, string_agg(case when c_nationkey = n_nationkey then '1' else '0' end, ' ' order by n_nationkey) as line from customer, nation group by 1")
def dense_rows(spark, d):
    m = tables.cn(spark, d)
    rows = formats.dense_rows(m, 0, m.n_rows)
    return rows.select("i", F.array_join(F.transform("vals", lambda v: v.cast("bigint").cast("string")), " ").alias("line"))


# --- vectors and solvers


def _two(spark, d) -> tuple[SparseMatrix, DataFrame, DataFrame]:
    m = tables.ps(spark, d)
    return m, _vec(m, 10), _vec(m, 7)


@query(_sql("vec", "select idx, a + b as v from vec"))
def vec_add(spark, d):
    _, a, b = _two(spark, d)
    return vector.add(a, b)


@query(_sql("vec", "select idx, a - b as v from vec"))
def vec_subtract(spark, d):
    _, a, b = _two(spark, d)
    return vector.subtract(a, b)


@query(_sql("vec", "select idx, a + 3 * b as v from vec"))
def vec_axpy(spark, d):
    _, a, b = _two(spark, d)
    return vector.axpy(a, 3, b)


@query(_sql("vec", "select sum(a * b) as dot from vec"))
def vec_dot(spark, d):
    _, a, b = _two(spark, d)
    return vector.dot(a, b)


@query(_sql("vec", "select idx, a * 2.5 as v from vec"))
def vec_scale(spark, d):
    _, a, _ = _two(spark, d)
    return vector.scale(a, 2.5)


@query(_sql("vec", "select idx, a, b from vec where abs(a - b) > 0.1 order by idx limit 10"))
def vec_compare(spark, d):
    _, a, b = _two(spark, d)
    return vector.compare(a, b)


@query(_sql("low", "select s.s_suppkey as idx, round(greatest(5 - s.s_suppkey, 0) / case when coalesce(e.val, 0) = 0 then 1 else e.val end, 9) as v from supplier s left join low e on e.i = s.s_suppkey and e.j = e.i"))
def jacobi_solve(spark, d):
    m = tables.lower(spark, d)
    return vector.jacobi(m, solvers.start_vectors(m)[1]).withColumn("v", F.round("v", 9))


def _steps(weights: str, steps: int = 3) -> str:
    """``steps`` iterations over lists; ``weights`` is a list of the preconditioner."""
    each = lambda e: f"list_transform(range(1, len(x) + 1), lambda k: {e})"
    return _sql("ss", "", True).rstrip() + f""",
grid as (select a.s_suppkey as i, list(coalesce(e.val, 0.0) order by b.s_suppkey) as line, max(case when a.s_suppkey = b.s_suppkey then e.val end) as d
  from supplier a cross join supplier b left join ss e on e.i = a.s_suppkey and e.j = b.s_suppkey group by a.s_suppkey),
m as (select list(line order by i) as a, list((i % 10)::double order by i) as x0, list(greatest(5 - i, 0)::double order by i) as b, list({weights} order by i) as w from grid),
start as (select x0 as x, list_transform(range(1, len(b) + 1), lambda k: b[k] - list_dot_product(a[k], x0)) as r from m),
it(n, x, r, p, rz) as (
  select 0, x, r, list_transform(range(1, len(x) + 1), lambda k: w[k] * r[k]), list_dot_product(r, list_transform(range(1, len(x) + 1), lambda k: w[k] * r[k])) from start, m
  union all
  select n + 1, x1, r1, {each('w[k] * r1[k] + list_dot_product(r1, z1) / rz * p[k]')}, list_dot_product(r1, z1)
  from (select *, {each('w[k] * r1[k]')} as z1
    from (select *, {each('x[k] + alpha * p[k]')} as x1, {each('r[k] - alpha * q[k]')} as r1
      from (select *, rz / list_dot_product(p, q) as alpha from (select it.*, w, list_transform(a, lambda line: list_dot_product(line, p)) as q from it, m where n < {steps}))))
)
select (generate_subscripts(x, 1) - 1)::bigint as idx, round(unnest(x), 6) as v from it where n = {steps}"""


def _start(spark, d) -> tuple[SparseMatrix, DataFrame, DataFrame]:
    m = tables.ss(spark, d)
    x0, b = solvers.start_vectors(m)
    return m, b, x0


@query(_steps("1.0::double"))
def cg_steps(spark, d):
    return solvers.cg(*_start(spark, d), stop=0.0, most=3).x.withColumn("v", F.round("v", 6))


@query(_steps("1.0 / d"))
def pcg_steps(spark, d):
    return solvers.pcg(*_start(spark, d), stop=0.0, most=3).x.withColumn("v", F.round("v", 6))


def _reached(spark, d, solve) -> DataFrame:
    m, b, x0 = _start(spark, d)
    s = solve(m, b, x0, most=200)
    return spark.createDataFrame([(s.residual <= 0.01, s.iterations < 200, solvers.residual(m, b, s.x) <= 0.2)], "converged boolean, in_time boolean, solved boolean")


@query("select true as converged, true as in_time, true as solved")
def cg_reached(spark, d):
    return _reached(spark, d, solvers.cg)


@query("select true as converged, true as in_time, true as solved")
def pcg_reached(spark, d):
    return _reached(spark, d, solvers.pcg)


@query()
def cg_solve(spark, d):
    m = tables.ss(spark, d)
    x0, b = solvers.start_vectors(m)
    return solvers.cg(m, b, x0, most=200).x


@query()
def pcg_solve(spark, d):
    m = tables.ss(spark, d)
    x0, b = solvers.start_vectors(m)
    return solvers.pcg(m, b, x0, most=200).x
