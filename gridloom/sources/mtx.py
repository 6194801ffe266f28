"""Matrix Market files and the text files around them: vectors, orderings, part vectors, statistics."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scan import number_lines, prefix_sum
from ..operators.matrix import SparseMatrix

# Words of the banner.
FIELDS, SYMMETRIES = ("real", "complex", "pattern", "integer"), ("general", "symmetric", "hermitian", "skew-symmetric")


@dataclass(frozen=True)
class Banner:
    """The first line of a Matrix Market file."""

    format: str
    field: str
    symmetry: str

    @classmethod
    def parse(cls, line: str) -> Banner:
        words = line.split()
        if len(words) != 5 or words[0] != "%%MatrixMarket":
            raise ValueError(f"no Matrix Market banner: {line[:80]!r}")
        kind, form, field, symmetry = (w.lower() for w in words[1:])
        if kind != "matrix" or form not in ("coordinate", "array") or field not in FIELDS or symmetry not in SYMMETRIES:
            raise ValueError(f"unknown banner: {line[:80]!r}")
        out = cls(form, field, symmetry)
        if not out.valid():
            raise ValueError(f"banner that no matrix has: {line[:80]!r}")
        return out

    def valid(self) -> bool:
        if self.format == "array" and self.field == "pattern":
            return False
        if self.field == "real" and self.symmetry == "hermitian":
            return False
        return not (self.field == "pattern" and self.symmetry in ("hermitian", "skew-symmetric"))

    def __str__(self) -> str:
        return f"%%MatrixMarket matrix {self.format} {self.field} {self.symmetry}"


@dataclass(frozen=True)
class Header:
    banner: Banner
    n_rows: int
    n_cols: int
    nnz: int  # as the file says, before mirroring


def _head(spark: SparkSession, path: str) -> tuple[list[str], int, DataFrame]:
    """The banner's and the size line's words, and the lines (``value``) after them, of a file or of a folder of parts by name.

    Only the first lines of the first part with text are read for it.
    """
    files = sorted(unquote(f) for f in spark.read.text(path).inputFiles())
    for k, name in enumerate(files):
        lines, most = spark.read.text(name).withColumn("n", F.monotonically_increasing_id()), 32
        while True:
            top = [r.value.strip() for r in lines.limit(most).collect()]
            found = next((i for i, x in enumerate(top) if x and not x.startswith("%")), None)
            if found is not None or len(top) < most:
                break
            most *= 8
        if not any(top):
            continue
        banner = next(x for x in top if x)
        if found is None or banner == top[found]:
            return [banner, ""], 0, lines
        rest = lines.where(F.col("n") > found).select("value")
        if files[k + 1 :]:
            rest = rest.unionByName(spark.read.text(files[k + 1 :]))
        return [banner, top[found]], found, rest.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    raise ValueError(f"empty file: {path}")


def read_mtx(spark: SparkSession, path: str, coefficients: str | None = None) -> tuple[SparseMatrix, Header]:
    """The matrix of a coordinate file (or a folder of its parts), 0-based, with the other triangle filled in.

    Pattern entries are 1.0, or with ``coefficients="row"`` 1 / nnz of their row; complex values become their real
    part, with the imaginary part in the column ``im``. Raises ValueError for dense files and wrong headers.
    """
    (first, size), _, data = _head(spark, path)
    banner = Banner.parse(first)
    if banner.format != "coordinate":
        raise ValueError("only sparse (coordinate) matrices are read")
    words = size.split()
    if len(words) != 3 or not all(w.isdigit() for w in words):
        raise ValueError(f"no size line: {path}")
    head = Header(banner, *map(int, words))
    f = F.split(F.trim("value"), r"\s+")
    value = F.lit(1.0) if banner.field == "pattern" else f[2].cast("double")
    rows = data.select((f[0].cast("long") - 1).alias("i"), (f[1].cast("long") - 1).alias("j"), value.alias("val"), *[f[3].cast("double").alias("im")] * (banner.field == "complex"))
    sign = -1 if banner.symmetry == "skew-symmetric" else 1
    m = SparseMatrix(rows, head.n_rows, head.n_cols)
    if banner.symmetry != "general":
        other = rows.where("i <> j").withColumns({"i": F.col("j"), "j": F.col("i"), "val": F.col("val") * sign})
        if banner.field == "complex":
            other = other.withColumn("im", F.col("im") * (-1 if banner.symmetry == "hermitian" else sign))
        m = m.with_entries(rows.unionByName(other))
    if coefficients == "row" and banner.field == "pattern":
        m = m.pattern_coefficients()
    return m, head


def read_dense(spark: SparkSession, path: str) -> tuple[SparseMatrix, Header]:
    """The matrix of an array file of real or integer values, column by column; zeros become no entries."""
    (first, size), found, _ = _head(spark, path)
    banner, words = Banner.parse(first), size.split()
    if banner.format != "array" or banner.field not in ("real", "integer") or banner.symmetry != "general":
        raise ValueError("no general array of real values")
    if len(words) != 2 or not all(w.isdigit() for w in words):
        raise ValueError(f"no size line: {path}")
    rows, cols = map(int, words)
    lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    at = number_lines(lines).where("idx > 0").select((F.col("idx") - 1).alias("idx"), F.trim("value").try_cast("double").alias("val"))
    e = at.where("val <> 0").select(F.pmod("idx", F.lit(rows)).alias("i"), F.floor(F.col("idx") / rows).alias("j"), "val")
    return SparseMatrix(e, rows, cols), Header(banner, rows, cols, rows * cols)


def write_mtx(m: SparseMatrix, path: str, field: str = "real") -> None:
    """A folder of text parts which make one coordinate file when put together in order; 1-based, 16 digits."""
    nnz = m.entries.count()
    value = F.format_string("%.16g", "val") if field == "real" else F.col("val").cast("long").cast("string")
    line = F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, *[value] * (field != "pattern"))
    body = m.entries.select("i", "j", line.alias("value"))
    head = m.spark.createDataFrame([(-2, 0, str(Banner("coordinate", field, "general"))), (-1, 0, f"{m.n_rows} {m.n_cols} {nnz}")], "i long, j long, value string")
    head.unionByName(body).orderBy("i", "j").select("value").write.text(path)


def write_parts(m: SparseMatrix, parts: DataFrame, path: str) -> None:
    """Each part as a matrix file of its own under ``part=<number>`` in the folder, rows counted from the part's first.

    ``parts`` is a partition (part, row_start, row_end). Each file set has a banner and its size line, parts
    without entries too; a large part is written by several tasks.
    """
    from ..operators.partition import part_of_rows

    of = part_of_rows(m, parts).join(parts.select("part", "row_start"), "part")
    rows = m.entries.join(of, "i").select("part", (F.col("i") - F.col("row_start")).alias("i"), "j", "val")
    counts = parts.join(rows.groupBy("part").agg(F.count("*").alias("nnz")), "part", "left")
    size = F.concat_ws(" ", F.col("row_end") - F.col("row_start"), F.lit(m.n_cols), F.coalesce("nnz", F.lit(0)))
    heads = counts.select("part", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("i"), x.alias("value")) for k, x in ((-2, F.lit(str(Banner("coordinate", "real", "general")))), (-1, size))])).alias("h"))
    line = F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, F.format_string("%.16g", "val"))
    all_rows = heads.select("part", "h.i", F.lit(-1).cast("long").alias("j"), "h.value").unionByName(rows.select("part", "i", "j", line.alias("value")))
    all_rows.repartitionByRange("part", "i", "j").sortWithinPartitions("part", "i", "j").select("part", "value").write.partitionBy("part").text(path)


def _numbers(spark: SparkSession, path: str, kind: str, header: bool) -> DataFrame:
    lines = number_lines(spark.read.text(path).where(F.trim("value") != ""))
    skip = int(header)
    return lines.where(F.col("idx") >= skip).select((F.col("idx") - skip).alias("idx"), F.trim("value").cast(kind).alias("v"))


def read_vector(spark: SparkSession, path: str, kind: str = "double", header: bool = True) -> DataFrame:
    """(idx, v): one number a line, after a line with their count if ``header``."""
    return _numbers(spark, path, kind, header)


def write_vector(v: DataFrame, path: str, decimals: int | None = 2) -> None:
    """The count, then the values in order of idx; real ones with ``decimals`` digits, integers with None."""
    value = F.col("v").cast("long").cast("string") if decimals is None else F.format_string(f"%.{decimals}f", "v")
    head = v.sparkSession.createDataFrame([(-1, str(v.count()))], "idx long, value string")
    head.unionByName(v.select("idx", value.alias("value"))).orderBy("idx").select("value").write.text(path)


def read_order_lookup(spark: SparkSession, path: str, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """Row and column orderings (idx, new_idx) of a file with all rows' new indices and then all columns'."""
    v = _numbers(spark, path, "long", False)
    return v.where(F.col("idx") < n_rows).select("idx", F.col("v").alias("new_idx")), v.where(F.col("idx") >= n_rows).select((F.col("idx") - n_rows).alias("idx"), F.col("v").alias("new_idx"))


def read_order(spark: SparkSession, path: str) -> DataFrame:
    """(idx, new_idx) of a file with a count and the new index of each old one."""
    return _numbers(spark, path, "long", True).select("idx", F.col("v").alias("new_idx"))


def read_dimensions(spark: SparkSession, path: str) -> DataFrame:
    """(part, row_start, row_end) of a file with a count and the parts' sizes."""
    sizes = _numbers(spark, path, "long", True)
    return prefix_sum(sizes, "idx", "v", "row_end").select(F.col("idx").cast("int").alias("part"), (F.col("row_end") - F.col("v")).alias("row_start"), "row_end")


def read_part_vector(spark: SparkSession, path: str) -> DataFrame:
    """(i, part) of a file with a part number a line."""
    return _numbers(spark, path, "int", False).select(F.col("idx").alias("i"), F.col("v").alias("part"))


def read_part_count(spark: SparkSession, path: str) -> int:
    """The first line of a statistics file."""
    return int(spark.read.text(path).limit(1).collect()[0].value.split()[0])


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def load_kway_order(spark: SparkSession, m: SparseMatrix, folder: str, name: str, k: int) -> tuple[SparseMatrix, DataFrame, DataFrame]:
    """The matrix in the order of K-way files ``<folder>/<name>_{vertexOrder,netOrder,vertexDimension,netDimension}_<K>K``, its row parts and its column parts."""
    at = lambda what: f"{folder}/{name}_{what}_{k}K"
    return m.reorder(read_order(spark, at("vertexOrder")), read_order(spark, at("netOrder"))), read_dimensions(spark, at("vertexDimension")), read_dimensions(spark, at("netDimension"))


def load_power_of_2_order(spark: SparkSession, m: SparseMatrix, stem: str) -> tuple[SparseMatrix, DataFrame]:
    """The matrix with rows in the order of ``<stem>.partVector``, and its parts (count in ``<stem>.stats``)."""
    from ..operators.partition import from_part_vector, order_from_part_vector

    parts, vector = read_part_count(spark, f"{stem}.stats"), read_part_vector(spark, f"{stem}.partVector")
    return m.reorder(order_from_part_vector(vector, parts)), from_part_vector(vector, parts)
