import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def same_rows(df, duck, sql):
    """The DataFrame has the rows and columns of the SQL."""
    columns = df.columns
    assert sorted(columns) == sorted(duck.sql(sql).columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(r) for r in df.collect()), key=key)
    want = sorted(duck.sql(f"select {', '.join(columns)} from ({sql})").fetchall(), key=key)
    assert got == want


def skewed(spark):
    """Part x supplier with rows of very unequal length, so that both regions of a hybrid have entries."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from gridloom.plans import tables

    m = tables.ps(spark, DATA)
    k = F.row_number().over(Window.partitionBy("i").orderBy("j"))
    most = F.when(F.col("i") % 50 == 0, 1000).otherwise(1 + F.col("i") % 3)
    return m.with_entries(m.entries.withColumn("k", k).where(F.col("k") <= most).drop("k"))
