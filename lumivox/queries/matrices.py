"""Queries on sparse matrices; the matrix is suppliers by parts, valued with quantities."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumivox import grid as g
from lumivox.operators import sparse as sp
from lumivox.queries import query

COO = "WITH coo AS (SELECT l_suppkey AS row, l_partkey AS col, sum(l_quantity) AS val FROM lineitem GROUP BY ALL) "


def coo(spark, sf_dir):
    lines = g.table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.sum("l_quantity").alias("val"))


@query(COO + "SELECT row, col, round(val, 6) + 0.0 AS val FROM coo WHERE val <> 0")
def coo_nonzeros(spark, sf_dir):
    return coo(spark, sf_dir).where("val <> 0").select("row", "col", g.rounded("val").alias("val"))


@query(COO + "SELECT row, count(*) AS n FROM coo WHERE val <> 0 GROUP BY row")
def nonzeros_rows(spark, sf_dir):
    return coo(spark, sf_dir).where("val <> 0").groupBy("row").agg(F.count("*").alias("n"))


@query(COO + "SELECT col, round(sum(val), 6) + 0.0 AS total FROM coo GROUP BY col")
def coo_sumcol(spark, sf_dir):
    return sp.column_sums(coo(spark, sf_dir)).withColumn("total", g.rounded("total"))


@query(COO + "SELECT row AS id, round(sum(val * p_retailprice), 4) + 0.0 AS y FROM coo JOIN part ON p_partkey = col GROUP BY row")
def coo_spmv(spark, sf_dir):
    x = g.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("x"))
    return sp.multiply(coo(spark, sf_dir), x).withColumn("y", g.rounded("y", 4))


@query(COO + "SELECT col AS id, round(sum(val * s_acctbal), 4) + 0.0 AS y FROM coo JOIN supplier ON s_suppkey = row GROUP BY col")
def coo_spmtv(spark, sf_dir):
    x = g.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"))
    return sp.multiply(coo(spark, sf_dir), x, transposed=True).withColumn("y", g.rounded("y", 4))


@query(COO + ", n AS (SELECT row, count(*) AS n FROM coo GROUP BY row) SELECT row, CAST(coalesce(sum(n) OVER (ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr, n FROM n")
def mat2csr_ptr(spark, sf_dir):
    return sp.row_pointers(coo(spark, sf_dir))


@query(COO + "SELECT row, CAST(row_number() OVER (PARTITION BY row ORDER BY col) - 1 AS INTEGER) AS slot, col, round(val, 6) + 0.0 AS val FROM coo")
def mat2ell(spark, sf_dir):
    return sp.slots(coo(spark, sf_dir)).withColumn("val", g.rounded("val"))
