"""Sparse matrices as coordinate tables (row, col, val)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def multiply(matrix: DataFrame, vector: DataFrame, transposed: bool = False) -> DataFrame:
    """Matrix times vector(id, x): a join on the inner index and a sum by the outer one."""
    inner, outer = ("row", "col") if transposed else ("col", "row")
    return matrix.join(vector, matrix[inner] == vector["id"]).groupBy(F.col(outer).alias("id")).agg(F.sum(F.col("val") * F.col("x")).alias("y"))


def column_sums(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("col").agg(F.sum("val").alias("total"))


def row_pointers(matrix: DataFrame) -> DataFrame:
    """(row, ptr, n): where each row's entries begin in row order, and how many it has.

    Rows are counted first, so the running sum is over rows only; it is taken in
    blocks of rows, and block totals alone meet in one place.
    """
    counts = matrix.groupBy("row").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("row") / 4096))
    totals = counts.groupBy("block").agg(F.sum("n").alias("total"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return inside.join(offsets, "block").select("row", (F.col("offset") + F.col("inside")).alias("ptr"), "n")


def slots(matrix: DataFrame) -> DataFrame:
    """(row, slot, col, val): each row's entries in the order of their columns, numbered from 0."""
    order = Window.partitionBy("row").orderBy("col")
    return matrix.select("row", (F.row_number().over(order) - 1).alias("slot"), "col", "val")
