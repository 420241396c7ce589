"""Lookups of fingerprints are never sent through the driver."""

from pyspark.sql import functions as F

from lumivox.llm import near_dedup


def test_lookups_are_not_broadcast(spark):
    """Grouped fingerprints are few bytes to Spark, also after each has become 33 lookups in either half."""
    values = spark.range(0, 3000, 1, 4).select(F.xxhash64(F.col("id") % 900).alias("fp")).unionByName(spark.createDataFrame([(7,), (6,)], "fp long"))
    found = near_dedup.close_pairs(values.groupBy("fp").count().select("fp"))
    found = found.where("a < b")
    assert (6, 7) in {(r.a, r.b) for r in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
