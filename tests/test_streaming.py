from pyspark.sql import functions as F

from lumivox.grid import table
from lumivox.streaming import rates


def test_event_rate_as_in_batch(spark, data, tmp_path):
    events = table(spark, data, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = rates.event_rate(rates.read_events(spark, str(tmp_path / "in"), 10), lateness="90 days")
    running = stream.writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    running.awaitTermination(120)
    batch = events.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")
    assert {tuple(r) for r in spark.table("rates").select("start", "n").collect()} == {tuple(r) for r in batch.collect()}


def test_coincidences(spark, data):
    events = table(spark, data, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first, second = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")
    found = {tuple(r) for r in rates.coincidences(first, second, "6 hours").collect()}
    a, b = first.collect(), second.collect()
    assert found == {(x.event_id, y.event_id) for x in a for y in b if x.user_id == y.user_id and abs((x.ts - y.ts).total_seconds()) <= 6 * 3600}
