"""Running numbers within keys, however many rows one key has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from lumivox.llm.common import cut

#: Rows that one range holds, about.
RANGE_ROWS = 250_000


def numbered(rows: DataFrame, key: str, order: list[str], count: int) -> DataFrame:
    """The rows with ``at`` (from 0, gapless in each ``key``, by ``order``, nulls first) and ``n`` (rows of the key).

    Rows are dealt into ranges of key and order, so a key with most of the rows lies in
    many of them; only the ranges' counts are summed in order. ``count`` is their
    number, at least about. Rows alike in key and order go to any range: a running
    number parts them. ``key`` must not be null. No rows give no rows.
    """
    session = rows.sparkSession
    ranges = max(int(session.conf.get("spark.sql.shuffle.partitions")), 1 + count // RANGE_ROWS)
    kept = cut(rows)  # ranges are fitted on a sample, which would compute the rows once more
    apart = kept.withColumn("tie", F.monotonically_increasing_id())
    ranged = apart.repartitionByRange(ranges, key, *order, "tie").sortWithinPartitions(key, *order).drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, nth = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            steps = np.empty(batch.num_rows, np.int64)
            for i, x in enumerate(batch.column(key).to_pylist()):
                nth = nth + 1 if x == last else 0
                last, steps[i] = x, nth
            extra = [pa.array(np.full(batch.num_rows, part, np.int64)), pa.array(steps)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "part", "nth"])

    schema = StructType([*ranged.schema.fields]).add("part", LongType()).add("nth", LongType())
    found = cut(ranged.mapInArrow(run, schema))
    sizes = found.groupBy("part", key).agg((F.max("nth") + 1).alias("size"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", key, F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"), F.sum("size").over(Window.partitionBy(key)).alias("n"))
    return found.join(offsets, ["part", key]).withColumn("at", F.col("offset") + F.col("nth")).drop("part", "nth", "offset")


def told_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Documents (doc_id, text) in which no doc_id has two texts, and whose numbers are whose.

    Where no doc_id repeats with another text, the documents are returned as they are.
    Otherwise every (doc_id, text) has a running number in place of its id, in the
    order of doc_id and the text's hash, and the second frame has (number, doc_id, mark),
    ``mark`` being ``text_mark``. Rows that repeat a doc_id with its text share a number.
    Only ids are read as long as none repeats.
    """
    repeated = docs.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return docs, None
    marked = docs.withColumn("mark", text_mark("text"))
    seen = cut(marked.select("doc_id", "mark").distinct())
    several = seen.groupBy("doc_id").count().where("count > 1")
    if several.isEmpty():
        return docs, None
    names = cut(numbered(seen.withColumn("all", F.lit("all")), "all", ["doc_id", "mark"], seen.count()).select(F.col("at").alias("number"), "doc_id", "mark"))
    return marked.join(names, ["doc_id", "mark"]).select(F.col("number").alias("doc_id"), "text"), names


def text_mark(column: str) -> Column:
    """A text's 64-bit hash: two texts of one doc_id are taken for one with a chance of 2^-64."""
    return F.xxhash64(column)
