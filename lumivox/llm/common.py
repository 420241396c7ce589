"""What several corpus operators share: reading, cutting lineage, batches, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step holds at a time.
STEP_BYTES = 1 << 21
#: Links that one partition holds, and that are joined in memory at a time.
LINKS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or else the one that was given to the context.

    Where there is neither, and Spark runs on this machine alone, a new local one.
    """
    path, given = spark.conf.get("spark.checkpoint.dir", None), spark._jsc.sc().getCheckpointDir()
    if given.isEmpty():
        if not path:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(path)
    return path or given.get() if given.isDefined() else path


def cut(df: DataFrame, most_rows: int | None = None) -> DataFrame:
    """Compute the rows once and keep them in the shared folder, without lineage.

    Where their number is known to be at most ``most_rows``, few rows don't stay in many partitions.
    """
    shared_dir(df.sparkSession)
    return (df if most_rows is None else df.coalesce(1 + most_rows // LINKS)).checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again: wide rows stay compressed."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filtered(docs: DataFrame, keep: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    """Rows of documents, with all their columns, that ``keep`` marks; it sees parts of a few MB of text.

    Each row is judged by itself, so nothing is shuffled. Other columns pass by,
    whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(keep(part), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that operators read; others, whatever their names, stay out.

    Columns of the right type are taken as they are: an alias would keep Spark from
    seeing that two joins need the same exchange.
    """
    kinds = dict(docs.dtypes)
    wanted = {"doc_id": "bigint", "text": "string"}
    return docs.select(*(docs[c] if kinds[c] == kind else docs[c].cast(kind).alias(c) for c, kind in wanted.items()))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` text bytes, each of at least one row."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = held = 0
    for at, size in enumerate(sizes):
        if at > start and held + size > most:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def joined(pairs: np.ndarray) -> np.ndarray:
    """The same components as stars: each node once, beside the smallest node that these links reach from it."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for u, v in pairs.tolist():
        if (x := find(u)) != (y := find(v)):
            root[max(x, y)] = min(x, y)
    stars = [(x, y) for x in root if (y := find(x)) != x]
    return np.array(stars, np.int64).reshape(-1, 2)


def contracted(edges: DataFrame) -> DataFrame:
    """(u, v) with the same components: every LINKS links of a partition have become stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars() -> pa.RecordBatch:
            found = joined(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])

        held, size = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1))
            size += batch.num_rows
            if size >= LINKS:
                yield stars()
                held, size = [], 0
        if held:
            yield stars()

    return edges.mapInArrow(run, "u long, v long")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the links; root is the smallest node reachable.

    Links that lie together are joined first. Then alternating large and small stars:
    every round is two grouped minima and two joins, so no component of more than
    LINKS links ever meets in one task. Rounds end when the edges stay as they are;
    fewer than LINKS links need none. Without links the result is empty.
    """
    edges = cut(links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u != v"))
    mark = F.struct(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))))
    n = edges.count()
    edges = cut(contracted(edges.coalesce(1 + n // LINKS)).distinct(), n)
    before = edges.agg(mark).first()[0] if n >= LINKS else [0]  # fewer have all been joined in one task
    while before[0]:
        few = 1 + n // LINKS
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(few)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(few).distinct(), n)
        now = edges.agg(mark).first()[0]
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
