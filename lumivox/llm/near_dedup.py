"""SimHash near-dedup by multi-index hashing over the fingerprint's two halves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox.llm.common import components, cut, id_and_text, slices, table
from lumivox.llm.fingerprints import fingerprint

WIDTH, MOST_BITS = 3, 3
#: Segments of a fingerprint and their bits. Of 3 differing bits, one half has 1 at most.
SEGMENTS, SEGMENT_BITS = 2, 32


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp) of every document; fp is the fingerprint as a signed long, 0 without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fps = np.array([fingerprint(x, width) for x in part.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def segment(fp: Column, at: int) -> Column:
    return F.shiftrightunsigned(fp, at * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1).cast("long"))


def ball(key: Column) -> Column:
    """Keys within one bit, above or equal: each pair one bit apart is met from its lower key."""
    higher = F.array(*(key.bitwiseOR(F.lit(1 << i).cast("long")) for i in range(SEGMENT_BITS)))
    return F.concat(F.array(key), F.array_remove(higher, key))


def close_pairs(values: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct longs in ``fp`` with few differing bits.

    Every fingerprint enters one table per half under that half, and looks up
    there the small Hamming ball around its own half (radius 1, each pair from
    one side); full distances verify what is met. Complete for ``most_bits`` up
    to 3: of two halves one differs in at most one bit.
    """
    if most_bits > 3:
        raise ValueError("two halves and balls of radius 1 find all pairs only up to 3 bits")
    fp = F.col("fp")
    kept = values.select(fp, F.explode(F.array(*(F.struct(F.lit(k).alias("seg"), segment(fp, k).alias("key")) for k in range(SEGMENTS)))).alias("e"))
    entries = kept.select(F.col("e.seg").alias("seg"), F.col("e.key").alias("key"), fp.alias("a"))
    probes = kept.select(F.col("e.seg").alias("seg"), F.explode(ball(F.col("e.key"))).alias("key"), fp.alias("b"))
    # merged, as Spark takes exploded rows for as small as what they come from and would send them all through the driver
    met = entries.join(probes.hint("merge"), ["seg", "key"]).where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most_bits))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    ``fingerprint`` has 16 lowercase hex digits; ``component_id`` is the smallest
    doc_id reachable over links of at most ``most_bits`` bits, itself included.
    Copies share a fingerprint and are grouped before any pair is looked for.
    Null and wordless texts have fingerprint 0, linked like any other; repeated
    rows stay; a null id is never the smallest unless all are null.
    """
    fps = cut(fingerprints(docs, width))
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(close_pairs(firsts.select("fp"), most_bits), "a", "b")
    labelled = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = labelled.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, width: int = WIDTH, most_bits: int = MOST_BITS) -> DataFrame:
    """The documents, with all their columns, of which doc_id is its group's smallest.

    Of a tie nothing is left to choose: the smallest doc_id of a group is one. Null and
    empty texts form one group of their own, by fingerprint 0. Rows that repeat a doc_id
    are all kept, unless one of them lies in a group with a smaller doc_id; null ids stay.
    No rows give no rows.
    """
    found = near_duplicates(docs.where("doc_id IS NOT NULL"), width, most_bits)
    dropped = found.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
