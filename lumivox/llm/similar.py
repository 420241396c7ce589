"""Near-duplicates at a similarity: several SimHashes, multi-index hashing, shingles decide.

A document has three 64-bit SimHashes of its word pairs, cut into eight segments of 24
bits. Each segment is looked up with all values that differ from it in one bit, among those
that have half of its bits in common, which lie together; what meets and differs in few bits
of all is compared by the sets of five-word shingles.
Pairs of words change half as much as shingles where a word is replaced, so texts
of a similarity of 0.8 differ in about a tenth of the bits and most meet in some segment.

Texts of the same words are one node. Each node is first held against one leader of the
segments it falls into, and only pairs across the groups so found are looked for after that.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox.llm.common import components, cut, id_and_text, slices
from lumivox.llm.fingerprints import LOWER, majorities
from lumivox.llm.ngram_join import shingles
from lumivox.llm.substring_dedup import batches_of, mixed, run_sums, word_hashes

#: Words of a shingle, and the share of two documents' shingles that must be common.
WIDTH, PERCENT = 5, 80
#: Words of a feature of the fingerprints; fingerprints, and the odd numbers that set them apart.
FEATURE, SALTS = 2, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Segments of all fingerprints' bits together, and bits of each.
SEGMENTS, SEGMENT_BITS = 8, 24
#: Differing bits of 192 up to which documents are compared; at a similarity of 0.8 about 18 differ, with a deviation of 4.
MOST_BITS = 36
#: Rounds in which nodes are held against one leader each.
ROUNDS = 2
#: Bits of a segment's halves: if two segments differ in one bit, a half of them is the same.
HALF_BITS = SEGMENT_BITS // 2
#: Rows that a bucket of such halves has about, and pairs that are compared at a time.
BUCKET_ROWS, PAIRS = 50_000, 1 << 19
#: Ids that are sent to every task (8 bytes each) to fetch texts; more are joined by a shuffle.
SENT_IDS = 500_000
#: Rows that a Python worker gets at a time; sets of shingles are wide.
BATCH_ROWS = 1000
PRINTS = [f"f{i}" for i in range(len(SALTS))]


def signatures(part: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Signature and word hashes of each text, A-Z in lower case."""
    texts = [(x or "").encode("utf-8", "surrogatepass").translate(LOWER) for x in part.column("text").to_pylist()]
    words, _, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    for start, end in zip((ends - counts).tolist(), ends.tolist()):
        own = words[start:end]
        yield xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63), own


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, sig, f0 .. f2, keys): fingerprints of every text, and the segments with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = list(signatures(part))
                features = [run_sums(w, np.arange(max(1, len(w) - FEATURE + 1)), min(FEATURE, len(w))) if len(w) else w for _, w in found]
                counts, hashes = np.array([len(x) for x in features]), np.concatenate(features)
                prints = np.stack([majorities(mixed(hashes ^ np.uint64(salt)), counts) for salt in SALTS], axis=1)
                bits = prints.view(np.uint8).reshape(len(found), SEGMENTS, -1).astype(np.int64)
                keys = (bits << (8 * np.arange(bits.shape[2]))).sum(axis=2) | (np.arange(SEGMENTS) << SEGMENT_BITS)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * SEGMENTS, pa.int32()), pa.array(keys.ravel()))
                columns = [part.column("doc_id"), pa.array([sig for sig, _ in found], pa.int64()), *(pa.array(np.ascontiguousarray(prints[:, i]).view(np.int64)) for i in range(len(SALTS))), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sig", *PRINTS, "keys"])

    return docs.mapInArrow(run, "doc_id long, sig long, " + ", ".join(f"{f} long" for f in PRINTS) + ", keys array<long>")


def dealt(nodes: DataFrame) -> DataFrame:
    """(bucket, half, key, sig, f0 .. f2, root): each node's segments, once for either half of their bits that others must have in common."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 1 + 2 * SEGMENTS * nodes.count() // BUCKET_ROWS
    # nodes are few bytes that become many rows, so Spark must not put them together
    rows = nodes.repartition(parts, "sig").select("sig", *PRINTS, "root", F.explode("keys").alias("key")).withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    low, high = (1 << HALF_BITS) - 1, (1 << SEGMENT_BITS) - (1 << HALF_BITS)
    common = F.col("key") - F.col("key").bitwiseAND(F.when(F.col("half") == 0, F.lit(high).cast("long")).otherwise(F.lit(low).cast("long")))
    return rows.select(F.pmod(F.xxhash64("half", common), F.lit(buckets)).cast("int").alias("bucket"), "half", "key", "sig", *PRINTS, "root")


class Bucket:
    """Rows of a bucket by half, segment and root; a segment one bit apart from another one lies in the same bucket."""

    def __init__(self, rows: pa.Table):
        codes = rows.column("half").to_numpy().astype(np.int64) << 32 | rows.column("key").to_numpy()
        roots = rows.column("root").to_numpy()
        order = np.lexsort((roots, codes))
        self.sigs, self.roots = rows.column("sig").to_numpy()[order], roots[order]
        self.prints = np.stack([rows.column(p).to_numpy()[order] for p in PRINTS]).view(np.uint64)
        self.codes, self.starts, self.which = np.unique(codes[order], return_index=True, return_inverse=True)
        self.ends = np.append(self.starts[1:], len(order))

    def lookups(self) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Places in ``codes`` and of what is looked up there: each code itself, then all with one more bit set in the half that may differ.

        Each pair one bit apart is met from its lower key; equal keys lie in both halves and are looked up in the first.
        """
        own = np.flatnonzero(self.codes >> 32 == 0)
        yield own, own, True
        for bit in range(HALF_BITS):
            wanted = self.codes | np.where(self.codes >> 32 == 0, 1 << (HALF_BITS + bit), 1 << bit)
            at = np.minimum(np.searchsorted(self.codes, wanted), len(self.codes) - 1)
            hit = np.flatnonzero((self.codes[at] == wanted) & (wanted != self.codes))
            yield hit, at[hit], False

    def rows_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows of some codes, and the place among these that each is of."""
        sizes = self.ends[codes] - self.starts[codes]
        own = np.repeat(np.arange(len(codes)), sizes)
        return spread(self.starts[codes], sizes), own

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits in which all fingerprints differ."""
        return sum(np.bitwise_count(p[i] ^ p[j]).astype(np.int64) for p in self.prints)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of ranges, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def one_each(nodes: DataFrame, turn: int) -> DataFrame:
    """(a, b): for every node the nearest leader of another group that leads a segment looked up; leaders change from turn to turn."""
    salt = np.uint64(SALTS[turn % len(SALTS)])

    def run(rows: pa.Table) -> pa.Table:
        own = Bucket(rows)
        ranks = mixed(own.sigs.view(np.uint64) ^ salt)
        order = np.lexsort((ranks, own.which))
        leaders = order[own.starts]
        bits, found = np.full(len(order), MOST_BITS + 1), np.zeros(len(order), np.int64)
        for asking, there, _ in own.lookups():
            i, at = own.rows_of(asking)
            j = leaders[there[at]]
            away = own.apart(i, j)
            near = (own.roots[i] != own.roots[j]) & ((away < bits[i]) | (away == bits[i]) & (away <= MOST_BITS) & (own.sigs[j] < found[i]))
            bits[i[near]], found[i[near]] = away[near], own.sigs[j[near]]
        met = np.flatnonzero(bits <= MOST_BITS)
        met = met[np.lexsort((found[met], bits[met], own.sigs[met]))]
        met = met[np.append(True, own.sigs[met][1:] != own.sigs[met][:-1])[: len(met)]]
        return pa.table([pa.array(own.sigs[met]), pa.array(bits[met].astype(np.int32)), pa.array(found[met])], ["a", "bits", "b"])

    met = dealt(nodes).groupBy("bucket").applyInArrow(run, "a long, bits int, b long")
    return met.groupBy("a").agg(F.min(F.struct("bits", "b")).alias("x")).select("a", "x.b")


def across(nodes: DataFrame) -> DataFrame:
    """(a, b): all pairs of different groups that meet in a segment and differ in few bits; pairs of one group are not looked at."""

    def run(rows: pa.Table) -> pa.Table:
        own = Bucket(rows)
        kinds, number = np.unique(own.roots, return_inverse=True)
        places, found = own.which * len(kinds) + number, [np.empty((2, 0), np.int64)]
        for asking, there, same in own.lookups():
            i, at = own.rows_of(asking)
            there = there[at]
            # rows of a code lie by root: those of the asking row's root are one stretch, the others lie before and after
            low, high = (np.searchsorted(places, there * len(kinds) + number[i], side) for side in ("left", "right"))
            for starts, ends in ([] if same else [(own.starts[there], low)]) + [(high, own.ends[there])]:
                sizes = ends - starts
                part = (np.cumsum(sizes) - sizes) // PAIRS
                for cuts in np.split(np.arange(len(i)), np.flatnonzero(np.diff(part)) + 1):
                    x, y = np.repeat(i[cuts], sizes[cuts]), spread(starts[cuts], sizes[cuts])
                    near = own.apart(x, y) <= MOST_BITS
                    x, y = own.sigs[x[near]], own.sigs[y[near]]
                    found.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
        pairs = np.unique(np.concatenate(found, 1), axis=1)
        return pa.table([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return dealt(nodes).groupBy("bucket").applyInArrow(run, "a long, b long").distinct()


def shingle_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(sig, shingles): sets of the texts of some documents, one row for texts of the same words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            rows = [(sig, shingles(w, width).tobytes()) for sig, w in signatures(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["sig", "shingles"])

    ids = cut(ids)
    few = ids.count() <= SENT_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").mapInArrow(run, "sig long, shingles binary").groupBy("sig").agg(F.min("shingles").alias("shingles"))


def alike(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose shingles are as alike as asked."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    sets = cut(shingle_sets(docs, nodes.join(wanted, "sig", "left_semi").select(F.col("first").alias("doc_id")).distinct(), width))
    left, right = (sets.select(F.col("sig").alias(s), F.col("shingles").alias(c)) for s, c in (("a", "x"), ("b", "y")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                keep.append(100 * common >= percent * (len(x) // 8 + len(y) // 8 - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Profiles of all rows, and the nodes with the roots of their groups, both computed."""
    rows = cut(profiles(docs))
    nodes = cut(rows.groupBy("sig").agg(F.min("doc_id").alias("first"), F.min(F.struct(*PRINTS, "keys")).alias("p")).select("sig", "first", "p.*")).withColumn("root", F.col("sig"))
    links = None
    for turn in range(ROUNDS + 1):
        pairs = cut(one_each(nodes, turn) if turn < ROUNDS else across(nodes))
        found = cut(alike(pairs, docs, nodes, width, percent))
        links = found if links is None else links.unionByName(found)
        roots = components(links, "a", "b").select(F.col("node").alias("sig"), F.col("root").alias("found"))
        nodes = cut(nodes.drop("root").join(roots, "sig", "left").withColumn("root", F.coalesce("found", "sig")).drop("found"))
    return rows, nodes


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_ROWS for what is computed meanwhile."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def similar_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, component_id) of every document with an id: the smallest doc_id that links reach.

    Documents link if percent of their distinct shingles of ``width`` words are common
    (A-Z in lower case; fewer words are one shingle) and their fingerprints meet; texts
    of the same words, and so all without any, always link. Rows of one doc_id with other
    texts are judged apart, and each has a row. No rows give no rows.

    Words and texts are told apart by 64-bit hashes: among a billion texts two would be taken
    for one with a chance of 3 %.
    """
    docs = id_and_text(docs).where("doc_id IS NOT NULL")
    with small_batches(docs.sparkSession):
        rows, nodes = grouped(docs, width, percent)
    ids = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    by_sig = nodes.select("sig", "root").join(ids, "root").select("sig", "component_id")
    return rows.select("doc_id", "sig").join(by_sig, "sig").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, of which doc_id is its group's smallest.

    Of a tie nothing is left to choose: the smallest doc_id of a group is one. Null and
    empty texts are one group. Rows that repeat a doc_id are all kept, unless one of
    them lies in a group with a smaller doc_id; null ids stay. No rows give no rows.
    """
    found = similar_groups(docs, width, percent)
    dropped = found.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
