"""Segments one bit apart are met, with few rows for each node, against all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from lumivox.llm import similar


def keys_of(prints):
    data = b"".join(int(p).to_bytes(8, "little") for p in prints)
    return [int.from_bytes(data[3 * s : 3 * s + 3], "little") | s << similar.SEGMENT_BITS for s in range(similar.SEGMENTS)]


def made(spark, n=400, kinds=40):
    """Nodes around some fingerprints, and every pair that meets in a segment and differs in few bits."""
    rng = random.Random(2)
    base, rows = [rng.getrandbits(192) for _ in range(kinds)], []
    for i in range(n):
        value = base[rng.randrange(kinds)]
        for bit in rng.sample(range(192), rng.randrange(26)):
            value ^= 1 << bit
        prints = [value >> (64 * k) & (1 << 64) - 1 for k in range(3)]
        rows.append((rng.getrandbits(63), prints, rng.randrange(9)))
    pairs = set()
    for i, (a, p, r) in enumerate(rows):
        for b, q, t in rows[:i]:
            meet = any((x ^ y).bit_count() <= 1 for x, y in zip(keys_of(p), keys_of(q)))
            if r != t and meet and sum((x ^ y).bit_count() for x, y in zip(p, q)) <= similar.MOST_BITS:
                pairs.add((min(a, b), max(a, b)))
    signed = lambda p: [int(x) for x in np.array(p, np.uint64).view(np.int64)]
    nodes = spark.createDataFrame([(a, *signed(p), keys_of(p), r) for a, p, r in rows], "sig long, f0 long, f1 long, f2 long, keys array<long>, root long")
    return nodes, pairs


def test_all_pairs_of_segments_one_bit_apart(spark, monkeypatch):
    nodes, pairs = made(spark)
    assert len(pairs) > 1000
    monkeypatch.setattr(similar, "BUCKET_ROWS", 700)
    monkeypatch.setattr(similar, "PAIRS", 100)
    assert {tuple(r) for r in similar.across(nodes).collect()} == pairs
    for turn in (0, 1):
        found = [(r.a, r.b) for r in similar.one_each(nodes, turn).collect()]
        assert len({a for a, _ in found}) == len(found) > 200 and {(min(p), max(p)) for p in found} <= pairs
    assert similar.across(nodes.withColumn("root", F.lit(1).cast("long"))).count() == 0
    assert similar.across(nodes.limit(0)).count() == similar.one_each(nodes.limit(0), 0).count() == 0


def test_sixteen_rows_for_each_node(spark):
    """Whole balls would be about 100 rows."""
    nodes, _ = made(spark, 50, 5)
    assert similar.dealt(nodes).count() == 16 * 50
