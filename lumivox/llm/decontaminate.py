"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Every benchmark item is covered by overlapping segments. A segment of m bytes within
k edits of some region of a document shares at least m - q + 1 - k * q of its
q-grams with it, all on k + 1 neighbouring diagonals. Shared q-grams are counted in
overlapping bands of diagonals; only bands that reach that number are aligned.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox.llm.common import filtered, id_and_text, slices, table
from lumivox.llm.edit import banded_find
from lumivox.llm.substring_dedup import stretches

#: Bytes of a q-gram: they are read as one 64-bit number.
Q = 8
#: Bytes of a segment and from one segment's start to the next.
SEGMENT, STRIDE = 64, 32
#: Edits per byte of a segment.
BUDGET = 0.1
#: Benchmark text that one index takes, in bytes, and document text that meets an index in one task.
BLOCK_BYTES, TASK_BYTES = 8 << 20, 64 << 20
#: Text bytes whose q-grams are looked up at a time, and shared q-grams that are counted at a time.
LOOK_BYTES, ENTRIES = 1 << 20, 1 << 20
#: Bytes of text in which all q-grams of a segment and a band lie.
REACH = 2 * SEGMENT
#: Counters of hits by hash of segment and band, a power of two.
CELLS = 1 << 20
FOUND = "doc_id long, item_id long, n_segments long, first_byte long, last_byte long, least_edits int"
RESULT = pa.schema([(x.split()[0], pa.int32() if x.endswith(" int") else pa.int64()) for x in FOUND.split(", ")])
#: Fixed value: capitals A-Z to small letters.
SMALL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def normal(text: str | None) -> bytes:
    """UTF-8 with small letters a-z and single spaces between words."""
    parts = (b" ".join(x.split()) for x in stretches((text or "").encode().translate(SMALL)))
    return b" ".join(x for x in parts if x)


def grams(text: bytes) -> np.ndarray:
    """All q-grams of a text as numbers, by place."""
    n = len(text) - Q + 1
    return np.ndarray((n,), "<u8", text, strides=(1,)).copy() if n > 0 else np.empty(0, np.uint64)


class Index:
    """q-grams of the segments of one block of items."""

    def __init__(self, items: list[tuple[int, str | None]]):
        segments: dict[bytes, list[int]] = {}
        for item, text in items:
            whole = normal(text)
            if len(whole) >= Q:
                last = max(0, len(whole) - SEGMENT)
                for at in sorted({*range(0, last, STRIDE), last}):
                    owners = segments.setdefault(whole[at : at + SEGMENT], [])
                    if item not in owners:
                        owners.append(item)
        self.segments, self.owners = list(segments), list(segments.values())
        lengths = np.array(list(map(len, self.segments)), np.int64)
        # a budget is only as large as leaves the lemma a positive number of q-grams
        self.most = np.minimum((lengths * BUDGET + 1e-9).astype(np.int64), (lengths - Q) // Q)
        self.needed = lengths - Q + 1 - self.most * Q
        each = [grams(s) for s in self.segments]
        values = np.concatenate(each or [np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(each), dtype=np.int32), list(map(len, each)))
        place = np.concatenate([np.arange(len(g), dtype=np.uint8) for g in each] or [np.empty(0, np.uint8)])
        order = np.argsort(values, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.values, self.first = np.unique(values[order], return_index=True)
        self.number = np.diff(np.append(self.first, len(values)))
        self.bits = max(16, int(len(self.values)).bit_length() + 3)
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self.slot(self.values)] = True

    def slot(self, values: np.ndarray) -> np.ndarray:
        return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def shared(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places in the text whose q-gram some segment has, and the q-gram's number in the index."""
        places, numbers = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for begin in range(0, len(text) - Q + 1 if len(self.values) else 0, LOOK_BYTES):
            n = min(LOOK_BYTES, len(text) - Q + 1 - begin)
            values = np.ndarray((n,), "<u8", text, offset=begin, strides=(1,))
            at = np.flatnonzero(self.maybe[self.slot(values)])
            found = np.minimum(np.searchsorted(self.values, values[at]), len(self.values) - 1)
            same = self.values[found] == values[at]
            places.append(at[same] + begin)
            numbers.append(found[same])
        return np.concatenate(places), np.concatenate(numbers)

    def hits(self, text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Segment, place in the segment and place in the text of every shared q-gram.

        They come in parts of about ENTRIES; a part begins REACH before the last one
        ended, so every band of a segment lies whole in one of them.
        """
        at, found = self.shared(text)
        upto = np.cumsum(self.number[found])
        begin = 0
        while begin < len(at):
            back = np.searchsorted(at, at[begin] - REACH)
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + ENTRIES, side="right")))
            own = found[back:end]
            number = self.number[own]
            entry = np.repeat(self.first[own] - (np.cumsum(number) - number), number) + np.arange(number.sum())
            yield self.owner[entry].astype(np.int64), self.place[entry].astype(np.int64), np.repeat(at[back:end], number)
            begin = end

    def crowded(self, owner: np.ndarray, place: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mask of the hits in bands that may share enough q-grams: repeats and other bands count too."""
        if not len(owner):
            return np.zeros(0, bool)
        band = (at - place) // (self.most[owner] + 1)
        needed = self.needed[owner]
        cells = [((owner * 0x9E3779B1 + b * 0x85EBCA6B) >> 5) & CELLS - 1 for b in (band, band - 1)]
        counts = np.bincount(cells[0], minlength=CELLS) + np.bincount(cells[1], minlength=CELLS)
        return (counts[cells[0]] >= needed) | (counts[cells[1]] >= needed)

    def bands(self, owner: np.ndarray, place: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
        """(segment, lowest diagonal) of the bands that share enough q-grams of the segment."""
        if not len(owner):
            return
        width = self.most[owner] + 1
        band = (at - place) // width
        owners, bands, places = np.tile(owner, 2), np.concatenate([band, band - 1]), np.tile(place, 2)
        order = np.lexsort((places, bands, owners))
        owners, bands, places = owners[order], bands[order], places[order]
        new = np.append(True, (owners[1:] != owners[:-1]) | (bands[1:] != bands[:-1]))
        distinct = new | np.append(True, places[1:] != places[:-1])
        starts = np.flatnonzero(new)
        enough = np.add.reduceat(distinct.astype(np.int64), starts) >= self.needed[owners[starts]]
        for s, b in zip(owners[starts[enough]].tolist(), bands[starts[enough]].tolist()):
            yield s, b * int(self.most[s] + 1)

    def matches(self, text: bytes, hits: tuple[np.ndarray, np.ndarray, np.ndarray], found: dict[int, tuple[int, int, int]]) -> None:
        """Put the best (edits, start, end) of every segment found in a normal text into ``found``."""
        for s, lowest in self.bands(*hits):
            if s in found and not found[s][0] and found[s][1] <= max(0, lowest):
                continue  # nothing better comes after an exact match
            most, segment = int(self.most[s]), self.segments[s]
            highest = lowest + 2 * most + 1  # an alignment's diagonals all lie in one of the two bands they share
            base = max(0, lowest)
            region = text[base : max(0, highest + len(segment))]
            if (at := region.find(segment)) >= 0:
                best = (0, at, at + len(segment))
            else:
                best = banded_find(segment, region, lowest - base, highest - base, most)
            if best is not None:
                new = (best[0], base + best[1], base + best[2])
                found[s] = min(found.get(s, new), new)

    def by_item(self, found: dict[int, tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        """(item, segments, first byte, last byte, least edits) of every item that has a segment in ``found``."""
        items: dict[int, list[tuple[int, int, int]]] = {}
        for s, best in found.items():
            for item in self.owners[s]:
                items.setdefault(item, []).append(best)
        return [(item, len(own), min(x[1] for x in own), max(x[2] for x in own), min(x[0] for x in own)) for item, own in sorted(items.items())]


def matches_of(index: Index, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int, int, int, int]]]]:
    """(number of the text, its matches) of the texts that have any."""
    forms = [normal(x) for x in texts]
    # line feeds part the texts: no normal text has any, so no q-gram of a segment lies across
    ends = np.cumsum([len(x) + 1 for x in forms])
    found: dict[int, dict[int, tuple[int, int, int]]] = {}
    exact, last = np.zeros(len(index.segments), bool), -1  # segments that the last text of the part before has as they are
    for owner, place, at in index.hits(b"\n".join(forms) + b"\n"):
        doc = np.searchsorted(ends, at, side="right")
        now = int(doc[-1])
        keep = index.crowded(owner, place, at)
        keep[keep] = ~(exact[owner[keep]] & (doc[keep] == last))
        owner, place, at, doc = owner[keep], place[keep], at[keep], doc[keep]
        cuts = np.searchsorted(doc, np.arange(len(forms) + 1))
        # a document with fewer hits than the easiest segment needs can't match
        for d in np.flatnonzero(np.diff(cuts) >= index.needed.min()).tolist():
            own = slice(cuts[d], cuts[d + 1])
            begin = int(ends[d]) - len(forms[d]) - 1
            index.matches(forms[d], (owner[own], place[own], at[own] - begin), found.setdefault(d, {}))
        exact[:] = False
        exact[[s for s, best in found.get(now, {}).items() if not best[0]]] = True
        last = now
    yield from ((d, index.by_item(own)) for d, own in found.items() if own)


_indexes: dict[str, Index] = {}


def index_of(items: Broadcast) -> Index:
    """The index of broadcast items, made once in each Python worker."""
    key, rows = items.value
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = Index(rows)
    return _indexes[key]


def rows_of(index: Index, docs: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in slices(docs):
        ids = part.column("doc_id").to_pylist()
        rows = [(ids[d], *m) for d, found in matches_of(index, part.column("text").to_pylist()) for m in found]
        columns = list(zip(*rows)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RESULT)], schema=RESULT)


def items_of(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """(item_id, text) of the items that count, and in how many blocks of about ``block_bytes`` they are taken."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text"))
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items, max(1, -(-total // block_bytes))


def broadcast_items(items: DataFrame) -> Broadcast:
    return items.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, sorted((r.item_id, r.text) for r in items.collect())))


def in_blocks(docs: DataFrame, items: DataFrame, blocks: int) -> DataFrame:
    """Matches of (doc_id, text) with a benchmark that is too large to broadcast.

    Every block of items meets every part of the documents in a task of its own, which
    makes the block's index; documents are sent once for each block.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // TASK_BYTES
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    texts = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("part"), every(blocks).alias("block"))
    marked = items.select("item_id", "text", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part"))

    def run(texts: pa.Table, items: pa.Table) -> pa.Table:
        index = Index(sorted(zip(items.column("item_id").to_pylist(), items.column("text").to_pylist())))
        return pa.Table.from_batches([x for batch in texts.to_batches() for x in rows_of(index, batch)], RESULT)

    return texts.groupBy("block", "part").cogroup(marked.groupBy("block", "part")).applyInArrow(run, FOUND)


def leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and benchmark item that it holds a segment of.

    Columns: doc_id, item_id, n_segments (distinct segments found), first_byte and
    last_byte (the span of all of them in the document's normal text), least_edits.
    Both sides are compared in small letters a-z with single spaces between words. A
    segment of 64 bytes may have 6 edits; shorter items are one segment with a tenth
    of their bytes, less where the lemma asks for it; items of under 8 bytes match
    nothing. Null and empty texts on either side match nothing; rows that repeat give
    the same rows again; null doc_ids are kept as they are; without items or
    documents the result is empty.

    A benchmark of up to ``block_bytes`` is broadcast, and the documents are read once
    without a shuffle. A larger one is dealt into blocks by a hash of item_id, and every
    block meets every part of the documents.
    """
    base = id_and_text(docs)
    items, blocks = items_of(benchmark, block_bytes)
    if blocks > 1:
        return in_blocks(base, items, blocks)
    known = broadcast_items(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from rows_of(index_of(known), batch)

    return base.mapInArrow(run, FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a leak, with all their columns, by the same rules; each row is judged by its own text."""
    items, blocks = items_of(benchmark, block_bytes)
    if blocks > 1:
        # texts stand for themselves here: ids may be null, or repeat with other texts
        texts = docs.select(F.xxhash64(docs["text"]).alias("doc_id"), docs["text"].cast("string").alias("text")).where("text IS NOT NULL").distinct()
        leaky = in_blocks(texts, items, blocks).select(F.col("doc_id").alias("hash of a leaky text")).distinct()
        return docs.join(leaky, F.xxhash64(docs["text"]) == leaky["hash of a leaky text"], "left_anti")
    known = broadcast_items(items)

    def keep(part: pa.RecordBatch) -> list[bool]:
        leaky = {d for d, _ in matches_of(index_of(known), part.column("text").to_pylist())}
        return [d not in leaky for d in range(part.num_rows)]

    return filtered(docs, keep)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
