"""Exact substring dedup: fixed-block anchors, rolling probes, maximal repeats.

A window of W words that also occurs elsewhere holds, wherever it occurs, one
whole aligned block of W // 2 words (blocks begin at word 0, W // 2, ... of each
document). So the aligned blocks are the index, every rolling run of W // 2
words is a probe, and only windows around a block that is met twice can repeat.
These hits are extended over their documents' words to all windows around them,
and each distinct window is traced to its first occurrence.

Probes and windows travel packed, one row per batch of documents and bucket of
hashes; what repeats inside a batch is settled there and sent once. A passage
found in a third of all documents thus costs its bucket one entry per batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox.llm.common import id_and_text, slices, table
from lumivox.llm.ordered import told_apart

WINDOW = 20
#: Text bytes whose repeats are settled together before anything is sent.
BATCH_BYTES = 5 << 20
#: Buckets of hashes, at least; text bytes of all documents for each bucket, at most.
BUCKETS, BUCKET_BYTES = 64, 64 << 20
#: Text bytes that are hashed at a time.
HASH_BYTES = 1 << 17
#: Bytes of a word that numpy hashes; longer words go through XXH3.
LONG_WORD = 4096
#: The bytes that part words.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Odd multipliers of the two window hashes, and random values for bytes and for places in a word.
BASES = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
BYTE_VALUES = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
PLACE_VALUES = np.random.default_rng(21).integers(0, 1 << 64, LONG_WORD, dtype=np.uint64) | np.uint64(1)
PARTS = np.isin(np.arange(256), list(SPACES))
SPACE = re.compile(b"[" + re.escape(SPACES) + b"]")
PACKED = "bucket int, kind byte, ids binary, counts binary, places binary, hashes binary"

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for later calls."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(1 << max(10, (n - 1).bit_length()), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def run_sums(values: np.ndarray, starts: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """Polynomial hash of ``width`` values from each start, the same wherever the run lies."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    return mixed((sums[starts + width] - sums[starts]) * powers(pow(base, -1, 1 << 64), len(values) + 1)[starts])


def stretches(text: bytes) -> Iterator[bytes]:
    """A text in parts of about HASH_BYTES that end where a word ends."""
    at = 0
    while len(text) - at > HASH_BYTES:
        cut = SPACE.search(text, at + HASH_BYTES)
        upto = cut.start() if cut else len(text)
        yield text[at:upto]
        at = upto
    yield text[at:] if at else text


def hashed(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and length of every word of some bytes.

    Each byte's value is multiplied by that of its place in the word, so no order of
    letters is special.
    """
    letters = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(letters) + 2, np.int8)
    np.logical_not(PARTS[letters], out=inside[1:-1].view(bool))
    steps = np.diff(inside)
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    lengths = ends - starts
    long = np.flatnonzero(lengths > LONG_WORD)
    for n in long.tolist():
        inside[1 + starts[n] : 1 + ends[n]] = 0
    short = np.where(lengths > LONG_WORD, 0, lengths)
    offsets = np.cumsum(short) - short
    place = np.arange(short.sum(), dtype=np.int32) - np.repeat(offsets.astype(np.int32), short)
    products = BYTE_VALUES[letters[inside[1:-1].view(bool)]] * PLACE_VALUES[place]
    sums = np.zeros(len(products) + 1, np.uint64)
    np.cumsum(products, out=sums[1:])
    hashes = mixed(sums[offsets + short] - sums[offsets] + lengths.astype(np.uint64))
    for n in long.tolist():
        hashes[n] = xxhash.xxh3_64_intdigest(data[starts[n] : ends[n]])
    return hashes, starts, lengths


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and length of every word of all texts in order, and each text's number of words."""
    hashes, lengths, counts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    while at < len(texts):
        if len(texts[at]) > HASH_BYTES:
            parts = [hashed(x) for x in stretches(texts[at])]
            hashes += [x[0] for x in parts]
            lengths += [x[2] for x in parts]
            counts.append(np.array([sum(len(x[0]) for x in parts)]))
            at += 1
            continue
        upto, held = at, 0
        while upto < len(texts) and (upto == at or held + len(texts[upto]) <= HASH_BYTES):
            held += len(texts[upto]) + 1
            upto += 1
        own, starts, sizes = hashed(b" ".join(texts[at:upto]))
        bounds = np.cumsum([len(x) + 1 for x in texts[at:upto]])
        hashes.append(own)
        lengths.append(sizes)
        counts.append(np.diff(np.searchsorted(starts, bounds), prepend=0))
        at = upto
    return np.concatenate(hashes), np.concatenate(lengths), np.concatenate(counts)


def planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on: small numbers leave runs of zeros to compress."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_planes(data: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


class Batch:
    """Documents in ascending id order, as one sequence of word hashes."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], window: int):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.words, _, self.counts = word_hashes([texts[i] for i in order])  # under 2^31 words
        self.first = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(len(ids), dtype=np.int32), self.counts)
        self.place = np.arange(len(self.words), dtype=np.int32) - self.first.astype(np.int32)[self.doc]
        self.window = window

    def runs(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a run of ``width`` words of one document begins, and the runs' hashes."""
        at = np.flatnonzero(self.place + width <= self.counts[self.doc])
        return at, run_sums(self.words, at, width)

    def spread(self, at: np.ndarray, after: int) -> np.ndarray:
        """Mask of the places in [a, a + after) for each a."""
        marks = np.zeros(len(self.words) + after + 1, np.int32)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + after, -1)
        return np.cumsum(marks, dtype=np.int32)[: len(self.words)] > 0

    def packed(self, at: np.ndarray, hashes: np.ndarray, buckets: int, *kept: np.ndarray) -> Iterator[tuple]:
        """One row per bucket of the hashes: documents, entries of each, places, and the ``kept`` numbers one after the other."""
        bucket = (hashes >> np.uint64(40)).astype(np.int64) % buckets
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        ranked = bucket[order]
        cuts = np.append(np.flatnonzero(np.diff(ranked, prepend=-1)), len(ranked))
        at, kept = at[order], [x[order] for x in kept]
        for b, lo, hi in zip(ranked[cuts[:-1]].tolist(), cuts, cuts[1:]):
            yield (b, 0, *self.by_doc(at[lo:hi]), b"".join(x[lo:hi].tobytes() for x in kept))

    def by_doc(self, at: np.ndarray) -> tuple[bytes, bytes, bytes]:
        """Documents, their numbers of entries, and the places as steps from one to the next."""
        docs, first, counts = np.unique(self.doc[at], return_index=True, return_counts=True)
        steps = np.diff(self.place[at], prepend=0)
        steps[first] = self.place[at[first]]
        small = steps.max(initial=0) < 1 << 16
        return planes(self.ids[docs]), planes(counts.astype(np.uint32)), planes(steps.astype(np.uint16 if small else np.uint32))

    def ranges(self, at: np.ndarray, buckets: int) -> Iterator[tuple]:
        """One row per document: the window starts ``at`` as ranges, to be passed on as they are."""
        if len(at):
            new = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(self.doc[at], prepend=-1) != 0))
            last = np.append(new[1:], len(at)) - 1
            pairs = np.stack([self.place[at[new]], self.place[at[last]] + 1], 1).astype(np.int32)
            docs, starts = np.unique(self.doc[at[new]], return_index=True)
            for d, lo, hi in zip(docs.tolist(), starts, np.append(starts[1:], len(pairs))):
                yield (int(self.ids[d]) % buckets, 1, self.ids[d : d + 1].tobytes(), b"", pairs[lo:hi].tobytes(), b"")


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 6
    types = [pa.int32(), pa.int8(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["bucket", "kind", "ids", "counts", "places", "hashes"])


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's rows, dealt anew into batches of about BATCH_BYTES of text."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch):
            held.append(part)
            size += part.column("text").nbytes
            if size >= BATCH_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held and (rows := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield rows[0]


def words_of(batch: pa.RecordBatch, window: int) -> Batch:
    return Batch(batch.column("doc_id").to_numpy(), [(x or "").encode() for x in batch.column("text").to_pylist()], window)


def first_of_each(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the index of its first occurrence in order, and its number of occurrences."""
    order = np.argsort(hashes, kind="stable").astype(np.int32)
    ranked = hashes[order]
    new = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(hashes) else np.empty(0, np.int64)
    counts = np.diff(np.append(new, len(hashes))).astype(np.int32)
    out = np.empty((2, len(hashes)), np.int32)
    out[:, order] = np.repeat(np.stack([order[new], counts]), counts, axis=1)
    return out[0], out[1]


def probes(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Packed rolling probes of every document; windows that repeat in a batch are marked there."""
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            b = words_of(batch, window)
            at, hashes = b.runs(window)
            first, counts = first_of_each(hashes)
            own = at[first == np.arange(len(at))]
            wanted = b.spread(own, window - block + 1)
            block_at, block_hashes = b.runs(block)
            keep = wanted[block_at]
            block_hashes = block_hashes[keep]
            yield rows_of([*b.packed(block_at[keep], block_hashes, buckets, block_hashes.astype(np.uint32)), *b.ranges(at[counts > 1], buckets)])

    return docs.mapInArrow(run, PACKED)


def unpacked(rows: pa.Table, *widths: type) -> list[np.ndarray]:
    """Document and place of every entry of packed rows, and its numbers of the given widths."""
    docs, places = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    kept = [[np.empty(0, w)] for w in widths]
    for row in zip(*(rows.column(c).to_pylist() for c in ("ids", "counts", "places", "hashes"))):
        ids, counts = from_planes(row[0], np.int64), from_planes(row[1], np.uint32).astype(np.int64)
        number, at = int(counts.sum()), 0
        for w, own in zip(widths, kept):
            own.append(np.frombuffer(row[3], w, number, at))
            at += own[-1].nbytes
        steps = from_planes(row[2], np.uint16 if len(row[2]) == 2 * number else np.uint32)
        sums, first = np.cumsum(steps, dtype=np.int64), np.cumsum(counts) - counts
        docs.append(np.repeat(ids, counts))
        places.append((sums - np.repeat(sums[first] - steps[first], counts)).astype(np.int32))
    return [np.concatenate(x) for x in (docs, places, *kept)]


def ranges_by_doc(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
    """Rows (doc_id, ranges): the ranges of each document as pairs of 32-bit integers."""
    order = np.argsort(docs, kind="stable")
    ids, first = np.unique(docs[order], return_index=True)
    pairs = np.stack([starts[order], ends[order]], 1).astype(np.int32)
    return pa.table([pa.array(ids, pa.int64()), pa.array([pairs[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(pairs)))], pa.binary())], ["doc_id", "ranges"])


def passed_on(rows: pa.Table) -> pa.Table:
    ids = [np.frombuffer(x.as_py(), np.int64)[0] for x in rows.column("ids")]
    return pa.table([pa.array(ids, pa.int64()), rows.column("places").cast(pa.binary())], ["doc_id", "ranges"])


def hits(packed: DataFrame, window: int) -> DataFrame:
    """(doc_id, ranges): window starts around every block that is indexed and met twice."""
    block = window // 2

    def run(rows: pa.Table) -> pa.Table:
        kind = rows.column("kind").to_numpy()
        docs, places, hashes = unpacked(rows.filter(pa.array(kind == 0)), np.uint32)
        order = np.argsort(hashes, kind="stable")
        new = np.flatnonzero(np.diff(hashes[order].astype(np.int64), prepend=-1) != 0)
        sizes = np.diff(np.append(new, len(order)))
        indexed = np.add.reduceat(places[order] % block == 0, new) > 0 if len(new) else np.empty(0, bool)
        met = order[np.repeat((sizes > 1) & indexed, sizes)]
        found = ranges_by_doc(docs[met], np.maximum(places[met] - (window - block), 0), places[met] + 1)
        return pa.concat_tables([found, passed_on(rows.filter(pa.array(kind == 1)))])

    return packed.groupBy("bucket").applyInArrow(run, "doc_id long, ranges binary")


def marked(places: np.ndarray, lists: list[list[bytes] | None], first: np.ndarray, counts: np.ndarray, extra: int) -> np.ndarray:
    """Mask over all words: those in one of their document's ranges, each longer by ``extra``."""
    marks = np.zeros(len(places) + 1, np.int64)
    for ranges, start, n in zip(lists, first.tolist(), counts.tolist()):
        if ranges:
            pairs = np.frombuffer(b"".join(ranges), np.int32).reshape(-1, 2).astype(np.int64)
            np.add.at(marks, start + np.minimum(pairs[:, 0], n), 1)
            np.add.at(marks, start + np.minimum(pairs[:, 1] + extra, n), -1)
    return np.cumsum(marks)[:-1] > 0


def candidate_windows(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Packed hashes of the windows in ``ranges``; those seen before in the batch go as removed ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            b = words_of(batch, window)
            lists = batch.column("ranges").to_pylist()
            order = np.argsort(batch.column("doc_id").to_numpy(), kind="stable")
            wanted = marked(b.place, [lists[i] for i in order], b.first, b.counts, 0)
            at, hashes = b.runs(window)
            keep = wanted[at]
            more = (run_sums(b.words, at[keep], window, BASES[1]) >> np.uint64(32)).astype(np.uint32)
            at, hashes = at[keep], hashes[keep]
            first, _ = first_of_each(hashes)
            own = (first == np.arange(len(at))) | (more != more[first])
            twin = (b.ids[b.doc[at]] == b.ids[b.doc[at[first]]]) & (b.place[at] == b.place[at[first]])
            yield rows_of([*b.packed(at[own], hashes[own], buckets, hashes[own], more[own]), *b.ranges(at[~own & ~twin], buckets)])

    return docs.mapInArrow(run, PACKED)


def later_windows(packed: DataFrame) -> DataFrame:
    """(doc_id, ranges): starts of the windows that also start earlier."""

    def run(rows: pa.Table) -> pa.Table:
        kind = rows.column("kind").to_numpy()
        docs, places, hashes, more = unpacked(rows.filter(pa.array(kind == 0)), np.uint64, np.uint32)
        order = np.lexsort((places, docs, more, hashes))
        docs, places, hashes, more = docs[order], places[order], hashes[order], more[order]
        new = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (more[1:] != more[:-1]))) if len(hashes) else np.empty(0, np.int64)
        first = np.repeat(new, np.diff(np.append(new, len(hashes))))
        later = (docs != docs[first]) | (places != places[first]) if len(hashes) else np.empty(0, bool)
        found = ranges_by_doc(docs[later], places[later], places[later] + 1)
        return pa.concat_tables([found, passed_on(rows.filter(pa.array(kind == 1)))])

    return packed.groupBy("bucket").applyInArrow(run, "doc_id long, ranges binary")


def kept_words(docs: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """Digest of what is left of each text when the words of its removed windows are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = [(x or "").encode().split() for x in part.column("text").to_pylist()]
                removed, left = [], []
                for text, ranges in zip(words, part.column("ranges").to_pylist()):
                    gone = 0
                    if ranges:
                        n = np.array([len(text)])
                        mask = marked(np.empty(len(text)), [ranges], np.zeros(1, np.int64), n, window - 1)
                        gone = int(mask.sum())
                        text = [w for w, m in zip(text, mask.tolist()) if not m]
                    removed.append(gone)
                    left.append(b" ".join(text))
                columns = [part.column("doc_id"), pa.array(map(len, words), pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if keep_text:
                    columns.append(pa.array([x.decode() for x in left], pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """Remove every word of a window that starts earlier in the corpus, too.

    Words are runs of characters other than space and \\x09-\\x0D. Earlier is: in a
    document of smaller doc_id, or in the same one before. Windows are judged on
    the input, not on what is left. Returns doc_id, n_words, n_removed,
    kept_sha256 (of the kept words joined by one space), and with ``keep_text``
    kept_text. Null and empty texts have no words; documents of less than a window
    lose none; rows that repeat a doc_id with its text count as one document and
    each return it; of rows that repeat a doc_id with other texts each is a document
    of its own, the one of the smaller hash being earlier; documents without an id are
    returned whole.

    Windows are the same if 96 bits of their words' hashes agree. Buckets grow in
    number with the text, so each has about the same size however much there is.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    spark = docs.sparkSession
    base = id_and_text(docs)
    known = base.where("doc_id IS NOT NULL")
    known, names = told_apart(known)
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    gathered = lambda found: found.groupBy("doc_id").agg(F.collect_list("ranges").alias("ranges"))
    around = gathered(hits(probes(known, window, buckets), window))
    later = gathered(later_windows(candidate_windows(known.join(around, "doc_id"), window, buckets)))
    judged = known.join(later, "doc_id", "left")
    if names is not None:
        judged = judged.withColumnRenamed("doc_id", "number").join(names, "number").select("doc_id", "text", "ranges")
    rest = base.where("doc_id IS NULL").withColumn("ranges", F.lit(None).cast("array<binary>"))
    return kept_words(judged.unionByName(rest), window, keep_text)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS s, ws FROM w),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(ws[s:s + 19], ' ') ORDER BY doc_id, s) AS rn FROM win),
gone AS (SELECT DISTINCT doc_id, s + k AS p FROM ranked, range(0, 20) r(k) WHERE rn > 1),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
