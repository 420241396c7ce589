"""N-gram Jaccard join by vertical partitioning.

All shingles have one global order, rare ones first, which is cut into fragments.
Each document's set falls into segments by fragment; overlaps of a pair are counted
segment by segment, apart from each other, and summed. Shingles that only one text
has can't overlap: they count in sizes only, and most documents have too many of
them to be like any other. Two sets as alike as asked must share a shingle near the
beginning of the order, which is where pairs come from; sizes, places and the
segments' lengths rule out most before anything is counted.

Texts of the same words are one node. Each node is first held against few others
that share most of its beginnings; what these links join need not be met again, so
only pairs across groups are looked for afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox.llm.common import components, cut, id_and_text, table
from lumivox.llm.fingerprints import LOWER
from lumivox.llm.substring_dedup import batches_of, from_planes, planes, run_sums, word_hashes

#: Words of a shingle; a link needs PERCENT of the union in common.
WIDTH, PERCENT = 4, 85
#: Pieces that the global order is cut into.
FRAGMENTS = 16
#: Buckets of hashes, at least; text bytes of all documents for each bucket, at most.
BUCKETS, BUCKET_BYTES = 64, 16 << 20
#: Steps of the order that fragments end at: bit length of the number of texts, then leading bits of the hash.
LEADING = 6
#: Bits of a shingle's hash that travel within its bucket.
SENT_BYTES = 6
#: Shingles of sets' beginnings that a task holds at a time.
ENTRIES = 1 << 16
#: Rounds in which nodes are held against one other each, before pairs across groups are looked for.
ROUNDS = 2


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingles of one text's word hashes, ascending; fewer words are one shingle, no words none."""
    if not len(words):
        return np.empty(0, np.uint64)
    size = min(width, len(words))
    return np.unique(run_sums(words, np.arange(len(words) - size + 1), size))


def sets_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Signature and shingles of each row's text; rows of the same words have the same."""
    texts = [(x or "").encode("utf-8", "surrogatepass").translate(LOWER) for x in batch.column("text").to_pylist()]
    words, _, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    known: dict[int, np.ndarray] = {}
    for start, end in zip((ends - counts).tolist(), ends.tolist()):
        own = words[start:end]
        sig = xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)
        if sig not in known:
            known[sig] = shingles(own, width)
        yield sig, known[sig]


def sizes_of(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, sig, n_shingles) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            found = [(sig, len(x)) for sig, x in sets_of(batch, width)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*found))], ["doc_id", "sig", "n_shingles"])

    return docs.mapInArrow(run, "doc_id long, sig long, n_shingles long")


def packed(to: np.ndarray, sigs: np.ndarray, sizes: np.ndarray, owner: np.ndarray, *kept: np.ndarray) -> Iterator[tuple]:
    """Entries by ``to``: their sets' signatures, entries and sizes, and the ``kept`` bytes of each entry. Owners ascend within each ``to``."""
    cuts = np.append(np.flatnonzero(np.diff(to, prepend=-1)), len(to))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own, counts = np.unique(owner[lo:hi], return_counts=True)
        yield int(to[lo]), sigs[own].tobytes(), planes(counts.astype(np.uint32)), planes(sizes[own].astype(np.uint32)), *(x[lo:hi].tobytes() for x in kept)


def unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature, size and owner of every entry of packed rows; equal signatures are one owner."""
    none = np.empty(0, np.int64)
    sigs = np.concatenate([none, *(np.frombuffer(x, np.int64) for x in rows.column("sigs").to_pylist())])
    counts = np.concatenate([none, *(from_planes(x, np.uint32).astype(np.int64) for x in rows.column("counts").to_pylist())])
    sizes = np.concatenate([none, *(from_planes(x, np.uint32).astype(np.int64) for x in rows.column("sizes").to_pylist())])
    sigs, first, own = np.unique(sigs, return_index=True, return_inverse=True)
    return sigs, sizes[first], np.repeat(own.astype(np.int32), counts)


def postings(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """One row per batch and bucket of hashes: the sets of the batch and their shingles there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            found = {sig: x for sig, x in sets_of(batch, width) if len(x)}
            if not found:
                continue
            sizes = np.array([len(x) for x in found.values()])
            hashes, owner = np.concatenate(list(found.values())), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            low = hashes[order].view(np.uint8).reshape(-1, 8)[:, :SENT_BYTES]
            yield row_batch(packed(bucket[order], np.array(list(found), np.int64), sizes, owner[order], low), ("bucket", "sigs", "counts", "sizes", "low"))

    return docs.mapInArrow(run, "bucket int, sigs binary, counts binary, sizes binary, low binary")


def row_batch(rows: Iterator[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    types = [pa.int32(), *[pa.binary()] * (len(names) - 1)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], list(names))


def shared(sent: DataFrame, parts: int) -> DataFrame:
    """Of each bucket the shingles that several sets have, packed anew by part of the signatures.

    ``band`` is the bit length of the number of sets, by which the global order begins.
    """

    def run(rows: pa.Table) -> pa.Table:
        sigs, sizes, owner = unpacked(rows)
        low = np.frombuffer(b"".join(rows.column("low").to_pylist()), np.uint8).reshape(-1, SENT_BYTES)
        tokens = np.zeros((len(low), 8), np.uint8)
        tokens[:, :SENT_BYTES] = low
        tokens = tokens.view(np.uint64).ravel() | np.uint64((rows.column("bucket")[0].as_py() & 0xFFFF) << 48)
        order = np.argsort(tokens)
        tokens, owner = tokens[order], owner[order]
        same = tokens[1:] == tokens[:-1]
        several = np.append(same, False) | np.append(False, same)  # all others stand alone
        tokens, owner = tokens[several], owner[several]
        order = np.lexsort((owner, tokens))
        tokens, owner = tokens[order], owner[order]
        new = np.append(True, (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1]))[: len(tokens)]  # a set sent by several batches counts once
        tokens, owner = tokens[new], owner[new]
        starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])[: len(tokens)])
        counts = np.diff(np.append(starts, len(tokens)))
        counts = np.repeat(counts, counts)
        tokens, owner, counts = tokens[counts > 1], owner[counts > 1], counts[counts > 1]
        bands = np.frexp(counts.astype(np.float64))[1].astype(np.uint8)
        part = (sigs[owner] % parts).astype(np.int32)
        order = np.lexsort((owner, part))
        names = ("part", "sigs", "counts", "sizes", "tokens", "bands")
        return pa.Table.from_batches([row_batch(packed(part[order], sigs, sizes, owner[order], tokens[order], bands[order]), names)])

    return sent.groupBy("bucket").applyInArrow(run, "part int, sigs binary, counts binary, sizes binary, tokens binary, bands binary")


def candidates(found: DataFrame, percent: int) -> DataFrame:
    """(sig, n, tokens, bands) of the sets that share enough of their shingles with others to be like one, in the global order."""

    def run(rows: pa.Table) -> pa.Table:
        sigs, sizes, owner = unpacked(rows)
        tokens = np.frombuffer(b"".join(rows.column("tokens").to_pylist()), np.int64)
        bands = np.frombuffer(b"".join(rows.column("bands").to_pylist()), np.uint8)
        counts = np.bincount(owner, minlength=len(sigs))
        kept = (100 * counts >= percent * sizes)[owner]
        owner, tokens, bands = owner[kept], tokens[kept], bands[kept]
        order = np.lexsort((tokens, bands, owner))
        tokens, bands = tokens[order], bands[order]
        own, counts = np.unique(owner, return_counts=True)
        ends = np.cumsum(counts).tolist()
        spans = list(zip([0, *ends], ends))
        return pa.table({
            "sig": sigs[own], "n": sizes[own], "tokens": pa.array([tokens[a:b].tobytes() for a, b in spans], pa.binary()),
            "bands": pa.array([bands[a:b].tobytes() for a, b in spans], pa.binary()),
        })

    return found.groupBy("part").applyInArrow(run, "sig long, n long, tokens binary, bands binary")


def steps_of(tokens: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """Steps of the global order, which fragments end at."""
    return (bands.astype(np.int64) << LEADING) + (tokens >> (64 - LEADING)) + (1 << (LEADING - 1))


def fragment_ends(sets: DataFrame, fragments: int) -> np.ndarray:
    """Steps at which fragments of about equally many entries end; a few thousand counts reach the driver, whatever the input."""
    top = 64 << LEADING

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(top, np.int64)
        for batch in batches:
            for tokens, bands in zip(batch.column("tokens").to_pylist(), batch.column("bands").to_pylist()):
                counts += np.bincount(steps_of(np.frombuffer(tokens, np.int64), np.frombuffer(bands, np.uint8)), minlength=top)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full])], ["step", "count"])

    counts = np.zeros(top, np.int64)
    for step, count in sets.mapInArrow(run, "step long, count long").groupBy("step").agg(F.sum("count")).collect():
        counts[step] = count
    sums = np.cumsum(counts)
    return np.unique(np.searchsorted(sums, sums[-1] * np.arange(1, fragments) / fragments))


def segments(sets: DataFrame, ends: np.ndarray) -> DataFrame:
    """(sig, fragment, segment): each set, cut at the fragments' ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sig, tokens, bands in zip(*(batch.column(c).to_pylist() for c in ("sig", "tokens", "bands"))):
                cuts = bounds_of(tokens, bands, ends)
                out += [(sig, i, tokens[8 * a : 8 * b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()))], ["sig", "fragment", "segment"])

    return sets.mapInArrow(run, "sig long, fragment int, segment binary")


def bounds_of(tokens: bytes, bands: bytes, ends: np.ndarray) -> list[int]:
    """Where a set's segments begin, and its end."""
    steps = steps_of(np.frombuffer(tokens, np.int64), np.frombuffer(bands, np.uint8))
    return [0, *np.searchsorted(steps, ends, side="right").tolist(), len(steps)]


def beginnings(sets: DataFrame, ends: np.ndarray, percent: int) -> DataFrame:
    """(token, sig, n, alone, place, near, lengths): the shingles of each set that a pair must share one of.

    Two sets with at least ``o`` in common share one of the first n - o + 1 of each. With
    any other set o is at least percent * n / 100, and with one not smaller, more: these
    first places are marked ``near``. ``place`` counts the shingles that the set has alone, which come first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for sig, n, tokens, bands in zip(*(batch.column(c).to_pylist() for c in ("sig", "n", "tokens", "bands"))):
                alone = n - len(bands)
                first = np.frombuffer(tokens, np.int64)[: max(0, n + percent * -n // 100 + 1 - alone)]
                near = n + 2 * percent * -n // (100 + percent) + 1 - alone
                out.append((first, sig, n, alone, near, np.diff(bounds_of(tokens, bands, ends))))
                held += len(first)
                if held >= ENTRIES:
                    yield entry_batch(out)
                    out, held = [], 0
            yield entry_batch(out)

    return sets.mapInArrow(run, "token long, sig long, n long, alone long, place long, near boolean, lengths array<int>")


def entry_batch(sets: list[tuple]) -> pa.RecordBatch:
    """One row per shingle of each set's beginning."""
    names = ["token", "sig", "n", "alone", "place", "near", "lengths"]
    if not sets:
        types = [*[pa.int64()] * 5, pa.bool_(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names)
    first, sig, n, alone, near, lengths = zip(*sets)
    counts = np.array([len(x) for x in first])
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    many = lambda x: np.repeat(np.array(x, np.int64), counts)
    spread = np.repeat(np.array(lengths, np.int32), counts, axis=0)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(spread) + 1) * spread.shape[1], pa.int32()), pa.array(spread.ravel()))
    columns = [np.concatenate(first), many(sig), many(n), many(alone), many(alone) + nth, nth < many(near)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], names)


def needed(n: Column, m: Column, percent: int) -> Column:
    """The least overlap of two sets that are as alike as asked."""
    return F.ceil(percent * (n + m) / (100 + percent) - 1e-9)


def overlaps(pairs: DataFrame, cut_sets: DataFrame) -> DataFrame:
    """(a, b, common) of pairs: overlaps are counted in each fragment and summed."""
    left = cut_sets.select(F.col("sig").alias("a"), "fragment", F.col("segment").alias("x"))
    right = cut_sets.select(F.col("sig").alias("b"), "fragment", F.col("segment").alias("y"))
    met = pairs.select("a", "b").join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())
            counts = [len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True)) for x, y in both]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(counts, pa.int64())], ["a", "b", "common"])

    return met.mapInArrow(run, "a long, b long, common long").groupBy("a", "b").agg(F.sum("common").alias("common"))


def alike(pairs: DataFrame, cut_sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b, n, m) that are as alike as asked."""
    counted = pairs.join(overlaps(pairs, cut_sets), ["a", "b"])
    return counted.where(100 * F.col("common") >= percent * (F.col("n") + F.col("m") - F.col("common"))).select("a", "b")


def possible(e: str, f: str, percent: int) -> Column:
    """Whether sizes and segments let e and f be alike; f has not more shingles."""
    c = lambda side, name: F.col(f"{side}.{name}")
    least = needed(c(e, "n"), c(f, "n"), percent)
    after = F.least(c(e, "n") - c(e, "place"), c(f, "n") - c(f, "place"))
    within = F.aggregate(F.zip_with(c(e, "lengths"), c(f, "lengths"), lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return (100 * c(f, "n") >= percent * c(e, "n")) & (after >= least) & (within >= least)


def one_each(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b, n, m): per set the set of another group that leads most of its beginnings and may be alike.

    A shingle is led by the set with the fewest shingles of its own: copies of a text are
    like the text, not like each other, and it is the one without changes.
    """
    lead = entries.groupBy("token").agg(F.min(F.struct("alone", "sig", "n", "place", "lengths", "root")).alias("h")).select("token", "h.*")
    met = entries.alias("e").join(lead.alias("f"), "token").where((F.col("e.root") != F.col("f.root")) & (100 * F.least("e.n", "f.n") >= percent * F.greatest("e.n", "f.n")))
    tally = met.groupBy(F.col("e.sig").alias("a"), F.col("f.sig").alias("b"), F.col("e.n").alias("n"), F.col("f.n").alias("m")).count()
    return tally.groupBy("a").agg(F.max_by(F.struct("b", "n", "m"), F.struct("count", "b")).alias("x")).select("a", "x.*")


def across(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b, n, m): every pair of different groups that shares a beginning and that nothing rules out."""
    several = entries.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("token")
    left = entries.join(several, "token")
    e, f = left.alias("e"), left.where("near").alias("f")
    larger = (F.col("e.n") > F.col("f.n")) | ((F.col("e.n") == F.col("f.n")) & (F.col("e.sig") > F.col("f.sig")))
    met = e.join(f, (F.col("e.token") == F.col("f.token")) & (F.col("e.root") != F.col("f.root")) & larger & possible("e", "f", percent))
    return met.select(F.col("e.sig").alias("a"), F.col("f.sig").alias("b"), F.col("e.n").alias("n"), F.col("f.n").alias("m")).distinct()


def with_root(entries: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links, "a", "b").select(F.col("node").alias("sig"), F.col("root").alias("found"))
    return entries.drop("root").join(roots, "sig", "left").withColumn("root", F.coalesce("found", "sig")).drop("found")


def linked(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links between signatures whose components are those of all links."""
    session = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS, -(-size // BUCKET_BYTES), int(session.conf.get("spark.sql.shuffle.partitions")))
    sets = cut(candidates(shared(postings(docs, width, buckets), buckets), percent))
    ends = fragment_ends(sets, FRAGMENTS)
    cut_sets = cut(segments(sets, ends))
    entries = cut(beginnings(sets, ends, percent)).withColumn("root", F.col("sig"))
    links = None
    for step in [one_each] * ROUNDS + [across]:
        found = cut(alike(cut(step(entries, percent)), cut_sets, percent))
        links = found if links is None else links.unionByName(found)
        if step is one_each:
            entries = cut(with_root(entries, links))
    return links


def ngram_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Two texts link when 100 * intersection >= percent * union of their sets of shingles.
    A text of fewer words is one shingle; null and wordless texts have none and are linked
    with nothing, not even each other. Rows of one doc_id with other texts are apart; a
    null id is the smallest only where a component has no other. No rows give no rows.

    Words are told apart by 64-bit hashes, shingles by 64 bits of these, texts by 64 bits
    of their words: among a billion texts two would be taken for one with a chance of 3 %.
    """
    docs = id_and_text(docs)
    rows = cut(sizes_of(docs, width))
    firsts = rows.where("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("first"))
    roots = components(linked(docs, width, percent), "a", "b").select(F.col("node").alias("sig"), "root")
    labelled = firsts.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    ids = labelled.groupBy("root").agg(F.min("first").alias("least"))
    by_sig = labelled.select("sig", "root").join(ids, "root").select("sig", "least")
    full = rows.where("n_shingles > 0").join(by_sig, "sig").select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    return full.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_groups(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
    SELECT DISTINCT r, CASE WHEN len(words) < 4 THEN array_to_string(words, ' ') ELSE words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] END AS shingle
    FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
sizes AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS (SELECT x.r AS a, y.r AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.r < y.r GROUP BY x.r, y.r),
links AS (SELECT a, b FROM pairs JOIN sizes n ON n.r = a JOIN sizes m ON m.r = b WHERE 100 * common >= 85 * (n.n + m.n - common)),
reach AS (
    SELECT r, r AS other FROM w
    UNION SELECT reach.r, e.b FROM reach JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON reach.other = e.a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least AS component_id
FROM w LEFT JOIN sizes ON w.r = sizes.r JOIN (SELECT reach.r, min(o.doc_id) AS least FROM reach JOIN w o ON o.r = reach.other GROUP BY reach.r) c ON c.r = w.r
"""
