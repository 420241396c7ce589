"""Fuzzy line dedup: sketches of normalised lines, edit similarity.

Lines whose normal forms are equal are one line. Of the distinct ones, those whose
normal forms have an edit similarity of at least 0.8 are linked; of each connected
group the first occurrence stays.

Which lines are compared is found by their words. Every line draws its words in
BANDS * ORDERS orders, a word the sooner the longer it is; the first words of ORDERS
orders make one key, and one bit of each first word goes into a 64-bit sketch. Lines
that share a key, and whose lengths and sketches allow the similarity, are compared.
Two lines that share the part j of their words, weighed by length, have a common key
with the probability 1 - (1 - j^4)^16.

The SimHash of a line's words with the pigeonhole over its blocks, which this replaces,
meets only lines of at most three differing bits, and so leaves out most pairs of
ordinary lines; the README has both shares.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox.llm.common import components, cut, id_and_text, slices, table, written
from lumivox.llm.ordered import text_mark, told_apart
from lumivox.llm.edit import similar_pairs
from lumivox.llm.substring_dedup import from_planes, mixed, planes, word_hashes

LEAST_SIMILARITY = 0.8
#: Keys of a line, and orders of its words that make one key.
BANDS, ORDERS = 16, 4
#: Bits of two sketches that may differ: 11 are expected at an edit similarity of 0.8, give or take 3, about 28 by chance.
SKETCH_BITS = 18
#: Orders and parts of lines that are looked at together, and words of a part.
TOGETHER, PARTS, PART_WORDS = 64, 1024, 128
#: Lines whose texts may be fetched by a broadcast of their places (about 24 bytes each).
BROADCAST_LINES = 300_000
#: Lines that a bucket of one band has about, lines of one key that are set against each other in one cell, lines of cells that a task takes.
BUCKET_LINES, CELL_LINES, TASK_LINES = 200_000, 2_000, 10_000
#: Pairs of lines of cells whose keys are compared at a time.
CELL_PAIRS = 100_000
#: Pairs that are verified together, and bytes of their lines: similar_pairs is the faster the more it has.
PAIRS, PAIR_BYTES = 25_000, 48 << 20


def _normal_bytes() -> bytes:
    """Capitals to small letters, digits to 0, other ASCII but the line feed to a space."""
    out = bytearray(range(256))
    for c in range(128):
        letter = chr(c)
        out[c] = ord(letter.lower()) if letter.isalpha() else ord("0") if letter.isdigit() else 10 if c == 10 else 32
    return bytes(out)


NORMAL = _normal_bytes()


def normal_lines(text: str | None) -> list[bytes]:
    """The normal form of each line; words lie between runs of spaces."""
    return (text or "").encode().translate(NORMAL).split(b"\n")


def line_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """XXH3 of the hashes of each line's words."""
    data, ends = memoryview(hashes.tobytes()), 8 * np.cumsum(counts)
    spans = zip((ends - 8 * counts).tolist(), ends.tolist())
    return np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in spans), np.uint64, len(counts))


def least_words(hashes: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """For each order in turn the hash of the first word of every line.

    In every order a word has the place -log(u) / length with u from its hash, so that
    the first words of two lines are the same with the probability of their weighted
    Jaccard similarity.
    """
    found = pa.array(hashes).dictionary_encode()
    words, which = found.dictionary.to_numpy(), found.indices.to_numpy()
    weights = np.empty(len(words), np.float32)
    weights[which] = lengths
    parts = -(-np.diff(starts, append=len(hashes)) // PART_WORDS)  # of each line
    part = np.cumsum(parts) - parts
    begins = np.repeat(starts, parts) + (np.arange(parts.sum()) - np.repeat(part, parts)) * PART_WORDS
    sizes = np.diff(begins, append=len(hashes))
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[order], sizes[order]
    places, firsts = np.empty((len(words), TOGETHER), np.float32), np.empty((len(begins), TOGETHER), np.float32)
    mine, other = (np.empty((PARTS, TOGETHER), np.float32) for _ in range(2))
    factors = mixed(np.arange(1, BANDS * ORDERS + 1, dtype=np.uint64)) | np.uint64(1)
    for lo in range(0, BANDS * ORDERS, TOGETHER):
        for at in range(0, len(words), 4096):
            own = words[at : at + 4096, None] * factors[lo : lo + TOGETHER]
            own >>= np.uint64(40)
            share = own.astype(np.float32)
            share += np.float32(0.5)
            share *= np.float32(2.0**-24)
            np.negative(np.log(share, out=share), out=share)
            np.divide(share, weights[at : at + 4096, None], out=places[at : at + 4096])
        # parts of about one length lie together: the n-th words of all of them that have one
        for at in range(0, len(begins), PARTS):
            own = sizes[at : at + PARTS]
            longer = len(own) - np.searchsorted(own[::-1], np.arange(own[0]), "right")
            for n, some in enumerate(longer.tolist()):
                np.take(places, which[begins[at : at + some] + n], 0, other[:some] if n else mine[:some], "clip")
                if n:
                    np.minimum(mine[:some], other[:some], out=mine[:some])
            firsts[order[at : at + PARTS]] = mine[: len(own)]
        least = firsts if len(firsts) == len(starts) else np.minimum.reduceat(firsts, part)
        for n, column in enumerate(np.ascontiguousarray(least.T), lo):
            yield mixed(column.view(np.uint32).astype(np.uint64) + (np.uint64(n) << np.uint64(32)))


def word_bands(hashes: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """BANDS keys of each line, the two halves of its sketch, and its length, as 32-bit numbers; every line has words."""
    out = np.zeros((len(counts), BANDS + 3), np.uint32)
    if not len(counts):
        return out
    starts = np.cumsum(counts) - counts
    sketch, key = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
    for order, least in enumerate(least_words(hashes, lengths, starts)):
        key = mixed(key ^ least)
        sketch = sketch << np.uint64(1) | least >> np.uint64(63)
        if order % ORDERS == ORDERS - 1:
            out[:, order // ORDERS] = key >> np.uint64(32)
            key = np.zeros(len(counts), np.uint64)
    out[:, BANDS], out[:, BANDS + 1] = sketch >> np.uint64(32), sketch & np.uint64(0xFFFFFFFF)
    out[:, BANDS + 2] = np.add.reduceat(lengths, starts) + counts - 1
    return out


def lines_of(docs: DataFrame) -> DataFrame:
    """(key, doc_id, line, bands): each batch's distinct lines with words, and where they come first.

    ``key`` is XXH3 of the hashes of a line's words, ``bands`` the packed numbers of ``word_bands``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids = part.column("doc_id").to_numpy()
                order = np.argsort(ids, kind="stable")
                texts = part.column("text").to_pylist()
                lines = [normal_lines(texts[i]) for i in order]
                numbers = np.array(list(map(len, lines)), np.int64)
                hashes, lengths, counts = word_hashes([x for own in lines for x in own])
                doc = np.repeat(ids[order], numbers)
                line = np.arange(len(doc)) - np.repeat(np.cumsum(numbers) - numbers, numbers)
                full = np.flatnonzero(counts)
                ends = np.cumsum(counts)
                keys = line_keys(hashes, counts)[full]
                _, first = np.unique(keys, return_index=True)
                at = full[first]
                own = counts[at]
                words = np.repeat((ends - counts)[at] - (np.cumsum(own) - own), own) + np.arange(own.sum())
                bands = [x.tobytes() for x in word_bands(hashes[words], lengths[words], own)]
                columns = [pa.array(keys[first].view(np.int64)), pa.array(doc[at]), pa.array(line[at].astype(np.int32)), pa.array(bands, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "line", "bands"])

    return docs.mapInArrow(run, "key long, doc_id long, line int, bands binary")


def dealt(lines: DataFrame, columns: list[str], parts: int) -> DataFrame:
    """(bucket, pack): each line's band key with its length, its sketch, and ``columns``, once for every band.

    Packs have the steps from key to key, and all numbers by bytes, so that what is small can be compressed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.uint32).reshape(-1, BANDS + 3).astype(np.uint64)
            sketch = bands[:, BANDS] << np.uint64(32) | bands[:, BANDS + 1]
            own = [batch.column(c).to_numpy().view(np.uint64) for c in columns]
            buckets, packs = [], []
            for t in range(BANDS):
                order = np.argsort(bands[:, t])
                keys = bands[order, t]
                part = keys % np.uint64(parts)
                for p in np.unique(part).tolist():
                    at = part == p
                    steps = np.diff(keys[at], prepend=np.uint64(0)) << np.uint64(32) | bands[order[at], BANDS + 2]
                    buckets.append(t * parts + p)
                    packs.append(b"".join(planes(x) for x in (steps, sketch[order[at]], *(x[order[at]] for x in own))))
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(packs, pa.binary())], ["bucket", "pack"])

    return lines.select("bands", *columns).mapInArrow(run, "bucket int, pack binary")


def met(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A bucket's rows of ``width`` numbers by band key and length, and where keys begin; lines that are alone in their key are left out."""
    packs = []
    for pack in rows.column("pack").to_pylist():
        own = np.stack([from_planes(x, np.uint64) for x in np.split(np.frombuffer(pack, np.uint8), width)], 1)
        own[:, 0] = np.cumsum(own[:, 0] >> np.uint64(32), dtype=np.uint64) << np.uint64(32) | own[:, 0] & np.uint64(0xFFFFFFFF)
        packs.append(own)
    values = np.concatenate(packs)
    values = values[np.argsort(values[:, 0], kind="stable")]
    keys = values[:, 0] >> np.uint64(32)
    new = np.append(True, keys[1:] != keys[:-1])
    alone = new & np.append(new[1:], True)
    values, new = values[~alone], new[~alone]
    return values, np.append(np.flatnonzero(new), len(values))


def close(values: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Mask of the pairs whose lengths and sketches allow the similarity."""
    a, b = (values[x, 0] & np.uint64(0xFFFFFFFF) for x in (left, right))
    apart = np.maximum(a, b) - np.minimum(a, b)
    return (apart <= ((1 - least) * np.maximum(a, b) + 1e-9).astype(np.uint64)) & (np.bitwise_count(values[left, 1] ^ values[right, 1]) <= SKETCH_BITS)


def nearest(lines: DataFrame, parts: int, least: float) -> DataFrame:
    """(a, b, owner): for every line and band the first close line before and after it, if any.

    ``owner`` is the line of a pair that asked for it; a line owns at most two pairs for each band.
    """

    def run(rows: pa.Table) -> pa.Table:
        values, cuts = met(rows, 3)
        first, last = (np.repeat(x, np.diff(cuts)) for x in (cuts[:-1], cuts[1:] - 1))
        lengths, found = (values[:, 0] & np.uint64(0xFFFFFFFF)).astype(np.int64), [np.empty((2, 0), np.int64)]
        for way in (1, -1):
            asking, step = np.arange(len(values)), 0
            while len(asking):
                step += way
                asking = asking[asking + step <= last[asking] if way > 0 else asking + step >= first[asking]]
                longer = lengths[np.maximum(asking, asking + step)]
                # lines lie by length: once a line is too long or short for a partner, so are all beyond it
                asking = asking[np.abs(lengths[asking + step] - lengths[asking]) <= ((1 - least) * longer + 1e-9).astype(np.int64)]
                ok = close(values, asking, asking + step, least)
                found.append(np.stack([asking[ok], asking[ok] + step]))
                asking = asking[~ok]
        owner, partner = values[np.concatenate(found, 1), 2].view(np.int64)
        return pa.table([pa.array(np.minimum(owner, partner)), pa.array(np.maximum(owner, partner)), pa.array(owner)], ["a", "b", "owner"])

    found = dealt(lines, ["key"], parts).groupBy("bucket").applyInArrow(run, "a long, b long, owner long")
    return found.groupBy("a", "b").agg(F.min("owner").alias("owner"))


def crossing(lines: DataFrame, parts: int, least: float) -> DataFrame:
    """(cell, band, side, key): lines that meet a close line of another root, once for every band and cell.

    The lines of one key make one cell. More than CELL_LINES are dealt into blocks, and
    each two blocks make a cell, with sides 1 and 2; side 0 is set against itself.
    """

    def run(rows: pa.Table) -> pa.Table:
        band = rows.column("bucket")[0].as_py() // parts
        values, cuts = met(rows, 4)
        found = [np.empty((0, 3), np.uint64)]
        starts = cuts[:-1]
        mixed_roots = np.minimum.reduceat(values[:, 3], starts) != np.maximum.reduceat(values[:, 3], starts) if len(values) else np.zeros(0, bool)
        for lo, hi in zip(starts[mixed_roots].tolist(), cuts[1:][mixed_roots].tolist()):
            roots = values[lo:hi, 3]
            marks = np.zeros(hi - lo, bool)
            kinds, number = np.unique(roots, return_counts=True)
            most = kinds[number.argmax()]
            for i in np.flatnonzero(roots != most).tolist():  # the largest root's lines need not ask
                others = np.flatnonzero(roots != roots[i])
                near = others[close(values[lo:hi], np.full(len(others), i), others, least)]
                marks[near] = True
                marks[i] |= len(near) > 0
            own = values[lo:hi][marks]
            if not len(own):
                continue
            own = own[np.argsort(own[:, 2])]
            blocks = -(-len(own) // CELL_LINES)
            block = np.arange(len(own)) * blocks // len(own)
            for i in range(blocks):
                for j in range(i, blocks):
                    cell = mixed(np.array([band << 32 | int(own[0, 0] >> np.uint64(32))], np.uint64) ^ mixed(np.array([i * blocks + j + 1], np.uint64)))[0]
                    for side, pick in ((0, block == i),) if i == j else ((1, block == i), (2, block == j)):
                        found.append(np.stack([np.full(pick.sum(), cell), np.full(pick.sum(), side, np.uint64), own[pick, 2]], 1))
        every = np.concatenate(found)
        columns = [pa.array(every[:, 0].view(np.int64)), pa.array(np.full(len(every), band, np.int32)), pa.array(every[:, 1].astype(np.int32)), pa.array(every[:, 2].view(np.int64))]
        return pa.table(columns, ["cell", "band", "side", "key"])

    return dealt(lines, ["key", "root"], parts).groupBy("bucket").applyInArrow(run, "cell long, band int, side int, key long")


def normal_texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(key, form) of the lines at ``places`` (key, doc_id, line): their words joined by single spaces.

    A document meets all its wanted lines at once, so its text is sent and split once.
    Where rows repeat a doc_id with other texts, only the line that has the key counts.
    """
    small = places.count() <= BROADCAST_LINES
    wanted = places.groupBy("doc_id").agg(F.collect_list(F.struct("key", "line")).alias("wanted"))
    found = docs.join(F.broadcast(wanted) if small else wanted, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys, forms = [], []
                for text, places in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist()):
                    lines = normal_lines(text)
                    here = [x for x in places if x["line"] < len(lines)]
                    keys += [x["key"] for x in here]
                    forms += [b" ".join(lines[x["line"]].split()) for x in here]
                hashes, _, counts = word_hashes(forms)
                right = line_keys(hashes, counts).view(np.int64) == np.array(keys, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(forms, pa.binary())], ["key", "form"]).filter(pa.array(right))

    return found.mapInArrow(run, "key long, form binary").groupBy("key").agg(F.min("form").alias("form"))


def verified(pairs: DataFrame, forms: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of keys whose normal forms are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept() -> pa.RecordBatch:
            xs, ys = ([v for batch in held for v in batch.column(c).to_pylist()] for c in ("x", "y"))
            pairs = pa.Table.from_batches([batch.select(["a", "b"]) for batch in held]).combine_chunks().to_batches()
            return pairs[0].filter(pa.array(similar_pairs(xs, ys, least)))

        held, rows, size = [], 0, 0
        for batch in (x for x in batches if x.num_rows):
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= PAIRS or size >= PAIR_BYTES:
                yield kept()
                held, rows, size = [], 0, 0
        if held:
            yield kept()

    both = pairs.join(forms.select(F.col("key").alias("a"), F.col("form").alias("x")), "a").join(forms.select(F.col("key").alias("b"), F.col("form").alias("y")), "b")
    return both.select("a", "b", "x", "y").coalesce(1 + pairs.count() // PAIRS).mapInArrow(run, "a long, b long")


def places_of(keys: DataFrame, distinct: DataFrame) -> DataFrame:
    return cut(distinct.join(keys.select("key").distinct(), "key").select("key", "doc_id", "line"))


def joining(cells: DataFrame, lines: DataFrame, forms: DataFrame, tried: DataFrame, least: float) -> DataFrame:
    """(a, b): roots that lines in cells link.

    A pair is looked at in the first band whose key it shares, unless it was ``tried``
    (a, b, owner) before, and only while nothing in its task has joined its roots yet;
    so a task gives less links than it has roots.
    """

    def looked_at(rows: pa.Table, cuts: np.ndarray) -> Iterator[tuple[int, int]]:
        """Places of the pairs that are looked at in the cells between ``cuts``, many cells at a time."""
        bands = np.frombuffer(b"".join(rows.column("bands").to_pylist()), np.uint32).reshape(-1, BANDS + 3).astype(np.uint64)
        values = np.stack([bands[:, BANDS + 2], bands[:, BANDS] << np.uint64(32) | bands[:, BANDS + 1]], 1)
        band, side, roots, keys = (rows.column(c).to_numpy() for c in ("band", "side", "root", "key"))
        lists = rows.column("partners").combine_chunks()
        own = np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy()))
        keys = keys.view(np.uint64)
        marks = lambda x, y: mixed((x << np.uint64(1)) ^ mixed(y))
        asked = np.append(np.unique(marks(keys[own], lists.flatten().to_numpy().view(np.uint64))), ~np.uint64(0))
        known = lambda x: asked[np.searchsorted(asked[:-1], x)] == x
        later = np.repeat(cuts[1:], np.diff(cuts)) - 1 - np.arange(len(rows))  # rows after each in its cell
        ends, lo = np.cumsum(later), 0
        while lo < len(rows):
            before = ends[lo] - later[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, before + CELL_PAIRS, "right")))
            i = np.repeat(np.arange(lo, hi), later[lo:hi])
            j = i + 1 + np.arange(len(i)) - np.repeat(ends[lo:hi] - later[lo:hi] - before, later[lo:hi])
            ok = (band[i] == band[j]) & ((side[i] + side[j] == 3) | (side[i] + side[j] == 0)) & (roots[i] != roots[j])
            i, j = i[ok], j[ok]
            ok = close(values, i, j, least)
            i, j = i[ok], j[ok]
            same = bands[i, :BANDS] == bands[j, :BANDS]
            ok = same[np.arange(len(i)), band[i]] & (same.argmax(1) == band[i])
            i, j = i[ok], j[ok]
            ok = ~known(marks(keys[i], keys[j])) & ~known(marks(keys[j], keys[i]))
            yield from zip(i[ok].tolist(), j[ok].tolist())
            lo = hi

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("cell", "ascending"), ("key", "ascending")])
        cells, forms, roots = rows.column("cell").to_numpy(), rows.column("form").to_pylist(), rows.column("root").to_pylist()
        pairs = looked_at(rows, np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, [len(rows)]]))
        up = {x: x for x in roots}

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        links = []
        while some := list(islice(pairs, PAIRS)):
            some = [(i, j) for i, j in some if top(roots[i]) != top(roots[j])]
            ok = similar_pairs([forms[i] for i, _ in some], [forms[j] for _, j in some], least, walk=False)
            for i, j in (some[n] for n in np.flatnonzero(ok)):
                if (a := top(roots[i])) != (b := top(roots[j])):
                    up[max(a, b)] = min(a, b)
                    links.append((roots[i], roots[j]))
        return pa.table([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    parts = 1 + cells.count() // TASK_LINES
    partners = tried.groupBy(F.col("owner").alias("key")).agg(F.collect_list(F.when(F.col("owner") == F.col("a"), F.col("b")).otherwise(F.col("a"))).alias("partners"))
    every = lines.join(forms, "key").join(partners, "key", "left").withColumn("partners", F.coalesce("partners", F.array().cast("array<long>")))
    rows = cells.join(every, "key").select(F.pmod(F.xxhash64("cell"), F.lit(parts)).cast("int").alias("bucket"), "cell", "band", "side", "key", "bands", "root", "form", "partners")
    return rows.groupBy("bucket").applyInArrow(run, "a long, b long")


def groups_of(distinct: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """(key, root) of the lines that are linked with any other.

    A large group has far more links than its connection needs, so links are sought
    twice. First every line is verified against the nearest under each of its keys
    only; that joins most groups. Then lines of different groups that still meet are
    brought together with their texts, and only links that join two groups come out:
    no link is lost, and no group sends its pairs.
    """
    near = cut(nearest(distinct, 1 + distinct.count() // BUCKET_LINES, least))
    places = places_of(near.select(F.explode(F.array("a", "b")).alias("key")), distinct)
    forms = written(normal_texts(docs, places))
    first = cut(verified(near, forms, least))
    roots = components(first, "a", "b").withColumnRenamed("node", "key")
    lines = cut(distinct.join(places.select("key"), "key").join(roots, "key", "left").select("bands", "key", F.coalesce("root", "key").alias("root")))
    cells = cut(crossing(lines, 1 + lines.count() // BUCKET_LINES, least))
    if cells.isEmpty():
        return roots
    across = components(joining(cells, lines, forms, near, least), "a", "b").select(F.col("node").alias("root"), F.col("root").alias("top"))
    return lines.select("key", "root").join(across, "root", "left").select("key", F.coalesce("top", "root").alias("root"))


def kept_lines(docs: DataFrame, least: float) -> DataFrame:
    """(doc_id, lines): the numbers of the lines with words that stay in each document."""
    first = F.min(F.struct("doc_id", "line", "bands"))
    distinct = cut(lines_of(docs).groupBy("key").agg(first.alias("at")).select("key", "at.doc_id", "at.line", "at.bands"))
    members = distinct.join(groups_of(distinct, docs, least), "key").select("key", "root", F.struct("doc_id", "line").alias("at"))
    later = members.join(members.groupBy("root").agg(F.min("at").alias("best")), "root").where("at != best").select("key")
    stay = distinct.select("key", "doc_id", "line").join(later, "key", "left_anti")
    return stay.groupBy("doc_id").agg(F.collect_list("line").alias("lines"))


def kept_of(doc_id: int | None, text: str | None, lines: list[int] | None) -> list[str]:
    """The lines of a text that stay: those without words, and those in ``lines``."""
    own, stay = (text or "").split("\n"), set(lines or ())
    if doc_id is None or len(stay) == len(own):
        return own
    return [x for n, x in enumerate(own) if n in stay or not x.encode().translate(NORMAL).strip()]


def digested(docs: DataFrame) -> DataFrame:
    """What is left of each text, in figures; ``lines`` has the numbers of the lines that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                total, gone, shas = [], [], []
                for doc_id, text, lines in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "lines"))):
                    n, kept = (text.count("\n") + 1 if text else 0), kept_of(doc_id, text, lines)
                    total.append(n)
                    gone.append(n - len(kept) if text else 0)
                    shas.append(hashlib.sha256("\n".join(kept).encode()).hexdigest())
                columns = [part.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_removed", "kept_sha256"])

    return docs.mapInArrow(run, "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def judged(docs: DataFrame, least: float, lines: str) -> DataFrame:
    """The documents with one more column, named ``lines``: numbers of the lines that stay."""
    own, mark = f"{lines} id", f"{lines} mark"
    known, names = told_apart(id_and_text(docs).where("doc_id IS NOT NULL"))
    kept = kept_lines(known, least)
    if names is None:
        kept = kept.select(F.col("doc_id").alias(own), F.col("lines").alias(lines))
        return docs.join(kept, docs["doc_id"] == kept[own], "left").drop(own)
    kept = kept.withColumnRenamed("doc_id", "number").join(names, "number").select(F.col("doc_id").alias(own), F.col("mark").alias(mark), F.col("lines").alias(lines))
    return docs.join(kept, (docs["doc_id"] == kept[own]) & (text_mark(docs["text"].cast("string")) == kept[mark]), "left").drop(own, mark)


def dedup_lines(docs: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """How every text looks without all lines but the first of each group of nearly equal lines.

    First is: in the document of the smallest doc_id, there the smallest line. Lines
    lie between line feeds. Their normal form has small letters a-z, 0 for digits and
    single spaces for other ASCII; lines without words always stay. Returns doc_id,
    n_lines, n_removed, kept_sha256 (of the kept lines joined by line feeds). Null and
    empty texts have no lines; rows that repeat a doc_id with its text count as one
    document and each return it; of rows that repeat a doc_id with other texts each is a
    document of its own, the one of the smaller hash being first; documents without an
    id are returned whole. No rows give no rows.
    """
    return digested(judged(id_and_text(docs), least, "lines"))


def without_repeated_lines(docs: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """The documents with all their columns, their texts without those lines; null texts stay null, and all else is as in ``dedup_lines``."""
    lines = "lines that stay"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", lines)))
                texts = [None if text is None else "\n".join(kept_of(doc_id, text, stay)) for doc_id, text, stay in rows]
                at, rest = part.schema.get_field_index("text"), part.drop_columns([lines])
                yield rest.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return judged(docs, least, lines).mapInArrow(run, docs.schema)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))
