"""Token ids in ORC: run-length encoded integers, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumivox.llm.common import cut, id_and_text, shared_dir, slices, table

MODEL = "byte_bpe_50k.json"
END = 0
#: A space before a printable ASCII or Latin letter always begins a new pre-token of
#: the byte-level pattern, and a single line feed before one is a pre-token, so what
#: lies between them is encoded alone.
CLEAN = re.compile("\ue000?[!-~¡-ʯ]+")
#: Any other space or line feed, one at the end, and the marks below.
ODD = r" ([^!-~¡-ʯ]|$)|\n([^!-~¡-ʯ]|$)|\s\n|[\x{e000}\x{e001}]"
#: Marks: of the key of a text's or line's first unit, and the key of the line feed.
FIRST, LINE = "\ue000", "\ue001"
#: Fixed value: the letter that stands for a space in byte-level vocabularies.
SPACE = "Ġ"
#: Units that a task remembers before it forgets those not met lately, and letters of the longest that it does.
REMEMBERED, LONGEST = 350_000, 64
#: Letters of a text that the library is given at a time, where the text has a place to part it.
CALL_LETTERS = 1 << 18
#: Places that no pre-token goes across: before the space of a word, between a letter and a digit.
APART = re.compile("(?<=[!-~])(?= [!-~])|(?<=[A-Za-z])(?=[0-9])")
#: Text bytes whose units are numbered together.
SLICE_BYTES = 8 << 20
#: Text bytes whose ids one file holds, about.
FILE_BYTES = 64 << 20
#: Unknown units that are encoded in one call of the library.
CALL = 1000
ORC_OPTIONS = {
    "compression": "lz4",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
}


class Encoder:
    """The tokenizers library, asked once for each distinct unit that a task meets.

    A unit's key is its text without the space in front, or for a text's or line's
    first unit, which has none, ``FIRST`` and its text. Codes are ids as unsigned 16-bit integers.
    Units are remembered in two generations: when the young one is full it becomes
    the old one, and what is met again comes back.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(model)
        vocabulary = self.library.get_vocab()
        if len(vocabulary) > 1 << 16:
            raise ValueError("ids of this vocabulary have more than 16 bits")
        self.begins = np.zeros(1 << 16, bool)
        self.begins[[i for token, i in vocabulary.items() if token[0] == SPACE]] = True
        self.feeds = np.zeros(1 << 16, bool)
        self.feeds[self.library.encode("\n", add_special_tokens=False).ids[0]] = True
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.parted = any(map(APART.search, self.added))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        parts = [list(self.parts(x)) for x in texts]
        found = iter(self.library.encode_batch_fast([x for own in parts for x in own], add_special_tokens=False))
        return [np.concatenate([np.array(next(found).ids, np.uint16) for _ in own]) for own in parts]

    def parts(self, text: str) -> Iterator[str]:
        """A text whole, or if it is long, in parts that are encoded alike alone."""
        at = 0
        while len(text) - at > CALL_LETTERS and not self.parted and (cut := APART.search(text, at + CALL_LETTERS)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def learn(self, keys: list[str]) -> None:
        """Encode units, many in one text: spaces, or else line feeds, begin only what a new unit begins."""
        young, spaced, first, rest = self.young, [], [], []
        for key in keys:
            (rest if CLEAN.fullmatch(key) is None else first if key[0] == FIRST else spaced).append(key)
        for many, text, begins in ((spaced, lambda g: " " + " ".join(g), self.begins), (first, lambda g: "\n" + "\n".join(k[1:] for k in g), self.feeds)):
            groups = [many[at : at + CALL] for at in range(0, len(many), CALL)]
            for group, ids in zip(groups, self.ids([text(g) for g in groups])):
                cuts = np.flatnonzero(begins[ids]).tolist()
                if len(cuts) != len(group):  # ids of units that can't be told apart: one by one
                    rest += group
                    continue
                skip, data = many is first, ids.tobytes()
                young.update(zip(group, (data[2 * (a + skip) : 2 * b] for a, b in zip(cuts, [*cuts[1:], len(ids)]))))
        texts = ["\n" if k == LINE else k[1:] if k[:1] == FIRST else f" {k}" for k in rest]
        young.update(zip(rest, (x.tobytes() for x in self.ids(texts))))

    def of_units(self, units: list[str]) -> list[bytes]:
        """Codes of distinct units."""
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        codes = list(map(young.get, units))
        unknown = []
        for n in [n for n, c in enumerate(codes) if c is None]:
            if (code := old.get(units[n])) is None:
                unknown.append(n)
            else:
                codes[n] = young[units[n]] = code
        self.learn([units[n] for n in unknown])
        for n in unknown:
            codes[n] = young[units[n]] if len(units[n]) <= LONGEST else young.pop(units[n])
        return codes

    def encode(self, texts: pa.Array, end: int) -> pa.ListArray:
        """Ids of every text, and ``end`` after them.

        Texts whose spaces all begin a unit are parted, and their units numbered, by
        Arrow; ids are then gathered by those numbers. Others go through the library
        as they are: those with unusual spaces, or strings of added tokens.
        """
        odd = pc.match_substring_regex(texts, ODD)
        for added in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, added))
        plain = texts.filter(pc.invert(odd))
        lined = pc.replace_substring(plain, "\n", f" {LINE} {FIRST}")
        lists = pc.split_pattern(pc.binary_join_element_wise(FIRST, lined, ""), " ")
        units = lists.flatten().dictionary_encode()
        codes = self.of_units(units.dictionary.to_pylist())
        lengths = np.fromiter(map(len, codes), np.int32, len(codes)) // 2
        number = units.indices.to_numpy()
        counts = lengths[number]
        ends = np.cumsum(counts, dtype=np.int32)
        begins = np.cumsum(lengths, dtype=np.int32) - lengths
        at = np.repeat(begins[number] - (ends - counts), counts)
        at += np.arange(len(at), dtype=np.int32)
        ids = np.frombuffer(b"".join(codes), np.uint16)[at]
        upto = np.append(0, ends)[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        found = as_lists(np.insert(ids, upto[1:], end), upto + np.arange(len(upto)))
        if not pc.any(odd).as_py():
            return found
        own = [np.append(x, np.uint16(end)) for x in self.ids(texts.filter(odd).to_pylist())]
        rest = as_lists(np.concatenate(own), np.cumsum([0, *map(len, own)]))
        mask = odd.to_numpy(zero_copy_only=False)
        order = np.where(mask, len(found) + np.cumsum(mask) - 1, np.cumsum(~mask) - 1)
        return pa.concat_arrays([found, rest]).take(pa.array(order))


def as_lists(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))


@lru_cache(maxsize=1)
def encoder(model: str) -> Encoder:
    return Encoder(model)


def encode(docs: DataFrame, model: str, end: int = END) -> DataFrame:
    """(place, doc_id, ids array<int>) of every document, the end id appended; a null text is empty. ``place`` numbers a partition's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            for part in slices(batch, most=SLICE_BYTES):
                texts = part.column("text").fill_null("")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + part.num_rows)), part.column("doc_id"), encoder(model).encode(texts, end)], ["place", "doc_id", "ids"])
                at += part.num_rows

    return id_and_text(docs).mapInArrow(run, "place long, doc_id long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, model: str, end: int = END) -> None:
    """Write the ids as ORC files in ascending doc_id order, nulls first.

    Texts are ranged by doc_id before they are encoded, as they are smaller than
    their ids. Each file holds one range of about FILE_BYTES of text, so files don't grow with
    the input; ``part`` is its number and ``place`` a row's place in it, so that readers
    know the order of files and rows without their names. Rows are sorted in each file, so
    stripe and row-group statistics prune by doc_id, and Bloom filters help further.
    """
    base = id_and_text(docs)
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    ranged = base.repartitionByRange(ranges, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows = encode(ranged, model, end).select(F.spark_partition_id().alias("part"), "place", "doc_id", "ids")
    rows.write.format("orc").options(**ORC_OPTIONS).save(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, place long, doc_id long, ids array<int>").orc(path)


def digest(ids: DataFrame) -> DataFrame:
    """(part, place, doc_id, n_tokens, ids_crc32) of rows of token files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False).tobytes()
            crcs = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("place"), batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())],
                ["part", "place", "doc_id", "n_tokens", "ids_crc32"],
            )

    return ids.mapInArrow(run, "part int, place long, doc_id long, n_tokens long, ids_crc32 long")


def with_starts(rows: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all documents before, over files and within each file.

    One file's rows meet in one task as one task wrote them; only the files' sums
    are added up in one place.
    """
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(offsets, "part").withColumn("start", F.col("offset") + F.col("inside"))


def tokens_through_orc(docs: DataFrame, model: str, path: str | None = None) -> DataFrame:
    """Write all token ids, read the files back, and return one row per document.

    doc_id, start, n_tokens (with the end id), ids_crc32 (unsigned, of the ids as
    little-endian unsigned 32-bit integers). Null and empty texts have the end id
    alone; null ids come first; rows that repeat a doc_id are neighbours, in the
    order of their texts' hashes, and ``start`` is where each lies in its file. Without rows the result is empty.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, model)
    return with_starts(cut(digest(read_tokens(spark, path)))).select("doc_id", "start", "n_tokens", "ids_crc32")


def model_text(path: str | None = None) -> str:
    """The tokenizer file (a few MB); tasks get its text and need no file of their own."""
    with open(path or public_tokenizers.path(MODEL), encoding="utf-8") as f:
        return f.read()


def op7_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_through_orc(table(spark, sf_dir, "documents"), model_text())
