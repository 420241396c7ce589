"""SentencePiece merge-type vocabularies: units of a text, the agenda of pairs, decoding.

With these vocabularies no piece holds the space mark after another character,
so no merge crosses from one unit (space marks, then other characters) to the
next; ``Vocabulary`` proves that for the model at hand when it is made. A unit's
pieces thus depend on the unit alone, and each task remembers the units it met.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from lumivox.llm.common import id_and_text, slices, table

MODEL = "piece_bpe_32k.model"
#: Fixed value: the mark that stands for a space.
MARK = "▁"
UNIT_START = re.compile(f"(?<=[^{MARK}])(?={MARK})")
INNER_MARK = re.compile(f"[^{MARK}]{MARK}")
#: Units that a task remembers before it starts anew, and letters of the longest that it does.
REMEMBERED, LONGEST = 400_000, 64
#: Letters of the longest unit that is compared with the library, which needs much memory for a longer one.
COMPARED = 1_000_000
#: Letters up to which units are merged side by side, by steps of width; longer ones one by one.
WIDTHS = (4, 8, 16, 32, 65)
#: Rank of a pair that makes no piece, odd multiplier and bits of the table of pairs.
NONE, ODD, TABLE_BITS = (1 << 31) - 1, 0x9E3779B97F4A7C15, 20
TOKEN_LIMIT = 4096


def units_of(text: str) -> list[str]:
    """The text's units, each without its first space mark; the text's own start has one too."""
    if "  " not in text and MARK not in text and not text.endswith(" ") and not text.startswith(" "):
        return text.split(" ") if text else []
    return [x[1:] for x in UNIT_START.split(MARK + text.replace(" ", MARK))] if text else []


class Vocabulary:
    """Pieces and scores of a model, read from its bytes."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(self.library.vocab_size())
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) for i in ids]
        names = [self.library.id_to_piece(i) for i in ids]
        self.ids = {names[i]: i for i in ids if not special[i]}
        self.bytes = {int(names[i][3:5], 16): i for i in ids if self.library.is_byte(i)}
        if any(map(INNER_MARK.search, self.ids)) or len(self.bytes) != 256:
            raise ValueError("units of this vocabulary can't be encoded one by one")
        costs = np.array([-self.library.get_score(i) for i in ids])
        self.ranks = np.unique(costs, return_inverse=True)[1].astype(np.int32)
        # symbols are pieces, then letters of pieces that are none themselves, any other letter, and nothing
        symbols = self.ids | {c: len(names) + i for i, c in enumerate(sorted(set("".join(self.ids)) - set(self.ids)))}
        self.pieces, self.other, self.nothing = len(names), len(names) + len(symbols), len(names) + len(symbols) + 1
        self.letters = np.full(0x110000, self.other, np.int32)
        for x, i in symbols.items():
            if len(x) == 1:
                self.letters[ord(x)] = i
        self.joins = {self.pair(symbols[p[:c]], symbols[p[c:]]): i for p, i in self.ids.items() for c in range(1, len(p)) if p[:c] in symbols and p[c:] in symbols}
        self.keys, self.made = np.full(1 << TABLE_BITS, -1, np.int64), np.zeros(1 << TABLE_BITS, np.int32)
        for key, i in self.joins.items():
            at = (key * ODD & (1 << 64) - 1) >> (64 - TABLE_BITS)
            while self.keys[at] >= 0:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.made[at] = key, i

    def pair(self, x, y):
        return x * (self.nothing + 1) + y

    def joined(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each two symbols the piece that they make and its rank (NONE if they make none); the best score has rank 0."""
        key = self.pair(x.astype(np.int64), y)
        at = ((key.view(np.uint64) * np.uint64(ODD)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        while len(off := np.nonzero((self.keys[at] != key) & (self.keys[at] >= 0))[0]):  # probes go on one by one
            at[off] = (at[off] + 1) % len(self.keys)
        made = self.made[at]
        return made, np.where(self.keys[at] == key, self.ranks[made], np.int32(NONE))

    def symbols_of(self, text: str) -> np.ndarray:
        return self.letters[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def merge_all(self, units: list[str]) -> list[bytes]:
        """Ids (32-bit integers) of each unit by an agenda of its own: the best-scored adjacent pair first, then the leftmost."""
        out: list[bytes] = [b""] * len(units)
        lengths = np.fromiter(map(len, units), np.int64, len(units)) + 1
        for low, width in zip((0, *WIDTHS), WIDTHS):
            at = np.flatnonzero((lengths > low) & (lengths <= width)).tolist()
            if at:
                for i, ids in zip(at, self.side_by_side([units[i] for i in at], lengths[at], width)):
                    out[i] = ids
        for i in np.flatnonzero(lengths > WIDTHS[-1]).tolist():
            out[i] = self.alone(units[i])
        return out

    def side_by_side(self, units: list[str], lengths: np.ndarray, width: int) -> list[bytes]:
        """Ids of units of up to ``width`` letters: every round each unit's agenda gives its best pair.

        A unit's row holds its symbols, chained by the places before and after; the
        agenda is the row of ranks of the pairs that begin at each place.
        """
        n, whole = len(units), MARK + MARK.join(units)
        rows, first = np.repeat(np.arange(n), lengths), np.cumsum(lengths) - lengths
        symbols = np.full((n, width + 1), self.nothing, np.int32)
        symbols[rows, np.arange(len(rows)) - first[rows]] = self.symbols_of(whole)
        after = np.tile(np.arange(1, width + 2, dtype=np.int16), (n, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int16), (n, 1))  # before the first lies the last place, which holds nothing
        made, agenda = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), NONE, np.int32)
        pieces, ranks = self.joined(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())
        made[:, :-1], agenda[:, :-1] = pieces.reshape(n, width), ranks.reshape(n, width)
        left = np.arange(n)
        while len(left):
            i = agenda[left].argmin(axis=1)
            more = agenda[left, i] != NONE
            left, i = left[more], i[more]
            j = after[left, i]
            k = after[left, j]
            symbols[left, i], symbols[left, j], agenda[left, j] = made[left, i], self.nothing, NONE
            after[left, i], before[left, k] = k, i
            made[left, i], agenda[left, i] = self.joined(symbols[left, i], symbols[left, k])
            h = before[left, i]
            made[left, h], agenda[left, h] = self.joined(symbols[left, h], symbols[left, i])
        there = symbols != self.nothing
        ids, ends = symbols[there], np.cumsum(there.sum(axis=1)).tolist()
        odd = set(np.nonzero((symbols >= self.pieces) & there)[0].tolist())
        data, starts = ids.tobytes(), [0, *ends]
        places = np.nonzero(there)[1]
        return [self.with_bytes(ids[a:b], places[a:b], MARK + units[r]) if r in odd else data[4 * a : 4 * b] for r, (a, b) in enumerate(zip(starts, ends))]

    def with_bytes(self, ids: np.ndarray, places: np.ndarray, text: str) -> bytes:
        """Ids where letters that are no pieces become the ids of their bytes."""
        out, last = [], 0
        for i in np.flatnonzero(ids >= self.pieces).tolist():
            out += [ids[last:i].tobytes(), array("i", [self.bytes[b] for b in text[places[i]].encode()]).tobytes()]
            last = i + 1
        return b"".join([*out, ids[last:].tobytes()])

    def merge(self, unit: str) -> list[int]:
        return np.frombuffer(self.merge_all([unit])[0], np.int32).tolist()

    def alone(self, unit: str) -> bytes:
        """Ids of one unit of any length; a letter takes about 40 bytes.

        The pairs of letters are sorted at once; those that merges add wait in a heap.
        """
        text = MARK + unit
        ids = self.symbols_of(text)
        n, joins, ranks = len(ids), self.joins, self.ranks.tolist()
        _, found = self.joined(ids[:-1], ids[1:])
        at = np.flatnonzero(found != NONE)
        first, later = np.sort((found[at].astype(np.int64) << 32) | at), []
        parts, after, before = array("i", ids.tobytes()), array("i", range(1, n + 1)), array("i", range(-1, n - 1))

        def agenda() -> Iterator[int]:
            for start in range(0, len(first), 1 << 16):
                for x in first[start : start + (1 << 16)].tolist():
                    while later and later[0] < x:
                        yield heapq.heappop(later)
                    yield x
            while later:
                yield heapq.heappop(later)

        for entry in agenda():
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if parts[i] < 0 or j >= n:
                continue
            made = joins.get(self.pair(parts[i], parts[j]))
            if made is None or ranks[made] != rank:
                continue  # one of the two has been merged elsewhere
            parts[i], parts[j], k = made, -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (wider := joins.get(self.pair(made, parts[k]))) is not None:
                    heapq.heappush(later, ranks[wider] << 32 | i)
            if (h := before[i]) >= 0 and (wider := joins.get(self.pair(parts[h], made))) is not None:
                heapq.heappush(later, ranks[wider] << 32 | h)
        ids = np.frombuffer(parts, np.int32)
        places = np.flatnonzero(ids >= 0)
        return self.with_bytes(ids[places], places, text)

    def whole_tokens(self) -> frozenset[str]:
        """Vocabulary strings that, as a unit of a text, encode alone as one token.

        Proved with the library itself, for each string that can be a unit: its
        encoding is exactly its own id.
        """
        own = [p[1:] for p in self.ids if p[0] == MARK]
        return frozenset(x for x, ids in zip(own, self.library.encode(own, num_threads=1)) if ids == [self.ids[MARK + x]])


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


class Remembered:
    """Ids of the units that a task has met, but of long ones only while they are needed."""

    def __init__(self, model: bytes, most: int = REMEMBERED):
        self.vocabulary, self.most, self.known = vocabulary(model), most, {}

    def learn(self, texts: list[list[str]]) -> list[str]:
        """Encode the units that are new, each once, and compare them with the library; the long ones are returned."""
        if len(self.known) > self.most:
            self.known.clear()
        new = list(set(chain.from_iterable(texts)).difference(self.known))
        found = self.vocabulary.merge_all(new)
        same = [i for i, x in enumerate(new) if x and len(x) <= COMPARED]  # the library reads an empty unit as no text
        theirs = self.vocabulary.library.encode([new[i] for i in same], num_threads=1)
        if any(len(found[i]) != 4 * len(x) for i, x in zip(same, theirs)) or b"".join(found[i] for i in same) != array("i", chain.from_iterable(theirs)).tobytes():
            raise AssertionError("the agenda and the sentencepiece library differ")
        self.known.update(zip(new, found))
        return [x for x in new if len(x) > LONGEST]

    def ids(self, units: list[str]) -> list[int]:
        return np.frombuffer(b"".join(map(self.known.__getitem__, units)), np.int32).tolist()

    def forget(self, units: list[str]) -> None:
        for x in units:
            del self.known[x]

    def forget_all(self) -> None:
        """At a task's end: a worker lives on through stages that need its memory."""
        self.known.clear()


@lru_cache(maxsize=2)
def remembered_ids(model: bytes) -> Remembered:
    return Remembered(model)


@lru_cache(maxsize=2)
def remembered_counts(model: bytes) -> tuple[frozenset[str], dict[str, int]]:
    return vocabulary(model).whole_tokens(), {}


def count_tokens(docs: DataFrame, model: bytes, limit: int = TOKEN_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document, whole texts.

    Units that are proved to be one token count as one without a look at their
    letters; only the rest are merged, each distinct one once per task. Null and
    empty texts have 0 bytes and 0 tokens; repeated rows are counted each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, counts = remembered_counts(model)
        library = vocabulary(model).library
        for batch in batches:
            for part in slices(batch):
                texts = [x or "" for x in part.column("text").to_pylist()]
                units = [units_of(x) for x in texts]
                if len(counts) > REMEMBERED:
                    counts.clear()
                if not counts:
                    counts.update(dict.fromkeys(single, 1))
                rest = list(set(chain.from_iterable(units)).difference(counts))
                counts.update(zip(rest, map(len, library.encode(rest, num_threads=1))))
                # the library reads an empty unit as no text; within a text it is a lone space mark
                counts[""] = 1
                long = [x for x in rest if len(x) > LONGEST]
                n_tokens = [sum(map(counts.__getitem__, u)) for u in units]
                n_bytes = [len(x.encode()) for x in texts]
                for x in long:
                    del counts[x]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def encode_and_decode(docs: DataFrame, model: bytes, keep: bool = False) -> DataFrame:
    """Encode every text with the agenda and decode the ids with the library.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256, and with ``keep`` also ids (array<int>) and decoded. In every
    Arrow batch the units met for the first time are checked against the library (but
    units of over COMPARED letters without a space); a difference ends the job. Null
    and empty texts have no ids and decode to "".
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, library = remembered_ids(model), vocabulary(model).library
        decimals = [str(i) for i in range(library.vocab_size())]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            for part in slices(batch):
                texts = [units_of(x or "") for x in part.column("text").to_pylist()]
                long = known.learn(texts)
                ids = [known.ids(x) for x in texts]
                known.forget(long)
                joined = [",".join(map(decimals.__getitem__, x)) for x in ids]
                decoded = library.decode(ids, num_threads=1) if ids else []
                columns = [part.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array(map(sha, joined), pa.string()), pa.array(map(sha, decoded), pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)
        known.forget_all()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep
    return id_and_text(docs).mapInArrow(run, schema)


def model_bytes(path: str | None = None) -> bytes:
    """The model file (about 0.5 MB); tasks get its bytes and need no file of their own."""
    with open(path or public_tokenizers.path(MODEL), "rb") as f:
        return f.read()


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), model_bytes())


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"), model_bytes())
