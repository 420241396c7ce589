"""SimHash fingerprints of word shingles, computed batch by batch with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: ASCII capitals and their small letters; nothing else changes case.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
#: Shingles whose bits are counted at a time (64 bytes each).
BLOCK = 1 << 15


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``width`` words, repeats included.

    Words are runs of bytes other than space and \\x09-\\x0D, with A-Z in lower
    case. A text of fewer words gives the hash of the whole sequence; a text
    without words (or null) gives none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, len(words) - width + 1)


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of a text as an unsigned number; 0 for a text without words."""
    return majority_bits(shingle_hashes(text, width))


#: Fixed value: one bit in each byte of a 64-bit number.
LANES = np.uint64(0x0101010101010101)


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each group of consecutive hashes the number whose bits are set in over half of them.

    Eight bits are summed at a time, one per byte, over runs of at most 255 hashes.
    Empty groups give 0.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    runs = -(-counts[full] // 255)
    group = np.repeat(np.arange(len(full)), runs)
    nth = np.arange(len(group)) - (np.cumsum(runs) - runs)[group]
    starts = (np.cumsum(counts) - counts)[full][group] + 255 * nth
    sums = np.empty((len(group), 8, 8), np.uint8)
    for bit in range(8):
        lanes = (hashes >> np.uint64(bit)) & LANES
        sums[:, :, bit] = np.add.reduceat(lanes, starts).view(np.uint8).reshape(-1, 8)
    totals = np.add.reduceat(sums.reshape(-1, 64).astype(np.int64), np.cumsum(runs) - runs, axis=0)
    bits = 2 * totals > counts[full][:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out
