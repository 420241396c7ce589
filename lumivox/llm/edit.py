"""Edit distances: by antidiagonals of many pairs or bit-parallel for whole strings, banded for a pattern inside a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs that numpy is worth it for, pairs that need none of the next length, and cells of an antidiagonal of all pairs that are taken together.
FEW, ENOUGH, CELLS = 8, 64, 32768
#: Letters of a string that numpy takes, and more than any distance of such strings; 16 bits hold it and as many again.
LETTERS, FAR = 8192, 10_000
#: Words that a walk looks ahead, and antidiagonals between two looks at which pairs are beyond hope.
AHEAD, STEPS_BETWEEN = 3, 64
#: Letters of the longer string between two moves of the band of integers.
WINDOW = 512


def trimmed(a: str | bytes, b: str | bytes) -> tuple[str | bytes, str | bytes]:
    """Two strings without their common ends."""
    for _ in range(2):
        low, high = 0, min(len(a), len(b))
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
        a, b = a[low:][::-1], b[low:][::-1]
    return a, b


def edit_distance(a: str | bytes, b: str | bytes, most: int | None = None) -> int:
    """Levenshtein distance; one column of the table is one Python integer.

    Common ends are cut first. Each step adds one letter of the longer string to
    the columns' differences, kept as bit sets of +1 and -1, of the letters of the
    shorter one that an alignment of ``most`` edits can touch there. With ``most`` the
    result is some number above it as soon as the distance must be.
    """
    a, b = sorted(trimmed(a, b), key=len)
    if not a:
        return len(b)
    if most is None:
        most = len(b)
    more = len(b) - len(a)
    if more > most:
        return more
    spare = (most - more) // 2
    at: dict = {}
    for i, letter in enumerate(a):
        at[letter] = at.get(letter, 0) | 1 << i
    up = down = distance = first = last = 0
    for start in range(0, len(b), WINDOW):
        gone, new = max(first, start - more - spare) - first, min(len(a), start + WINDOW + spare) - last
        first, last, distance = first + gone, last + new, distance + new
        up, down = up >> gone | (1 << new) - 1 << last - new - first, down >> gone
        full, top = (1 << last - first) - 1, 1 << last - first - 1
        here = {letter: places >> first & full for letter, places in at.items()}
        reach = most + more + last - start
        for letter in b[start : start + WINDOW]:
            if distance > reach:
                return distance
            reach -= 1
            same = here.get(letter, 0)
            settled = same | down
            steady = (((same & up) + up) ^ up) | settled
            rise = down | (full & ~(steady | up))
            fall = up & steady
            distance += bool(rise & top) - bool(fall & top)
            rise = rise << 1 | 1
            up = full & (fall << 1 | ~(settled | rise))
            down = full & rise & settled
    return distance


def within(pairs: list[tuple[bytes, bytes]], most: np.ndarray) -> np.ndarray:
    """For pairs (shorter, longer), none over LETTERS: is their distance at most ``most``?

    All pairs advance by an antidiagonal of their tables at a time. The arrays have a
    row for each even and each odd diagonal (place in the longer string minus place in
    the shorter) that an alignment of ``most`` edits can touch, and a column for each
    pair. A common front fills all longer strings up to one length, which leaves
    distances as they are. Pairs that can't get there any more are dropped.
    """
    sizes = np.array([(len(a), len(b)) for a, b in pairs])
    n, more = int(sizes[:, 1].max()), sizes[:, 1] - sizes[:, 0]
    spare = (most - more) // 2
    low = (min(int(spare.max()), n) + 1) // 2 * 2
    rows = (low + min(int((more + spare).max()), n)) // 2 + 1  # diagonals from -low on
    short, long = (np.zeros((len(pairs), n + 2 * rows + 2), np.uint8) for _ in range(2))
    for row, other, (a, b), d in zip(short, long, pairs, more.tolist()):
        row[rows + 1 + d : rows + 1 + d + len(a)] = np.frombuffer(a, np.uint8)[::-1]
        other[rows + 1 + n - len(b) : rows + 1 + n] = np.frombuffer(b, np.uint8)
    short, long = (np.ascontiguousarray(x.T).astype(np.int16) for x in (short, long))
    most, more, number, out = most.astype(np.int16), more.astype(np.int16), np.arange(len(pairs)), np.zeros(len(pairs), bool)
    even, odd = (np.full((rows + 1, len(pairs)), FAR, np.int16) for _ in range(2))
    even[low // 2] = 0  # the last row of even and the first of odd stay beyond all diagonals
    differ, least, one = np.empty((rows, len(pairs)), np.int16), np.empty((rows, len(pairs)), np.int16), np.int16(1)
    diagonals = np.arange(-low, 2 * rows - low, dtype=np.int16)[:, None]
    ends = 2 * n - int(more.max())
    for s in range(1, 2 * n + 1):
        own, other = (odd[1:], even) if s % 2 else (even[:-1], odd)
        i, j = (s + low - s % 2) // 2, (s - low + s % 2) // 2  # places of the first diagonal
        np.bitwise_xor(short[n - i + rows + 1 : n - i + 2 * rows + 1], long[j + rows : j + 2 * rows], out=differ)
        np.minimum(differ, one, out=differ)
        np.add(differ, own, out=differ)
        np.minimum(other[1:], other[:-1], out=least)
        np.add(least, one, out=least)
        np.minimum(least, differ, out=own)
        if s >= ends:
            done = np.flatnonzero(more == 2 * n - s)
            out[number[done]] = own[(more[done] + low - s % 2) // 2, done] <= most[done]
        if s % STEPS_BETWEEN == 0:
            hope = np.minimum((even[:-1] + np.abs(more - diagonals[::2])).min(0), (odd[1:] + np.abs(more - diagonals[1::2])).min(0))
            stay = (hope <= most) & (more < 2 * n - s)
            if not stay.any():
                break
            if stay.sum() <= 0.8 * len(stay):
                number, most, more = number[stay], most[stay], more[stay]
                short, long, even, odd = (np.compress(stay, x, 1) for x in (short, long, even, odd))  # rows stay contiguous
                differ, least = (np.empty((rows, len(number)), np.int16) for _ in range(2))
    return out


def walked(x: list[bytes], y: list[bytes], most: int) -> bool:
    """True if setting the words of two lines against each other in order needs ``most`` edits at most.

    Where they differ, the next equal words within AHEAD end the difference.
    """
    i = j = cost = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            while (run := x[i : i + 8]) and run == y[j : j + 8]:
                i, j = i + len(run), j + len(run)
            continue
        for p, q in STEPS:
            if i + p < len(x) and j + q < len(y) and x[i + p] == y[j + q]:
                break
        else:
            p = q = 1
        a, b = sum(map(len, x[i : i + p])) + p, sum(map(len, y[j : j + q])) + q
        cost += max(a, b) - (p > 0 < q)  # one space of either stays
        if cost > most:
            return False
        i, j = i + p, j + q
    return cost + sum(map(len, x[i:])) + len(x) - i + sum(map(len, y[j:])) + len(y) - j <= most


#: Words of either line that a difference takes, the fewest first.
STEPS = sorted(((p, q) for p in range(AHEAD + 1) for q in range(AHEAD + 1) if p + q), key=sum)


def batched(rest: list[tuple[int, tuple[bytes, bytes], int]]) -> Iterator[list[tuple[int, tuple[bytes, bytes], int]]]:
    """(number, pair, most) by about the same length and most, as many as CELLS allows."""

    def size(x: tuple) -> tuple[int, int]:
        """Steps of a quarter to a half of the length, and half the diagonals."""
        bits = (n := len(x[1][1])).bit_length()
        return bits * 4 + (n << 2 >> bits), 1 + min(x[2], n) // 2

    rest.sort(key=size)
    sizes, start = list(map(size, rest)), 0
    for at in range(1, len(rest) + 1):
        if at == len(rest) or at - start >= FEW and ((at - start) * sizes[at][1] > CELLS or sizes[at][0] > sizes[start][0] + (at - start < ENOUGH)):
            yield rest[start:at]
            start = at


def similar(a: bytes, b: bytes, least: float) -> bool:
    """True if 1 - distance / longer length is at least ``least``."""
    return bool(similar_pairs([a], [b], least)[0])


def similar_pairs(xs: list[bytes], ys: list[bytes], least: float, walk: bool = True) -> np.ndarray:
    """For each pair whether 1 - distance / longer length is at least ``least``.

    Words set against each other in order bound the distance from above, which is often
    enough where most pairs are similar; ``walk`` says whether to try. The rest goes through ``within`` with others of about its size, or, if long
    or few, through ``edit_distance``.
    """
    out, rest, alone = np.zeros(len(xs), bool), [], []
    for i, (a, b) in enumerate(zip(xs, ys)):
        most = int((1 - least) * max(len(a), len(b)) + 1e-9)
        if abs(len(a) - len(b)) > most:
            continue
        if walk and walked(a.split(b" "), b.split(b" "), most):
            out[i] = True
            continue
        a, b = sorted(trimmed(a, b), key=len)
        if len(b) <= most:
            out[i] = True
        elif a:
            (rest if len(b) <= LETTERS else alone).append((i, (a, b), most))
    for some in batched(rest):
        if len(some) < FEW:
            alone += some
        else:
            out[[i for i, _, _ in some]] = within([p for _, p, _ in some], np.array([m for _, _, m in some]))
    for i, (a, b), most in alone:
        out[i] = edit_distance(a, b, most) <= most
    return out


def banded_find(pattern: bytes, text: bytes, lowest: int, highest: int, most: int) -> tuple[int, int, int] | None:
    """Best alignment of the whole pattern inside the text, within a band of diagonals.

    A diagonal is text place minus pattern place. Returns (edits, start, end) with the
    fewest edits, the first end among ties, or None if more than ``most`` are needed.
    """
    width, far = highest - lowest + 1, most + 1
    cells = [(0, lowest + d) if 0 <= lowest + d <= len(text) else (far, 0) for d in range(width)]
    for i, letter in enumerate(pattern):
        new = []
        for d in range(width):
            at = i + lowest + d  # the text letter that this diagonal sets against the pattern's
            best = (far, 0)
            if 0 <= at < len(text):
                cost, start = cells[d]
                best = (cost + (text[at] != letter), start)
            if d + 1 < width and cells[d + 1][0] + 1 < best[0]:
                best = (cells[d + 1][0] + 1, cells[d + 1][1])
            if d and new[d - 1][0] + 1 < best[0] and 0 <= at < len(text):
                best = (new[d - 1][0] + 1, new[d - 1][1])
            new.append(best)
        cells = new
        if min(c for c, _ in cells) > most:
            return None
    cost, d = min((c, d) for d, (c, _) in enumerate(cells))
    return (cost, cells[d][1], len(pattern) + lowest + d) if cost <= most else None
