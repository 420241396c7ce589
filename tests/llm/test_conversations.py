"""Conversation repair against a plain table of best edits and a plain account of faults."""

import hashlib
import random
import zlib
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumivox.llm import conversations as C
from lumivox.llm.common import table

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def cheapest(rows):
    """Best (cost, audit) over rows of (initial, fault), by states after each row."""

    def inserted(best):
        for _ in range(2):
            for state in list(best):
                cost, edits = best[state]
                to, found = C.NEEDED[state], (cost + 5, edits + "I")
                if to not in best or found < best[to]:
                    best[to] = found
        return best

    best = inserted({C.START: (0, "")})
    for initial, fault in rows:
        after = {}

        def offer(state, cost, edits):
            if state not in after or (cost, edits) < after[state]:
                after[state] = cost, edits

        for state, (cost, edits) in best.items():
            offer(state, cost + 2, edits + "D")
            if fault not in "bd":
                stay = cost + 5 * (fault == "t")
                offer(C.NEEDED[state], stay + 1, edits + "R")
                if (state, initial) in C.KEPT:
                    offer(C.KEPT[state, initial], stay, edits + "K")
        best = inserted(after)
    return min(best[s] for s in C.ENDS if s in best)


def expected(rows):
    """One result per conversation, read straight from the rules."""
    out = {}
    for conv in {r[0] for r in rows}:
        left = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            left += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults, codes = set(), {"b": 0, "d": 0, "t": 0, "-": 0}, []
        for _, role, text in left:
            core = text.rstrip(SPACES)
            fault = "b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "-"
            seen.add((role, text))
            faults[fault] += 1
            codes.append((role[:1] if role[:1] in ("s", "u", "a") else "-", fault))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
        cost, audit = cheapest(codes) if left else (0, "")
        turns = [t for t, _, _ in left if t is not None]
        state, at, lines = C.START, 0, []
        for edit in audit:
            if edit == "I":
                lines.append(C.NAMES[C.NEEDED[state]] + ":")
                state = C.NEEDED[state]
                continue
            _, role, text = left[at]
            if edit == "K":
                lines.append(f"{role}:{text}")
                state = C.KEPT[state, role[0]]
            elif edit == "R":
                lines.append(f"{C.NAMES[C.NEEDED[state]]}:{text}")
                state = C.NEEDED[state]
            at += 1
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults["b"], faults["d"], faults["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def same(df, most=C.CHUNK):
    found = {r.conv_id: tuple(r)[1:] for r in C.repair(df, most).collect()}
    assert found == expected([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    return found


def test_whole_table(spark, data):
    found = same(table(spark, data, "conversations"))
    assert any(r[5] for r in found.values())


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, edits string, letters string, at int")


def random_rows(rng, convs, length):
    roles = ["user", "assistant", "system", "tool", None, ""]
    texts = ["Yes.", "No!", "Why?", "cut off", " ", "", None, "Yes.\n", "a.b", " ", "x" * 50 + "."]
    return [(c, None if rng.random() < 0.05 else rng.randrange(length), rng.choice(roles[:2] if rng.random() < 0.7 else roles), rng.choice(texts)) for c in convs for _ in range(rng.randrange(1, length))]


@pytest.mark.parametrize("most", [3, C.CHUNK])
def test_random_conversations(spark, most):
    rng = random.Random(most)
    same(made(spark, random_rows(rng, [None, *range(60)], 14)).repartition(5), most)


def test_long_conversations(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"text {t}" + rng.choice([".", ""])) for t in range(1500)]
    rows += [(2, 0, "user", "word " * 100000 + "end.")]
    same(made(spark, rows).repartition(4))


def test_odd_tables(spark):
    assert same(made(spark, [])) == {}
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert same(made(spark, [(dropped, 0, "user", "gone.")]))[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    same(made(spark, [(3, 1, "user", "Same.")] * 5 + [(3, None, None, None)]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("sua-"), st.sampled_from("bdt----")), max_size=12))
def test_search_is_optimal(codes):
    rows = "".join(a + b for a, b in codes)
    best = min((cost, edits) for _, _, cost, edits in C.answers(rows, True, True))
    assert best == cheapest(codes)


def test_search_against_all_edits():
    """Every edit string over up to three rows with up to three insertions."""
    for codes in product([("s", "-"), ("u", "-"), ("a", "t"), ("-", "-"), ("u", "d")], repeat=3):
        found = []
        for ops in product("DKR", repeat=3):
            for gaps in product(range(3), repeat=4):
                if sum(gaps) <= 3:
                    state, cost, ok = C.START, 0, True
                    for i in range(4):
                        for _ in range(gaps[i]):
                            state, cost = C.NEEDED[state], cost + 5
                        if i < 3:
                            (initial, fault), op = codes[i], ops[i]
                            cost += {"D": 2, "K": 0, "R": 1}[op] + (5 if fault == "t" and op != "D" else 0)
                            ok &= op == "D" or (fault not in "bd" and (op == "R" or (state, initial) in C.KEPT))
                            state = state if op == "D" or not ok else C.NEEDED[state] if op == "R" else C.KEPT[state, initial]
                    if ok and state in C.ENDS:
                        found.append((cost, "".join("I" * g + o for g, o in zip(gaps, [*ops, ""]))))
        assert min(x[2:] for x in C.answers("".join(a + b for a, b in codes), True, True)) == min(found)
