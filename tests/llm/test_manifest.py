"""The Merkle manifest against a tree built plainly, whole and in small blocks."""

import hashlib
import random
import zlib
from itertools import groupby

import pytest

from lumivox.llm import manifest
from lumivox.llm.common import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf_of(r, text):
    return sha("".join(field(x) for x in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def reduced(nodes):
    """Root, and for each node its (place, siblings) per level."""
    at, ways = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, way in enumerate(ways):
            run, place = nodes[at[i] // 8 * 8 : at[i] // 8 * 8 + 8], at[i] % 8
            way.append((place, run[:place] + run[place + 1 :]))
            at[i] //= 8
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], ways


def expected(rows):
    keyed = sorted(rows, key=lambda r: (r.lang is not None, (r.lang or "").encode(), r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)))
    groups = [list(g) for _, g in groupby(keyed, key=lambda r: r.lang)]
    subs = [reduced([leaf_of(r, r.text) for r in g]) for g in groups]
    if not subs:
        return []
    root, tops = reduced([s for s, _ in subs])
    out = []
    for g, (subroot, ways), top in zip(groups, subs, tops):
        for r, way in zip(g, ways):
            way = way + top
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            node = leaf_of(r, r.text.translate(LOWER) if hit and r.text is not None else r.text)
            for place, others in way:
                node = sha("".join(others[:place] + [node] + others[place:]))
            out.append((r.doc_id, leaf_of(r, r.text), subroot, root, sha("".join(x for _, o in way for x in o)), node, node == root))
    return out


def same(docs, levels=manifest.BLOCK_LEVELS):
    found = [tuple(r) for r in manifest.manifest(docs, levels).collect()]
    assert sorted(found, key=str) == sorted(expected(docs.collect()), key=str)
    return found


def test_whole_table(spark, data):
    found = same(table(spark, data, "documents"))
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("levels", [1, 2])
def test_versions_go_on_above_their_blocks(spark, make_docs, levels):
    rng = random.Random(levels)
    docs = make_docs([(i, "".join(rng.choice("abAB") for _ in range(rng.randrange(5)))) for i in rng.sample(range(10000), 600)]).repartition(5)
    mixed = docs.selectExpr(*(f"`{c}`" for c in docs.columns if c != "lang"), "CASE WHEN doc_id % 3 > 0 THEN 'en' WHEN doc_id % 2 = 0 THEN concat('l', doc_id % 21) END AS lang")
    same(mixed, levels)


def test_odd_rows(spark, odd, make_docs):
    same(odd)
    same(odd.unionByName(odd), 1)  # every row twice
    assert same(make_docs([])) == []
    same(make_docs([(7, None)]))  # a lone leaf is the root


def test_hot_ids_lie_in_many_ranges(spark, make_docs):
    docs = make_docs([(None if i % 3 else 5, f"text {i % 40}") for i in range(300)])
    same(docs, 1)
