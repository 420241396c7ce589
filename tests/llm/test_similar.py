"""Near-duplicates at a similarity against shingle sets compared pair by pair."""

import random

import pytest

from lumivox.llm import similar
from lumivox.llm.common import table
from test_repeats import roots, rows_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, width=5):
    words = text.translate(LOWER).encode().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def jaccard(a, b):
    return len(a & b) / len(a | b)


def changed(rng, words, share):
    return [rng.choice("abcdefgh") * 9 if rng.random() < share else w for w in words]


def test_recall_and_precision(spark, data, make_docs):
    """Near copies of texts of 100 to 2,000 words: nine of ten pairs at 0.8 to 0.85 are found, and nothing below 0.8."""
    rng = random.Random(8)
    texts = [t.split() for _, t in rows_of(table(spark, data, "documents")) if 100 <= len(t.split()) <= 2000]
    rng.shuffle(texts)
    pairs = {}
    for n, words in enumerate(texts * 4):
        words = changed(rng, words, 0.3)  # each original is unlike the others
        pairs[2 * n] = (" ".join(words), " ".join(changed(rng, words, rng.choice([0.012, 0.018, 0.02, 0.022, 0.03]))))
    docs = make_docs([(i + k, t) for i, both in pairs.items() for k, t in enumerate(both)])
    found = {r.doc_id: r.component_id for r in similar.similar_groups(docs.repartition(6)).collect()}
    bands = {low: [0, 0] for low in (0.0, 0.8, 0.85, 0.9)}
    for i, (a, b) in pairs.items():
        band = max(x for x in bands if jaccard(shingle_set(a), shingle_set(b)) >= x)
        bands[band][0] += 1
        bands[band][1] += found[i + 1] == i
        assert found[i] == i
    assert bands[0.0][1] == 0 and bands[0.0][0] > 20
    assert bands[0.8][0] > 40 and all(hit >= 0.9 * n for n, hit in list(bands.values())[1:]), bands


def test_groups_of_given_documents(spark, data):
    rows = rows_of(table(spark, data, "documents"))
    sets = [shingle_set(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    want = roots(len(rows), links)
    least = {r: min(i for (i, _), q in zip(rows, want) if q == r) for r in want}
    found = {r.doc_id: r.component_id for r in similar.similar_groups(table(spark, data, "documents")).collect()}
    assert len(links) > 10 and found == {i: least[r] for (i, _), r in zip(rows, want)}


def test_crowd_is_joined_by_few_pairs(make_docs):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i in range(400) for k in [rng.randrange(300)]]
    assert {r.component_id for r in similar.similar_groups(make_docs(rows)).collect()} == {0}


def test_odd_documents(odd, make_docs):
    rows = [r for r in rows_of(odd) if r[0] is not None]
    found = sorted(tuple(r) for r in similar.similar_groups(odd).collect())
    assert [i for i, _ in found] == sorted(i for i, _ in rows)
    wordless = [i for i, t in rows if not t.encode().split()]
    assert all((i, min(wordless)) in found for i in wordless)
    assert similar.similar_groups(make_docs([])).count() == 0
    kept = similar.one_of_each(make_docs([(3, "a b c"), (1, "A b  c"), (None, "a b c"), (7, "other words"), (7, "a b c"), (9, None), (8, "")]))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 8, None]
    assert kept.columns == make_docs([]).columns
