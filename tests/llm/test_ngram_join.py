"""The n-gram join against sets compared pair by pair."""

import random

import pytest

from lumivox.llm import ngram_join
from lumivox.llm.common import table
from test_repeats import roots, rows_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, width):
    words = text.translate(LOWER).encode().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def expected(rows, width=4, percent=85):
    sets = [shingle_set(text, width) for _, text in rows]
    at = {}
    for i, x in enumerate(sets):
        for s in x:
            at.setdefault(s, []).append(i)
    links = set()
    for i, x in enumerate(sets):
        for j in {j for s in x for j in at[s] if j > i}:
            common = len(x & sets[j])
            if 100 * common >= percent * (len(x) + len(sets[j]) - common):
                links.add((i, j))
    found = roots(len(rows), links)
    least = {}
    for (i, _), r in zip(rows, found):
        least[r] = i if least.get(r) is None or (i is not None and i < least[r]) else least[r]
    return sorted(((i, len(x), least[r]) for (i, _), x, r in zip(rows, sets, found)), key=str), len(links)


def same(docs):
    want, links = expected(rows_of(docs))
    assert sorted((tuple(r) for r in ngram_join.ngram_groups(docs).collect()), key=str) == want
    return links


def test_whole_table(spark, data):
    assert same(table(spark, data, "documents").repartition(3))


def changed(rng, words, share):
    return [rng.choice("abcdefgh") * 9 if rng.random() < share else w for w in words]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_copies(make_docs, seed):
    """Chains, stars and crowds of near copies, many of them close to the bound, and passages that many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(4))
    passage, texts = [word() for _ in range(60)], []
    for _ in range(12):
        words = [word() for _ in range(rng.randrange(20, 200))]
        texts.append(words)
        for _ in range(rng.randrange(1, 12)):
            words = changed(rng, rng.choice([words, texts[-1]]), rng.choice([0, 0.01, 0.02, 0.03]))
            texts.append(words[: len(words) - rng.randrange(0, 8)])
    texts += [[word() for _ in range(8)] + passage for _ in range(30)]
    texts += [passage + [word() for _ in range(rng.randrange(6))] for _ in range(15)]
    few = [word() for _ in range(6)]
    texts += [[rng.choice(few) for _ in range(rng.randrange(1, 9))] for _ in range(60)]
    rng.shuffle(texts)
    docs = make_docs([(rng.randrange(10**6), " ".join(w.upper() if rng.random() < 0.1 else w for w in t)) for t in texts])
    assert same(docs.repartition(6)) > 50


def test_few_words_in_all_orders(make_docs):
    rng = random.Random(9)
    pool = "the of and to in".split()
    docs = make_docs([(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(4, 40)))) for i in range(300)])
    same(docs)


def test_odd_documents(odd, make_docs):
    same(odd)
    assert same(make_docs([])) == 0
    same(make_docs([(i % 7, x) for i, x in enumerate(["a b c d e", "", None, "b", "B ", "a b c d e"] * 20)]))


def test_crowd_is_joined_by_few_pairs(spark, make_docs):
    """Near copies of one text are held against it, not against each other."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))] + [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i in range(1, 400) for k in [rng.randrange(200)]]
    docs = make_docs(rows)
    links = ngram_join.linked(ngram_join.id_and_text(docs), 4, 85)
    assert links.count() < 4 * len(rows)
    assert {r.component_id for r in ngram_join.ngram_groups(docs).collect()} == {0}
