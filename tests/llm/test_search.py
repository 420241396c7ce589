"""Neighbours, decontamination and the quality classifier."""

import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from lumivox.llm import decontaminate, edit, neighbours, quality
from lumivox.llm.common import table


def brute_nearest(rows, k, every):
    rows = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q, v in rows.items():
        if q % every == 0:
            scored = sorted((-float(v @ w), i) for i, w in rows.items() if i != q)[:k]
            out[q] = [i for _, i in scored]
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, cell string")


def test_recall_on_embeddings(spark, data):
    rows = [(r.vec_id, r.embedding) for r in table(spark, data, "embeddings").collect()]
    want = brute_nearest(rows, 20, 20)
    found = {}
    for r in sorted(neighbours.op5_projected_neighbours(spark, data).collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == set(want)
    assert all([r["rank"] for r in own] == list(range(1, 21)) for own in found.values())
    hits = sum(len({r.vec_id for r in found[q]} & set(want[q])) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    by_id = {i: np.array(v, float) for i, v in rows}
    assert all(abs(r.score - float(by_id[q] @ by_id[r.vec_id])) < 1e-12 for q in found for r in found[q])


def test_cells_buckets_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 64)
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", 16)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 10)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16)) * 3
    points = centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, 16)) * rng.uniform(0.1, 1)
    points = points.astype(np.float32)
    points[:200] = points[0]  # a third of all rows is one vector: a hot cell, and ties
    rows = [(i, v.tolist()) for i, v in enumerate(points)]
    want = brute_nearest(rows, 5, 20)
    found = {}
    for r in sorted(neighbours.nearest(vectors(spark, [(*r, "x", "x") for r in rows]), 5).collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert sum(len(set(found[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)
    assert found[0] == want[0]  # ties go to the smaller ids


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (None, [1.0, 1.0]), (7, [1.0]), (1, [0.5, 0.5]), (20, [2.0, 0.0])]
    found = {(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(vectors(spark, [(*r, "x", "x") for r in rows])).collect()}
    assert found == {(0, 1, 20, 2.0), (0, 2, 1, 0.5), (20, 1, 0, 2.0), (20, 2, 1, 1.0)}
    assert neighbours.nearest(vectors(spark, [])).count() == neighbours.nearest(vectors(spark, [(1, None, "x", "x")])).count() == 0


@pytest.mark.parametrize("dims", [2, 8, 16])
def test_chi_square_quantile(dims):
    sums = (np.random.default_rng(0).normal(size=(200_000, dims)) ** 2).sum(1)
    assert abs((sums <= neighbours.chi_square_quantile(0.9, dims)).mean() - 0.9) < 0.005


def brute_leaks(docs, items):
    found = set()
    for i, text in docs:
        whole = decontaminate.normal(text)
        for item, passage in items:
            form = decontaminate.normal(passage)
            if len(form) < decontaminate.Q:
                continue
            last = max(0, len(form) - 64)
            for at in {*range(0, last, 32), last}:
                piece = form[at : at + 64]
                most = min(int(len(piece) * 0.1 + 1e-9), (len(piece) - 8) // 8)
                if edit.banded_find(piece, whole, -len(piece), len(whole), most):
                    found.add((i, item))
                    break
    return found


def corpus():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(150)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(n, text(rng.randrange(3, 40))) for n in range(12)] + [(90, None), (91, ""), (92, "abc"), (93, "short one")]
    docs = []
    for i in range(60):
        body = text(rng.randrange(0, 60))
        if i % 2:
            passage = list(rng.choice(items[:12])[1])
            for _ in range(rng.randrange(0, len(passage) // 6)):
                at = rng.randrange(len(passage))
                passage[at : at + 1] = rng.choice([[], ["x"], [passage[at], "y"], [passage[at].upper()], [" \n "] if passage[at] == " " else [passage[at]]])
            body = f"{body}\n{''.join(passage)} {text(rng.randrange(0, 20))}"
        docs.append((i, body))
    return docs + [(100, None), (101, ""), (102, "short one"), (103, "a short  ONE here")], items


@pytest.mark.parametrize("block_bytes", [1 << 22, 200])
def test_leaks(spark, make_docs, block_bytes):
    docs, items = corpus()
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items] + [(None, "no id at all here", "x")], "item_id long, text string, doc_id string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(make_docs(docs), benchmark, block_bytes).collect()}
    want = brute_leaks(docs, items)
    assert found == want and len(want) > 15 and (102, 93) in want
    left = decontaminate.clean(make_docs(docs), benchmark, block_bytes)
    assert left.columns == make_docs([]).columns
    assert {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_leaks_of_nothing(spark, make_docs, odd):
    nothing = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a passage that is long enough to be found")], "item_id long, text string")
    assert decontaminate.leaks(odd, nothing).count() == decontaminate.leaks(make_docs([]), some).count() == decontaminate.leaks(odd, some).count() == 0
    assert decontaminate.clean(odd, nothing).count() == odd.count()


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    found = [r for r in quality.op2_quality(spark, sf_dir).collect()]
    assert len(found) == table(spark, sf_dir, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    own = [(r.predicted, labels[r.doc_id], r.score) for r in found if r.held_out and r.doc_id in labels]
    assert sum(p == q for p, q, _ in own) >= 0.9 * len(own)
    assert sum(p for p, q, _ in own if q == 1) >= 0.98 * sum(q for _, q, _ in own)


def test_gradients():
    rng = np.random.default_rng(0)
    net = quality.Network(1)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    layout = quality.Layout.of([bytes(rng.integers(1, 256, n).tolist()) for n in (0, 3, 700, 1500)])
    slope = rng.normal(size=4)
    loss = lambda: float(net.forward(layout)[0] @ slope)
    grads = net.gradients(layout, net.forward(layout)[1], slope)
    for name, value in net.params.items():
        for at in rng.integers(0, value.size, 12):
            place = np.unravel_index(at, value.shape)
            old = value[place]
            value[place] = old + 1e-5
            high = loss()
            value[place] = old - 1e-5
            low = loss()
            value[place] = old
            assert abs((high - low) / 2e-5 - grads[name][place]) < 2e-3, name


def plain_score(net, text):
    """The network read off its definition: windows of eight bytes, chunks that overlap by half, largest values and means."""
    p = {k: v.astype(float) for k, v in net.params.items()}
    halves = -(-(len(text) + 4) // 256)
    padded = text.ljust(halves * 256, b"\0")
    best = []
    for h in range(halves):
        most = np.zeros(quality.FILTERS)
        for at in range(h * 256, h * 256 + 256, 4):
            if at + 8 <= len(padded):
                window = np.concatenate([p["embed"][b] for b in padded[at : at + 8]])
                most = np.maximum(most, window @ p["filters"] + p["bias"])
        best.append(most)
    chunks = [np.maximum(a, b) for a, b in zip(best, best[1:])] + [best[-1]]
    features = np.concatenate([np.max(chunks, axis=0), np.mean(chunks, axis=0)])
    return 1 / (1 + np.exp(-(features @ p["out"] + p["shift"][0])))


def test_scores_as_defined():
    rng = np.random.default_rng(7)
    net = quality.Network(4)
    texts = [bytes(rng.integers(0, 256, n).tolist()) for n in (0, 1, 251, 252, 253, 256, 700, 2000)]
    assert np.allclose(net.scores(texts), [plain_score(net, t) for t in texts], atol=1e-4)


def test_long_texts_teach(spark, make_docs):
    """All labelled texts are longer than what is learnt from each; what differs lies anywhere in them."""
    rng = np.random.default_rng(5)
    kinds = [["plain words that make a sentence."], ["@@##", "0x00", "%%%%", "!!"]]
    rows = [(i, " ".join(rng.choice(kinds[i % 2], 9000 if i % 2 == 0 else 20000))) for i in range(40)]
    assert all(len(t) > quality.SAMPLE_LETTERS for _, t in rows)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int")
    found = {r.doc_id: r.score for r in quality.score(make_docs([(i, t[:900]) for i, t in rows]), quality.learn(make_docs(rows), labels)).collect()}
    assert min(v for i, v in found.items() if i % 2 == 0) > max(v for i, v in found.items() if i % 2)
    parts = make_docs([(1, "abcdefghij" * 10)]).select(quality.excerpt(F.col("text"), 16).alias("t")).first().t.split(" ")
    assert len(parts) == quality.PIECES and parts[0] == "ab" and parts[-1] == "ij"


def test_quality_of_odd_rows(spark, odd, make_docs):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(30)] + [(None, 1, "x"), (3, None, "x"), (4, 7, "x")], "doc_id long, quality int, text string")
    found = quality.classify(odd, labels).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    again = {(r.doc_id, r.score) for r in quality.classify(odd, labels).collect()}
    assert again == {(r.doc_id, r.score) for r in found}
    for some in (labels.where("doc_id < 0"), labels.where("quality = 1")):
        assert len({r.score for r in quality.classify(odd, some).collect()}) == 1
    left = quality.accepted(odd, labels)
    assert left.columns == odd.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in found if r.predicted)
    assert quality.classify(make_docs([]), labels).count() == quality.accepted(make_docs([]), labels).count() == 0


def test_layout_does_not_let_texts_touch():
    net = quality.Network(2)
    texts = [b"", b"abc" * 200, b"x" * 255, b"y" * 256, b"z" * 5000]
    together = net.scores(texts)
    assert np.allclose(together, [net.scores([t])[0] for t in texts])
