"""Every operator on texts of megabytes, with spaces and without any."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lumivox.llm import decontaminate, fingerprints, line_dedup, manifest, near_dedup, ngram_join, pieces, quality, sharding, substring_dedup, token_files

PASSAGE = "a passage of a benchmark that nobody should learn from, whatever it says"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    prose = " ".join(rng.choice(words) for _ in range(300_000))
    return {1: f"{prose} {PASSAGE} end", 2: "x" * 1_200_000, 3: "".join(rng.choices("abcXYZ0189+/", k=400_000)), 4: "日本語" * 150_000, 5: "-" * 300_000, 6: "short"}


@pytest.fixture(scope="module")
def long_docs(make_docs, texts):
    return make_docs(list(texts.items()))


def test_words_and_lines(long_docs, texts):
    for r in substring_dedup.remove_repeats(long_docs).collect():
        assert (r.n_words, r.n_removed) == (len(texts[r.doc_id].split()), 0)
    for r in line_dedup.dedup_lines(long_docs).collect():
        assert (r.n_lines, r.n_removed) == (1, 0) and r.kept_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_quality(spark, long_docs, texts):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.classify(long_docs, labels).collect())
    net = quality.Network(3)
    for size in (quality.SLICE_BYTES, 3 * quality.SLICE_BYTES + 100, 2 * quality.SLICE_BYTES - quality.STEP):
        text = texts[1].encode()[:size]
        assert abs(net.of_long(text) - net.forward(quality.Layout.of([text]))[0][0]) < 1e-3


def test_tokens(long_docs, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    want = {i: library.encode(t) for i, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in pieces.count_tokens(long_docs, pieces.model_bytes()).collect()} == {i: len(x) for i, x in want.items()}
    found = {r.doc_id: r.ids_sha256 for r in pieces.encode_and_decode(long_docs, pieces.model_bytes()).collect()}
    assert found == {i: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for i, x in want.items()}


def test_orc_tokens(long_docs, texts, tmp_path):
    library = Tokenizer.from_file(public_tokenizers.path(token_files.MODEL))
    found = token_files.tokens_through_orc(long_docs, token_files.model_text(), str(tmp_path / "ids")).collect()
    for r in found:
        ids = np.array([*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    assert len(found) == len(texts)


def test_shards_and_fingerprints(long_docs, texts):
    assert {r.doc_id: r.size for r in sharding.assign_shards(long_docs).collect()} == {i: len(t.encode()) + 16 for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in near_dedup.near_duplicates(long_docs).collect()} == {i: f"{fingerprints.fingerprint(t, 3):016x}" for i, t in texts.items()}


def test_manifest_and_ngrams(long_docs, texts):
    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    leaves = {i: hashlib.sha256("".join(field(x) for x in (i, "s", "en", len(t), t)).encode()).hexdigest() for i, t in texts.items()}
    assert {r.doc_id: r.leaf for r in manifest.manifest(long_docs).collect()} == leaves
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_groups(long_docs.union(long_docs.selectExpr("doc_id + 100", *(f"`{c}`" for c in long_docs.columns[1:])))).collect()}
    for i, t in texts.items():
        words = t.split()
        assert found[i] == found[i + 100] == (len({tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))}), i)


def test_leaks(spark, long_docs):
    benchmark = spark.createDataFrame([(1, PASSAGE), (2, "-" * 200)], "item_id long, text string")
    found = decontaminate.leaks(long_docs, benchmark)
    assert sorted((r.doc_id, r.item_id, r.least_edits) for r in found.collect()) == [(1, 1, 0), (5, 2, 0)]
    assert sorted(r.doc_id for r in decontaminate.clean(long_docs, benchmark).collect()) == [2, 3, 4, 6]
