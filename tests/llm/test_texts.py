"""Token counts, SentencePiece, ORC token files and shards on whole and odd texts."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumivox.llm import pieces, sharding, token_files
from lumivox.llm.common import table

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
MODEL = pieces.model_bytes()


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" ▁ab\n.")), max_size=60))
def test_units_encode_as_the_library_does(text):
    merge = pieces.vocabulary(MODEL).merge
    assert [i for u in pieces.units_of(text) for i in merge(u)] == LIBRARY.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" ab\n.,'s1é")), max_size=60))
def test_orc_units_encode_as_the_library_does(text):
    encoder = token_files.encoder(token_files.model_text())
    texts = [text, "a b", f"a{text}", f"{text} b", ""]
    want = [[*encoder.library.encode(x, add_special_tokens=False).ids, 0] for x in texts]
    assert encoder.encode(pa.array(texts), 0).to_pylist() == want


def test_whole_tokens_are_one_token():
    found = pieces.vocabulary(MODEL).whole_tokens()
    assert len(found) > 10_000
    assert all(len(LIBRARY.encode(x)) == 1 for x in list(found)[:2000])


def test_agenda_differs_from_a_wrong_order():
    # pairs merge by score, not from the left
    assert pieces.vocabulary(MODEL).merge("ationthe") == LIBRARY.encode("ationthe")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aeinorst日本ü🙂\x00"), st.characters(exclude_categories=["Cs", "Z"])), min_size=1, max_size=90), min_size=1, max_size=6))
def test_units_side_by_side_and_alone(texts):
    vocabulary = pieces.vocabulary(MODEL)
    units = [x.replace(pieces.MARK, "") for x in texts]
    assert [vocabulary.alone(x) for x in units] == vocabulary.merge_all(units)


def test_token_counts(odd):
    found = sorted(tuple(r) for r in pieces.count_tokens(odd, MODEL, limit=50).collect() if r.doc_id is not None)
    want = sorted((i, len(t.encode()), len(LIBRARY.encode(t)), len(LIBRARY.encode(t)) > 50) for i, t in rows_of(odd) if i is not None)
    assert found == want


def test_encode_and_decode(odd):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    found = sorted(tuple(r) for r in pieces.encode_and_decode(odd, MODEL).collect() if r.doc_id is not None)
    want = []
    for i, t in rows_of(odd):
        ids = LIBRARY.encode(t)
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids))))
    assert found == sorted(w for w in want if w[0] is not None)


def test_kept_ids(make_docs):
    row = pieces.encode_and_decode(make_docs([(1, "and the rest")]), MODEL, keep=True).first()
    assert row.ids == LIBRARY.encode("and the rest") and row.decoded == "and the rest"


def test_empty_tables(make_docs):
    empty = make_docs([])
    assert pieces.count_tokens(empty, MODEL).count() == pieces.encode_and_decode(empty, MODEL).count() == 0
    assert sharding.assign_shards(empty).count() == token_files.tokens_through_orc(empty, token_files.model_text()).count() == 0


def test_tokens_through_orc(odd, tmp_path):
    library = Tokenizer.from_file(public_tokenizers.path(token_files.MODEL))
    rows = sorted(rows_of(odd), key=lambda r: (r[0] is not None, r[0] or 0))
    path = str(tmp_path / "tokens")
    found = token_files.tokens_through_orc(odd, token_files.model_text(), path).collect()
    codes = [[*library.encode(t, add_special_tokens=False).ids, 0] for _, t in rows]
    starts = np.cumsum([0, *map(len, codes)])[:-1]
    want = sorted((i if i is not None else -1, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for (i, _), c in zip(rows, codes))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in found) == want
    assert sorted(r.start for r in found) == starts.tolist()
    assert {r.doc_id: r.start for r in found}[2] == starts[[i for i, _ in rows].index(2)]


def test_orc_files_are_ordered_and_indexed(spark, data, tmp_path):
    from pyarrow import orc

    path = str(tmp_path / "tokens")
    token_files.write_tokens(table(spark, data, "documents"), path, token_files.model_text())
    last = -1
    for file in sorted(tmp_path.glob("tokens/*.orc")):
        ids = orc.ORCFile(file).read(columns=["doc_id"]).column("doc_id").to_pylist()
        assert ids == sorted(ids) and (not ids or ids[0] > last)
        last = ids[-1] if ids else last
    found = token_files.read_tokens(spark, path).where("doc_id = 7")
    assert found.count() == 1 and "doc_id" in found._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]


@pytest.mark.parametrize("shards", [1, 2, 7, 40, 41, 1000])
def test_jump_hash_moves_rows_only_into_the_new_shard(shards):
    keys = np.random.default_rng(shards).integers(0, 1 << 64, 5000, dtype=np.uint64)
    now, grown = sharding.jump_hash(keys, shards), sharding.jump_hash(keys, shards + 1)
    assert now.min() >= 0 and now.max() < shards
    assert ((grown == now) | (grown == shards)).all()
    assert abs((grown == shards).mean() - 1 / (shards + 1)) < 0.02


def test_jump_hash_as_defined():
    def plain(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
        return b

    keys = [0, 1, 2, 12345, (1 << 64) - 1]
    assert sharding.jump_hash(np.array(keys, np.uint64), 40).tolist() == [plain(k, 40) for k in keys]


def mix(value, seed):
    """XXH64 of a long of eight bytes, as Spark's xxhash64 has it."""
    return xxhash.xxh64_intdigest(value.to_bytes(8, "little", signed=True), seed)


def test_whole_result_of_shards(make_docs):
    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
        return b

    rows = [(i * 7 - 50, "t" * (i % 13)) for i in range(500)]
    found = sharding.assign_shards(make_docs(rows)).collect()
    want = {i: (len(t) + 16, zlib.crc32(t.encode()), "key", jump(mix(i, 42), 40), jump(mix(i, 42), 41)) for i, t in rows}
    assert {r.doc_id: (r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in found} == want
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


@pytest.mark.parametrize("run_rows", [1, 100_000])
def test_shards(odd, run_rows):
    found = sharding.assign_shards(odd, 3, run_rows).toPandas()
    rows = rows_of(odd)
    assert sorted(zip(found["size"], found.text_crc32)) == sorted((len(t.encode()) + 16, zlib.crc32(t.encode())) for _, t in rows)
    for _, slots in found.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    assert ((found.grown_shard == found.shard) | (found.grown_shard == 3)).all()
    assert set(found.law) == {"key"} and found.groupby("doc_id").shard.nunique().max() == 1


def test_starts_are_the_places_in_the_files(spark, make_docs, tmp_path):
    """Rows of one doc_id with other texts: start counts the ids that lie before each in the files."""
    texts = ["a b c d e f", "x", "many more words are here than there", "some"]
    docs = make_docs([(i % 20, f"{texts[i // 20]} {i}") for i in range(80)] + [(None, "no id"), (None, "")]).repartition(4)
    path = str(tmp_path / "ids")
    found = token_files.tokens_through_orc(docs, token_files.model_text(), path).collect()
    flat = [i for r in token_files.read_tokens(spark, path).orderBy("part", "place").collect() for i in r.ids]
    assert len(found) == 82 and sum(r.n_tokens for r in found) == len(flat)
    for r in found:
        assert zlib.crc32(np.array(flat[r.start : r.start + r.n_tokens], "<u4").tobytes()) == r.ids_crc32
    assert len({r.start for r in found}) == 82


def test_files_do_not_grow_with_the_input(spark, make_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 2000)
    docs = make_docs([(i, f"words of number {i} " * 10) for i in range(200)])
    path = tmp_path / "ids"
    token_files.write_tokens(docs, str(path), token_files.model_text())
    assert len(list(path.glob("*.orc"))) >= 15
