"""Substring dedup, line dedup and SimHash near-dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lumivox.llm import common, edit, fingerprints, line_dedup, near_dedup, substring_dedup
from lumivox.llm.common import components, table


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


def removed_words(rows, window):
    first = {}
    docs = {i: t.encode().split() for i, t in sorted(r for r in rows if r[0] is not None)}
    for i, words in docs.items():
        for s in range(len(words) - window + 1):
            first.setdefault(tuple(words[s : s + window]), (i, s))
    out = {}
    for i, words in docs.items():
        gone = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] != (i, s):
                gone.update(range(s, s + window))
        out[i] = (len(words), len(gone), hashlib.sha256(b" ".join(w for n, w in enumerate(words) if n not in gone)).hexdigest())
    return out


@pytest.mark.parametrize(("window", "batch"), [(2, 1 << 20), (3, 60), (5, 1 << 20), (5, 60), (20, 60)])
def test_substring_dedup(make_docs, monkeypatch, window, batch):
    rng = random.Random(window)
    passages = [" ".join(rng.choice("abcdefghij") for _ in range(window + 6)) for _ in range(4)]
    rows = []
    for i in range(60):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(9)) for _ in range(rng.randrange(0, 30))]
        words.insert(rng.randrange(len(words) + 1), rng.choice(passages))
        rows.append((rng.randrange(500) * 2, rng.choice(["\n", " ", "\t"]).join(words)))
    rows = list({i: t for i, t in rows}.items()) + [(1, "x " * 60), (3, None), (5, ""), (7, passages[0])]
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", batch)
    found = {r.doc_id: tuple(r)[1:] for r in substring_dedup.remove_repeats(make_docs(rows), window).collect()}
    assert found == removed_words([(i, t or "") for i, t in rows], window)


def test_substring_dedup_of_odd_rows(odd):
    found = substring_dedup.remove_repeats(odd, keep_text=True).collect()
    want = removed_words(rows_of(odd), 20)
    assert len(found) == len(rows_of(odd))
    for r in found:
        assert sha(r.kept_text) == r.kept_sha256
        if r.doc_id is None:
            assert (r.n_words, r.n_removed) == (2, 0)
        else:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]


def test_substring_dedup_of_nothing(make_docs):
    assert substring_dedup.remove_repeats(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(make_docs([]), 1)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=20), st.binary(max_size=20))
def test_edit_distance(a, b):
    assert edit.edit_distance(a, b) == levenshtein(a, b)
    assert edit.similar(a, b, 0.8) == (levenshtein(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))


def test_many_pairs_at_once(monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    xs, ys = [], []
    for n in range(240):
        line = [rng.choice(words) for _ in range(rng.choice([0, 1, 12, 40, 90]))]
        other = [w for w in line if rng.random() > 0.1] + [rng.choice(words) for _ in range(n % 5)]
        xs.append(" ".join(line).encode())
        ys.append(" ".join(other).encode())
    want = [levenshtein(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9) for a, b in zip(xs, ys)]
    for few in (0, 1000):
        monkeypatch.setattr(edit, "FEW", few)
        assert edit.similar_pairs(xs, ys, 0.8).tolist() == want
    assert 40 < sum(want) < 200


def test_few_long_pairs_at_once(monkeypatch):
    """A dozen pairs of 3,000 letters are compared together, and not pair by pair."""
    rng = random.Random(12)
    xs, ys = [], []
    for n in range(12):
        line = bytearray(rng.choice(b"abcdefgh") for _ in range(3000 + n))
        xs.append(bytes(line))
        for at in rng.sample(range(1, 2900), 250 + 40 * n):
            line[at : at + 1] = rng.choice([b"", b"x", b"yz"])
        ys.append(b"x" + bytes(line) + b"x")
    want = [edit.edit_distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9) for a, b in zip(xs, ys)]
    assert 3 < sum(want) < 10

    def alone(*_):
        raise AssertionError("a pair by itself")

    monkeypatch.setattr(edit, "edit_distance", alone)
    assert edit.similar_pairs(xs, ys, 0.8).tolist() == edit.similar_pairs(xs, ys, 0.8, walk=False).tolist() == want


@pytest.mark.parametrize("window", [1, 7, 512])
def test_edit_distance_in_a_band(monkeypatch, window):
    monkeypatch.setattr(edit, "WINDOW", window)
    rng = random.Random(window)
    for _ in range(60):
        a = [rng.choice("abc") for _ in range(rng.randrange(1, 60))]
        b = list(a)
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(3)] = rng.choice(["", "a", "xy"])
        a, b = "".join(a), "".join(b)
        want = levenshtein(a, b)
        assert edit.edit_distance(a, b) == want
        for most in range(want + 3):
            found = edit.edit_distance(a, b, most)
            assert found == want if most >= want else found > most


@pytest.mark.parametrize("links", [10, 200_000])
def test_components_by_rounds_and_at_once(spark, monkeypatch, links):
    monkeypatch.setattr(common, "LINKS", links)
    rng = random.Random(3)
    pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(n, n + 1) for n in range(200, 240)]
    group = roots(241, pairs)
    want = [min(m for m in range(241) if group[m] == group[n]) for n in range(241)]
    found = {r.node: r.root for r in common.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert found == {n: want[n] for a, b in pairs if a != b for n in (a, b)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc ", max_size=12), min_size=2, max_size=2))
def test_similar_words(pair):
    a, b = (" ".join(x.split()).encode() for x in pair)
    assert edit.similar(a, b, 0.6) == (levenshtein(a, b) <= int(0.4 * max(len(a), len(b)) + 1e-9))


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=1, max_size=10), st.text("ab", max_size=16))
def test_banded_find(pattern, text):
    p, t = pattern.encode(), text.encode()
    best = min(levenshtein(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
    cost, start, end = edit.banded_find(p, t, -len(p), len(t), len(p))
    assert cost == best == levenshtein(p, t[start:end])


def bands_of(forms):
    hashes, lengths, counts = line_dedup.word_hashes(forms)
    return line_dedup.word_bands(hashes, lengths, counts).astype(np.uint64)


def compared(bands, n, least=0.8):
    """Earlier lines that share a key with line n, of lengths and sketches that allow the similarity."""
    rows = np.arange(n)
    sketch, lengths = bands[:, 16] << np.uint64(32) | bands[:, 17], bands[:, 18].astype(int)
    apart = np.abs(lengths[rows] - lengths[n]) <= ((1 - least) * np.maximum(lengths[rows], lengths[n]) + 1e-9).astype(int)
    return rows[(bands[rows, :16] == bands[n, :16]).any(1) & apart & (np.bitwise_count(sketch[rows] ^ sketch[n]) <= line_dedup.SKETCH_BITS)].tolist()


def brute_lines(rows, least):
    first = {}
    for i, text in sorted(r for r in rows if r[0] is not None):
        for n, form in enumerate(line_dedup.normal_lines(text)):
            if form.strip():
                first.setdefault(b" ".join(form.split()), (i, n))
    forms = list(first)
    bands = bands_of(forms)
    links = [(a, b) for b in range(len(forms)) for a in compared(bands, b) if edit.edit_distance(forms[a], forms[b]) <= int((1 - least) * max(len(forms[a]), len(forms[b])) + 1e-9)]
    group = roots(len(forms), links)
    best = {}
    for n, f in enumerate(forms):
        best[group[n]] = min(best.get(group[n], first[f]), first[f])
    stay, out = set(best.values()), {}
    for i, text in rows:
        own = text.split("\n")
        kept = [x for n, (x, form) in enumerate(zip(own, line_dedup.normal_lines(text))) if i is None or not form.strip() or (i, n) in stay]
        out[i] = (len(own) if text else 0, len(own) - len(kept), sha("\n".join(kept)))
    return out, links


def varied_lines():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    lines = [[rng.choice(words) for _ in range(40)] for _ in range(6)] + [["Wher."] * 30]
    rows = []
    for i in range(120):
        own = []
        for _ in range(rng.randrange(0, 4)):
            line = list(rng.choice(lines))
            for _ in range(rng.randrange(0, 3)):
                at = rng.randrange(len(line))
                line[at : at + 1] = rng.choice([[], [rng.choice(words)], [line[at].upper() + "!"], [line[at], line[at]]])
            own.append(" ".join(line))
        rows.append((i, "\n".join(own + ["", f"alone {rng.choice(words)} {rng.choice(words)}", "- - -"])))
    return rows


def test_line_dedup(make_docs):
    rows = varied_lines()
    want, links = brute_lines(rows, 0.8)
    assert len(links) > 50
    found = {r.doc_id: tuple(r)[1:] for r in line_dedup.dedup_lines(make_docs(rows)).collect()}
    assert found == want
    left = line_dedup.without_repeated_lines(make_docs(rows))
    assert left.columns == make_docs([]).columns
    assert {r.doc_id: sha(r.text) for r in left.collect()} == {i: w[2] for i, w in want.items()}


def test_line_dedup_of_odd_rows(odd, make_docs):
    want = brute_lines(rows_of(odd), 0.8)[0]
    found = line_dedup.dedup_lines(odd).collect()
    assert len(found) == len(rows_of(odd))
    assert all(tuple(r)[1:] == want[r.doc_id] for r in found)
    texts = [r.text for r in line_dedup.without_repeated_lines(odd).where("doc_id = 0").collect()]
    assert texts == [None]
    assert line_dedup.dedup_lines(make_docs([])).count() == line_dedup.without_repeated_lines(make_docs([])).count() == 0


def test_line_dedup_by_edit_similarity_alone(make_docs):
    """Lines of 5 to 60 words with a tenth of them replaced: brute force has no filter before the edit similarity."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 8)))
    forms, rows = [], []
    for i in range(100):
        line = [word() for _ in range((6, 10, 20, 40, 60)[i % 5])]
        for copy in range(2):
            if copy:
                for at in rng.sample(range(len(line)), max(1, len(line) // 10)):
                    line[at] = word()
            forms.append(" ".join(line).encode())
            rows.append((2 * i + copy, forms[-1].decode()))
    links = [(a, b) for b in range(len(forms)) for a in range(b) if edit.similar(forms[a], forms[b], 0.8)]
    assert len(links) >= 90
    gone = {r.doc_id for r in line_dedup.dedup_lines(make_docs(rows)).collect() if r.n_removed}
    assert gone <= {b for _, b in links} and len(gone) >= 0.95 * len(links)


def crowd(kind, n):
    """Distinct lines that are alike in their words only: one order of twelve words each, or a table's rows."""
    rng = random.Random(n)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12)]
    if kind == "orders":
        lines = {" ".join(rng.sample(words, 12)) for _ in range(n)}
    else:
        lines = {f"0 0 0 {''.join(rng.choice('abcdefghijklmnop') for _ in range(9))}" for _ in range(n)}
    return list(enumerate(sorted(lines)))


@pytest.mark.parametrize(("kind", "cell"), [("orders", 2000), ("orders", 50), ("table", 2000)])
def test_line_dedup_of_crowds(make_docs, monkeypatch, kind, cell):
    monkeypatch.setattr(line_dedup, "CELL_LINES", cell)
    rows = crowd(kind, 300)
    found = {r.doc_id: tuple(r)[1:] for r in line_dedup.dedup_lines(make_docs(rows)).collect()}
    assert found == brute_lines(rows, 0.8)[0]


@pytest.mark.parametrize("kind", ["orders", "table"])
def test_what_crowds_of_lines_send_grows_with_their_number(make_docs, kind):
    for n in (250, 1000):
        lines = line_dedup.lines_of(make_docs(crowd(kind, n)).select("doc_id", "text"))
        assert line_dedup.nearest(lines, 4, 0.8).count() <= 32 * n
        assert line_dedup.crossing(lines.selectExpr("bands", "key", "key AS root"), 4, 0.8).count() <= 16 * n


def thue_morse(letters):
    order = [0]
    for _ in range(10):
        order += [1 - x for x in order]
    return "".join(letters[x] for x in order)


def test_words_of_special_orders_of_letters_differ(make_docs):
    middle = [thue_morse("ab"), thue_morse("ba")]
    rows = [(i, " ".join([f"w{n}" for n in range(15)] + [w] + [f"v{n}" for n in range(15)])) for i, w in enumerate(middle)]
    assert [r.n_removed for r in substring_dedup.remove_repeats(make_docs(rows)).collect()] == [0, 0]
    assert [r.n_removed for r in line_dedup.dedup_lines(make_docs(list(enumerate(middle)))).collect()] == [0, 0]


def test_word_hashes_of_long_texts_and_words(monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 5, 70]))).encode() for _ in range(3000)] + [b"z" * 5000, b"z" * 5001, b"y" * 9000]
    rng.shuffle(words)
    alone = [int(substring_dedup.hashed(w)[0][0]) for w in words]
    assert len(set(alone)) == len(set(words))
    for size in (64, 1000, 1 << 20):
        monkeypatch.setattr(substring_dedup, "HASH_BYTES", size)
        hashes, lengths, counts = substring_dedup.word_hashes([b"\t".join(words), b"", b" x  y ", b" ".join(words[:9])])
        assert hashes[: len(words)].tolist() == alone and lengths[: len(words)].tolist() == list(map(len, words))
        assert counts.tolist() == [len(words), 0, 2, 9]


def test_repeated_ids_with_other_texts(make_docs):
    line = [" ".join(f"{c}{n}" for n in range(25)) for c in "abc"]
    docs = make_docs([(1, line[0]), (2, f"{line[1]}\n{line[0]}"), (2, f"{line[0]}\n{line[2]}"), (3, line[2])])
    found = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect())
    assert found == [(1, 25, 0), (2, 50, 25), (2, 50, 25), (3, 25, 25)]  # only what has been there before goes
    found = sorted((r.doc_id, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs).collect())
    assert found == [(1, 1, 0), (2, 2, 1), (2, 2, 1), (3, 1, 1)]


def test_normal_texts_split_each_document_once(spark, make_docs, monkeypatch, tmp_path):
    split, seen = line_dedup.normal_lines, str(tmp_path / "seen")

    def noted(text):
        with open(seen, "a") as out:
            out.write("x")
        return split(text)

    monkeypatch.setattr(line_dedup, "normal_lines", noted)
    docs = make_docs([(1, "\n".join(f"Line {chr(97 + n)}" for n in range(20))), (2, "other")]).select("doc_id", "text")
    forms = [f"line {chr(97 + n)}".encode() for n in range(20)]
    hashes, _, counts = line_dedup.word_hashes(forms)
    keys = line_dedup.line_keys(hashes, counts).view(np.int64).tolist()
    places = spark.createDataFrame([(keys[n], 1, n) for n in range(0, 20, 2)] + [(keys[1], 1, 3), (keys[5], 1, 99)], "key long, doc_id long, line int")
    found = line_dedup.normal_texts(docs, places).collect()
    assert {r.key: bytes(r.form) for r in found} == {keys[n]: forms[n] for n in range(0, 20, 2)}  # other lines than the key's don't count
    with open(seen) as notes:
        assert len(notes.read()) == 1


def brute_fingerprint(text, width):
    words = text.encode().translate(fingerprints.LOWER).split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_of_odd_texts(odd):
    for _, text in rows_of(odd):
        assert fingerprints.fingerprint(text, 3) == brute_fingerprint(text, 3)


def test_majorities_in_groups():
    rng = np.random.default_rng(3)
    counts = np.array([0, 1, 2, 255, 256, 1000, 0, 3])
    hashes = rng.integers(0, 1 << 64, counts.sum(), dtype=np.uint64)
    ends = np.cumsum(counts)
    want = [fingerprints.majority_bits(hashes[e - n : e]) if n else 0 for e, n in zip(ends, counts)]
    assert fingerprints.majorities(hashes, counts).tolist() == want


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_close_pairs(spark, most):
    rng = random.Random(most)
    values = {rng.getrandbits(64) for _ in range(50)}
    for v in list(values):
        for _ in range(4):
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                v ^= 1 << b
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = {tuple(r) for r in near_dedup.close_pairs(spark.createDataFrame([(v,) for v in signed], "fp long"), most).collect()}
    assert found == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= most}


def test_components(spark):
    rng = random.Random(0)
    links = [(n, n + 1) for n in range(100, 140)] + [(200, 200 + n) for n in range(1, 30)] + [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(120)] + [(7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    group = roots(600, links)
    least = {}
    for n in range(600):
        least[group[n]] = min(least.get(group[n], n), n)
    assert found == {n: least[group[n]] for n in {x for a, b in links if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute_near(rows, width, most):
    fps = [brute_fingerprint(t, width) for _, t in rows]
    group = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= most])
    least = {}
    for n, (i, _) in enumerate(rows):
        least[group[n]] = min(least.get(group[n], i), i, key=lambda x: (x is None, x or 0))
    return sorted(((i if i is not None else -1), f"{f:016x}", least[g] if least[g] is not None else -1) for (i, _), f, g in zip(rows, fps, group))


def test_near_duplicates_of_odd_rows(odd, make_docs):
    found = near_dedup.near_duplicates(odd).collect()
    known = lambda x: -1 if x is None else x
    assert sorted((known(r.doc_id), r.fingerprint, known(r.component_id)) for r in found) == brute_near(rows_of(odd), 3, 3)
    assert near_dedup.near_duplicates(make_docs([])).count() == near_dedup.one_of_each(make_docs([])).count() == 0
    left = near_dedup.one_of_each(odd)
    assert left.columns == odd.columns
    assert None in [r.doc_id for r in left.collect()]


def test_near_duplicates_of_documents(spark, data):
    docs = table(spark, data, "documents")
    found = sorted(tuple(r) for r in near_dedup.op10_simhash_near_dedup(spark, data).collect())
    assert found == brute_near(rows_of(docs), 3, 3)
    stay = {i for i, _, c in found if i == c}
    assert {r.doc_id for r in near_dedup.one_of_each(docs).collect()} == stay


def test_substring_query_matches_sql(spark, data, duck, same_rows):
    found = substring_dedup.op1_substring_dedup(spark, data).toPandas()
    same_rows(found, duck.execute(substring_dedup.ORACLE_SQL).df())
