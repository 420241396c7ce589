import pytest

#: Names that operators use for columns of their own.
CLASHES = ("key", "sim", "fp", "root", "lines", "ranges", "score", "shard", "slot", "bucket", "part", "ids", "line", "at", "n")
#: Texts that are awkward somewhere: nothing, spaces only, unusual spaces and letters, marks of tokenizers, long ones.
ODD_TEXTS = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a b c", "x\x0by\x0cz\x1fw", "▁x y▁z ▁▁", "<s> </s> <unk> <0x41>", "<|endoftext|> a <|endoftext|>",
    "日本語 テスト  🙂🙂 x", "it's John's 'quote' x'", "Naïve ÜNÏ, çà; où?", "1a2 b3.,; c,.d 12,345", "\x00a \x00", "same words here " * 300, "Many\nlines\n\nof\ntext", "word " * 20000,
]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text) rows, with further columns whose names clash."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * len(CLASHES)) for i, t in rows], schema)

    return make


@pytest.fixture(scope="session")
def odd(make_docs):
    rows = list(enumerate(ODD_TEXTS)) + [(5, "a"), (None, "no id"), (100, "a"), (101, "same words here " * 300)]
    return make_docs(rows)
